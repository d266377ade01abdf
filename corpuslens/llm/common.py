"""What the operators share: Arrow mapping, byte views of texts, table reading."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that the vectorised operators work on at once.
SLICE_BYTES = 4 << 20


#: Rows of an Arrow batch: texts may be long, and a batch is held whole on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def release() -> None:
    """Gives memory back that the allocators of this worker hold for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more; it looks for them when the driver collects garbage.

    What a job that has just ended still holds (events on their way to listeners, for one) outlives a first collection, so there are two.
    """
    for pause in (1, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_of(df: DataFrame, most: int) -> int:
    """Into how many buckets packed values are dealt: one for each so many bytes that df reads, four for each shuffle partition at least."""
    read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = read if read < 1 << 60 else 0  # rows that aren't read from files have no size
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // most))


def strings(col: pa.Array) -> pa.Array:
    """The column as large_string without nulls (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of n + 1), without copying."""
    col = strings(col)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each (a longer text alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def map_arrow(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    fields: list[tuple[str, T.DataType]],
    drop: tuple[str, ...] = (),
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """df's columns but for drop, and fields computed batch by batch.

    fn gets each Arrow batch (with what setup made once per task, if given) and
    returns an array per field. A field replaces a column of the same name.
    """
    made = {name for name, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in made]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        args = (setup(),) if setup else ()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch, *args)
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [out[n] for n, _ in fields], names + [n for n, _ in fields])
        release()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def scrambled(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers made from a seed."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
