"""Sources: page, chapter, chunk, alias and override files, and the test tables as them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.graph import cut_lineage

#: Packs of chapter numbers are broadcast up to so many bytes. A pack has doc_ids that differ in their last bits only, so many bits that
#: packs are small enough together and have no more places than these, if there are more than the first.
MOST_BYTES, BITS, MOST_PLACES = 1 << 26, (12, 20, 28, 36, 44, 52, 60), 65_536
#: Bytes of a pack besides its places.
PACK = 150


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, in whatever store Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str | list[str], schema: str, missing_ok: bool = False) -> DataFrame | None:
    """A JSON array or document file (or several); None if it is absent and may be."""
    paths = [path] if isinstance(path, str) else path
    gone = [p for p in paths if not exists(spark, p)]
    if gone:
        if missing_ok:
            return None
        raise FileNotFoundError(gone[0])
    return spark.read.schema(schema).json(paths, multiLine=True)


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """Pages (page_num, text) of one JSON file, or of all batch files; None if absent."""
    return read_json(spark, path, schemas.PAGE, missing_ok=True)


def page_range(pages: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """Pages start to end (inclusive; None: the last). ValueError for a range out of order or bounds."""
    last = page_count(pages)
    end = last if end is None else end
    if not 1 <= start <= end <= last:
        raise ValueError(f"pages {start} to {end} of {last}")
    return pages.filter(F.col("page_num").between(start, end))


def page_count(pages: DataFrame) -> int:
    return pages.agg(F.coalesce(F.max("page_num"), F.lit(0))).first()[0]


def scan_binary(spark: SparkSession, path: str, render: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_num, text) of binary documents by an injected function (such as OCR) from bytes to page texts."""
    if not exists(spark, path):
        raise FileNotFoundError(path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(p, i, t) for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for i, t in enumerate(render(raw), 1)]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["path", "page_num", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page_num int, text string")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of a book-grouped JSON file, in its order: (book_num, book_pos, chapter_pos, ...)."""
    books = read_json(spark, path, schemas.BOOKS).select(F.posexplode("books").alias("book_pos", "b"))
    return books.select("book_pos", "b.book_num", F.posexplode("b.chapters").alias("chapter_pos", "c")).select("book_num", "book_pos", "chapter_pos", "c.*")


def read_chunks(spark: SparkSession, path: str, chunk_type: str | None = None) -> DataFrame:
    """Chunks from JSON or Parquet; a chunk_type prunes the partitions of a Parquet table."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    chunks = read_json(spark, path, schemas.CHUNK) if path.endswith(".json") else spark.read.parquet(path)
    return chunks if chunk_type is None else chunks.filter(F.col("chunk_type") == chunk_type)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(char_id, label, aliases) of a JSON object keyed by id."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", schemas.ALIASES)).alias("char_id", "r")).select("char_id", "r.label", "r.aliases")


def read_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(drops(char_id), merges(group, place, char_id)); None if absent."""
    both = read_json(spark, path, schemas.OVERRIDES, missing_ok=True)
    if both is None:
        return None
    drops = both.select(F.explode("drop").alias("char_id"))
    merges = both.select(F.posexplode("force_merge").alias("group", "g")).select("group", F.posexplode("g").alias("place", "char_id"))
    return drops, merges


def batch_ranges(n_pages: int, size: int = 50) -> list[tuple[int, int]]:
    return [(s, min(s + size - 1, n_pages)) for s in range(1, n_pages + 1, size)]


# ---- the test tables in these roles


def documents_as_chapters(docs: DataFrame) -> DataFrame:
    """Chapters: a book for each source, numbered by name; chapters by doc_id."""
    book = F.dense_rank().over(Window.orderBy("source"))
    books = docs.select("source").distinct().withColumn("book_num", book)  # one row a source
    # ids are numbered without their texts
    ids = docs.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    ids = cut_lineage(ids.select("source", "doc_id", "n", F.coalesce(before, F.lit(0)).alias("before")).join(books, "source"))
    packs, bits = _packed(ids)
    # up to a checked size, texts stay where they are read
    bytes_ = packs.agg(F.sum(PACK + _width(bits) * F.size("_at") + 32 * F.greatest(F.size("_more"), F.lit(0)))).first()[0] or 0
    same = (F.col("source") == F.col("_s")) & _pack("doc_id", bits).eqNullSafe(F.col("_p"))
    met = docs.select("doc_id", "text", "source").join(F.broadcast(packs) if bytes_ <= MOST_BYTES else packs, same)
    at = F.coalesce(F.array_position("_at", _place("doc_id", bits)).cast("int"), F.lit(1)) - 1  # a doc_id that is null has a pack of its own
    more = F.get(F.col("_more"), at)
    once = F.coalesce(more["n"], F.lit(1)) == 1
    numbered = met.filter(once).withColumn("chapter_num", (F.coalesce(more["before"], F.col("_first") + at) + 1).cast("int"))
    if not packs.filter("_more IS NOT NULL").isEmpty():
        within = F.row_number().over(Window.partitionBy("source", "doc_id").orderBy(F.xxhash64("text")))
        numbered = numbered.unionByName(met.filter(~once).withColumn("before", more["before"]).withColumn("chapter_num", (F.col("before") + within).cast("int")).drop("before"))
    return numbered.select("doc_id", "book_num", "chapter_num", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("chapter_title"), F.col("chapter_num").alias("page_start"), "text")


def _pack(doc_id: str, bits: int) -> Column:
    return F.shiftright(F.col(doc_id).cast("long"), bits)


def _width(bits: int) -> int:
    return 2 if bits < 16 else 4 if bits < 32 else 8


def _place(doc_id: str, bits: int) -> Column:
    """A doc_id's place in its pack, in as few bytes as do."""
    low = F.col(doc_id).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return low.cast({2: "smallint", 4: "int", 8: "long"}[_width(bits)])


def _packed(ids: DataFrame) -> tuple[DataFrame, int]:
    """ids(source, doc_id, n, before, book_num) as a row for doc_ids of a source that differ in their last bits only, and the number of bits.

    Columns: _s, _p, book_num, _at (places of its doc_ids, in order), _first (chapters before them), and _more (before
    and n of each) where a doc_id has several rows. Ids that lie far apart get more bits, while packs stay short enough to be looked through.
    """
    for bits in BITS:
        rows, n, longest = ids.groupBy("source", _pack("doc_id", bits)).count().agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        if bits > BITS[0] and longest > MOST_PLACES:
            bits = BITS[0]
            break
        if rows * PACK + n * _width(bits) <= MOST_BYTES:
            break
    one = F.struct(_place("doc_id", bits).alias("at"), "before", "n")
    packs = ids.groupBy("source", "book_num", _pack("doc_id", bits).alias("_p")).agg(F.sort_array(F.collect_list(one)).alias("x"))
    several = F.exists("x", lambda e: e["n"] > 1)
    packs = packs.select(F.col("source").alias("_s"), "_p", "book_num", F.transform("x", lambda e: e["at"]).alias("_at"), F.get(F.col("x"), F.lit(0))["before"].alias("_first"), F.when(several, F.transform("x", lambda e: F.struct(e["before"].alias("before"), e["n"].alias("n")))).alias("_more"))
    return cut_lineage(packs), bits


def documents_as_chunks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text", "source", "lang")


def benchmark_as_queries(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").alias("query_id"), "text")
