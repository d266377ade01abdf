"""Sinks: batch files, merged artefacts, keyed upserts.

Plain Parquet has no MERGE: an upsert writes the new table beside the old one, puts the old one aside,
gives the new one its name and only then deletes the old. If a run ends between, the old table
stands aside (``.before``), and the next upsert takes it up again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut_lineage
from ..schemas import CHUNK
from .readers import exists


def write_batches(pages: DataFrame, path: str, size: int = 50) -> None:
    """Pages in one partition for each batch of page numbers; a retry replaces its batches only."""
    batch = F.format_string("%05d", (F.floor((F.col("page_num") - 1) / size) * size + 1).cast("int"))
    pages.withColumn("batch", batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def merge_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches as one table, in order of page number."""
    return spark.read.json(path, schema="page_num INT, text STRING, batch STRING").select("page_num", "text").orderBy("page_num")


def write_pages(pages: DataFrame, path: str, force: bool = False) -> None:
    """Refuses to overwrite unless forced."""
    pages.write.mode("overwrite" if force else "errorifexists").json(path)


def write_books(books: DataFrame, path: str) -> None:
    """One JSON document with all books in order (its size is that of one artefact)."""
    ordered = F.sort_array(F.collect_list(F.struct("book_num", "title", "chapters")))
    books.agg(ordered.alias("books")).coalesce(1).write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Partitioned by chunk_type, so that a search reads one of them."""
    chunks.write.mode("overwrite").partitionBy("chunk_type").parquet(path)


def write_aliases(entities: DataFrame, path: str) -> None:
    """One JSON object keyed by id, as read_aliases takes it (a dictionary of names: one artefact)."""
    entry = F.struct("char_id", F.struct("label", "aliases").alias("r"))
    keyed = entities.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))
    keyed.coalesce(1).write.mode("overwrite").text(path)


def write_character_index(chunks: DataFrame, path: str) -> None:
    """(char_id, id): which chunks have a character; the filter's inverted table."""
    chunks.select(F.explode("characters").alias("char_id"), "id").distinct().write.mode("overwrite").parquet(path)


def upserted(old: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new put in by key; of equal keys in new, one row counts."""
    fresh = new.dropDuplicates([key])
    return fresh if old is None else old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str = "id", expected: int | None = None) -> int:
    """Upserts into the Parquet table at path (created if missing); gives the number of rows upserted.

    expected: how many rows there should be (such as vectors); another number is a ValueError.
    """
    fs, named, beside, aside = _names(spark, path)
    if fs.exists(aside) and not fs.exists(named):  # a swap was broken off
        fs.rename(aside, named)
    # counted and written from one evaluation
    fresh = cut_lineage(new.dropDuplicates([key]))
    n = fresh.count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows for {expected}")
    old = spark.read.parquet(path) if exists(spark, path) else None
    upserted(old, fresh, key).write.mode("overwrite").parquet(beside.toString())
    fs.delete(aside, True)
    if old is not None and not fs.rename(named, aside):
        raise OSError(f"could not put {path} aside")
    if not fs.rename(beside, named):
        raise OSError(f"could not swap {beside.toString()} in")
    fs.delete(aside, True)
    return n


def _names(spark: SparkSession, path: str) -> tuple:
    """The file system of a table, its place, and those beside it for what comes and what goes."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    bare = path.rstrip("/")
    fs = of(bare).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, of(bare), of(bare + ".next"), of(bare + ".before")


def ensure_table(spark: SparkSession, path: str, schema: str) -> bool:
    """Creates an empty table if there is none; whether it did."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def build_store(spark: SparkSession, folder: str, chunks: DataFrame, encode) -> dict[str, int]:
    """Encodes chunks and upserts them by type into tables of folder; chunks of each type by their number.

    Tables that are missing are created; the inverted table of characters is written anew.
    """
    schema = f"{CHUNK}, embedding ARRAY<FLOAT>"
    columns = [c.split(" ")[0] for c in CHUNK.split(", ")]
    done, stored = {}, []
    for kind in ("chapter", "paragraph"):
        path = f"{folder}/{kind}"
        ensure_table(spark, path, schema)
        rows = chunks.filter(F.col("chunk_type") == kind).select(*columns, encode(F.col("text")).cast("array<float>").alias("embedding"))
        done[kind] = upsert(spark, path, rows)
        stored.append(spark.read.parquet(path).select("id", "characters"))
    write_character_index(stored[0].unionByName(stored[1]), f"{folder}/characters")
    return done
