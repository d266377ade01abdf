"""Connected components as a fixpoint of DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there.

    The session's ``spark.checkpoint.dir`` is used; only where it is unset (tests
    on one machine) a local folder is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        import tempfile

        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")

        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, which needs no Python worker of its own."""
    return spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("s")).select("s.*")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the least node.

    Alternates large-star and small-star steps: each node's larger neighbours, then
    its smaller ones, are linked to the least node it knows. Edges only ever get
    fewer or shorter, stars appear after a logarithmic number of rounds, and no
    node's neighbours are gathered in one row.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for _ in range(most_rounds):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("s"), F.col("b").alias("n")).distinct()
        # small star: a node's smaller neighbours, and itself, go to the least of them
        lowest = large.groupBy("n").agg(F.min("s").alias("m"))
        small = large.join(lowest, "n").select(F.col("m").alias("a"), F.col("s").alias("b")).filter("a <> b").unionAll(lowest.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()
        links = cut_lineage(small)
        # a forest of stars: each leaf has one centre, and no node is both
        ends = links.select(F.col("b").alias("n"), F.lit(1).alias("leaf")).unionAll(links.select(F.col("a").alias("n"), F.lit(0).alias("leaf")))
        if ends.groupBy("n").agg(F.sum("leaf").alias("k"), F.min("leaf").alias("low")).filter("k > 1 OR (k = 1 AND low = 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
