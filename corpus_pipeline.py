"""A corpus pipeline of five operators: documents in, a mixture of documents out.

Stages take (spark, docs, sf_dir) and give a DataFrame; all but the last return the
columns of documents, whatever else these hold. run() writes each stage's result as
Parquet into the shared folder (``spark.checkpoint.dir``) and reads it again.

1. language: documents without a predicted language, or of less than MIN_SHARE of one, go.
2. near_copies: of each component of the n-gram Jaccard join, the document of least id
   stays (a null id is no one's least; of equal ids one text); documents without words are
   no one's copies. As near-duplicate stages do, it takes five words and 80 percent; the four words and
   85 percent of op9's contract bind that query only.
3. decontaminate: contaminated documents go.
4. pii: personal data in texts becomes ``<KIND>``; n_chars, if there, follows.
5. mix: each document comes as often as its rate says (copy_no from 1), with its
   likeliest domain and rate. Columns of documents called domain, rate or copy_no get ``_given`` behind
   their names.

Null texts have no language and go in stage 1. Rows that are equal in doc_id and
text are one document from stage 2 on; of rows that share an id and are near
copies of each other, one stays. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, language_id, mixing, ngram_join, pii
from corpuslens.llm.common import small_batches, table
from corpuslens.llm.queries import MIXTURE, MIXTURE_SIZE, remainder
from corpuslens.operators.graph import cut_lineage, ensure_checkpoint_dir

#: Least posterior share of the predicted language; most ids to leave out that are broadcast (8 bytes each).
MIN_SHARE, MOST_BROADCAST = 0.5, 1_000_000
#: Words of a shingle, and percent of the union that near copies share.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _aside(docs: DataFrame) -> tuple[DataFrame, str, tuple[str, ...]]:
    """docs under names that no operator uses, its text's and all names."""
    names = tuple(f"_column_{i}" for i in range(len(docs.columns)))
    return docs.toDF(*names), names[docs.columns.index("text")], names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = language_id.fit(language_id.training_sample(docs.filter(remainder(3) != 1)))
    rows, text, names = _aside(docs)
    judged = language_id.predict_language(rows, model, text, names)
    return judged.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_SHARE)).select(*names).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows, text, names = _aside(docs)
    doc_id, keys = names[docs.columns.index("doc_id")], ["_id", "_tag"]
    # a null id is above all others
    keyed = rows.withColumns({"_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)), "_tag": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    asked = keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keys)
    found = cut_lineage(ngram_join.ngram_components(asked, NEAR_WORDS, NEAR_PERCENT, keep=tuple(keys), root="_root"))
    # by the root, as a component_id may stand for several components
    worded = found.filter("n_shingles > 0").select("_root", *keys)
    chosen = worded.groupBy("_root").agg(F.min(F.struct(*keys)).alias("_one")).select("_one.*")
    gone = cut_lineage(worded.select(*keys).distinct().join(chosen, keys, "left_anti"))
    few = gone.count() <= MOST_BROADCAST
    out = keyed.join(F.broadcast(gone) if few else gone, keys, "left_anti")
    # rows given twice
    again = found.groupBy(*keys).count().filter("count > 1").join(gone, keys, "left_anti").select(*keys)
    if not again.isEmpty():
        out = out.dropDuplicates(keys)
    return out.select(*names).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    rows, text, names = _aside(docs)
    judged = decontaminate.decontaminate(rows, bench, text=text, keep=names)
    return judged.filter(~F.col("contaminated")).select(*names).toDF(*docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, text, names = _aside(docs)
    found = pii.find_pii(rows, text, names)
    clean = F.when(F.size("spans") > 0, pii.redact(F.col(text), F.col("spans"))).otherwise(F.col(text))
    out = found.withColumn(text, clean).select(*names).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    rows, text, names = _aside(docs)
    rows = rows.withColumn("doc_id", F.col(names[docs.columns.index("doc_id")]))
    mixed = mixing.mix(rows, labels, ["quality", "toxic"], MIXTURE, MIXTURE_SIZE, text=text, keep=names)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    given = [F.col(n).alias(f"{c}_given" if c in ("domain", "rate", "copy_no") else c) for n, c in zip(names, docs.columns, strict=True)]
    return mixed.filter("copies > 0").select(*given, "domain", "rate", times.alias("copy_no"))


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminated), ("pii", without_pii), ("mix", mixture)]

#: Learned models can't be put in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
