"""Research: sub-questions, a search and finding for each, and one report for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators.fusion import merge_candidates
from .hybrid import Index, hybrid_search
from .synthesis import NO_EVIDENCE, plan_errors, resolve_citations, checked_citations, passage, synthesise


def clauses(query: Column) -> Column:
    """Stand-in for a planner: the question's sentences, at most eight."""
    return F.slice(sentences(query), 1, 8)


def plan(queries: DataFrame, planner=clauses) -> DataFrame:
    """(query_id, sub_no, sub_question), sub_no from 1; an empty plan stops the job."""
    made = queries.select("query_id", planner(F.col("text")).alias("subs"))
    wrong = plan_errors(F.col("subs"))
    checked = made.withColumn("subs", F.when(wrong.isNull(), F.col("subs")).otherwise(F.raise_error(wrong).cast("array<string>")))
    return checked.select("query_id", F.posexplode("subs").alias("i", "sub_question")).select("query_id", (F.col("i") + 1).alias("sub_no"), "sub_question")


def sub_findings(subs: DataFrame, candidates: DataFrame, answer=None) -> DataFrame:
    """(query_id, sub_no, sub_question, finding) with candidates(query_id, sub_no, rank, id, text); without candidates the mark for no evidence."""
    key = F.concat_ws("/", F.col("query_id").cast("string"), F.col("sub_no").cast("string"))
    flat = candidates.select(key.alias("query_id"), "rank", "id", "text")
    asked = subs.select("*", key.alias("key"))
    some = asked.join(flat.select(F.col("query_id").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("query_id"), F.col("sub_question").alias("text"))
    more = {} if answer is None else {"answer": answer}
    found = synthesise(some, flat, **more).withColumnRenamed("query_id", "key")
    none = F.struct(F.concat(F.lit("Nothing in the corpus speaks to: "), F.col("sub_question")).alias("answer"), F.array(F.lit(NO_EVIDENCE)).alias("source_ids"), F.lit(1).alias("conviction"), F.array(F.concat(F.lit("without evidence: "), F.col("sub_question"))).alias("gaps"))
    return asked.join(found, "key", "left").select("query_id", "sub_no", "sub_question", F.coalesce("finding", none).alias("finding"))


def joined_answers(findings: Column) -> Column:
    """Stand-in for an aggregating model: answers one after the other; the least conviction; all gaps."""
    return F.struct(F.array_join(F.transform(findings, lambda x: x["finding"]["answer"]), "\n").alias("answer"), F.array_min(F.transform(findings, lambda x: x["finding"]["conviction"])).alias("conviction"), F.flatten(F.transform(findings, lambda x: x["finding"]["gaps"])).alias("gaps"))


def report(queries: DataFrame, subs: DataFrame, candidates: DataFrame, aggregate=joined_answers) -> DataFrame:
    """One row for each question: query_id, answer, source_ids, conviction, gaps, n_sub, n_empty.

    Sub-findings without evidence are counted, not cited. The numbers that an answer cites are those of
    the merged passages, each once at its first appearance; the stand-in cites what
    the sub-findings cite. Without any evidence the report says so.
    """
    real = subs.filter(F.col("finding.source_ids") != F.array(F.lit(NO_EVIDENCE)))
    counts = subs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sub"), F.sum((F.col("finding.source_ids") == F.array(F.lit(NO_EVIDENCE))).cast("int")).alias("n_empty"))
    merged = merge_candidates(candidates.withColumnRenamed("sub_no", "list_no")).withColumn("id", F.col("id").cast("string"))
    cited = real.select("query_id", F.explode("finding.source_ids").alias("id")).distinct().join(merged, ["query_id", "id"])
    numbers = cited.select("query_id", F.row_number().over(_by_number()).alias("place"), F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]")).alias("raw"))
    ids = checked_citations(resolve_citations(numbers, merged.withColumnRenamed("number", "rank")))
    whole = real.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("sub_no", "finding"))).alias("f")).select("query_id", aggregate(F.col("f")).alias("a"))
    out = queries.select("query_id").join(counts, "query_id", "left").join(whole, "query_id", "left").join(ids, "query_id", "left")
    nothing = "The corpus holds no passage on any part of this question, so it is left open."
    gaps = F.transform(F.sequence(F.lit(0), F.col("n_sub").cast("int") - 1), lambda i: F.concat(F.lit("sub-question "), i.cast("string"), F.lit(": no passages")))
    return out.select(
        "query_id",
        F.coalesce("a.answer", F.lit(nothing)).alias("answer"),
        F.coalesce("source_ids", F.array(F.lit(NO_EVIDENCE))).alias("source_ids"),
        F.coalesce("a.conviction", F.lit(1)).alias("conviction"),
        F.coalesce("a.gaps", gaps).alias("gaps"),
        "n_sub",
        "n_empty",
    )


def _by_number():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy("number")


def render_subfindings(queries: DataFrame, subs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, context): the aggregator's view of the sub-findings and of passages(query_id, rank, source, text, ...)."""
    # fixed values: the layout of the context
    gaps = F.when(F.size("finding.gaps") > 0, F.concat(F.lit("['"), F.array_join("finding.gaps", "', '"), F.lit("']"))).otherwise("(none)")
    part = F.concat(F.format_string("Sub-finding %d: %s\n  conviction: %d/5\n  answer: %s\n  gaps: ", "sub_no", "sub_question", "finding.conviction", "finding.answer"), gaps)
    in_order = lambda rows, by, line: rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.count(F.lit(1)).alias("n"))
    found = in_order(subs, "sub_no", part).select("query_id", F.concat(F.format_string("\n\n=== SUB-FINDINGS (%d) ===\n\n", "n"), F.col("lines")).alias("found"))
    shown = in_order(passages, "rank", passage(F.col("rank"))).select("query_id", F.concat(F.format_string("\n\n=== FLATTENED PASSAGE SET (%d) ===\n\n", "n"), F.col("lines")).alias("shown"))
    both = queries.join(found, "query_id").join(shown, "query_id", "left")
    return both.select("query_id", F.concat(F.lit("Original research question: "), F.col("text"), "found", F.coalesce("shown", F.lit("\n\n=== FLATTENED PASSAGE SET (0) ===\n\n"))).alias("context"))


def research(index: Index, queries: DataFrame, planner=clauses, top: int = 10, answer=None) -> DataFrame:
    """The whole: plan, search all sub-questions of all questions in one batch, find, report."""
    from ..operators.graph import cut_lineage

    subs = cut_lineage(plan(queries, planner))
    key = F.concat_ws("/", F.col("query_id").cast("string"), F.col("sub_no").cast("string"))
    asked = subs.select(key.alias("query_id"), F.col("sub_question").alias("text"))
    hits, _ = hybrid_search(index, asked, top=top, payload=("text",))
    hits = cut_lineage(hits.withColumnRenamed("query_id", "key"))
    found = subs.select("*", key.alias("key")).join(hits, "key").select("query_id", "sub_no", "rank", "id", "text")
    return report(queries, cut_lineage(sub_findings(subs, found, answer)), found)
