"""Answers from passages: contexts, an injected model, and checks of what it cites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import citation_number, head_words, sentences

NO_EVIDENCE = "__no_evidence__"
PAST = "array<struct<turn_no:bigint,question:string,answer:string>>"


def passage(number: Column, c: Callable[[str], Column] = F.col) -> Column:
    """One numbered passage; chapters are cut to their first words, ids are not shown."""
    body = F.when(c("source") == "chapter", head_words(c("text"))).otherwise(c("text"))
    return F.concat(F.format_string("[%d] Book %d, Chapter %d: %s (p.%d, source=%s)\n    ", number, c("book_num"), c("chapter_num"), c("chapter_title"), c("page_start"), c("source")), body)


def render_context(candidates: DataFrame) -> DataFrame:
    """(query_id, context, n) from candidates(query_id, rank, source, text, ...)."""
    lines = candidates.select("query_id", "rank", passage(F.col("rank")).alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n"))


def prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Question: "), query, F.lit("\n\nNumbered passages:\n\n"), context)


def resolve_citations(cited: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, place, raw, id) of cited(query_id, place, raw) against candidates(query_id, rank, id); id is null if there is no such passage."""
    numbered = cited.withColumn("rank", citation_number(F.col("raw")))
    return numbered.join(candidates.select("query_id", "rank", "id"), ["query_id", "rank"], "left").select("query_id", "place", "raw", "id")


def checked_citations(resolved: DataFrame) -> DataFrame:
    """(query_id, source_ids); a citation without a passage stops the job with its text."""
    bad = F.raise_error(F.concat(F.lit("no such passage: "), F.col("raw")))
    safe = resolved.withColumn("id", F.coalesce(F.col("id").cast("string"), bad.cast("string")))
    return safe.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("source_ids"))


def finding_errors(finding: Column) -> Column:
    """What is wrong with a finding (null: nothing)."""
    return F.when(F.size(finding["source_ids"]) < 1, "no source").when(~finding["conviction"].between(1, 5), "conviction out of range").when(finding["answer"].isNull(), "no answer")


def plan_errors(sub_questions: Column) -> Column:
    return F.when(~F.size(sub_questions).between(1, 8), "1 to 8 sub-questions are needed")


def extractive(query: Column, top: Column) -> Column:
    """Stand-in for a model: the first sentences of the best passages, which it cites.

    top: array<struct<rank, text>>; gives a finding whose sources are passage numbers.
    """
    used = F.slice(top, 1, 3)
    answer = F.array_join(F.transform(used, lambda x: F.concat(F.coalesce(F.get(sentences(x["text"]), F.lit(0)), F.lit("")), F.lit(" ["), x["rank"].cast("string"), F.lit("]"))), " ")
    return F.struct(answer.alias("answer"), F.transform(used, lambda x: x["rank"].cast("string")).alias("source_ids"), F.least(F.size(top), F.lit(5)).alias("conviction"), F.array().cast("array<string>").alias("gaps"))


def synthesise(queries: DataFrame, candidates: DataFrame, answer=extractive, cached: bool = True) -> DataFrame:
    """(query_id, finding) for queries(query_id, text) with candidates; a query without any is a ValueError.

    answer(query, top) is an expression, or a UDF that calls a model. With cached, queries
    of equal prompts are answered once.
    """
    return _synthesise(queries.withColumn("past", F.array().cast(PAST)), candidates, lambda query, top, _: answer(query, top), cached)


def synthesise_with_history(queries: DataFrame, candidates: DataFrame, history: DataFrame | None = None, answer=None, cached: bool = True) -> tuple[DataFrame, DataFrame]:
    """Findings as synthesise gives them, and history(query_id, turn_no, question, answer) with the new turns behind.

    answer(query, top, past) also sees the earlier turns of the query's thread, in order. Citations are
    those of the new candidates only.
    """
    past = None if history is None else history.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn_no").cast("long").alias("turn_no"), "question", "answer"))).alias("past"))
    asked = queries.withColumn("past", F.array().cast(PAST)) if past is None else queries.join(past, "query_id", "left").withColumn("past", F.coalesce("past", F.array().cast(PAST)))
    found = _synthesise(asked, candidates, answer or (lambda query, top, _: extractive(query, top)), cached)
    number = F.coalesce(F.element_at(F.transform("past", lambda x: x["turn_no"]), -1) + 1, F.lit(1).cast("long")) if past is not None else F.lit(1).cast("long")
    turns = asked.withColumn("turn_no", F.when(F.size("past") > 0, number).otherwise(1)) if past is not None else asked.withColumn("turn_no", number)
    new = turns.select("query_id", "turn_no", F.col("text").alias("question")).join(found.select("query_id", F.col("finding.answer").alias("answer")), "query_id")
    return found, new if history is None else history.select("query_id", F.col("turn_no").cast("long").alias("turn_no"), "question", "answer").unionByName(new)


def _synthesise(queries: DataFrame, candidates: DataFrame, answer, cached: bool) -> DataFrame:
    if not queries.join(candidates, "query_id", "left_anti").isEmpty():
        raise ValueError("a query has no candidates")
    best = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("top"))
    asked = queries.join(best, "query_id")
    made = answer(F.col("text"), F.col("top"), F.col("past")).cast(schemas.FINDING).alias("raw")
    if cached:
        once = asked.withColumn("key", F.sha2(F.to_json(F.struct("text", "top", "past")), 256))
        raws = once.select("query_id", "key").join(once.dropDuplicates(["key"]).select("key", made), "key").select("query_id", "raw")
    else:
        raws = asked.select("query_id", made)
    cited = raws.select("query_id", F.posexplode("raw.source_ids").alias("place", "raw"))
    ids = checked_citations(resolve_citations(cited, candidates))
    out = raws.join(ids, "query_id", "left").select("query_id", F.struct("raw.answer", F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), "raw.conviction", "raw.gaps").alias("finding"))
    wrong = finding_errors(F.col("finding"))
    return out.withColumn("finding", F.when(wrong.isNull(), F.col("finding")).otherwise(F.raise_error(wrong).cast(out.schema["finding"].dataType)))


def evidence(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, place, id, payload) of each cited id; of several candidates with an id the first counts, missing ones show."""
    first = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank"))).filter("_n = 1").drop("_n")
    cited = findings.select("query_id", F.posexplode("finding.source_ids").alias("place", "id"))
    return cited.join(first.withColumn("id", F.col("id").cast("string")), ["query_id", "id"], "left")


def citation_count(source_ids: Column) -> Column:
    """How many are cited; none if it is the mark for no evidence."""
    return F.when(source_ids == F.array(F.lit(NO_EVIDENCE)), 0).otherwise(F.size(source_ids))
