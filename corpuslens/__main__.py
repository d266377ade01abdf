"""Command line: build a store from a documents table, search it, answer and research questions, or chat.

    python -m corpuslens build DOCUMENTS.parquet STORE
    python -m corpuslens search|answer|research STORE "question" [--characters a,b] [--top 10]
    python -m corpuslens chat STORE
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import snippet
from .functions.vectors import hashed_embedding
from .operators import chunking
from .operators.graph import cut_lineage
from .plans import chat, hybrid, research, synthesis
from .sources import readers, sinks

CHAT_HELP = "/history  /research QUESTION  /clear  /help  /exit"


def build(spark: SparkSession, documents: str, store: str) -> dict[str, int]:
    """Chunks of the documents (source, doc_id, text), encoded and put into the store; how many of each type."""
    chunks = chunking.chunk_chapters(readers.documents_as_chapters(spark.read.parquet(documents)))
    return sinks.build_store(spark, store, cut_lineage(chunks.withColumn("characters", F.array().cast("array<string>"))), hashed_embedding)


def load(spark: SparkSession, store: str) -> hybrid.Index:
    both = [readers.read_chunks(spark, f"{store}/{kind}").withColumn("chunk_type", F.lit(kind)) for kind in ("chapter", "paragraph")]
    order = F.col("book_num").cast("long") * 10**13 + F.col("chapter_num").cast("long") * 10**6 + F.pmod(F.xxhash64("id"), F.lit(10**6))
    index = hybrid.build_index(cut_lineage(both[0].unionByName(both[1]).withColumn("pos", order)))
    return hybrid.Index(index.chunks, {k: cut_lineage(v) for k, v in index.postings.items()}, cut_lineage(index.vocab))


def found(spark: SparkSession, index: hybrid.Index, question: str, top: int, wanted: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(candidates with their texts, the question as searched)."""
    asked = spark.createDataFrame([(0, question)], "query_id int, text string")
    hits, seen = hybrid.hybrid_search(index, asked, top=top, wanted=wanted, payload=("text", "book_num", "chapter_num", "chapter_title"))
    return cut_lineage(hits), seen


def answered(spark: SparkSession, index: hybrid.Index, question: str, top: int, wanted: list[str] | None, session: chat.ChatSession | None = None) -> list[str]:
    """Lines of an answer with its sources; a session is read as history and gets the turn."""
    hits, seen = found(spark, index, question, top, wanted)
    if hits.isEmpty():
        return ["nothing found"]
    asked = spark.createDataFrame([(0, question)], "query_id int, text string")
    past = spark.createDataFrame([(0, t["turn_no"], t["query"], t["finding"]["answer"]) for t in session.turn_list] if session else [], "query_id int, turn_no long, question string, answer string")
    findings, _ = synthesis.synthesise_with_history(asked, hits.select("query_id", "rank", "id", "text"), past)
    x = cut_lineage(findings).first()["finding"].asDict()
    if session is not None:
        candidates = [r.asDict() for r in hits.orderBy("rank").select("id", "score", "text", "book_num", "chapter_num", "chapter_title").collect()]
        session.record(question, x, seen.first()["rewritten"], candidates)
    return [x["answer"], f"conviction {x['conviction']} of 5", *(f"  [{i}] {s}" for i, s in enumerate(x["source_ids"], 1))]


def researched(spark: SparkSession, index: hybrid.Index, question: str, top: int) -> list[str]:
    if not question.strip():
        raise ValueError("a question is needed")
    r = research.research(index, spark.createDataFrame([(0, question)], "query_id int, text string"), top=top).first()
    return [r["answer"], f"conviction {r['conviction']} of 5; {r['n_sub']} parts, {r['n_empty']} without evidence", *(f"  {s}" for s in r["source_ids"]), *(f"  open: {g}" for g in r["gaps"])]


def talk(spark: SparkSession, index: hybrid.Index, lines, top: int = 10):
    """Replies to each line of a conversation."""
    session = chat.ChatSession(spark)
    for line in map(str.strip, lines):
        command, _, rest = line.partition(" ")
        if command == "/exit":
            return
        if command == "/help":
            yield [CHAT_HELP]
        elif command == "/clear":
            session.reset()
            yield ["forgotten"]
        elif command == "/history":
            yield [f"{t['turn_no'] + 1}. {t['query']}" for t in session.turn_list]
        elif command == "/research":
            yield researched(spark, index, rest, top) if rest.strip() else ["a question is needed"]
        elif command.startswith("/"):
            yield [f"unknown: {command}", CHAT_HELP]
        elif line:
            yield answered(spark, index, line, top, None, session)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpuslens")
    sub = parser.add_subparsers(dest="command", required=True)
    made = sub.add_parser("build")
    made.add_argument("documents")
    made.add_argument("store")
    for name in ("search", "answer", "research", "chat"):
        p = sub.add_parser(name)
        p.add_argument("store")
        if name != "chat":
            p.add_argument("question")
        p.add_argument("--characters", default="")
        p.add_argument("--top", type=int, default=10)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("corpuslens").getOrCreate()
    if a.command == "build":
        print(build(spark, a.documents, a.store))
        return 0
    index, wanted = load(spark, a.store), [c.strip() for c in a.characters.split(",") if c.strip()] or None
    if a.command == "search":
        hits, _ = found(spark, index, a.question, a.top, wanted)
        rows = hits.orderBy("rank").select("rank", "id", F.round("score", 4).alias("score"), snippet(F.col("text"), 220).alias("shown")).collect()
        print("\n".join(f"{r['rank']}. {r['id']} ({r['score']})\n   {r['shown']}" for r in rows))
    elif a.command == "chat":
        for reply in talk(spark, index, sys.stdin, a.top):
            print("\n".join(reply), flush=True)
    else:
        print("\n".join(answered(spark, index, a.question, a.top, wanted) if a.command == "answer" else researched(spark, index, a.question, a.top)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
