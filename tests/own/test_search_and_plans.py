"""Search, fusion, correction, answers, sources and sinks."""

import json
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.functions.memory import released
from corpuslens.operators import bm25, dense, fusion, rewrite
from corpuslens.operators.graph import no_rows
from corpuslens.plans import chat, hybrid, queries, research, stats, synthesis
from corpuslens.sources import readers, sinks


def docs(spark, texts):
    return spark.createDataFrame([(f"d{i}", i, t) for i, t in enumerate(texts)], "id string, pos long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def py_bm25(texts, query):
    toks = [t.lower().split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = Counter(w for t in toks for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    return [sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in query.split()) for t in toks]


def test_bm25(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(40)]
    p = bm25.build_postings(docs(spark, texts))
    q = "a b b z"
    want = py_bm25(texts, q)
    order = sorted((i for i in range(40) if want[i] > 0), key=lambda i: (-round(want[i], 9), i))[:10]
    got = bm25.search(p, asked(spark, q), 10).orderBy("rank").collect()
    assert [x.pos for x in got] == order and all(abs(x.score - want[x.pos]) < 1e-8 for x in got)
    assert bm25.search(p, asked(spark, "zzz"), 5).count() == 0
    common = bm25.build_postings(docs(spark, [f"word u{i}" for i in range(20)]))
    assert bm25.search(common, asked(spark, "word"), 5).count() == 5
    with pytest.raises(ValueError):
        bm25.build_postings(docs(spark, []))


def test_bm25_filter(spark):
    chunks = docs(spark, [f"x u{i}" for i in range(12)]).withColumn("characters", F.when(F.col("pos") % 5 == 4, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"))))
    p = bm25.build_postings(chunks)
    few = bm25.search_filtered(p, asked(spark, "x"), 1, chunks, ["a", "z"], over_fetch=4).collect()
    assert few == []  # fetched four, none of which fits
    assert bm25.search_filtered(p, asked(spark, "x"), 1, chunks, ["a"], exact=True).count() == 1
    assert bm25.search_filtered(p, asked(spark, "x"), 3, chunks, None).count() == 3


def test_dense(spark):
    r = random.Random(2)
    vecs = [(f"v{i}", i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)]
    qs = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(9)]
    v = spark.createDataFrame(vecs, "id string, pos long, embedding array<float>").repartition(4)
    q = spark.createDataFrame(qs, "query_id int, embedding array<double>")
    for block in (4096, 4):
        got = {(x.query_id, x.rank): x.pos for x in dense.dense_search(v, q, 5, block).collect()}
        for k, e in qs:
            order = sorted(range(60), key=lambda i: (-sum(a * b for a, b in zip(e, vecs[i][2])), i))[:5]
            assert [got[(k, j + 1)] for j in range(5)] == order
    assert dense.dense_search(v, q.limit(0), 5).count() == 0


def test_fusion(spark):
    rows = lambda *lists: spark.createDataFrame([(0, n, i + 1, x) for n, ids in enumerate(lists) for i, x in enumerate(ids)], "query_id int, list_no int, rank int, id string")
    top = [x.id for x in fusion.reciprocal_rank_fusion(rows("abc", "cad")).orderBy("rank").collect()]
    assert set(top[:2]) == {"a", "c"}
    twice = fusion.reciprocal_rank_fusion(rows("aa", "a")).collect()
    assert len(twice) == 1 and abs(twice[0].score - (2 / 61 + 1 / 62)) < 1e-12
    merged = fusion.merge_candidates(rows("sa", "bs")).orderBy("number").collect()
    assert [(x.number, x.id) for x in merged] == [(1, "s"), (2, "a"), (3, "b")]
    with pytest.raises(ValueError):
        fusion.union_lists([None, None])


def test_rewrite(spark):
    vocab = rewrite.vocabulary(docs(spark, ["thunderstorm harbour steam whistle", "gasometer harbor"]))
    got = rewrite.rewrite(asked(spark, "Thnudersotrm!", "ab qq", "zzzzzzzzz", "steam, whistle!", "harbopr", "gasommeter " + "q" * 80, ""), vocab).orderBy("query_id").collect()
    assert [x.rewritten for x in got] == ["thunderstorm", "ab qq", "zzzzzzzzz", "steam whistle", "harbour", "gasometer " + "q" * 80, ""] or got[4].rewritten in ("harbour", "harbor")
    assert [tuple(c) for c in got[0].corrections] == [("thnudersotrm", "thunderstorm")]
    assert rewrite.rewrite(asked(spark, "gasommeter"), vocab, cutoff=99).first().rewritten == "gasommeter"
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcdé") for _ in range(r.randint(3, 12))) for _ in range(300)})
    bad = ["".join(r.choice("abcdé") for _ in range(r.randint(5, 70))) for _ in range(40)]
    from tests.own.test_text_and_entities import py_ratio

    vocab = rewrite.vocabulary(docs(spark, [" ".join(words)]))
    found = {x.token: (x.fix, x.ratio) for x in rewrite.corrections(asked(spark, " ".join(bad)), vocab).collect()}
    for t in set(bad) - set(words):
        best = max((py_ratio(t, w), -i, w) for i, w in enumerate(words))
        assert found.get(t) == ((best[2], pytest.approx(best[0])) if best[0] >= 80 else None)


CAND = "query_id int, rank int, id string, source string, text string, book_num int, chapter_num int, chapter_title string, page_start int"


def test_synthesis(spark):
    long = " ".join(f"w{i}" for i in range(1000))
    c = spark.createDataFrame([(0, 1, "a", "paragraph", long, 1, 2, "T", 3), (0, 2, "b", "chapter", long, 1, 2, "T", 3), (1, 1, "b", "chapter", "short. more", 1, 2, "T", 3)], CAND)
    ctx = {x.query_id: x.context for x in synthesis.render_context(c).collect()}
    assert ctx[1] == "[1] Book 1, Chapter 2: T (p.3, source=chapter)\n    short. more"
    assert long in ctx[0].split("\n\n")[0] and ctx[0].endswith("w199 […chapter continues…]")
    cited = spark.createDataFrame([(0, 0, "2"), (0, 1, "[1]"), (0, 2, "99"), (0, 3, "b")], "query_id int, place int, raw string")
    ids = synthesis.resolve_citations(cited, c)
    assert [x.id for x in ids.orderBy("place").collect()] == ["b", "a", None, None]
    with pytest.raises(Exception, match="no such passage"):
        synthesis.checked_citations(ids).collect()
    found = {x.query_id: x.finding for x in synthesis.synthesise(asked(spark, "q", "r"), c).collect()}
    assert found[0].source_ids == ["a", "b"] and found[1].answer == "short. [1]"
    with pytest.raises(ValueError):
        synthesis.synthesise(asked(spark, "q", "r", "none"), c)
    bad = lambda q, top: F.struct(F.lit("x").alias("answer"), F.array(F.lit("1")).alias("source_ids"), F.lit(6).alias("conviction"), F.array().cast("array<string>").alias("gaps"))
    with pytest.raises(Exception, match="conviction"):
        synthesis.synthesise(asked(spark, "q"), c, bad).collect()
    seen = synthesis.evidence(synthesis.synthesise(asked(spark, "q", "r"), c), c).orderBy("query_id", "place").collect()
    assert [(x.query_id, x.id, x.source) for x in seen] == [(0, "a", "paragraph"), (0, "b", "chapter"), (1, "b", "chapter")]


def test_hybrid_and_research(spark):
    texts = ["apples grow on trees", "pears grow on trees too", "ships sail the sea", "the sea is deep"]
    chunks = spark.createDataFrame([(f"{k[0]}{i}", i, k, t, ["x"] if i % 2 else []) for k in ("paragraph", "chapter") for i, t in enumerate(texts)], "id string, pos long, chunk_type string, text string, characters array<string>")
    index = hybrid.build_index(chunks)
    found, seen = hybrid.hybrid_search(index, asked(spark, "Ships, seas"), payload=("text",))
    assert found.filter("rank = 1").first().text == "ships sail the sea" and seen.first().rewritten == "ships seas"
    only, _ = hybrid.hybrid_search(index, asked(spark, "trees"), wanted=["x"], payload=("characters",))
    assert all(x.characters == ["x"] for x in only.collect())
    with pytest.raises(ValueError):
        hybrid.hybrid_search(index, asked(spark, " "))
    got = {x.query_id: x for x in research.research(index, asked(spark, "Where do apples grow? Who sails the sea?", "Who sails?")).collect()}
    assert got[0].n_sub == 2 and got[0].n_empty == 0 and got[0].source_ids and got[1].n_sub == 1
    subs = spark.createDataFrame([(5, 1, "nothing")], "query_id int, sub_no int, sub_question string")
    none = spark.createDataFrame([], "query_id int, sub_no int, rank int, id string, text string")
    empty = research.report(spark.createDataFrame([(5, "nothing")], "query_id int, text string"), research.sub_findings(subs, none), none).first()
    assert (empty.source_ids, empty.conviction, empty.gaps, empty.n_empty) == (["__no_evidence__"], 1, ["sub-question 0: no passages"], 1)
    with pytest.raises(Exception, match="sub-questions"):
        research.plan(asked(spark, "q"), lambda c: F.array().cast("array<string>")).collect()


def test_chat(spark):
    s = chat.ChatSession(spark)
    s.record("q", {"answer": "a", "source_ids": ["7"], "conviction": 3, "gaps": []}, "q q", [{"id": "7", "score": 0.5, "text": "t"}])
    s.record("r", {"answer": "b", "source_ids": ["7"], "conviction": 3, "gaps": []})
    name = s.thread_id
    assert len(s) == 2 and [x.query for x in chat.history(s.turns(), name).collect()] == ["q", "r"]
    s.reset()
    assert len(s) == 0 and s.thread_id == name


def test_sources_and_sinks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"t{i}") for i in range(1, 121)], "page_num int, text string")
    sinks.write_batches(pages, f"{tmp_path}/b")
    sinks.write_batches(pages.filter("page_num > 100").withColumn("text", F.lit("new")), f"{tmp_path}/b")
    merged = sinks.merge_batches(spark, f"{tmp_path}/b").collect()
    assert [x.page_num for x in merged] == list(range(1, 121)) and merged[99].text == "t100" and merged[119].text == "new"
    assert readers.batch_ranges(120) == [(1, 50), (51, 100), (101, 120)]
    assert readers.page_range(pages, 5, 9).count() == 5 and readers.page_count(pages) == 120
    for bad in ((0, 3), (5, 4), (1, 121)):
        with pytest.raises(ValueError):
            readers.page_range(pages, *bad)
    assert readers.read_pages(spark, f"{tmp_path}/none.json") is None
    with pytest.raises(FileNotFoundError):
        readers.read_chunks(spark, f"{tmp_path}/none")
    sinks.write_pages(pages, f"{tmp_path}/p")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_pages(pages, f"{tmp_path}/p")
    sinks.write_pages(pages, f"{tmp_path}/p", force=True)
    (tmp_path / "books.json").write_text(json.dumps({"books": [{"book_num": 2, "title": "B", "chapters": [{"chapter_num": 1, "chapter_title": "x", "page_start": 1, "page_end": 2, "text": "t"}]}]}, indent=2))
    assert readers.read_books(spark, f"{tmp_path}/books.json").first().chapter_title == "x"
    (tmp_path / "aliases.json").write_text(json.dumps({"ann": {"label": "Ann", "aliases": ["Ann", "A"]}}))
    assert tuple(readers.read_aliases(spark, f"{tmp_path}/aliases.json").first()) == ("ann", "Ann", ["Ann", "A"])
    (tmp_path / "o.json").write_text(json.dumps({"drop": ["x"], "force_merge": [["a", "b"], ["c"]]}))
    drops, merges = readers.read_overrides(spark, f"{tmp_path}/o.json")
    assert drops.count() == 1 and sorted(map(tuple, merges.collect())) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert sinks.upsert(spark, f"{tmp_path}/u", rows) == 2
    assert sinks.upsert(spark, f"{tmp_path}/u", spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"), expected=2) == 2
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/u").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(ValueError):
        sinks.upsert(spark, f"{tmp_path}/u", rows, expected=3)
    (tmp_path / "doc.bin").write_bytes(b"one\ftwo")
    got = readers.scan_binary(spark, f"{tmp_path}/doc.bin", lambda raw: raw.decode().split("\f")).orderBy("page_num").collect()
    assert [(x.page_num, x.text) for x in got] == [(1, "one"), (2, "two")]
    assert tuple(stats.page_summary(spark.createDataFrame([(1, "ab"), (2, " \n")], "page_num int, text string")).first()) == (2, 4, 1)


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    from corpuslens.streaming.ingest import ingest

    rows = [(1, i, f"T{i}", i, f"Sentence one of {i}. Sentence two.") for i in range(3)]
    schema = "book_num int, chapter_num int, chapter_title string, page_start int, text string"
    spark.createDataFrame(rows, schema).write.json(f"{tmp_path}/in")
    for run in ("one", "two"):
        q = ingest(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/chunks", f"{tmp_path}/terms", f"{tmp_path}/cp-{run}")
        q.awaitTermination(120)
        chunks = spark.read.parquet(f"{tmp_path}/chunks")
        assert chunks.count() == 6 and chunks.select("id").distinct().count() == 6


def test_history_goes_into_prompts_and_grows(spark):
    from corpuslens.plans import synthesis

    q = spark.createDataFrame([(1, "who?"), (2, "where?")], "query_id int, text string")
    c = spark.createDataFrame([(1, 1, "x", "Ann came. Late."), (2, 1, "y", "In town."), (2, 2, "z", "At sea.")], "query_id int, rank int, id string, text string")
    past = spark.createDataFrame([(2, 0, "when?", "noon"), (2, 1, "why?", "rain")], "query_id int, turn_no long, question string, answer string")
    told = lambda query, top, past: F.struct(F.concat_ws("|", query, F.array_join(F.transform(past, lambda x: x["question"]), ",")).alias("answer"), F.array(F.lit("[1]")).alias("source_ids"), F.lit(4).alias("conviction"), F.array().cast("array<string>").alias("gaps"))
    found, grown = synthesis.synthesise_with_history(q, c, past, told)
    assert {x.query_id: (x.finding.answer, x.finding.source_ids) for x in found.collect()} == {1: ("who?|", ["x"]), 2: ("where?|when?,why?", ["y"])}
    assert sorted(map(tuple, grown.collect())) == [(1, 1, "who?", "who?|"), (2, 0, "when?", "noon"), (2, 1, "why?", "rain"), (2, 2, "where?", "where?|when?,why?")]
    with pytest.raises(ValueError):
        synthesis.synthesise_with_history(q, c.filter("query_id = 1"))


def test_store_from_documents_to_chat(spark, tmp_path):
    from corpuslens import __main__ as cli

    docs = spark.createDataFrame([(i, f"s{i % 2}", f"Ann met Bo near lake{i}. They spoke of weather{i} and boats.") for i in range(8)], "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    store = f"{tmp_path}/store"
    first = cli.build(spark, f"{tmp_path}/documents.parquet", store)
    assert first == {"chapter": 8, "paragraph": 8} == cli.build(spark, f"{tmp_path}/documents.parquet", store)
    index = cli.load(spark, store)
    assert index.chunks.count() == 16 and "lake3" in cli.found(spark, index, "lake3", 3, None)[0].orderBy("rank").first().text
    replies = list(cli.talk(spark, index, ["weather5", "/history", "/what", "/clear", "/history", "/exit", "never"]))
    assert replies[0][1].startswith("conviction") and replies[1] == ["1. weather5"] and replies[2][0] == "unknown: /what" and replies[3:] == [["forgotten"], []]
    with pytest.raises(ValueError):
        cli.researched(spark, index, "  ", 3)


def test_aliases_come_back_and_swaps_are_taken_up_again(spark, tmp_path):
    rows = [("ann", "Ann", ["Ann", "Annie"]), ("bo", "Bo", ["Bo"])]
    sinks.write_aliases(spark.createDataFrame(rows, "char_id string, label string, aliases array<string>"), f"{tmp_path}/a")
    assert sorted(map(tuple, readers.read_aliases(spark, f"{tmp_path}/a").collect())) == rows
    t = f"{tmp_path}/t"
    assert sinks.upsert(spark, t, spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")) == 2
    (tmp_path / "t").rename(tmp_path / "t.before")  # as a run leaves it that ends between the names
    assert sinks.upsert(spark, t, spark.createDataFrame([("b", 2)], "id string, v int")) == 1
    assert sorted(map(tuple, spark.read.parquet(t).collect())) == [("a", 1), ("b", 2)] and not (tmp_path / "t.before").exists()


def test_context_of_findings_and_passages(spark):
    q = spark.createDataFrame([(1, "who?")], "query_id int, text string")
    subs = spark.createDataFrame([(1, 1, "when?", ("noon", ["x"], 3, []))], "query_id int, sub_no int, sub_question string, finding struct<answer:string,source_ids:array<string>,conviction:int,gaps:array<string>>")
    p = spark.createDataFrame([(1, 1, "paragraph", "At noon.", 2, 3, "T", 9)], "query_id int, rank int, source string, text string, book_num int, chapter_num int, chapter_title string, page_start int")
    got = research.render_subfindings(q, subs, p).first().context
    assert got == "Original research question: who?\n\n=== SUB-FINDINGS (1) ===\n\nSub-finding 1: when?\n  conviction: 3/5\n  answer: noon\n  gaps: (none)\n\n=== FLATTENED PASSAGE SET (1) ===\n\n[1] Book 2, Chapter 3: T (p.9, source=paragraph)\n    At noon."


def test_search_without_postings_gives_the_same(spark):
    texts = ["the sea and the ship", "a ship", "the the the sea", None, "", "the sea and the ship", "Quill the sailor", "the", "the end", "the ship of the sea"]
    rows = [(i, i, t) for i, t in enumerate(texts)] + [(1, 1, "a mast"), (1, 1, "the ship at sea"), (20, 20, "x")]
    d = spark.createDataFrame(rows, "id long, pos long, text string").repartition(4)
    q = asked(spark, "the ship ship", "sea", "zzz", "the", "a mast x")
    show = lambda x: [(r.query_id, r["rank"], r.id, round(r.score, 6)) for r in x.orderBy("query_id", "rank").collect()]
    whole = show(bm25.search(bm25.build_postings(d), q, 4))
    assert whole and show(bm25.search_texts(d, q, 4)) == whole
    assert show(bm25.search_texts(d, q, 4, block=1)) == whole
    with pytest.raises(ValueError):
        bm25.search_texts(d.limit(0), q, 4)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = ["The ship sails. It is old.", "A ship at sea.", "Seas of ships.", None]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "ship at sea"), (1, "old sailing")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def no_postings(monkeypatch):
    def built(*_):
        raise AssertionError("postings of all texts")

    monkeypatch.setattr(bm25, "build_postings", built)


def test_rrf_fusion_makes_no_postings_of_all_texts(spark, tables, monkeypatch):
    no_postings(monkeypatch)
    got = [(x.query_id, x["rank"], x.id) for x in queries.rrf_fusion(spark, tables).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (1, 1, 0)]  # half of the documents have "ship", so it weighs nothing


def test_synthesise_makes_no_postings_of_all_texts(spark, tables, monkeypatch):
    no_postings(monkeypatch)
    got = [(x.query_id, x.sources, x.conviction) for x in queries.synthesise(spark, tables).orderBy("query_id").collect()]
    assert got == [(0, "1", 1), (1, "0", 1)]


def test_hybrid_search_makes_no_postings_of_all_texts(spark, tables, monkeypatch):
    chunks = queries._hybrid_index(spark, tables).chunks
    assert "embedding" not in chunks.columns and sorted((x.chunk_type, x.pos % 10**6, x.text) for x in chunks.filter("text LIKE '%sails%'").collect()) == [(k, 0, "The ship sails. It is old.") for k in ("chapter", "paragraph")]
    kept = hybrid.build_index(chunks)
    assert sorted(map(tuple, kept.vocab.collect())) == sorted(map(tuple, queries._hybrid_index(spark, tables).vocab.collect()))
    show = lambda found: sorted((x.query_id, x["rank"], x.id, round(x.score, 6)) for x in found.collect())
    want = show(hybrid.hybrid_search(kept, queries._asked(spark, tables))[0])
    some = show(hybrid.hybrid_search(kept, queries._asked(spark, tables), wanted=["book1"])[0])
    assert some == show(hybrid.hybrid_search(queries._hybrid_index(spark, tables), queries._asked(spark, tables), wanted=["book1"])[0])
    no_postings(monkeypatch)
    assert show(queries.hybrid_search(spark, tables)) == want and {x[0] for x in want} == {0, 1}


def test_first_places_by_batches(spark):
    rows = [(7, "b a"), (3, "c a a"), (5, ""), (4, "a b"), (9, "d d c"), (6, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        d = spark.createDataFrame(rows, "pos long, text string").coalesce(1)
        found = rewrite.vocabulary(d)
        assert sorted(map(tuple, found.collect())) == [("a", 3, 1), ("b", 4, 1), ("c", 3, 0), ("d", 9, 0)]
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row a word
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_research_report_makes_no_postings_and_moves_texts_of_hits_only(spark, tables, monkeypatch):
    kept = hybrid.build_index(queries._hybrid_index(spark, tables).chunks)
    report = lambda index: sorted((x.query_id, x.conviction, len(x.source_ids), x.n_sub, x.n_empty) for x in research.research(index, queries._asked(spark, tables)).collect())
    want = report(kept)
    hits, _ = hybrid.hybrid_search(queries._hybrid_index(spark, tables), queries._asked(spark, tables), payload=("text",))
    hits.collect()
    assert "SortMergeJoin" not in hits._jdf.queryExecution().optimizedPlan().toString() and "strategy=broadcast" in hits._jdf.queryExecution().optimizedPlan().toString()
    no_postings(monkeypatch)
    assert sorted(map(tuple, queries.research_report(spark, tables).collect())) == want and len(want) == 2


def test_dense_search_holds_rows_against_the_best_so_far(spark):
    r = np.random.default_rng(3)
    v = np.repeat(r.integers(-3, 4, (300, 4)).astype(float), 3, 0)[r.permutation(900)]  # three of each, so there are ties
    q = r.integers(-3, 4, (70, 4)).astype(float)
    rows = spark.createDataFrame([(f"x{i}", i, x.tolist()) for i, x in enumerate(v)], "id string, pos long, embedding array<double>").coalesce(2)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<double>")
    want = sorted((j, n + 1, f"x{i}") for j, s in enumerate((v @ q.T).T) for n, i in enumerate(np.lexsort((np.arange(900), -s))[:5]))
    assert sorted((x.query_id, x["rank"], x.id) for x in dense.dense_search(rows, asked, 5).collect()) == want
    # what is kept of a query's rows bounds those that come later
    least, kept = np.full(2, -np.inf), pa.table({"q": [0, 0, 0, 1], "id": list("abcd"), "pos": [3, 1, 2, 4], "score": [1.0, 1.0, 2.0, 5.0]})
    assert dense._best(kept, 2, least).column("id").to_pylist() == ["c", "b", "d"] and least.tolist() == [1.0, -np.inf]


def test_texts_of_hybrid_search_go_out_in_small_batches(spark, tables):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        chunks = queries._hybrid_index(spark, tables).chunks
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)
        many = chunks.limit(1).crossJoin(spark.range(0, 5000, 1, 1).select(F.col("id").alias("i"))).select("text").coalesce(1)
        assert max(x.n for x in many.mapInArrow(sizes, "n long").collect()) <= queries.BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_workers_give_memory_back_and_empty_tables_need_none(spark):
    def grown(batches):
        for b in batches:
            kept = [bytearray(1 << 16) for _ in range(2000)]  # 128 MB in pieces below the allocator's own maps
            del kept[::2]
            yield b

    def resident(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"mb": pa.array([int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20] * b.num_rows, pa.int64())})

    one = spark.range(0, 1, 1, 1)
    before = one.mapInArrow(resident, "mb long").first().mb
    assert one.mapInArrow(released(grown), "id long").count() == 1
    assert one.mapInArrow(resident, "mb long").first().mb < before + 60
    none = no_rows(spark, "a struct<b:int,c:string>, d array<double>")
    assert none.dtypes == [("a", "struct<b:int,c:string>"), ("d", "array<double>")] and none.count() == 0
    assert "Python" not in none._jdf.queryExecution().executedPlan().toString() and "ExistingRDD" not in none._jdf.queryExecution().executedPlan().toString()
