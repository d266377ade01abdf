"""The pipeline on a small corpus, each stage against plain Python."""

import random

import corpus_pipeline as cp
from tests.llm.test_ngram_join import brute
from tests.llm.test_text_operators import brute_base, brute_hits


def test_stages(spark, tmp_path):
    r = random.Random(6)
    kinds = {"en": ["the", "ing", "wh", "er"], "de": ["sch", "ung", "ei", "ß"]}
    sentence = lambda k, n: " ".join("".join(r.choice(kinds[k]) for _ in range(r.randint(1, 4))) for _ in range(n))
    items = [sentence("en", 20) for _ in range(3)]
    rows = [(i, sentence(k, r.randint(30, 90)), k) for i, k in enumerate(["en", "de"] * 40)]
    copies = [(200 + i, rows[i][1] + (" extra" if i % 2 else ""), rows[i][2]) for i in range(12)]
    odd = [(300, None, "en"), (301, "12 34", "en"), (302, "", "de"), (303, items[0] + " " + sentence("en", 8), "en"), (304, "write to a.b@c.de or +1 (017) 555-7713 " + sentence("en", 30), "en"), (305, rows[50][1], "en"), (305, rows[50][1], "en")]
    docs = spark.createDataFrame([(d, t, k, "s", len(t or ""), 0.5, 1) for d, t, k in rows + copies + odd], "doc_id long, text string, lang string, source string, n_chars long, score double, copies int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 3 > 0, 0) for i in range(80)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "int(quality) as quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    (_, s1), (_, s2), (_, s3), (_, s4), (_, s5) = cp.STAGES
    held = lambda df: sorted(map(tuple, df.select("doc_id", "text").collect()))
    one = s1(spark, docs, str(tmp_path)).cache()
    assert one.columns == docs.columns
    assert {x[0] for x in held(one)} == {d for d, _, _ in rows + copies + odd} - {300, 301, 302}
    two = s2(spark, one, str(tmp_path)).cache()
    stays = {d for d, _, c in brute(held(one), 5, 80) if d == c}
    assert two.columns == docs.columns and [x[0] for x in held(two)] == sorted(stays)
    three = s3(spark, two, str(tmp_path)).cache()
    gone = {d for d, t in held(two) if (lambda n, hit, _: hit and 20 * hit >= n)(*brute_hits(t, list(enumerate(items)), 13))}
    assert gone == {303} and {x[0] for x in held(three)} == stays - gone
    four = s4(spark, three, str(tmp_path)).cache()
    assert four.columns == docs.columns
    before = dict(held(three))
    for x in four.collect():
        assert x.n_chars == len(x.text)
        assert x.text == before[x.doc_id] if not brute_base(before[x.doc_id]) else x.text.startswith("write to <EMAIL> or <PHONE> ")
    five = s5(spark, four, str(tmp_path)).collect()
    assert {x.doc_id for x in five} <= stays - gone and all(x.rate > 0 and x.copy_no >= 1 for x in five)
    assert len({(x.doc_id, x.copy_no) for x in five}) == len(five)
    assert five and set(docs.columns) - {"copies"} <= set(five[0].asDict())


def test_run_on_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_components_that_share_an_id_or_have_none(spark, tmp_path):
    r = random.Random(7)
    a, b, c, d, e = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    # 5 twice, unlinked; b has further copies; c and d, each with a copy, have no ids; of e's rows, one has no id
    rows = [(5, a), (5, b), (9, b + " more"), (10, b + " yet"), (None, c), (None, c + " more"), (None, d), (None, d), (None, e), (3, e + " more"), (None, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.text) for x in cp.near_copies(spark, docs, str(tmp_path)).collect())
    kept_c = [t for _, t in got if t.startswith(c)]
    assert len(kept_c) == 1
    assert got == sorted([(5, a), (5, b), (-1, kept_c[0]), (-1, d), (3, e + " more"), (-1, ""), (5, "")])


def test_columns_of_any_name_go_through(spark, tmp_path):
    r = random.Random(8)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    base = words(80)
    rows = [(1, base, "m1", 7, "d", 0.25, 3), (2, base + " more", "m2", 7, "d", 0.25, 3), (3, words(50), "m3", 7, "d", 0.25, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _tag int, domain string, rate double, _p int")
    spark.createDataFrame([(1, words(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    two = cp.near_copies(spark, docs, str(tmp_path))
    assert sorted(map(tuple, two.collect())) == [rows[0], rows[2]] and two.columns == docs.columns
    four = cp.without_pii(spark, cp.decontaminated(spark, two, str(tmp_path)), str(tmp_path))
    assert sorted(map(tuple, four.collect())) == [rows[0], rows[2]] and four.columns == docs.columns
    five = cp.mixture(spark, four, str(tmp_path))
    assert five.columns == ["doc_id", "text", "_id", "_tag", "domain_given", "rate_given", "_p", "domain", "rate", "copy_no"]
    assert all((x.domain_given, x.rate_given, x._tag, x._p) == ("d", 0.25, 7, 3) for x in five.collect())


def test_near_copies_share_five_words_and_80_percent(spark, tmp_path):
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(208)]
    # 4 words changed, apart: 20 of 204 shingles differ, 184 of 224 are shared (82 percent); of four-word ones 189 of 221 (85.5)
    at = [30, 80, 130, 180]
    near = [w + "x" if i in at else w for i, w in enumerate(base)]
    far = [w + "x" if i in [*at, 10] else w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far[100:] + base[:40]))], "doc_id long, text string")
    assert sorted(x.doc_id for x in cp.near_copies(spark, docs, str(tmp_path)).collect()) == [1, 3]
