"""Text functions and entity rules on their behavioural cases, and against plain Python."""

import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.functions import fuzzy, text as tx
from corpuslens.functions.vectors import bag_vectors
from corpuslens.operators import chapters, chunking, entities
from corpuslens.operators.graph import components
from corpuslens.plans import queries
from corpuslens.sources import readers


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", fn(F.col("v")).alias("o"))
    return [r.o for r in df.orderBy("i").collect()]


def py_cleanse(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"^\s*\d+\s*$", "", t, flags=re.MULTILINE)
    return re.sub(r"\n{3,}", "\n\n", t.replace("--", "—")).strip()


def test_cleanse(spark):
    r = random.Random(1)
    bits = ["\r", "\n", "\r\n", " ", " ", "\x85", " ", "\x1c", "7", "12", "٣", "-", "--", "a", "B.", "\f", "́"]
    texts = ["Rain fell.\n107\nIt stopped.", "oak\r\nash\relm", "a\n\n\n\n\nb", " a -- b "] + ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    got = column(spark, texts, tx.cleanse)
    assert got[0] == "Rain fell.\n\nIt stopped." and got[1] == "oak\nash\nelm" and got[2] == "a\n\nb" and got[3] == "a — b"
    assert got == [py_cleanse(t) for t in texts]
    assert column(spark, got, tx.cleanse) == [py_cleanse(t) for t in got]


def test_tokens_titles_slugs_ids(spark):
    assert column(spark, ["Stop! Who's at (the) door?", "Ça_va 12"], tx.tokens) == [["stop", "who", "s", "at", "the", "door"], ["ça_va", "12"]]
    got = column(spark, ["Chapter 5: X", "Chapter 7 — X", "CHAPTER 1 - foo", "Title Page"], tx.parse_title)
    assert [tuple(x) if x else None for x in got] == [(5, "X"), (7, "X"), (1, "foo"), None]
    assert column(spark, ["T. M. Vale", "Éva Ön", ".", "a  b\n"], tx.slugify) == ["t_m_vale", "éva_ön", "", "a_b"]
    assert column(spark, ["Ann's", "Ann’S ", " Prof\nVale  x"], tx.normalise_mention) == ["Ann", "Ann", "Prof Vale x"]
    names = ["b1-c2-i0-chapter", "b3-c1-i12-paragraph"]
    assert column(spark, names, tx.uuid5) == [str(uuid.uuid5(uuid.UUID(tx.CHUNK_NAMESPACE), n)) for n in names]
    assert column(spark, ["he", "xy", "the man", "the old man", "Ann", ""], tx.is_useful_mention) == [False, False, False, True, True, False]
    assert column(spark, ["Ann and Bo", "old Bo", "Bo, sir", "a b c d e", "Mr. Vale"], tx.is_alias_candidate) == [False, False, False, False, True]
    assert column(spark, ["Mr. Vale", "the boy"], lambda c: F.array_sort(tx.significant(c))) == [["vale"], []]
    assert column(spark, ["2", "[1]", " [3] ", "x", "[[9"], tx.citation_number) == [2, 1, 3, None, 9]
    assert column(spark, [" a  b ", "x" * 300], lambda c: tx.snippet(c, 220)) == ["a b", "x" * 220 + "…"]
    assert column(spark, ["a, b,,c ", ""], tx.slug_list) == [["a", "b", "c"], []]


def test_whole_word(spark):
    df = spark.createDataFrame([("Ann met Bo.", "ann"), ("Annie", "ann"), ("o'neil ran", "O'Neil"), ("élan", "lan"), ("a x\\Ey b", "x\\Ey")], "t string, a string")
    assert [r[0] for r in df.select(tx.whole_word(F.col("t"), F.col("a"))).collect()] == [True, False, True, False, True]


def py_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_indel_ratio(spark):
    r = random.Random(2)
    pairs = [("thnudersotrm", "thunderstorm"), ("", ""), ("", "a"), ("abc", "abc")] + [("".join(r.choice("abcé") for _ in range(r.randint(0, 9))), "".join(r.choice("abcé") for _ in range(r.randint(0, 9)))) for _ in range(200)]
    got = [x[0] for x in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(fuzzy.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [py_ratio(a, b) for a, b in pairs])
    assert round(got[0], 2) == 83.33


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: root[n] for a, b in edges if a != b for n in (a, b)}


def counts(spark, rows):
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(rows)], "pos int, name string, cnt long")


def clusters_of(df):
    return {x.canonical: list(x.aliases) for x in df.collect()}


def test_alias_clusters(spark):
    pairs = lambda rows: {(x.a, x.b) for x in entities.alias_pairs(counts(spark, rows)).collect()}
    assert pairs([("Ann Vale", 9), ("Ann Mary Vale", 9)]) == {("Ann Vale", "Ann Mary Vale")}
    assert pairs([("Vale", 9), ("Ann Vale", 9)]) == set()
    assert pairs([("Hermiona", 9), ("Hcrmiona", 9)]) == {("Hermiona", "Hcrmiona")}  # 87.5
    assert pairs([("Hermiona", 9), ("Hcrmlona", 9)]) == set()  # 75
    assert pairs([("Mr. Vale", 9), ("Mrs. Vale", 9)]) == set()
    rare = [("Ann Vale", 9), ("Mary Vale", 8), ("Ann Mary Vale", 4)]
    assert clusters_of(entities.cluster_aliases(counts(spark, rare))) == {n: [n] for n, _ in rare}
    assert clusters_of(entities.cluster_aliases(counts(spark, [("Ann Vale", 9), ("Mary Vale", 8), ("Ann Mary Vale", 10)]))) == {"Ann Mary Vale": ["Ann Mary Vale", "Ann Vale", "Mary Vale"]}
    assert clusters_of(entities.cluster_aliases(counts(spark, [("Ann", 2), ("Bo", 3)]))) == {"Bo": ["Bo"]}


def entity_table(spark, rows):
    return spark.createDataFrame([(i, c, a) for i, (c, a) in enumerate(rows)], "pos long, canonical string, aliases array<string>")


def test_claim_slugs_overrides(spark):
    t = entity_table(spark, [("Ann Vale", ["Ann Vale"]), ("Ann", ["Ann"]), ("Reed", ["Reed"]), ("Bo Reed", ["Bo Reed"]), ("Kit Reed", ["Kit Reed"]), ("Ann Mary Vale", ["Ann Mary Vale"])])
    assert clusters_of(entities.claim_single_words(t)) == {"Ann Vale": ["Ann Vale", "Ann"], "Reed": ["Reed"], "Bo Reed": ["Bo Reed"], "Kit Reed": ["Kit Reed"], "Ann Mary Vale": ["Ann Mary Vale"]}
    ids = lambda names: [x.char_id for x in entities.to_entities(entity_table(spark, [(n, [n]) for n in names])).orderBy("pos").collect()]
    assert ids(["X", "x!", "x", "."]) == ["x", "x_2", "x_3"]
    assert ids(["x 2", "x", "x!"]) == ["x_2", "x", "x_3"]
    people = entities.to_entities(entity_table(spark, [("A", ["a"]), ("B", ["b", "a"]), ("C", ["c"]), ("D", ["d"])]))
    drops = spark.createDataFrame([("d",)], "char_id string")
    merges = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "nobody"), (1, 0, "missing"), (1, 1, "c"), (2, 0, "c")], "group int, place int, char_id string")
    assert {x.char_id: list(x.aliases) for x in entities.apply_overrides(people, drops, merges).collect()} == {"a": ["a", "B", "b"], "c": ["c"]}


def test_coref(spark):
    persons = spark.createDataFrame([(1, 0, 8, "Ann Vale"), (2, 0, 8, "Ann Vale"), (3, 0, 8, "Ann Vale"), (3, 20, 27, "Bo Reed")], "chapter_id int, start int, end int, text string")
    rows = []
    for ch in (1, 2):
        rows += [(ch, 0, 0, 8, "Ann Vale"), (ch, 0, 50, 59, "Miss Vale"), (ch, 0, 70, 79, "The Queen")]
    rows += [(3, 0, 0, 8, "Ann Vale"), (3, 0, 20, 27, "Bo Reed"), (3, 0, 50, 59, "Miss Vale"), (1, 1, 0, 8, "Ann Vale"), (1, 1, 90, 99, "once Vale"), (1, 1, 60, 90, "a very long tale of Vale")]
    got = entities.dominant_owners(entities.coref_counts(spark.createDataFrame(rows, "chapter_id int, cluster_id int, start int, end int, text string"), persons))
    assert [(x.title, list(x.owners)) for x in got.collect()] == [("Miss Vale", ["Ann Vale"])]
    tie = spark.createDataFrame([("t", "a", 2, 2), ("t", "b", 2, 1)], "title string, owner string, cnt long, first_seen int")
    assert entities.dominant_owners(tie).first().owners == ["b", "a"]
    base = entity_table(spark, [("Ann Vale", ["Ann Vale"]), ("Miss Vale", ["Miss Vale"]), ("Bo", ["Bo"])])
    resolved = spark.createDataFrame([(0, "Miss Vale", ["Ann Vale"]), (1, "x", ["Bo", "Ann Vale"]), (2, "The Bo", ["Bo"])], "pos int, title string, owners array<string>")
    assert clusters_of(entities.merge_coref(base, resolved)) == {"Ann Vale": ["Ann Vale", "Miss Vale"], "Bo": ["Bo", "The Bo"]}
    assert clusters_of(entities.merge_coref(base, resolved.filter("pos = 2")))["Bo"] == ["Bo", "The Bo"]


def test_tagging(spark):
    people = spark.createDataFrame([(0, "ann", "Ann", ["Ann", "Annie V."]), (1, "bo", "Bo", ["Bo"]), (2, "dots", "Dots", ["..."])], "pos long, char_id string, label string, aliases array<string>")
    chunks = spark.createDataFrame([(1, "BO and ann and Ann"), (2, "Bob"), (3, ""), (4, "a...b"), (5, None)], "id int, text string")
    assert {x.id: list(x.characters) for x in entities.tag_characters(chunks, people).collect()} == {1: ["ann", "bo"], 2: [], 3: [], 4: ["dots"], 5: []}


def py_fold(s, n, like, threshold, least, most, overlap):
    if not s:
        return []
    out, cur, count = [], [0], n[0]
    for i in range(1, len(s)):
        if count + n[i] > most or (like[i] < threshold and count >= least):
            out.append(cur)
            cur = (cur[-overlap:] if overlap else []) + [i]
            count = sum(n[k] for k in cur)
        else:
            cur, count = cur + [i], count + n[i]
    return [" ".join(s[k] for k in c) for c in out + [cur]]


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_chunk_fold(spark, overlap):
    r = random.Random(overlap)
    rows = []
    for i in range(60):
        k = r.randint(0, 25)
        rows.append((i, [(f"s{j}", r.choice([1, 5, 40, 120, 500]), r.random()) for j in range(k)]))
    df = spark.createDataFrame(rows, "i int, parts array<struct<s:string,n:int,like:double>>")
    got = {x.i: x.o for x in df.select("i", F.transform(F.array("parts"), lambda p: chunking.fold(p, overlap=overlap))[0].alias("o")).collect()}
    for i, p in rows:
        assert got[i] == py_fold([x[0] for x in p], [x[1] for x in p], [x[2] for x in p], 0.35, 100, 400, overlap)


def test_chunk_chapters(spark):
    text = " ".join(f"Word{i} of sentence number {i} goes here now." for i in range(120))
    ch = spark.createDataFrame([(1, 1, "One", 3, text), (1, 2, "Two", 9, "")], "book_num int, chapter_num int, chapter_title string, page_start int, text string")
    rows = chunking.chunk_chapters(ch, encode=lambda s: np.ones((len(s), 1))).collect()
    again = chunking.chunk_chapters(ch).collect()
    assert {x.id for x in rows} >= {x.id for x in again if x.chunk_index == 0} and len({x.id for x in rows}) == len(rows)
    paragraphs = sorted((x for x in rows if x.chunk_type == "paragraph"), key=lambda x: x.chunk_index)
    assert len(paragraphs) == 3 and [x.chunk_index for x in paragraphs] == [0, 1, 2] and all(x.page_start == 3 for x in paragraphs)
    assert sum(x.chunk_type == "chapter" for x in rows) == 2
    assert np.allclose((bag_vectors(["a b", None]) ** 2).sum(1), [1, 0])


def test_outline(spark):
    outline = spark.createDataFrame([(0, 1, "Volume 1", 1), (1, 2, "Chapter 1: A", 2), (2, 2, "Chapter 2: B", 270), (3, 1, "Volume 2", 276), (4, 2, "Chapter 1: C", 281), (5, 2, "Notes", 300)], "pos int, level int, title string, page int")
    r = chapters.outline_ranges(outline, 400, "volume").orderBy("pos").collect()
    assert [(x.book_num, x.chapter_num, x.page_start, x.page_end) for x in r] == [(1, 1, 2, 269), (1, 2, 270, 280), (2, 1, 281, 400)]
    pages = spark.createDataFrame([(2, " one. "), (3, " "), (4, "two"), (5, "three”"), (269, "end")], "page_num int, text string")
    got = chapters.chapters_from_outline(outline, pages, 400, "Volume").collect()
    assert [(x.chapter_num, x.text) for x in got] == [(1, "one.\n\ntwo three” end")]
    books = chapters.by_book(chapters.chapters_from_outline(outline, pages, 400, "volume"), chapters.book_titles(outline, "volume").limit(0))
    assert books.first().title == "Book 1" and chapters.flatten_books(books).first().chapter_title == "A"


def test_alias_pairs_are_those_of_all_pairs(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    names = []
    for n in range(1, 21):
        for _ in range(12):
            w = word(n)
            names.append(w)
            for _ in range(r.randint(1, 4)):
                i = r.randrange(len(w) + 1)
                w = r.choice([w[:i] + word(1) + w[i:], w[:i] + w[i + 1 :] or w])
                names.append(w)
    names += [" ".join(r.choice(["ann", "bo", "vale", "reed", "kit", "cole"]) for _ in range(r.randint(2, 4))) for _ in range(120)]
    names = sorted(set(names), key=lambda x: (len(x) % 7, x))
    rows = [(x.title(), r.randint(2, 7)) for x in names]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(row)
            last = row[0]
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    want = set()
    for j, (b, cb) in enumerate(rows):
        for a, ca in rows[:j]:
            x, y = set(a.lower().split()), set(b.lower().split())
            if min(ca, cb) < 3 or (len(x) > 1) != (len(y) > 1):
                continue
            if len(x) == 1 and " " not in a + b and 200 * lcs(a.lower(), b.lower()) >= 85 * (len(a) + len(b)):
                want.add((a, b))
            if len(x) > 1 and (x <= y or y <= x) and not (min(len(x), len(y)) > 1 and max(len(x), len(y)) >= 3 and (ca if len(x) > len(y) else cb) < 5):
                want.add((a, b))
    got = [(x.a, x.b) for x in entities.alias_pairs(counts(spark, rows)).collect()]
    single = {n for n, _ in rows if " " not in n or len(set(n.split())) > 1}
    got = [p for p in got if set(p) <= single]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_entity_queries_take_all_names(spark, tmp_path):
    letters = "abcdefghij"
    names = ["".join(letters[int(d)] * 2 for d in f"{i:03d}").title() for i in range(500)]
    docs = [(i, f"{n} 1 {n} 2 {n} 3", "en", "s0", 9) for i, n in enumerate(names)] + [(500, "Zoe Quill 1 Zoe Quill 2 Zoe Quill 3 Zoe May Quill 1 Zoe May Quill 2 Zoe May Quill 3 Zoe May Quill 4 Zoe May Quill 5", "en", "s0", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    path = str(tmp_path)
    numbered = queries._counts(spark, path).orderBy("pos").collect()
    assert [x.pos for x in numbered] == list(range(502)) and [x.name for x in numbered] == ["Zoe May Quill", *sorted([*names, "Zoe Quill"])]
    assert ("Zoe May Quill", "Zoe Quill") in {(x.a, x.b) for x in queries.alias_pairs(spark, path).collect()}
    assert sum(len(x.aliases.split("|")) for x in queries.alias_clusters(spark, path).collect()) == 502
    tags = {x.id: x.characters for x in queries.tag_characters(spark, path).collect()}
    assert tags == {**{i: n.lower() for i, n in enumerate(names)}, 500: "zoe_may_quill,zoe_quill"}
    assert queries.cluster_totals(spark, path).count() == 502


def test_coref_titles_take_all_mentions(spark, tmp_path):
    text = " 1 ".join(f"Zoe{chr(97 + i // 26)}{chr(97 + i % 26)} Quill{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(45))
    spark.createDataFrame([(i, text) for i in range(2)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.title: x.owners for x in queries.coref_titles(spark, str(tmp_path)).collect()}
    assert len(got) == 45 and got["that quillbs"] == "Zoebs Quillbs"


def test_titles_and_ids_as_one_after_the_other_would_have_them(spark):
    r = random.Random(17)
    for _ in range(3):
        names = [f"n{i}" for i in range(9)]
        base = [(i, n, r.sample([n, *r.sample(names, 2)], 2)) for i, n in enumerate(r.sample(names, 6))]
        titles = [(i, t, [r.choice([*names, "t1", "t2", "t3"])] if r.random() < 0.9 else ["n1", "n2"]) for i, t in enumerate(r.sample([*names, "t1", "t2", "t3", "t4"], 9))]
        plain = {c: list(a) for _, c, a in base}
        for _, title, owners in titles:
            homes = [c for c, a in plain.items() if len(owners) == 1 and owners[0] in [c, *a]]
            if homes:
                plain[homes[0]] += [title] * (title not in plain[homes[0]])
                if homes[0] != title:
                    plain.pop(title, None)
        c = spark.createDataFrame(base, "pos long, canonical string, aliases array<string>")
        t = spark.createDataFrame(titles, "pos long, title string, owners array<string>")
        assert {x.canonical: list(x.aliases) for x in entities.merge_coref(c, t).collect()} == plain
    slugs = [r.choice(["a", "a_2", "a_2_2", "b", "a_3", "A!", "?"]) for _ in range(30)]
    taken, want = set(), []
    for s in slugs:
        s = s.lower().replace("!", "").replace("?", "")
        if s:
            k = next(k for k in range(1, 99) if (s if k == 1 else f"{s}_{k}") not in taken)
            want.append(s if k == 1 else f"{s}_{k}")
            taken.add(want[-1])
    got = entities.to_entities(spark.createDataFrame([(i, s, [s]) for i, s in enumerate(slugs)], "pos long, canonical string, aliases array<string>"))
    assert [x.char_id for x in got.orderBy("pos").collect()] == want


def test_words_meet_by_few_keys_and_clusters_by_stars(spark):
    rng = random.Random(5)
    made = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([3, 5, 6, 7, 8, 9, 12, 15, 17, 21]))).title() for _ in range(90)} | {"Abcabcab" + x for x in "defghijklm"})
    made += [x[:4] + "c" + x[4:] for x in made if len(x) > 11]
    made = sorted(set(made))
    c = counts(spark, [(x, 9) for x in made])
    low = [x.lower() for x in made]
    alike = {(made[i], made[j]) for j in range(len(made)) for i in range(j) if 200 * entities._common(low[i], low[j]) >= 85 * (len(low[i]) + len(low[j]))}
    assert {(x.a, x.b) for x in entities.alias_pairs(c).collect()} == alike and len(alike) > 60
    root = {x: x for x in made}
    for _ in made:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(map(sorted, (x.aliases for x in entities.cluster_aliases(c).collect()))) == sorted(sorted(x for x in made if root[x] == r) for r in set(root.values()))
    # ten words of one subsequence are linked through one of them
    links = entities._spelled_links(entities._spelled(c.filter("name LIKE 'Abcabcab_'").select(F.col("pos").cast("long").alias("pos"), "name", F.lower("name").alias("w")), 85), 85)
    assert links.count() == 9
    assert entities.MOST_KEPT == 500 and len(entities._keys("abcdefgh", 85)) < 60


def test_words_meet_by_numbers_and_each_pair_once(spark):
    # of six and seven letters, sharing many subsequences, so the pairs meet by several keys
    words = ["Aabbcc", "Aabbccd", "Aabbcca", "Xaabbcc"]
    one = counts(spark, [(x, 9) for x in words]).select(F.col("pos").cast("long").alias("pos"), "name", F.lower("name").alias("w"))
    met = entities._met(*(entities._spelled(one, 85, longer) for longer in (False, True)))
    assert {t for _, t in met.dtypes} == {"bigint"}
    low = one.orderBy("pos").collect()
    alike = sorted((x.pos, y.pos) for x in low for y in low if x.pos < y.pos and 200 * entities._common(x.w, y.w) >= 85 * (len(x.w) + len(y.w)))
    assert sorted(map(tuple, met.collect())) == sorted((x.a_pos, x.b_pos) for x in entities._spelled_alike(met, one, 85).collect()) == alike and len(alike) > 3
    for w in words:
        assert sorted(k for side in (False, True) for k in entities._keys(w, 85, (side,))) == sorted(entities._keys(w, 85))


def test_paragraphs_are_those_of_the_fold_and_chapters_are_numbered_in_place(spark):
    r = random.Random(23)
    texts = [" ".join(" ".join(r.choice(["sea", "ship", "mast", "old　rope", "x"]) for _ in range(r.choice([1, 4, 30, 150, 420]))) + ". " for _ in range(r.randint(0, 30))) for _ in range(30)] + [None, "one"]
    docs = spark.createDataFrame([(i // 2 if i < 4 else i, f"s{i % 3}" if i > 3 else "s0", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    ch = readers.documents_as_chapters(docs)
    for overlap in (0, 1, 2):
        want = chunking.sentence_parts(ch).select("book_num", "chapter_num", F.posexplode(F.transform(F.array("parts"), lambda p: chunking.fold(p, overlap=overlap))[0]))
        got = chunking.paragraph_chunks(ch, overlap=overlap).select("book_num", "chapter_num", "chunk_index", "text").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) > 100
    numbers = sorted((x.book_num, x.chapter_num, x.doc_id) for x in ch.collect())
    assert [x[1] for x in numbers if x[0] == 1] == list(range(1, 1 + sum(x[0] == 1 for x in numbers))) and len(numbers) == 32
    for book in {x[0] for x in numbers}:
        assert (own := [x[2] for x in numbers if x[0] == book]) == sorted(own)
    # texts are not shuffled to be numbered, if none share their id
    plan = readers.documents_as_chapters(docs.filter("doc_id > 3"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize(("apart", "n"), [(1, 520_000), (2**43, 520_000), (2**60 + 1, 7)])
def test_chapters_of_many_documents_are_numbered_without_moving_texts(spark, apart, n):
    # ids on both sides of 0, that of one source twice, and none
    rows = spark.range(n).select(((F.col("id") - n // 2) * F.lit(apart)).alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    more = spark.createDataFrame([(0, "s9"), (0, "s9"), (4097, "s9"), (-1, "s9"), (None, "s9"), (None, "s9")], "doc_id long, source string")
    docs = rows.unionByName(more).withColumn("text", F.lit("x"))
    found = readers.documents_as_chapters(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == plan.count("Join Inner") > 0
    want = docs.select(F.dense_rank().over(Window.orderBy("source")).alias("book_num"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("chapter_num"), "doc_id")
    digest = lambda d: d.select(F.count(F.lit(1)), F.sum(F.xxhash64("book_num", "chapter_num", "doc_id").cast("decimal(38,0)"))).first()
    assert digest(found) == digest(want)
    alone = readers.documents_as_chapters(rows.withColumn("text", F.lit("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in alone and "strategy=broadcast" in alone
