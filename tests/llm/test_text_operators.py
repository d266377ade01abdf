"""Operators 1, 3, 4, 5 and 10 against plain Python on small and awkward tables."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from corpuslens.llm import chat_format, decontaminate, fingerprints, pii, token_counts

DOCS = "doc_id long, text string, n_words string, spans string"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts, start)], DOCS)


# ---- 1 decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute_hits(text, items, window):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, s in items:
        w = WORD.findall(lower(s))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontaminate(spark, block_bytes):
    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "Ab", "é", "ß1", "the", "9"])
    items = [(i, " ".join(word() for _ in range(r.randint(0, 9)))) for i in range(12)] + [(None, "a b a b a"), (3, "the é the é"), (50, None), (51, ".,;"), (52, "9")]
    texts = [r.choice([" ", ", ", "--"]).join(word() for _ in range(r.randint(0, 60))) for _ in range(40)] + [None, "", "...", "a", "a", LONG]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, texts), bench, window=4, block_bytes=block_bytes).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items, 4)
        assert (got[i].n_words, got[i].n_hit, list(got[i].items)) == (n, hit, found), t
        assert sum(s.end - s.start for s in got[i].hit_spans) == hit
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)


def test_decontaminate_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.decontaminate(docs(spark, ["a b", None]), bench).collect()
    assert [(x.n_words, x.n_hit, x.contaminated) for x in sorted(out, key=lambda x: x.doc_id)] == [(2, 0, False), (0, 0, False)]
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0


# ---- 3 token counts


def test_tokens_as_the_library_counts_them(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_counts.tokenizer(path)
    r = random.Random(5)
    bits = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", " ", " ", "　", "'s", "'re", "é", "́", "中", "😀", "١", "Ⅷ", "a", "the", "ing", "ABC", "123", "_", "-", "​", "\r\n", "\x00"]
    count = lambda s: lib.encode(s, add_special_tokens=False).ids
    for _ in range(1500):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        assert token_counts.encode_spliced(own, s, 8, 4).tolist() == count(s)
    texts = [None, "", "a <|endoftext|> b", LONG, LONG, "x" * 5000, " " * 5000, "ab" * 3000 + " c" * 3000]
    got = {x.doc_id: x for x in token_counts.token_counts(docs(spark, texts), path, chunk_chars=1000, overlap_chars=16).collect()}
    for i, t in enumerate(texts):
        n = len(count(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


# ---- 4 PII

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_pii_base_spans_are_those_of_plain_patterns(spark):
    r = random.Random(7)
    bits = ["a@b.c", "_d@e.f", "@", ".", "1", "25", "255", "256", "00", "7.7.7.7", "4068516892505468", "4068 5168-9250 5468", "-", " ", "+1 (017) 555-7713", "+", "(", ")", "x", "é", "😀", "\n", "9" * 12, "0" * 25]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", "mail " * 3000 + "x@y.zz", "1" * 60_000, "1 " * 30_000, "a" * 60_000, "+1" + " " * 30_000, "1.2." * 5000, "1-1" * 10_000]
    got = {x.doc_id: x.spans for x in pii.find_pii(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in got[i] if s.kind in pii.BASE] == brute_base(t), t
        assert list(got[i]) == sorted(got[i], key=lambda s: (s.start, s.rank))


def test_pii_checks_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 01", "call 555-123-4567 now", "part 555-123-4567 now", "Konto: GB82WEST12345698765432"]
    found = pii.find_pii(docs(spark, texts)).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in x.spans] for x in found] == [[("iban", 5, 32)], [], [("local_phone", 5, 17)], [], [("iban", 7, 29)]]
    assert found[4].spans[0].score == 1.0
    out = pii.find_pii(docs(spark, ["to a@b.cc, 1.2.3.4"]), keep=("doc_id", "text")).select(pii.redact(pii.F.col("text"), pii.F.col("spans"))).first()[0]
    assert out == "to <EMAIL>, <IP>"
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_ibans_with_capitals_digits_and_words_behind_them(spark):
    spaced, solid = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    behind = ["", ".", " BIC COBADEFF", " Please pay", " 12 EUR", " A", " " + solid + " X1", "\n" + solid]
    texts = [f"é {n}{b}" for n in (spaced, solid) for b in behind] + [spaced + "X", spaced + "1", "X" + spaced, spaced[:-1] + "1 BIC COBADEFF"]
    found = pii.find_pii(docs(spark, texts)).orderBy("doc_id").collect()
    got = [[texts[x.doc_id][s.start : s.end] for s in x.spans if s.kind == "iban"] for x in found]
    assert got == [[n] + [solid] * (solid in b) for n in (spaced, solid) for b in behind] + [[]] * 4
    clean = pii.find_pii(docs(spark, texts[2:4]), keep=("doc_id", "text")).select("doc_id", pii.redact(pii.F.col("text"), pii.F.col("spans"))).collect()
    assert sorted(x[1] for x in clean) == ["é <IBAN> BIC COBADEFF", "é <IBAN> Please pay"]


# ---- 5 fingerprints


def test_fingerprints(spark):
    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 8))) for _ in range(n))
    texts = [text(r.choice([0, 1, 5, 300])) for _ in range(60)] + [None, "", "same", "same", text(9000)]
    ids = r.sample(range(-500, 500), len(texts))
    rows = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fingerprint string").repartition(5)
    got = {x.doc_id: x for x in fingerprints.compare_edits(rows, bucket_rows=7).collect()}
    order = sorted(zip(ids, texts))
    assert len(got) == len(texts)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        k = len(t) // 4
        want = t[: len(t) - k] + n[:k]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1
        if len(t) > 1000:
            assert got[i].near_edited > 0.6
    plain = {x.doc_id: x.fingerprint for x in fingerprints.fingerprints(rows).collect()}
    assert plain == {i: x.fingerprint for i, x in got.items()}
    by_text = {}
    for i, t in zip(ids, texts):
        assert by_text.setdefault(t or "", plain[i]) == plain[i]
    one = fingerprints.compare_edits(docs(spark, ["only"])).first()
    assert one.near_next == 1.0
    assert fingerprints.compare_edits(docs(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (1, "bb"), (None, "c")], "doc_id long, text string")
    assert fingerprints.compare_edits(nulls, bucket_rows=1).count() == 3


def test_chunks_return_after_an_insertion():
    r = random.Random(2)
    import pyarrow as pa

    s = "".join(r.choice("abcdefgh ") for _ in range(20_000))
    a, b = fingerprints.chunk_sets(pa.array([s, s[:7000] + "inserted" + s[7000:]]))
    assert fingerprints.containment(a, b) > 0.95


# ---- 10 chat formatting


def test_chat_round_trip(spark):
    r = random.Random(13)
    bits = ["[INST]", " [/INST]", "</s>", "<s> ", "<<SYS>>", " <</SYS>>", "<<ROLE:", ">>", "\\", "\\[", "<", "[", " ", "ok", "é😀", "\n", ""]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 6)))
    roles = ["user", "assistant", "system", None, "", "tool", ">>x", "a\\<b"]
    rows = [(c, t, r.choice(roles), r.choice([text(), text(), None]), "z") for c in range(200) for t in range(r.randint(1, 6))] + [(None, 0, "user", "hi", "z"), (0, None, "user", "first", "z"), (999, 0, "assistant", LONG, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_chats(df)
    got = {x.conv_id: x for x in chat_format.read_back(formatted).collect()}
    texts = {x.conv_id: x.formatted for x in formatted.collect()}
    for c in {x[0] for x in rows}:
        turns = sorted([(-1 if t is None else t, role or "", x or "") for k, t, role, x, _ in rows if k == c])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(texts[c])
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_plain_texts_are_not_escaped():
    s, spans, n = chat_format.format_turns([("user", "a [b] <c>"), ("assistant", "d")])
    assert (s, n) == ("[INST] a [b] <c> [/INST]<s> d </s>", 0)
    assert s[spans[0][0] : spans[0][1]] == "d"
    with pytest.raises(chat_format.GrammarError):
        chat_format.parse("[INST] a </s> [/INST]")


def test_runs_of_white_space_and_overlaps_that_widen(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_counts.tokenizer(path)
    count = lambda s: lib.encode(s, add_special_tokens=False).ids
    for s in ("x" + " " * 2_000_000 + "y", "\n" * 2_000_000, "a" + "\t" * 5000 + "<|endoftext|>" + " " * 5000 + "b"):
        assert token_counts.encode_spliced(own, s).tolist() == count(s)
    # the overlaps of 4 characters hold no two places that both scans show: special strings lie over them, or one run
    scans = []
    encode = own.encode
    own.encode = lambda text: scans.append(text) or encode(text)
    try:
        for s in ("ab" * 40 + " c, d, e, f" * 9, "<|endoftext|>" * 20 + "a b c d " * 9, "a b, " * 60):
            scans.clear()
            assert token_counts.encode_spliced(own, s, 16, 4).tolist() == count(s)
            # a chunk that was scanned again is longer than it was
            assert any(len(y) > len(x) and y.startswith(x) for x, y in zip(scans, scans[2:]))
    finally:
        own.encode = encode
    rows = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, n_tokens int, over_limit int")
    assert token_counts.token_counts(rows, path, keep=("doc_id", "n_tokens", "over_limit")).first().asDict() == {"doc_id": 1, "n_bytes": 3, "n_tokens": 2, "over_limit": False}


def test_files_with_other_rules_are_refused(tmp_path):
    plain = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "ba": 3}, "merges": [["a", "b"], ["b", "a"]]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "normalizer": None, "added_tokens": []}
    token_counts._check(plain)
    other = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"model": plain["model"] | {"ignore_merges": True}}, {"model": plain["model"] | {"merges": [["b", "a"], ["a", "b"]]}}]
    for x in other:
        with pytest.raises(ValueError):
            token_counts._check(plain | x)


def test_pii_of_many_spans_and_clashing_names(spark):
    n = 20_000
    text = "".join(f"mail us{i}@ex{i}.com call 555-123-{1000 + i % 9000} or " for i in range(n))
    rows = spark.createDataFrame([(1, text, 5, 6, 7)], "doc_id long, text string, _base int, _added int, _0 int")
    x = pii.find_pii(rows, keep=("doc_id", "_base", "_added", "_0")).first()
    assert (x._base, x._added, x._0) == (5, 6, 7)
    assert [f"{s.kind}:{s.start}:{s.end}" for s in x.spans if s.kind in pii.BASE] == brute_base(text)
    assert [(s.start, s.end) for s in x.spans if s.kind == "local_phone"] == [m.span() for m in re.finditer(r"555-123-\d{4}", text)]


def test_fingerprints_by_brute_force():
    f = fingerprints
    r = random.Random(21)
    texts = ["".join(r.choice("abcdefgh \né") for _ in range(r.choice([0, 3, 31, 32, 33, 500, 4000]))) for _ in range(40)] + ["a" * 3000, ""]
    sets = f.chunk_sets(pa.array(texts, pa.large_string()))
    plain = []
    for t in texts:
        raw, chunks, start = t.encode(), {}, 0
        while start < len(raw):
            end = min(len(raw), start + f.LARGEST)
            for at in range(start + f.SMALLEST, end):
                # a hash ends with the byte before the boundary; it takes 32 bytes, of this text where a chunk is that long
                h = sum(int(f._GEAR[raw[at - 1 - k]]) << k for k in range(min(32, at))) % (1 << 32)
                if h < 1 << (32 - (f.STRICT_BITS if at < start + f.NORMAL else f.LOOSE_BITS)):
                    end = at
                    break
            chunks[hashlib.blake2b(raw[start:end], digest_size=f._DIGEST_BYTES).digest()] = end - start
            start = end
        plain.append(chunks)
    assert sets == plain
    for a, b in zip(plain, plain[1:]):
        shared = sum(n for d, n in a.items() if d in b)
        assert f.containment(a, b) == (shared / min(sum(a.values()), sum(b.values())) if a and b else float(a == b))


def test_decontamination_in_blocks_with_clashing_names(spark):
    r = random.Random(31)
    word = lambda: r.choice(["ab", "cd", "é", "x1", "zz"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 3, 13, 30])))) for i in range(40)]
    texts = [" ".join(word() for _ in range(40)) + " " + items[i % 40][1] for i in range(60)] + [None, "", "?!", None]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, _key int, _0 int, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    keep = ("doc_id", "_key", "_0", "n_hit")
    key = lambda x: (x.doc_id, x._key, x._0, x.n_words, x.n_hit, sorted(x["items"]), x.contaminated)
    one, many = (sorted(map(key, decontaminate.decontaminate(df, bench, keep=keep, block_bytes=b).collect())) for b in (1 << 20, 500))
    assert one == many and len(one) == len(texts)
    for d, k, z, n, hit, found, _ in one:
        assert (k, z) == (1, 2) and (n, hit) == brute_hits(texts[d], items, 13)[:2]
