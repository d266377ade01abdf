"""The queries of this subpackage and their SQL, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fingerprints, language_id, mixing, ngram_join, pii, quality, suffix_dedup, token_counts
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), g AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)
), h AS (
  SELECT g.doc_id, g.i, g.k, p.item_id FROM g JOIN p USING (k, s)
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(of(*pii.BASE)), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


#: The contract's patterns, and the added kinds' with a character on either side (RE2 has no look-around).
_OP4_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}",
    "local_phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}",
}
_OP4_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, t, '{kind}' AS kind, {rank} AS rank, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d))"""
    for rank, (kind, p) in enumerate(_OP4_PATTERNS.items())
)
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_OP4_FOUND}), n AS (
  SELECT *, s + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS digits, reverse(regexp_replace(v, '[^0-9]', '', 'g')) AS turned,
    substr(t, s, 1) AS before, substr(t, s + length(v) + 1, 1) AS after, lower(substr(t, greatest(s - 40, 0)::BIGINT + 1, least(s, 40)::BIGINT)) AS context,
    substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4) AS moved FROM f
), k AS (
  SELECT doc_id, kind, rank, s, e FROM n WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS INTEGER), 999) <= 255))
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN turned[i]::INT ELSE turned[i]::INT * 2 - CASE WHEN turned[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN NOT regexp_matches(before || after, '[A-Za-z0-9]') AND list_reduce(list_transform(string_split(moved, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97, 0) = 1
    ELSE NOT regexp_matches(before, '[0-9A-Za-z+(]') AND NOT regexp_matches(after, '[0-9A-Za-z]') AND regexp_matches(context, '(^|[^\p{{L}}\p{{N}}])({pii.CONTEXT["local_phone"]})($|[^\p{{L}}\p{{N}}])') END
), a AS (
  SELECT * FROM k WHERE rank < 4 UNION ALL
  SELECT * FROM k WHERE rank >= 4 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.rank < 4 AND b.doc_id = k.doc_id AND b.s < k.e AND k.s < b.e)
), l AS (SELECT *, kind || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM a)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, rank) FILTER (rank < 4), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def remainder(n: int) -> Column:
    """crc32 of doc_id as text modulo n; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    model = language_id.fit(language_id.training_sample(docs.filter(remainder(3) != 1)))
    return language_id.predict_language(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=("doc_id", "held_out"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    model = quality.fit(*quality.training_sample(docs, labels))
    out = quality.score_quality(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


#: Shares of the mixture by domain of the labelled table, and its size against the corpus.
MIXTURE = {"quality=1,toxic=0": 0.9, "quality=0,toxic=0": 0.07, "quality=1,toxic=1": 0.02, "quality=0,toxic=1": 0.01}
MIXTURE_SIZE = 0.9


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["quality", "toxic"], MIXTURE, MIXTURE_SIZE)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN 'all ' || array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


#: Fixed value: a conversation of control strings, added to the table.
CLASHING = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{CLASHING}' as text")
    return chat_format.read_back(chat_format.format_chats(rows.unionByName(more)))


OP10_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CLASHING}' UNION ALL SELECT -1, 1, 'assistant', '{CLASHING}'
), t AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 20 + length(role) END
    + length(text)
    + CASE WHEN regexp_matches(text, '\\[\\\[<>]|\[/?INST\]|</?s>|<</?SYS>>|<<ROLE:|<</ROLE>>')
           THEN length(regexp_replace(text, '[^\\\[<>]', '', 'g')) ELSE 0 END AS n
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars,
  sum(CASE WHEN regexp_matches(text, '\\[\\\[<>]|\[/?INST\]|</?s>|<</?SYS>>|<<ROLE:|<</ROLE>>') THEN 1 ELSE 0 END)::INTEGER AS n_escaped
FROM t GROUP BY conv_id
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op4_pii": OP4_SQL, "op9_ngram_join": OP9_SQL, "op10_chat_format": OP10_SQL}
