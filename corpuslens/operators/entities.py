"""Entities: mention counts, alias clusters, co-reference titles, overrides, tagging.

Order matters in several rules (first seen wins). It is carried as an explicit ``pos``.
Shapes: mentions (name), counts (pos, name, cnt), clusters (pos, canonical, aliases),
entities (pos, char_id, label, aliases).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import holds_word, is_alias_candidate, normalise_mention, pieces, shares_significant, significant, slugify, tokens, whole_word
from .graph import components, cut_lineage

SIMILARITY, LEAST_COUNT, ANCHOR_COUNT, DOMINANCE, LEAST_TITLES, MAX_WORDS = 85, 3, 5, 2.0, 2, 4
#: Words with more subsequences than this are blocked by segments.
MOST_KEPT = 500

#: Stand-in for a tagger: runs of one to four capitalised words.
NAMES = r"\p{Lu}[\p{L}’']+(?: \p{Lu}[\p{L}’']+){0,3}"

#: Characters of which only one of tokens and word boundaries makes a part of words.
ODD_WORDS = r"(?U)[\w&&[^\p{L}\p{N}_]]|[\p{L}\p{N}&&[^\w]]"


def name_spans(text: Column) -> Column:
    """Surrogate person tagger: array<string> of capitalised sequences."""
    return F.regexp_extract_all(text, F.lit(NAMES), F.lit(0))


def count_mentions(mentions: DataFrame) -> DataFrame:
    """(name, cnt) of normalised mentions(name); longer names must pass as alias candidates."""
    named = mentions.select(normalise_mention(F.col("name")).alias("name")).filter("name <> ''")
    return named.filter((F.size(pieces(F.col("name"))) == 1) | is_alias_candidate(F.col("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("cnt"))


def alias_pairs(counts: DataFrame, least_count: int = LEAST_COUNT, similarity: float = SIMILARITY, anchor_count: int = ANCHOR_COUNT) -> DataFrame:
    """(a, b) of names of one person, a before b by pos.

    Longer names pair if the words of one hold those of the other: the smaller one's
    rarest word is looked up among all words. Single words pair by spelling,
    blocked by shared subsequences (see _spelled_alike).
    Of two names with two significant parts or more, a larger one of three or more must be frequent.
    """
    many, one = _countable(counts, least_count)
    long_pairs = _held(many, anchor_count).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"))
    met = _met(*(_spelled(one, similarity, longer) for longer in (False, True)))
    return long_pairs.unionByName(_spelled_alike(met, one, similarity).select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))).distinct()


def _countable(counts: DataFrame, least_count: int) -> tuple[DataFrame, DataFrame]:
    """Names of enough mentions: of several words, and of one."""
    low = F.lower("name")
    names = counts.filter(F.col("cnt") >= least_count).select(F.col("pos").cast("long").alias("pos"), "name", "cnt", low.alias("w"), F.array_distinct(pieces(low)).alias("words"), F.size(significant(F.col("name"))).alias("sig"))
    return names.filter(F.size("words") > 1), names.filter(F.size("words") == 1)


def _held(many: DataFrame, anchor_count: int) -> DataFrame:
    """(a, b) of longer names, as structs, of which one holds the words of the other."""
    whole = F.struct("pos", "name", "cnt", "sig", "words")
    parts = many.select(F.explode("words").alias("part"), whole.alias("y"))
    rarest = parts.join(parts.groupBy("part").agg(F.count(F.lit(1)).alias("k")), "part").groupBy(F.col("y.pos").alias("pos")).agg(F.min(F.struct("k", "part")).alias("r"))
    held = many.join(rarest, "pos").select(F.col("r.part").alias("part"), whole.alias("x")).join(parts, "part")
    held = held.filter((F.col("x.pos") != F.col("y.pos")) & (F.size(F.array_except("x.words", "y.words")) == 0))
    first = F.col("x.pos") < F.col("y.pos")
    met = held.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    larger_cnt = F.when(F.col("a.sig") > F.col("b.sig"), F.col("a.cnt")).otherwise(F.col("b.cnt"))
    rare_anchor = (F.least("a.sig", "b.sig") > 1) & (F.greatest("a.sig", "b.sig") >= 3) & (larger_cnt < anchor_count)
    return met.filter(~rare_anchor)


def _spelled(words: DataFrame, similarity: float, longer: bool | None = None) -> DataFrame:
    """(key, sure, longer, pos, name, w) of words(pos, name, w): what those whose Indel ratio is similarity at least meet by; longer: only the keys of that side.

    Words of n <= m letters are alike if and only if they share a subsequence of l letters, so words of
    any two such lengths meet by theirs: an equi-join on whole subsequences, which few others share. Lengths for which a word
    has more than MOST_KEPT of them (names of some 14 letters and more) meet by segments instead: l common letters leave n - l and m - l
    deletions and insertions, each of which spoils one of that many segments and one more of the shorter word at most, so one stands in the
    longer word, moved by no more than that. No pair is missed; with the first kind of key (sure), none meets that is not alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for low in range(0, t.num_rows, 2000):
                part = t.slice(low, 2000)
                made = [_keys(w, similarity, (False, True) if longer is None else (longer,)) for w in part.column("w").to_pylist()]
                size = [len(x) for x in made]
                at = pa.array(np.repeat(np.arange(len(made)), size))
                flat = [x for own in made for x in own]
                columns = [pa.array([x[0] for x in flat], pa.string()), *(pa.array([x[c] for x in flat], pa.bool_()) for c in (1, 2)), part.column("pos").take(at), part.column("name").take(at), part.column("w").take(at)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "sure", "longer", "pos", "name", "w"])

    return words.select("pos", "name", "w").mapInArrow(run, "key string, sure boolean, longer boolean, pos long, name string, w string")


def _met(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """(a_pos, b_pos), each once, of words that share a key, a before b; keys are joined as hashes and rows hold numbers only, so some that share none may be among them."""
    x, y = (side.select(F.xxhash64("key").alias("key"), F.col("pos").alias(f"{n}_pos"), F.length("w").alias(f"{n}_n")) for side, n in ((shorter, "x"), (longer, "y")))
    met = x.join(y, "key").filter("x_pos < y_pos OR x_pos > y_pos AND x_n < y_n")
    return met.select(F.least("x_pos", "y_pos").alias("a_pos"), F.greatest("x_pos", "y_pos").alias("b_pos")).distinct()


def _spelled_alike(met: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a_pos, a_name, a_w, b_pos, b_name, b_w) of those pairs of met(a_pos, b_pos) that are alike, with words(pos, name, w)."""
    a, b = (words.select(*(F.col(c).alias(f"{n}_{c}") for c in ("pos", "name", "w"))) for n in "ab")
    flat = met.join(a, "a_pos").join(b, "b_pos").select("a_pos", "a_name", "a_w", "b_pos", "b_name", "b_w")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            words = zip(t.column("a_w").to_pylist(), t.column("b_w").to_pylist(), strict=True)
            yield t.filter(pa.array([200 * _common(x, y) >= similarity * (len(x) + len(y)) for x, y in words], pa.bool_()))

    return flat.mapInArrow(check, flat.schema)


def _spelled_links(keyed: DataFrame, similarity: float) -> DataFrame:
    """(a, b), places of words that are alike or linked by such: every word of a sure key to the key's first one, and pairs by other keys."""
    w = Window.partitionBy("key")
    met = keyed.filter("sure").select("key", "longer", "pos").withColumns({"a": F.min("pos").over(w), "some": F.max("longer").over(w), "all": F.min("longer").over(w)})
    stars = met.filter("some AND NOT all AND a <> pos").select("a", F.col("pos").alias("b"))
    unsure = keyed.filter("NOT sure")
    alike = _spelled_alike(_met(unsure.filter("NOT longer"), unsure.filter("longer")), unsure.select("pos", "name", "w").distinct(), similarity)
    return stars.unionByName(alike.select(F.col("a_pos").alias("a"), F.col("b_pos").alias("b"))).distinct()


def _keys(w: str, similarity: float, wanted: tuple[bool, ...] = (False, True)) -> list[tuple[str, bool, bool]]:
    """(key, whether all that meet by it are alike, whether w is the longer word) of all that w may meet by; of words of n and m letters, both sides have the same way."""
    out: list[tuple[str, bool, bool]] = []
    size, kept = len(w), {}
    for other in range(math.ceil(size * similarity / (200 - similarity) - 1e-9), math.floor(size * (200 - similarity) / similarity + 1e-9) + 1):
        n, m = min(size, other), max(size, other)
        common = math.ceil((n + m) * similarity / 200 - 1e-9)
        less, more = n - common, m - common
        if less < 0:
            continue
        sides = [x for x in ((False, True) if n == m else (size == m,)) if x in wanted]
        if not sides:
            continue
        if math.comb(m, more) <= MOST_KEPT:
            if common not in kept:
                kept[common] = {"".join(x) for x in combinations(w, common)}
            out += [(f"{n},{m},{x}", True, longer) for longer in sides for x in kept[common]]
            continue
        k = less + more + 1
        for i in range(k):
            place, end = i * n // k, (i + 1) * n // k
            if False in sides:
                out.append((f"{n},{m},{i},{w[place:end]}", False, False))
            if True in sides:
                moved = {w[place + by : end + by] for by in range(-less, more + 1) if place + by >= 0 and end + by <= m}
                out += [(f"{n},{m},{i},{x}", False, True) for x in moved]
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def cluster_aliases(counts: DataFrame, least_count: int = LEAST_COUNT, similarity: float = SIMILARITY, anchor_count: int = ANCHOR_COUNT) -> DataFrame:
    """(pos, canonical, aliases): connected names; the most frequent one (first on ties) names the cluster."""
    names = counts.filter(F.col("cnt") >= least_count).withColumn("pos", F.col("pos").cast("long"))
    many, one = _countable(counts, least_count)
    held = _held(many, anchor_count).select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b"))
    # words of a group are linked through one of them, so links are as many as keys, not as pairs
    links = cut_lineage(held.unionByName(_spelled_links(_spelled(one, similarity), similarity)))
    grouped = names.join(components(links).withColumnRenamed("node", "pos"), "pos", "left").withColumn("component", F.coalesce("component", "pos"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "pos", "name")))
    rows = grouped.groupBy("component").agg(F.min("pos").alias("pos"), ordered.alias("m"))
    return rows.select("pos", F.col("m")[0]["name"].alias("canonical"), F.transform("m", lambda x: x["name"]).alias("aliases"))


def person_names(spans: DataFrame) -> DataFrame:
    """Distinct lower-cased names over spans(chapter_id, start, end, text)."""
    return spans.select(F.lower(normalise_mention(F.col("text"))).alias("name")).filter("name <> ''").distinct()


def coref_counts(coref: DataFrame, persons: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(title, owner, cnt, first_seen) from coref(chapter_id, cluster_id, start, end, text) and person spans.

    A mention is a person if its span is one, or its text is one anywhere in the corpus.
    Clusters with exactly one distinct person give their other mentions to it, if they
    pass as aliases and share a significant part with it.
    """
    mentions = coref.withColumn("m", normalise_mention(F.col("text"))).filter("m <> ''")
    exact = persons.select("chapter_id", "start", "end").distinct().withColumn("_span", F.lit(True))
    known = person_names(persons).withColumn("_known", F.lit(True))
    marked = mentions.join(exact, ["chapter_id", "start", "end"], "left").withColumn("_low", F.lower("m")).join(known, F.col("_low") == known["name"], "left").drop("name")
    marked = marked.withColumn("person", F.coalesce("_span", F.lit(False)) | F.coalesce("_known", F.lit(False)))
    keys = ["chapter_id", "cluster_id"]
    owners = marked.filter("person").groupBy(*keys).agg(F.collect_set("m").alias("o")).filter(F.size("o") == 1).select(*keys, F.col("o")[0].alias("owner"))
    titles = marked.filter(~F.col("person")).filter(is_alias_candidate(F.col("m"), max_words)).join(owners, keys).filter(shares_significant(F.col("m"), F.col("owner")))
    return titles.groupBy(F.col("m").alias("title"), "owner").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("chapter_id", "cluster_id", "start")).alias("first_seen"))


def dominant_owners(counted: DataFrame, ratio: float = DOMINANCE, least: int = LEAST_TITLES) -> DataFrame:
    """(title, owners): the top owner if alone or ratio times as frequent as the next, else all by count."""
    w = Window.partitionBy("title").orderBy(F.desc("cnt"), "first_seen")
    ranked = counted.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("cnt").over(w))
    top = ranked.filter("rank = 1").select("title", F.col("cnt").alias("top"), (F.col("second").isNull() | (F.col("cnt") >= ratio * F.col("second"))).alias("alone"))
    return ranked.join(top.filter(F.col("top") >= least), "title").filter("rank = 1 OR NOT alone").groupBy("title").agg(F.sort_array(F.collect_list(F.struct("rank", "owner"))).alias("o")).select("title", F.transform("o", lambda x: x["owner"]).alias("owners"))


def merge_coref(clusters: DataFrame, resolved: DataFrame) -> DataFrame:
    """clusters with the titles of resolved(pos, title, owners) that have one owner.

    A title joins the first cluster (by pos) that has its owner as a member, and a cluster that is named by the
    title goes then. Titles count in order of pos, later ones seeing what earlier ones did. That only matters
    where the owner of one is the other, or a member of the cluster that the other may remove: the later of such
    two waits. Each round takes all titles that wait for none of those left, at the same time.
    """
    left = resolved.filter(F.size("owners") == 1).select("pos", "title", F.col("owners")[0].alias("owner"))
    members = clusters.select("canonical", F.col("pos").alias("place"), F.explode(F.array_distinct(F.concat(F.array("canonical"), F.col("aliases")))).alias("name"))
    joined = left.select(F.col("pos").alias("at"), "title", F.col("owner").alias("canonical")).limit(0)
    gone = left.select(F.col("title").alias("canonical")).limit(0)
    left, members = cut_lineage(left), cut_lineage(members)
    while not left.isEmpty():
        other = left.select(F.col("pos").alias("other"), F.col("title").alias("named"))
        by_title = left.join(other, (F.col("owner") == F.col("named")) & (F.col("pos") != F.col("other")))
        by_cluster = left.join(members, F.col("owner") == F.col("name")).join(other, (F.col("canonical") == F.col("named")) & (F.col("pos") != F.col("other")))
        later = F.greatest("pos", "other").alias("pos")
        ready = cut_lineage(left.join(by_title.select(later).unionByName(by_cluster.select(later)).distinct(), "pos", "left_anti"))
        target = ready.join(members, F.col("owner") == F.col("name")).groupBy("pos", "title").agg(F.min_by("canonical", "place").alias("canonical"), F.min("place").alias("place"))
        target = cut_lineage(target)
        removed = target.filter(F.col("title") != F.col("canonical")).select(F.col("title").alias("canonical")).distinct()
        grown = members.unionByName(target.select("canonical", "place", F.col("title").alias("name"))).distinct()
        members = cut_lineage(grown.join(removed, "canonical", "left_anti"))
        joined = joined.unionByName(target.select(F.col("pos").alias("at"), "title", "canonical"))
        gone = gone.unionByName(removed)
        left = cut_lineage(left.join(ready.select("pos"), "pos", "left_anti"))
    added = joined.groupBy("canonical").agg(F.sort_array(F.collect_list(F.struct("at", "title"))).alias("t"))
    new = F.coalesce(F.transform("t", lambda x: x["title"]), F.array().cast("array<string>"))
    kept = clusters.join(gone.distinct(), "canonical", "left_anti").join(added, "canonical", "left")
    return kept.select("pos", "canonical", F.concat("aliases", F.array_distinct(F.array_except(new, F.col("aliases")))).alias("aliases"))


def claim_single_words(clusters: DataFrame) -> DataFrame:
    """Clusters of one word join the only longer one (at most two significant parts) that has it."""
    sized = clusters.withColumn("sig", significant(F.col("canonical"))).withColumn("n", F.size(pieces(F.col("canonical"))))
    owners = sized.filter((F.col("n") > 1) & (F.size("sig") <= 2)).select(F.col("canonical").alias("owner"), F.explode("sig").alias("word"))
    only = owners.groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.first("owner").alias("owner")).filter("k = 1")
    claimed = sized.filter((F.col("n") == 1) & (F.size("sig") == 1)).withColumn("word", F.col("sig")[0]).join(only, "word").select("pos", "canonical", "owner", "aliases")
    added = claimed.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("pos", "aliases"))).alias("t")).withColumnRenamed("owner", "canonical")
    kept = clusters.join(claimed.select("canonical"), "canonical", "left_anti").join(added, "canonical", "left")
    new = F.coalesce(F.flatten(F.transform("t", lambda x: x["aliases"])), F.array().cast("array<string>"))
    return kept.select("pos", "canonical", F.array_distinct(F.concat("aliases", new)).alias("aliases"))


def to_entities(clusters: DataFrame) -> DataFrame:
    """(pos, char_id, label, aliases): slugs as ids, with _2, _3, ... where taken; names without a slug go.

    A suffixed id may itself be another name's slug. Of several that ask for one id the first by pos
    gets it, and the others ask for their next one, until all differ; since the same order holds for every id,
    that is what giving them out one after the other would lead to. The n-th of a slug asks for its n-th id first.
    """
    slugged = clusters.withColumn("slug", slugify(F.col("canonical"))).filter("slug <> ''")
    n = F.row_number().over(Window.partitionBy("slug").orderBy("pos"))
    asked = F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("n").cast("string")))
    named = slugged.withColumn("n", n)
    while True:
        named = cut_lineage(named.withColumn("char_id", asked).withColumn("turn", F.row_number().over(Window.partitionBy("char_id").orderBy("pos"))))
        if named.filter("turn > 1").isEmpty():
            return named.select("pos", "char_id", F.col("canonical").alias("label"), "aliases")
        named = named.withColumn("n", F.col("n") + (F.col("turn") > 1).cast("int")).drop("char_id", "turn")


def apply_overrides(entities: DataFrame, drops: DataFrame, merges: DataFrame) -> DataFrame:
    """entities without drops(char_id), then with merges(group, place, char_id) done.

    In a group of two or more, place 0 is the primary, which must exist; each further
    one adds its label and aliases to the primary's and goes. Unknown ones are skipped.
    """
    left = entities.join(drops.select("char_id").distinct(), "char_id", "left_anti")
    primary = merges.filter("place = 0").select("group", F.col("char_id").alias("primary"))
    primary = primary.join(left.select(F.col("char_id").alias("primary")), "primary", "left_semi")
    moved = merges.filter("place > 0").join(primary, "group").filter("char_id <> primary").join(left, "char_id")
    first = Window.partitionBy("char_id").orderBy("group", "place")
    moved = moved.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    names = F.concat(F.array("label"), F.col("aliases"))
    added = moved.groupBy(F.col("primary").alias("char_id")).agg(F.sort_array(F.collect_list(F.struct("group", "place", names.alias("names")))).alias("t"))
    kept = left.join(moved.select("char_id"), "char_id", "left_anti").join(added, "char_id", "left")
    new = F.coalesce(F.flatten(F.transform("t", lambda x: x["names"])), F.array().cast("array<string>"))
    return kept.select("pos", "char_id", "label", F.when(F.size(new) > 0, F.array_distinct(F.concat("aliases", new))).otherwise(F.col("aliases")).alias("aliases"))


def label_of(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """ids(char_id) with label, null for unknown ones."""
    return ids.join(entities.select("char_id", "label"), "char_id", "left")


def _adjacent(words: Column) -> Column:
    """Pairs of neighbouring words, as one string each."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def alias_table(entities: DataFrame) -> DataFrame:
    """(char_id, alias, key): an alias's key is its token or, of several, the longest pair of neighbours."""
    rows = entities.select("char_id", F.explode(F.array_distinct("aliases")).alias("alias")).filter("alias <> ''")
    words = tokens(F.col("alias"))
    keys = F.when(F.size(words) > 1, _adjacent(words)).otherwise(words)
    longest = F.array_max(F.transform(keys, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return rows.withColumn("key", longest)


def tag_characters(chunks: DataFrame, entities: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(key, characters): sorted ids of the entities that have an alias in a chunk as whole words.

    Chunks meet aliases by an equi-join on a token of the alias or two neighbouring ones. An alias
    that is one token is found by that, where tokens end at word boundaries; else the pattern is
    tried, once the text has joined all it may hold. Aliases without a token are few and tried on every chunk.
    """
    aliases = alias_table(entities)
    # both come out of the generator, so that no exploded row holds a text
    marked = F.struct(tokens(F.col(text)).alias("w"), (~F.regexp_like(F.lower(text), F.lit(ODD_WORDS))).alias("plain"))
    words = F.transform(F.array(marked), lambda m: F.transform(F.array_distinct(F.concat(m["w"], _adjacent(m["w"]))), lambda w: F.struct(m["plain"].alias("plain"), w.alias("key_"))))[0]
    keyed = chunks.select(key, F.explode(words).alias("_k")).select(key, "_k.plain", "_k.key_")
    may = keyed.join(aliases.filter("key IS NOT NULL").withColumnRenamed("key", "key_"), "key_")
    sure = F.col("plain") & (F.lower("alias") == F.col("key_")) & ~F.contains("key_", F.lit(" "))
    unsure = may.filter(~sure).groupBy(key).agg(F.collect_set(F.struct("char_id", "alias")).alias("_may"))
    # the lower-cased text is bound once for all aliases
    held = F.transform(F.array(F.lower(text)), lambda t: F.filter("_may", lambda x: F.contains(t, F.lower(x["alias"])) & holds_word(t, x["alias"])))[0]
    tried = chunks.select(key, text).join(unsure, key).select(key, F.explode(held).alias("x")).select(key, "x.char_id")
    hits = may.filter(sure).select(key, "char_id").unionByName(tried)
    odd = aliases.filter("key IS NULL")
    if not odd.isEmpty():
        every = chunks.select(key, text).join(odd, whole_word(F.col(text), F.col("alias")))
        hits = hits.unionByName(every.select(key, "char_id"))
    found = hits.groupBy(key).agg(F.sort_array(F.collect_set("char_id")).alias("characters"))
    return chunks.select(key).join(found, key, "left").select(key, F.coalesce("characters", F.array().cast("array<string>")).alias("characters"))


def cluster_totals(clusters: DataFrame, counts: DataFrame) -> DataFrame:
    """(canonical, total): summed mentions of each cluster's aliases, most first; unknown ones count 0."""
    names = clusters.select("pos", "canonical", F.explode("aliases").alias("name"))
    return names.join(counts.select("name", "cnt"), "name", "left").groupBy("pos", "canonical").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("total")).orderBy(F.desc("total"), "pos")


def merge_summary(before: DataFrame, after: DataFrame, drops: DataFrame) -> DataFrame:
    """One row: entities before and after, dropped and merged ones."""
    n = before.agg(F.count(F.lit(1)).alias("before"))
    m = after.agg(F.count(F.lit(1)).alias("after"))
    d = before.join(drops.select("char_id").distinct(), "char_id", "left_semi").agg(F.count(F.lit(1)).alias("dropped"))
    return n.join(F.broadcast(m)).join(F.broadcast(d)).withColumn("merged", F.col("before") - F.col("after") - F.col("dropped"))
