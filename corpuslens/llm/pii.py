"""Personal data: patterns propose, checksums confirm, context words adjust the score.

All of it is built-in column functions. A pattern's matches and what lies between
them come from ``regexp_extract_all`` and ``split`` on the same pattern, so places
(code points, end exclusive) are running sums of their lengths. These, and all that goes from one
span to the next, are folded in pieces of about the square root of their number, as an
array that grows by one is copied each time; parts of a text are taken from pieces of it, as a place in a
text is found by walking to it. Patterns are possessive
and start where a run of their characters starts, which gives the leftmost
non-overlapping matches without retries inside a run.

Base kinds are kept whenever their check holds, whatever their score:

* email; ip (four parts of at most 255); card (14 to 19 digits, Luhn);
  phone (``+``, 10 to 15 digits).

Kinds that the method adds are kept from ``threshold`` on, unless they overlap a
base span:

* iban: two capitals, two digits, 11 to 30 capitals or digits, mod-97 is 1. Its pattern
  proposes starts; of the ends at which no letter or digit follows and that pass, the one at the country's
  length counts, else the last;
* local_phone: ten digits in the North American manner without ``+``. Nothing
  confirms it, so it needs a context word near it.

A score is the kind's prior, plus what its checksum gives, plus a bonus if a
context word of its kind stands within ``near`` characters before it.

Null counts as an empty text, which has no spans; repeated rows are judged each by
itself; texts may be of any length and hold any number of spans; an empty table gives an empty
result; other columns, whatever their names, are ignored, or kept with ``keep`` (one called spans is
replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone")
KINDS = BASE + ADDED

#: What proposes each kind.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})",
    "local_phone": r"(?<![0-9A-Za-z+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
}
#: How far an account number may reach from its start, and so many characters at most with the one behind it.
IBAN_RUN, IBAN_MOST = r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+", 68
#: How many capitals and digits the account numbers of a country have.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
#: What a text must hold for a pattern to be tried: a cheap test.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words that make a kind likelier when they stand before it.
CONTEXT = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|debit|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobile|telefon|llame|appelez",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "local_phone": "phone|tel|call|fax|mobile|telefon|llame|appelez",
}
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.4, "local_phone": 0.3}
CHECKED, BONUS, THRESHOLD, NEAR = 0.4, 0.3, 0.6, 40
#: Characters of the pieces of a text.
PIECE = 1024


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(xs: Column, start: Column, step) -> Column:
    """The state after each element: start, then step(state, element), in pieces of about the square root of the size."""

    def of(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.greatest(F.size(xs), F.lit(1)))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.slice(xs, i * size + 1, size))
        none = F.slice(F.array(start), 1, 0)

        def inner(last: Column, part: Column) -> Column:
            grow = lambda a, x: let(step(a["last"], x), lambda v: F.struct(v.alias("last"), F.concat(a["out"], F.array(v)).alias("out")))
            return F.aggregate(part, F.struct(last.alias("last"), none.alias("out")), grow)

        outer = lambda a, part: let(inner(a["last"], part), lambda r: F.struct(r["last"].alias("last"), F.concat(a["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(parts, F.struct(start.alias("last"), F.slice(F.array(none), 1, 0).alias("out")), outer, lambda a: F.flatten(a["out"]))

    return let(xs, of)


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(of: Column, start: Column, length: Column) -> Column:
    """So many characters from start (0: the first) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    few = F.array_join(F.slice(of, first + 1, (F.floor((start + length) / PIECE) - first + 1).cast("int")), "")
    return F.substr(few, (start % PIECE + 1).cast("int"), length.cast("int"))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches of a pattern."""
    values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # zip_with pads the values, of which there is one less than of the gaps
    pairs = F.zip_with(between, values, lambda gap, value: F.struct(F.length(gap).cast("bigint").alias("gap"), value.alias("value")))
    found = F.filter(pairs, lambda x: x["value"].isNotNull())

    def placed(found: Column) -> Column:
        ends = running(found, F.lit(0).cast("bigint"), lambda at, x: at + x["gap"] + F.length(x["value"]))
        return F.zip_with(found, ends, lambda x, end: F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value")))

    return let(found, placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), "(?<=.)(?=.)"), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number (capitals and digits, blanks between) leaves 1 modulo 97."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def ibans(text: Column, cut: Column) -> Column:
    """Confirmed account numbers of a text (cut: its pieces), leftmost first and apart: array<struct<start, end, value>>."""

    def last_end(rest: Column) -> Column:
        most = F.length(F.regexp_extract(rest, IBAN_RUN, 0))
        ends = F.sequence(F.lit(15), F.greatest(most, F.lit(15)))
        bare = lambda e: F.length(F.replace(F.substr(rest, F.lit(1), e), F.lit(" "), F.lit("")))
        country = F.substr(rest, F.lit(1), F.lit(2))
        fixed = F.coalesce(*(F.when(country.isin(v.split()), F.lit(k)) for k, v in IBAN_LENGTHS.items()), F.lit(0))
        passing = F.filter(ends, lambda e: (e <= most) & (F.substr(rest, e, F.lit(1)) != " ") & ~F.substr(rest, e + 1, F.lit(1)).rlike("[A-Za-z0-9]") & (bare(e) >= 15) & mod97(F.substr(rest, F.lit(1), e)))
        return F.array_max(F.transform(passing, lambda e: F.struct((bare(e) == fixed).alias("fixed"), e.alias("e"))))["e"]

    def whole(x: Column) -> Column:
        rest = part(cut, x["start"], F.lit(IBAN_MOST))
        # bound once, as each use would cut it again
        return let(rest, lambda r: let(last_end(r), lambda k: F.struct(x["start"].alias("start"), (x["start"] + k).alias("end"), F.substr(r, F.lit(1), k).alias("value"))))

    def apart(found: Column) -> Column:
        """Those that begin where the last of those before has ended."""
        ends = running(found, F.lit(0).cast("bigint"), lambda at, x: F.when(x["start"] >= at, x["end"]).otherwise(at))
        return let(ends, lambda ends: F.filter(found, lambda x, i: (i == 0) | (x["start"] >= F.element_at(ends, F.greatest(i, F.lit(1))))))

    return let(F.filter(F.transform(located(text, PATTERNS["iban"]), whole), lambda x: x["end"].isNotNull()), apart)


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array<struct<start, rank, end, kind, score>>."""
    words = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{CONTEXT[kind]})(?![\p{{L}}\p{{N}}])"

    def spans(cut: Column) -> Column:
        found = ibans(text, cut) if kind == "iban" else F.filter(located(text, PATTERNS[kind]), lambda x: confirmed(kind, x["value"]))

        def scored(x: Column) -> Column:
            before = part(cut, F.greatest(x["start"] - NEAR, F.lit(0)), F.least(x["start"], F.lit(NEAR)))
            score = F.lit(PRIOR[kind] + (CHECKED if kind in ("card", "iban", "ip") else 0)) + F.when(before.rlike(words), BONUS).otherwise(0.0)
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

        return F.transform(found, scored)

    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>")
    may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(may & F.regexp_like(text, F.lit(PATTERNS[kind])), let(pieces(text), spans)).otherwise(none)


def free_spans(base: Column, added: Column) -> Column:
    """All base spans and those added ones that overlap none of them, by start, then kind."""
    edge = F.lit(2**62)

    def kept(xs: Column) -> Column:
        is_base = lambda x: x["rank"] < len(BASE)
        # the furthest end of base spans up to each, and the least start of those from it on
        reach = running(xs, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, F.when(is_base(x), x["end"]).otherwise(0)))
        ahead = F.reverse(running(F.reverse(xs), edge, lambda a, x: F.least(a, F.when(is_base(x), x["start"]).otherwise(edge))))
        both = F.arrays_zip(xs.alias("x"), reach.alias("reach"), ahead.alias("ahead"))
        return F.transform(F.filter(both, lambda y: is_base(y["x"]) | ((y["reach"] <= y["x"]["start"]) & (y["ahead"] >= y["x"]["end"]))), lambda y: y["x"])

    merged = F.array_sort(F.concat(base, added))
    return F.when(F.size(added) > 0, let(merged, kept)).otherwise(merged)


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """keep and spans (start, rank, end, kind, score; by start, then kind) per row."""
    names = tuple(dict.fromkeys([*keep, text]))
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*(kind_spans(t, k) for k in BASE))
    added = F.filter(F.concat(*(kind_spans(t, k) for k in ADDED)), lambda x: x["score"] >= threshold)
    # by place, as the names of columns that are kept are anybody's
    both = docs.select(*names, base, added).toDF(*(f"_{i}" for i in range(len(names))), "_base", "_added")
    out = [F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c in keep and c != "spans"]
    return both.select(*out, free_spans(F.col("_base"), F.col("_added")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""

    def of(cut: Column) -> Column:
        # where the spans before and including each have ended
        reach = running(spans, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x["end"]))

        def put(reach: Column) -> Column:
            before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.element_at(reach, F.greatest(i, F.lit(1))))
            mark = lambda x, at: F.when(x["start"] >= at, F.concat(part(cut, at, x["start"] - at), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")
            marks = F.transform(spans, lambda x, i: let(before(i), lambda at: mark(x, at)))
            last = F.element_at(reach, -1)
            return F.concat(F.array_join(marks, ""), part(cut, last, F.length(text) - last))

        return let(reach, put)

    return F.when(F.size(spans) > 0, let(pieces(text), of)).otherwise(text)
