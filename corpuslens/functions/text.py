"""Column expressions for text: cleansing, tokens, names, slugs, ids, snippets.

All are built-in functions (no UDF). Patterns spell out Unicode behaviour, as the
JVM's classes are ASCII unless told otherwise: ``(?U)`` for classes, ``d`` so that
only line feeds end lines, and U+001C to U+001F as white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in str.isspace, and a token as in re's \w+ on lower-cased text.
WS = r"[\s\x1c-\x1f]"
TOKEN = r"[\p{L}\p{N}_]+"

# Word lists of the name rules, in alphabetical order.
PRONOUNS = "he her hers herself him himself his i it its itself me mine my myself our ours ourselves she that their theirs them themselves these they this those us we what which who whom whose you your yours yourself yourselves".split()
TITLES = "a an aunt auntie boy child dad daddy doctor dr dr. father girl kid lady lord madam madame man master miss mom mommy mother mr mr. mrs mrs. ms ms. mum mummy prof prof. professor sir the uncle woman".split()
CONJUNCTIONS = "& and nor or".split()
MODIFIERS = "alone also blankly calmly cautiously darling dear dearest even grumpily happily hastily heavily herself himself hoarsely itself just merely muttered old oneself only poor spat sweet themselves thickly weakly wearily young".split()
#: Characters that mark running prose, and the namespace of chunk ids.
PROSE_MARKS = ",;\"'“”‘’"
CHUNK_NAMESPACE = "8d6f5a31-2c4e-4b5f-a1b2-c3d4e5f60718"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(c, rf"(?U){WS}+", " ")


def cleanse(c: Column) -> Column:
    """Line ends as LF, no lines of digits only, em dashes, at most one blank line, stripped."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"(?mdU)^{WS}*\p{{Nd}}+{WS}*$", "")
    c = F.regexp_replace(c, "--", "—")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    """Lower-cased words: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def pieces(c: Column) -> Column:
    """Parts between white space."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(pieces(c))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def parse_title(c: Column) -> Column:
    """struct(num, title) of ``Chapter N: title`` (also - and —), else null."""
    pattern = rf"(?iU)\A{WS}*Chapter{WS}+(\p{{Nd}}+){WS}*[-:—]{WS}*(.*?){WS}*\z"
    return F.when(F.regexp_like(c, F.lit(pattern)), F.struct(F.regexp_extract(c, pattern, 1).try_cast("int").alias("num"), F.regexp_extract(c, pattern, 2).alias("title")))


def normalise_mention(c: Column) -> Column:
    """Stripped, without a trailing possessive, white space collapsed."""
    return collapse(F.regexp_replace(strip(c), r"(?i)['’]s\z", ""))


def significant(c: Column) -> Column:
    """Distinct lower-cased parts of a name that are no titles."""
    return F.array_except(pieces(F.lower(c)), F.array(*map(F.lit, TITLES)))


def shares_significant(a: Column, b: Column) -> Column:
    return F.arrays_overlap(significant(a), significant(b))


def is_useful_mention(c: Column) -> Column:
    """Three characters or more, no pronoun, not an article with at most one word."""
    low = F.lower(strip(c))
    parts = pieces(low)
    article = F.coalesce(F.get(parts, F.lit(0)).isin("a", "an", "the"), F.lit(False))
    return (F.length(low) >= 3) & ~low.isin(PRONOUNS) & ~(article & (F.size(parts) <= 2))


def is_alias_candidate(c: Column, max_words: int = 4) -> Column:
    """A useful mention that is short, of one person, and no prose."""
    words = pieces(F.lower(c))
    prose = F.regexp_like(c, F.lit(f"[{PROSE_MARKS}]"))
    return is_useful_mention(c) & ~prose & (F.size(words) <= max_words) & ~F.arrays_overlap(words, F.array(*map(F.lit, CONJUNCTIONS + MODIFIERS)))


def slugify(c: Column) -> Column:
    """Lower case, letters and digits of any script, blanks as underscores."""
    c = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", "")
    return F.regexp_replace(strip(c), rf"(?U){WS}+", "_")


def whole_word(text: Column, alias: Column) -> Column:
    """Whether a lower-cased text holds an alias between word boundaries (in lower case it cannot end the quotation)."""
    return holds_word(F.lower(text), alias)


def holds_word(low: Column, alias: Column) -> Column:
    """whole_word of a text that is in lower case."""
    return F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), F.lower(alias), F.lit(r"\E\b")))


def uuid5(name: Column, namespace: str = CHUNK_NAMESPACE) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def chunk_id(book: Column, chapter: Column, index: Column, kind: Column) -> Column:
    return uuid5(F.concat(F.lit("b"), book.cast("string"), F.lit("-c"), chapter.cast("string"), F.lit("-i"), index.cast("string"), F.lit("-"), kind))


def sentences(c: Column) -> Column:
    """Sentences: cut behind ``.``, ``!`` or ``?`` (and closing quotes or brackets) before white space.

    An approximation of a rule-based segmenter, which isn't available here.
    """
    cut = F.split(F.coalesce(c, F.lit("")), rf"(?U)(?<=[.!?…][\"'”’)\]]{{0,3}}){WS}+", -1)
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def ends_sentence(c: Column) -> Column:
    """Whether a page ends with ``.``, ``!`` or ``?``, at most one closing quote, and white space."""
    return F.regexp_like(c, F.lit(rf"(?U)[.!?][\"'”’]?{WS}*\z"))


def snippet(c: Column, limit: int = 220) -> Column:
    """Blanks collapsed; cut to limit characters with an ellipsis."""
    flat = strip(collapse(c))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("…")))


def head_words(c: Column, limit: int = 200) -> Column:
    """The first words of a longer text, with a marker."""
    words = pieces(c)
    return F.when(F.size(words) <= limit, c).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit(" […chapter continues…]")))


def conviction_label(c: Column) -> Column:
    # The words of convictions 1 to 5.
    names = ["very low", "low", "moderate", "high", "very high"]
    label = F.coalesce(F.get(F.array(*map(F.lit, names)), c - 1), F.lit("?"))
    return F.concat(c.cast("string"), F.lit("/5 ("), label, F.lit(")"))


def slug_list(c: Column) -> Column:
    """The parts of a comma-separated list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda s: s != "")


def drift(found: Column, expected: Column) -> Column:
    """How far a detected page is off: ok, warn (at most 2), bad, or — if unknown."""
    d = F.abs(found - expected)
    return F.when(d.isNull(), "—").when(d == 0, "ok").when(d <= 2, "warn").otherwise("bad")


def citation_number(c: Column) -> Column:
    """The number in a citation such as ``2`` or ``[2]``, else null."""
    bare = F.regexp_replace(strip(c), r"\A\[+|\]+\z", "")
    return strip(bare).try_cast("int")
