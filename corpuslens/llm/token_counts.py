"""Token counts by overlap resynchronisation.

A text longer than ``chunk_chars`` is cut into chunks that overlap, and each is scanned by
itself from its own start, whatever stands there, giving tokens and their byte offsets. Two
neighbouring scans are spliced where they have come to agree: at a *proven stable* place,
of which the overlap must show two. Such a place is the end of a run of letters or of numbers, or of
other characters before white space; the tokenizer's splitting pattern has no alternative that goes
on across it, so any scan that comes to it starts a new piece there. Both scans must show a token
boundary at either place and equal tokens between them; else (a special string
over it, one long run) the overlap is doubled and scanned again, until they agree or the text
ends. Counts therefore equal those of encoding the text in one go. Each character is
encoded once, and those of overlaps twice.

Runs of white space of any length are taken out before the engine sees them (its regular expression
holds a place for each character of a run): all but the last character is one piece if anything follows, by the
same pattern.

Nulls count as empty texts; empty texts have 0 tokens; repeated rows are counted
each by itself; texts may be of any length (one of a single run of letters is one chunk); an empty table gives an
empty result; other columns are ignored (or kept, with ``keep``; one called n_bytes, n_tokens or over_limit is
replaced).
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, strings

#: A text of more characters is cut; the first overlap between chunks.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 256

#: Characters that the splitting pattern takes as white space.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: A run of so much white space doesn't go through the engine's regular expression.
LONG_RUN = 4096

_STABLE = regex.compile(rf"\p{{L}}(?=\P{{L}})|\p{{N}}(?=\P{{N}})|[^\p{{L}}\p{{N}}{SPACE}](?=[{SPACE}])")
_LONG = regex.compile(rf"[{SPACE}]{{{LONG_RUN},}}+")


def _byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary file -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def _check(spec: dict) -> None:
    """Raises unless the file's rules are those that are followed here."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and not spec.get("normalizer")
    plain = plain and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain = plain and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and not any(t.get(x) for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip"))
    if not plain:
        raise ValueError("a byte-level BPE with its usual pattern, without a normalizer and other extras, is needed")
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("ids are to follow the order of merges")


class ByteBpe:
    """Ids and byte lengths of the tokens of a text, for a byte-level BPE.

    ``path`` is a tokenizers .json file, of which the vocabulary and the added
    tokens are read, or a .tiktoken rank file. Ids are those of the library that
    the file is made for; encoding runs in tiktoken, several times as fast.
    """

    #: How a byte-level BPE of this kind splits a text, as its library documents.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken

        special: dict[str, int] = {}
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            _check(spec)
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            of = _byte_alphabet()
            ranks = {bytes(of[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set(special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for tok, i in ranks.items():
            self.lengths[i] = len(tok)
        for tok, i in special.items():
            self.lengths[i] = len(tok.encode())

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text's tokens, scanned from its first character on."""
        parts, at = [], 0
        for m in _LONG.finditer(text):
            # the last character goes with what follows, unless that is a special string, before which the text ends
            last = m.end() < len(text) and not any(text.startswith(x, m.end()) for x in self.allowed)
            parts += [self._scan(text[at : m.start()]), self.encoding._encode_single_piece(text[m.start() : m.end() - last])]
            at = m.end() - last
        if not parts:
            return self._scan(text)
        return np.concatenate([np.asarray(x, np.int64) for x in [*parts, self._scan(text[at:])]])

    def _scan(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token ends."""
        return np.cumsum(self.lengths[ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def _splice(text: str, start: int, cut: int, end: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int, int, int] | None:
    """How many tokens of the left scan (from start) and of the right one (from cut) lie before the first place that both show, and before the last.

    Both scans know the text from cut to end. None: they don't show their agreement.
    """
    before = len(text[start:cut].encode())
    places, at, last = [], before, cut
    for m in _STABLE.finditer(text, cut, max(cut, end)):
        at += len(text[last : m.end()].encode())
        last = m.end()
        places.append(at)
    places = np.array(places, np.int64)
    known = [np.searchsorted(x, places) for x in (left, right + before)]
    both = np.ones(len(places), bool)
    for x, k in zip((left, right + before), known, strict=True):
        both &= (k < len(x)) & (x[np.minimum(k, len(x) - 1)] == places)
    at = np.flatnonzero(both)
    return (int(known[0][at[0]]) + 1, int(known[1][at[0]]) + 1, int(known[0][at[-1]]) + 1, int(known[1][at[-1]]) + 1) if len(at) > 1 else None


def encode_spliced(bpe: ByteBpe, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> np.ndarray:
    """Ids of the tokens of a text, from overlapping chunks."""
    # a special string over a place is to be seen whole by the scan from the left
    reach = max([1, *map(len, bpe.allowed)])
    n, chunk = len(text), max(chunk_chars, reach, 2)
    if n <= chunk + overlap_chars:
        return bpe.encode(text)
    parts: list[np.ndarray] = []
    start, done, left_end = 0, 0, chunk + overlap_chars
    left = bpe.encode(text[:left_end])
    while left_end < n:
        cut, overlap = start + chunk, overlap_chars
        while True:
            end = cut + overlap
            if end > left_end:
                left_end = min(end, n)
                left = bpe.encode(text[start:left_end])
                if left_end == n:
                    break
            right_end = min(n, end + chunk)
            right = bpe.encode(text[cut:right_end])
            found = _splice(text, start, cut, end - reach + 1, bpe.ends(left), bpe.ends(right))
            if found and np.array_equal(left[found[0] : found[2]], right[found[1] : found[3]]):
                parts.append(left[done : found[0]])
                start, done, left, left_end = cut, found[1], right, right_end
                break
            overlap *= 2
    return np.concatenate([*parts, left[done:]])


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """keep, n_bytes, n_tokens and over_limit (more than limit tokens) per row."""

    def count(batch: pa.RecordBatch, bpe: ByteBpe) -> dict[str, pa.Array]:
        size, tokens = [], []
        for x in strings(batch.column(text)):
            s = x.as_py()
            size.append(len(s.encode()))
            tokens.append(len(encode_spliced(bpe, s, chunk_chars, overlap_chars)))
        tokens = np.array(tokens, np.int64)
        return {"n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array(tokens > limit)}

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    drop = () if text in keep else (text,)
    return map_arrow(docs.select(*dict.fromkeys([*keep, text])), count, fields, drop, setup=lambda: tokenizer(path))
