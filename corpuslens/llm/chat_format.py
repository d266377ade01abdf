"""Chat formatting with a grammar round trip.

Template (one string per conversation, no separators between turns)::

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    any other  <<ROLE:role>> text <</ROLE>>

Grammar of a text: ``\\`` before one of ``\\ [ < >`` stands for that character;
control strings do not occur in it. A conversation is rendered with its texts as
they are, parsed by a deterministic parser and compared with its source. Texts
(or roles) that were not recovered are escaped (every ``\\ [ < >`` gets a ``\\``)
and the whole is rendered and parsed again, until it is identical. Escaping all
of them is always faithful, so this ends.

A null role or text counts as empty. Turns of equal number are ordered by role,
then text; repeated rows are turns of their own; a null turn number comes first;
a null conv_id is a conversation; texts may be of any length. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: Fixed values of the template: role -> what opens and closes a turn.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("<<ROLE:", ">> ", " <</ROLE>>")
CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>|<<ROLE:|<</ROLE>>"

_LEX = re.compile(rf"\\([\\\[<>])|({CONTROL})")
_ROLE_END = re.compile(r"\\([\\\[<>])|(>>)")
_CLASH = re.compile(rf"\\[\\\[<>]|{CONTROL}")
_SPECIAL = re.compile(r"[\\\[<>]")


class GrammarError(ValueError):
    """The text is not of the template."""


def escape(s: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], s)


def _until(s: str, at: int, stop: str, lex: re.Pattern) -> tuple[str, int]:
    """The unescaped text from at up to stop (exclusive), and where stop starts."""
    out, i = [], at
    for m in lex.finditer(s, at):
        if m[1]:
            out += (s[i : m.start()], m[1])
            i = m.end()
        elif m[2] == stop.lstrip(" "):
            end = m.start() - (len(stop) - len(stop.lstrip(" ")))
            if end < i or not s.startswith(stop, end):
                break
            out.append(s[i:end])
            return "".join(out), end
        else:
            break
    raise GrammarError(f"no {stop!r} for the text at {at}")


def parse(s: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end of the escaped text in s."""
    out, at = [], 0
    while at < len(s):
        for role, (opens, closes) in MARKS.items():  # noqa: B007
            if s.startswith(opens, at):
                at += len(opens)
                break
        else:
            if not s.startswith(OTHER[0], at):
                raise GrammarError(f"no turn at {at}")
            role, at = _until(s, at + len(OTHER[0]), ">>", _ROLE_END)
            if not s.startswith(OTHER[1], at) or role in MARKS:
                raise GrammarError(f"no role at {at}")
            at, closes = at + len(OTHER[1]), OTHER[2]
        text, end = _until(s, at, closes, _LEX)
        out.append((role, text, at, end))
        at = end + len(closes)
    return out


def render(turns: list[tuple[str, str]], escaped: set[int]) -> str:
    out = []
    for i, (role, text) in enumerate(turns):
        opens, closes = MARKS.get(role) or (OTHER[0] + (escape(role) if i in escaped else role) + OTHER[1], OTHER[2])
        out += (opens, escape(text) if i in escaped else text, closes)
    return "".join(out)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], int]:
    """(formatted text, spans of assistant texts, escaped turns) of one conversation."""
    escaped: set[int] = set()
    while True:
        s = render(turns, escaped)
        try:
            back = parse(s)
        except GrammarError:
            back = []
        if [x[:2] for x in back] == turns:
            return s, [x[2:] for x in back if x[0] == "assistant"], len(escaped)
        clash = {i for i, x in enumerate(turns) if i not in escaped and any(map(_CLASH.search, x))}
        more = {i for i, x in enumerate(turns) if i not in escaped and any(map(_SPECIAL.search, x))}
        escaped |= clash or more or set(range(len(turns)))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (code points, end exclusive), n_escaped."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, spans, n = [], [], []
        for turns in batch.column("turns"):
            s, loss, k = format_turns([(x["role"], x["text"]) for x in turns.as_py()])
            texts.append(s)
            spans.append([{"start": a, "end": b} for a, b in loss])
            n.append(k)
        return {"formatted": pa.array(texts, pa.string()), "loss_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "n_escaped": pa.array(n, pa.int32())}

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return map_arrow(convs, run, [("formatted", T.StringType()), ("loss_spans", span), ("n_escaped", T.IntegerType())], drop=("turns",))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the parser finds in the output of format_chats, as counts and digests."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        cols: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for s, spans in zip(batch.column("formatted"), batch.column("loss_spans"), strict=True):
            s = s.as_py()
            turns = parse(s)
            loss = "".join(re.sub(r"\\([\\\[<>])", r"\1", s[x["start"] : x["end"]]) for x in spans.as_py())
            cols["n_turns"].append(len(turns))
            cols["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode()).hexdigest())
            cols["loss_chars"].append(len(loss))
            cols["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            cols["formatted_chars"].append(len(s))
        return {k: pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in cols.items()}

    fields = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    return map_arrow(formatted, run, fields, drop=("formatted", "loss_spans"))
