"""Chat sessions: an append-only table of turns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def history(turns: DataFrame, thread_id: str | int, thread: str = "thread_id", order: str = "turn_no") -> DataFrame:
    return turns.filter(F.col(thread) == thread_id).orderBy(order)


def thread_lengths(turns: DataFrame, thread: str = "thread_id") -> DataFrame:
    return turns.groupBy(thread).agg(F.count(F.lit(1)).alias("n_turns"))


class ChatSession:
    """Turns of one thread. reset() forgets them and keeps the thread's id."""

    def __init__(self, spark: SparkSession, thread_id: str | None = None):
        self.spark, self.thread_id = spark, thread_id or str(uuid.uuid4())
        self._turns: list[dict] = []

    def record(self, query: str, finding: dict, rewritten_query: str | None = None, candidates: list[dict] = ()) -> dict:
        """Appends a turn and gives it: the query as typed and as searched, its finding, and the candidates it was drawn from."""
        turn = {"thread_id": self.thread_id, "turn_no": len(self._turns), "query": query, "rewritten_query": query if rewritten_query is None else rewritten_query, "finding": finding, "candidates": list(candidates)}
        self._turns.append(turn)
        return turn

    @property
    def turn_list(self) -> list[dict]:
        return list(self._turns)

    def reset(self) -> None:
        self._turns = []

    def __len__(self) -> int:
        return len(self._turns)

    def turns(self) -> DataFrame:
        return self.spark.createDataFrame(self._turns, schemas.TURN)
