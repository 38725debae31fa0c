"""Turns of chat sessions: saving them under the next numbers, reading the oldest back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.relational import top


def next_numbers(turns: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """(session, next_seq) of each session that has turns: one more than its last number, 0 if that is null."""
    return turns.groupBy(session).agg((F.coalesce(F.max(seq), F.lit(-1)) + 1).alias("next_seq"))


def save(turns: DataFrame, new: DataFrame, order: list[str], session: str = "session_id", content: str = "content", seq: str = "seq") -> DataFrame:
    """The rows to append for `new` turns: numbered on from each session's last number in `order`; turns without content and without a session are ignored."""
    given = new.filter(F.col(session).isNotNull() & (F.coalesce(content, F.lit("")) != ""))
    known = next_numbers(turns, session, seq).withColumnRenamed("next_seq", "_w_next")
    place = F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1
    numbered = given.withColumn(seq, place).join(known, session, "left")
    return numbered.withColumn(seq, (F.col(seq) + F.coalesce("_w_next", F.lit(0))).cast(turns.schema[seq].dataType)).select(*[F.col(f"`{c}`") for c in turns.columns])


def load(turns: DataFrame, limit: int = 40, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """The oldest `limit` turns of each session."""
    return top(turns, [session], [F.col(seq).asc()], limit)
