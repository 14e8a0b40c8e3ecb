"""Sends matched with their answers, and repeats suppressed, while both stream in.

State lives in Spark's state store and is bounded by watermarks: a send waits ``within`` for its answer, and what is
older than the watermark (event time less ``lateness``) leaves the state. Choose RocksDB as the state
store where that is much.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """Rows of which none with the same keys came before. Repeats are known for ``lateness`` after the first one, in
    event time ``at``; the state forgets them then."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def match_answers(sends: DataFrame, answers: DataFrame, keys: list[str], within: str, lateness: str) -> DataFrame:
    """Every send (keys, sent_at, ...) with its answer (keys, answered_at, ...) or, once ``within`` has passed, without.

    An answer that comes later than ``within`` after its send, or before it, is none. A send without an answer is
    given out when the watermark has passed the time it could come, so the sends of the last
    ``within`` are still open when a stream stops. Of a null key nothing is known: it has no answer.
    """
    sent = sends.withWatermark("sent_at", lateness)
    renamed = answers.withColumnsRenamed({k: f"_answer_{k}" for k in keys}).withWatermark("answered_at", lateness)
    same = " and ".join(f"{k} = _answer_{k}" for k in keys)
    matched = sent.join(
        renamed, F.expr(f"{same} and answered_at >= sent_at and answered_at <= sent_at + interval {within}"), "left_outer"
    )
    return matched.drop(*[f"_answer_{k}" for k in keys])


def unanswered(matched: DataFrame) -> DataFrame:
    """Sends whose time has passed without an answer."""
    return matched.where("answered_at is null")
