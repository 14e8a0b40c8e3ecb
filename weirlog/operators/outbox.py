"""Planning of sends: order, batches, retries and what is left after a failure.

An outbox row has ``id, topic, key, value, state`` with states ``new``, ``failed`` (to be
retried), ``sent`` (not yet acknowledged) and ``acked``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.operators.blocks import BLOCK, BLOCK_BITS, number_rows, with_prefix

# Sizes of save slices and send batches.
SAVE_SLICE = 1000
SEND_BATCH = 100

# Failed rows leave the queue before new ones; other states are not in the queue.
_RANK = "case state when 'failed' then 0 when 'new' then 1 end as rank"


def enqueue_ids(rows: DataFrame, arrival: str, last_id: int = 0, bits: int = BLOCK_BITS) -> DataFrame:
    """Ids per topic in arrival order, continuing after ``last_id``."""
    return number_rows(rows, ["topic"], arrival, "enqueue_id", start=last_id, bits=bits)


def slice_of(number: str, size: int) -> str:
    """SQL for the zero-based slice of a one-based dense number."""
    return f"({number} - 1) div {size}"


def drain_order(outbox: DataFrame, size: int = SEND_BATCH, bits: int = BLOCK_BITS) -> DataFrame:
    """Failed rows first, then new ones, each by id. Batches are numbered per state, so that no
    batch mixes the two. Read in the order ``topic, rank, place``."""
    waiting = outbox.selectExpr("*", _RANK).where("rank is not null")
    placed = number_rows(waiting, ["topic", "rank"], "id", "place", bits=bits)
    return placed.selectExpr("*", f"{slice_of('place', size)} as batch_no")


def drain_head(outbox: DataFrame, count: int) -> DataFrame:
    """The next batch of each topic: up to ``count`` rows, all failed or all new."""
    waiting = outbox.selectExpr("*", _RANK).where("rank is not null")
    # a bare row_number filter lets Spark cut each map task to `count` rows before the shuffle
    head = waiting.selectExpr("*", "row_number() over (partition by topic order by rank, id) as place")
    head = head.where(f"place <= {count}").selectExpr("*", "min(rank) over (partition by topic) as _leading")
    return head.where("rank = _leading").drop("_leading")


def unconfirmed(sends: DataFrame, acks: DataFrame) -> DataFrame:
    """Sends without an acknowledgement."""
    return sends.join(acks, "id", "left_anti")


def failed_sends(sends: DataFrame, errors: DataFrame) -> DataFrame:
    """Sends that came back with an error."""
    return sends.join(errors, "id", "left_semi")


def retry_set(**parts: DataFrame) -> DataFrame:
    """Rows to queue again, each once. Parts are named by reason; where a row is in several, the
    part given first names it."""
    labelled = [
        part.selectExpr("*", f"named_struct('place', {place}, 'reason', '{name}') as _reason")
        for place, (name, part) in enumerate(parts.items())
    ]
    union = reduce(lambda a, b: a.unionByName(b), labelled)
    rest = [c for c in union.columns if c not in ("id", "_reason")]
    once = union.groupBy("id").agg(
        F.expr("min(_reason).reason as reason"), *[F.expr(f"any_value(`{c}`) as `{c}`") for c in rest]
    )
    return once.select("id", *rest, "reason")


def retry_plan(sends: DataFrame, acks: DataFrame, errors: DataFrame) -> DataFrame:
    """Sends to queue again with the reason, each once: those that came back with an error, those not yet
    sent, and those without an acknowledgement. Both answers are reduced to one row per id and joined
    once."""
    answers = acks.selectExpr("id", "true as _ack", "false as _error").unionByName(
        errors.selectExpr("id", "false as _ack", "true as _error")
    )
    once = answers.groupBy("id").agg(F.expr("bool_or(_ack) as _ack"), F.expr("bool_or(_error) as _error"))
    reason = """case when coalesce(_error, false) then 'failed' when state = 'new' then 'unsent'
        when not coalesce(_ack, false) then 'unconfirmed' end as reason"""
    joined = sends.join(once, "id", "left").selectExpr("*", reason).where("reason is not null")
    return joined.drop("_ack", "_error")


def remaining_after_failure(
    rows: DataFrame, keys: list[str], seq: str, slice_no: str, failed: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Rows of the first failing slice of each key and of every later slice."""
    marked = with_prefix(
        rows,
        keys,
        seq,
        partials={"_failed": f"min(if({failed}, {slice_no}, null))"},
        overall={"first_failed": "min(_failed)"},
        bits=bits,
    )
    return marked.where(f"{slice_no} >= first_failed").drop(BLOCK)


def backlog_depth(outbox: DataFrame) -> DataFrame:
    """Rows per topic and state."""
    return outbox.groupBy("topic", "state").agg(F.expr("count(1) as messages"))
