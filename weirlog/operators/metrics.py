"""Measures of a running log: pending work, totals, latency and throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.operators.blocks import BLOCK_BITS, in_block, running_sum, with_prefix


def pending_gate(
    rows: DataFrame, keys: list[str], seq: str, delta: str, max_pending: int, bits: int = BLOCK_BITS
) -> DataFrame:
    """Pending work after each step and whether more may be taken: not above the limit."""
    pending = running_sum(rows, keys, seq, delta, "pending", bits=bits)
    return pending.selectExpr("*", f"pending <= {max_pending} as ready")


def sink_totals(rows: DataFrame, **conditions: str) -> DataFrame:
    """Rows per topic for which each condition holds."""
    return rows.groupBy("topic").agg(*[F.expr(f"count_if({sql}) as {name}") for name, sql in conditions.items()])


def observed_totals(rows: DataFrame, name: str, **conditions: str) -> DataFrame:
    """The rows unchanged, counting on the way. A streaming query reports the counts of each batch
    under ``name`` in its progress; nothing is computed twice."""
    return rows.observe(name, *[F.expr(f"count_if({sql}) as {total}") for total, sql in conditions.items()])


def latency_stats(rows: DataFrame, sent: str, received: str) -> DataFrame:
    """Count, total and mean of ``received - sent`` per partition, in the unit of the inputs."""
    spent = f"{received} - {sent}"
    totals = rows.groupBy("topic", "partition").agg(
        F.expr("count(1) as messages"), F.expr(f"sum({spent}) as total_latency")
    )
    return totals.selectExpr("*", "cast(total_latency as double) / messages as mean_latency")


def checkpoint_step(total: str) -> str:
    """Distance between throughput reports: a power of ten, at least 10, that cuts the total into
    at most 100 parts, then doubled until there are at most 20."""
    tens = f"cast(pow(10, greatest(length(cast(greatest({total}, 1) - 1 as string)) - 2, 1)) as bigint)"
    return f"""case when {tens} * 20 >= {total} then {tens} when {tens} * 40 >= {total} then {tens} * 2
        when {tens} * 80 >= {total} then {tens} * 4 else {tens} * 8 end"""


def throughput_checkpoints(rows: DataFrame, seq: str, micros: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Messages so far, time since the first one, and their rate, at every report of a topic."""
    keys = ["topic"]
    carried = with_prefix(
        rows,
        keys,
        seq,
        partials={"_rows": "count(1)", "_start": f"min({micros})"},
        before={"_base": "sum(_rows)"},
        overall={"_total": "sum(_rows)", "_began": "min(_start)"},
        local={"_place": f"row_number() over ({in_block(keys, seq)})"},
        bits=bits,
    )
    reports = carried.selectExpr(
        "topic",
        "cast(_place + coalesce(_base, 0) as bigint) as messages",
        f"{checkpoint_step('_total')} as step",
        f"{micros} - _began as elapsed_us",
    ).where("messages % step = 0")
    return reports.selectExpr(
        "topic", "step", "messages", "elapsed_us", "messages * 1000000D / nullif(elapsed_us, 0) as per_second"
    )
