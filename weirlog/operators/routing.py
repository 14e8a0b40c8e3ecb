"""Spread rows over subscribers and hand batches on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame


def route(rows: DataFrame, subscribers: int) -> DataFrame:
    """Subscriber of each row, by offset."""
    return rows.selectExpr("*", f"cast(pmod(offset, {subscribers}) as int) as subscriber")


def chain(rows: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply stages one after the other; with no stages the rows pass unchanged."""
    return reduce(lambda df, stage: df.transform(stage), stages, rows)
