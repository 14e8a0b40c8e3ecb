"""Nanosecond event times. The long stays the truth; timestamps are derived from it."""

from __future__ import annotations


def event_time(nanos: str) -> str:
    """Microsecond UTC timestamp of a nanosecond count."""
    return f"timestamp_micros(({nanos}) div 1000)"


def month_of(nanos: str) -> str:
    """``yyyy-MM`` in UTC, computed on whole days so that no session time zone enters."""
    return f"date_format(date_from_unix_date(cast(({nanos}) div 86400000000000 as int)), 'yyyy-MM')"


def micros_of(ts: str) -> str:
    """Microseconds since the epoch of a timestamp, with or without a zone (UTC session)."""
    return f"unix_micros(cast({ts} as timestamp))"
