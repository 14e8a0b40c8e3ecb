"""Enum codes: names and delivery-status classes."""

from __future__ import annotations

from weirlog.schemas import ENUMS


def enum_name(enum: str, code: str) -> str:
    """Name of a code, given SQL for the enum's name and for the code. A code outside the enum
    gives its number as text."""
    pairs = ", ".join(f"'{e}:{k}', '{v}'" for e, table in ENUMS.items() for k, v in table.items())
    return f"coalesce(try_element_at(map({pairs}), concat({enum}, ':', {code})), cast({code} as string))"


def delivery_class(code: str) -> str:
    return f"""case when {code} between 1 and 3 then 'progress' when {code} = 64 then 'pending'
        when {code} = 128 then 'failed' when {code} = 129 then 'aborted' else 'unknown' end"""


def retryable(code: str) -> str:
    """Only a plain failure may be retried."""
    return f"coalesce({code} = 128, false)"
