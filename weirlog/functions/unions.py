"""Tagged unions: a ``type`` code and one payload field per alternative."""

from __future__ import annotations


def tagged(code: int, payload: tuple[str, str] | None = None, nanos: str | None = None) -> str:
    """A union value with its tag and payload ``(field, value)`` set together, so that they
    cannot disagree.

    Alternatives without fields of their own (users, channels, updates, deletions) carry the
    tag only. ``nanos`` adds the envelope time.
    """
    fields = [f"'type', {code}"]
    if nanos is not None:
        fields.append(f"'tsNanos', cast({nanos} as bigint)")
    if payload is not None:
        fields.append(f"'{payload[0]}', {payload[1]}")
    return f"named_struct({', '.join(fields)})"


def union_problem(tag: str, payloads: dict[int, str]) -> str:
    """Null when the tag is known and exactly its payload is present, otherwise the reason."""
    known = ", ".join(map(str, payloads))
    missing = " or ".join(f"({tag} = {code} and {value} is null)" for code, value in payloads.items())
    stray = " or ".join(f"({tag} <> {code} and {value} is not null)" for code, value in payloads.items())
    return f"""case when {tag} is null or {tag} not in ({known}) then 'unknown_type'
        when {missing} then 'payload_missing' when {stray} then 'payload_mismatch' end"""
