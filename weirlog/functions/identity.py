"""Keys, document ids, index names and document bodies."""

from __future__ import annotations

from weirlog.functions.times import month_of


def sender_key(address: str) -> str:
    """Canonical text of an address; equal addresses, and only those, share a key.

    A side that is absent is ``-``; one that is there without a type has type 0, as the record format
    does not tell a default from an absent field. An address holds two enum codes, so few distinct
    keys exist. Route with it, but do not shuffle heavy work on it alone.
    """
    user, channel = (
        f"if({address}.{side} is null, '-', cast(coalesce({address}.{side}.type, 0) as string))" for side in ("user", "channel")
    )
    return f"concat({user}, ':', {channel})"


def document_id(req: str) -> str:
    """``app_id_nanos``; absent fields are at their defaults. Null when there is no message."""
    return f"""if({req}.msg is null, null, concat(coalesce({req}.app, ''), '_', coalesce({req}.id, ''), '_',
        cast(coalesce({req}.msg.tsNanos, 0) as string)))"""


def month_index(nanos: str, prefix: str) -> str:
    return f"concat('{prefix}_', {month_of(nanos)})"


def given(value: str, default: str = "0") -> str:
    """Null in place of a default, which the record format does not tell from an absent field."""
    return f"nullif({value}, {default})"


def given_items(value: str) -> str:
    return f"if(size({value}) > 0, {value}, null)"


def _address(at: str) -> str:
    def side(name: str) -> str:
        inner = f"named_struct('type', {given(f'{at}.{name}.type')})"
        return f"'{name}', if({at}.{name} is not null, {inner}, null)"

    return f"if({at} is not null, named_struct({side('user')}, {side('channel')}), null)"


def document_body(req: str) -> str:
    """JSON of a request with default-valued fields left out."""
    value = f"""if(p.value is not null, named_struct(
        'format', {given('p.value.format')},
        'data', if(octet_length(p.value.data) > 0, p.value.data, null)), null)"""
    properties = f"""transform({given_items(f'{req}.session.data')},
        p -> named_struct('name', {given('p.name', "''")}, 'value', {value}))"""
    return f"""to_json(named_struct(
        'id', {given(f'{req}.id', "''")},
        'app', {given(f'{req}.app', "''")},
        'session', if({req}.session is not null, named_struct(
            'type', {given(f'{req}.session.type')}, 'data', {properties}), null),
        'msg', if({req}.msg is not null, named_struct(
            'type', {given(f'{req}.msg.type')}, 'id', {given(f'{req}.msg.id', "''")},
            'ver', {given(f'{req}.msg.ver')}, 'tsNanos', {given(f'{req}.msg.tsNanos')}), null),
        'from', {_address(f'{req}.`from`')},
        'to', transform({given_items(f'{req}.to')}, a -> {_address('a')})))"""
