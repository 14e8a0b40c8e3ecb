"""Upsert by document id with change detection.

A field that is null in an update keeps its stored value; any other value replaces it. The
first row of a document is ``created``; a later one is ``noop`` when the stored document stays
the same and ``updated`` otherwise. Versions count the rows that were not ``noop``.

Documents are many and mostly small, so the fold is a window per document. Documents with more
than ``hot_rows`` rows in one input are taken out and range-partitioned by document *and* order,
which spreads a single document over as many slices as it needs; the state at each slice border
is carried over in a table of one row per document and slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.functions.identity import document_id, given, given_items, month_index, sender_key
from weirlog.functions.times import month_of
from weirlog.functions.unions import tagged
from weirlog.schemas import DOCUMENT_TYPE, STORE_MSG_CREATED
from weirlog.session import join_lookup, settle

HOT_ROWS = 1_000_000
SLICE_ROWS = 500_000
SEED = "_seed_version"
SLICE = "_slice"


def _seen(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Add what earlier rows of the group left: ``_old_*`` fields, and ``_first``."""
    ordered = f"partition by {', '.join(keys)} order by {', '.join(order)}"
    earlier = f"{ordered} rows between unbounded preceding and 1 preceding"
    return rows.selectExpr(
        "*",
        *[f"last(`{f}`, true) over ({earlier}) as `_old_{f}`" for f in fields],
        f"row_number() over ({ordered}) = 1 as _first",
    )


def _judged(seen: DataFrame, fields: list[str]) -> DataFrame:
    """Merge fields and add ``outcome`` and ``_step``, the versions a row adds.

    ``_carry_*`` columns, where present, hold the state before the group.
    """
    if "_carry_seen" in seen.columns:
        old = {f: f"coalesce(`_old_{f}`, `_carry_{f}`)" for f in fields}
        first = "_first and _carry_seen is null"
    else:
        old, first = {f: f"`_old_{f}`" for f in fields}, "_first"
    changed = " or ".join(f"(`{f}` is not null and not (`{f}` <=> {old[f]}))" for f in fields)
    outcome = f"""case when {SEED} is not null then 'seed' when {first} then 'created'
        when {changed} then 'updated' else 'noop' end"""
    rest = [f"`{c}`" for c in seen.columns if c not in fields and not c.startswith(("_old_", "_carry_", "_first"))]
    judged = seen.selectExpr(*rest, *[f"coalesce(`{f}`, {old[f]}) as `{f}`" for f in fields], f"{outcome} as outcome")
    return judged.selectExpr("*", f"case outcome when 'seed' then {SEED} when 'noop' then 0L else 1L end as _step")


def _versions(rows: DataFrame, keys: list[str], order: list[str], base: str = "0L") -> DataFrame:
    ordered = f"partition by {', '.join(keys)} order by {', '.join(order)}"
    rest = [f"`{c}`" for c in rows.columns if c not in ("_step", "_base", "_stored", SEED, SLICE)]
    version = f"sum(_step) over ({ordered} rows between unbounded preceding and current row)"
    return rows.selectExpr(*rest, f"{version} + {base} as version").where("outcome <> 'seed'")


def _fold_whole(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    return _versions(_judged(_seen(rows, [key], order, fields), fields), [key], order)


def _fold_sliced(rows: DataFrame, key: str, order: list[str], fields: list[str], slices: int) -> DataFrame:
    sliced = settle(rows.repartitionByRange(slices, key, *order).selectExpr("*", f"spark_partition_id() as {SLICE}"))
    keys = [key, SLICE]
    before = f"over (partition by {key} order by {SLICE} rows between unbounded preceding and 1 preceding)"
    position = f"struct({', '.join(order)})"

    state = sliced.groupBy(*keys).agg(
        F.expr("count(1) as _rows"),
        *[F.expr(f"max_by(`{f}`, if(`{f}` is not null, {position}, null)) as `_last_{f}`") for f in fields],
    )
    carry = state.selectExpr(
        *keys,
        f"sum(_rows) {before} as _carry_seen",
        *[f"last(`_last_{f}`, true) {before} as `_carry_{f}`" for f in fields],
    )
    stepped = _judged(_seen(sliced, keys, order, fields).join(carry, keys), fields)
    steps = stepped.groupBy(*keys).agg(F.expr("sum(_step) as _steps"))
    base = steps.selectExpr(*keys, f"sum(_steps) {before} as _base")
    return _versions(stepped.join(base, keys), keys, order, "coalesce(_base, 0L)")


def fold_upserts(
    rows: DataFrame,
    key: str,
    order: list[str],
    fields: list[str],
    *,
    stored: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Apply updates in order. Adds ``outcome`` and ``version`` and merges ``fields``.

    ``stored`` holds the documents as they are before the first row: ``key``, ``fields`` and
    ``version``. ``order`` must be unique within a document and free of nulls.
    """
    counts = rows.groupBy(key).agg(F.expr("count(1) as _n")).where(f"_n > {hot_rows}")
    hot_total = counts.agg(F.expr("sum(_n) as total")).first().total

    rows = rows.selectExpr("*", f"cast(null as bigint) as {SEED}")
    if stored is not None:
        seeds = stored.selectExpr(key, *[f"`{f}`" for f in fields], f"version as {SEED}")
        rows = rows.unionByName(seeds, allowMissingColumns=True)
        # stored rows come first whatever the order columns say
        rows = rows.selectExpr("*", f"if({SEED} is null, 1, 0) as _stored")
        order = ["_stored", *order]

    if hot_total is None:
        return _fold_whole(rows, key, order, fields)
    # at most total / hot_rows keys
    hot = settle(counts.select(key))
    cold = _fold_whole(join_lookup(rows, hot, [key], "left_anti"), key, order, fields)
    slices = hot_total // slice_rows + 1
    return cold.unionByName(_fold_sliced(join_lookup(rows, hot, [key], "left_semi"), key, order, fields, slices))


def latest_documents(changes: DataFrame, key: str) -> DataFrame:
    """The highest version of each document; reduces before it shuffles."""
    rest = [c for c in changes.columns if c != key]
    packed = ", ".join(f"`{c}`" for c in rest)
    newest = changes.groupBy(key).agg(F.expr(f"max_by(struct({packed}), version) as _doc"))
    return newest.selectExpr(key, "_doc.*")


# Leaf fields of a request in the document table. Objects merge leaf by leaf, arrays whole.
DOCUMENT_FIELDS = [
    "app",
    "id",
    "session_type",
    "session_data",
    "msg_type",
    "msg_id",
    "msg_ver",
    "from_user",
    "from_channel",
    "to",
]


TEXT = "''"  # default of a text field, in SQL


def document_updates(rows: DataFrame, prefix: str) -> DataFrame:
    """Delivery-event rows as updates. Defaults count as absent, as in the stored JSON."""
    req, nanos = "data.msgDelivery.req", "data.msgDelivery.req.msg.tsNanos"
    return rows.selectExpr(
        "topic",
        "partition",
        "offset",
        "timestamp",
        f"{document_id(req)} as doc_id",
        f"{month_of(nanos)} as month",
        f"{month_index(nanos, prefix)} as index",
        f"{sender_key(f'{req}.`from`')} as sender",
        f"{nanos} as ts_nanos",
        f"{given(f'{req}.app', TEXT)} as app",
        f"{given(f'{req}.id', TEXT)} as id",
        f"{given(f'{req}.session.type')} as session_type",
        f"{given_items(f'{req}.session.data')} as session_data",
        f"{given(f'{req}.msg.type')} as msg_type",
        f"{given(f'{req}.msg.id', TEXT)} as msg_id",
        f"{given(f'{req}.msg.ver')} as msg_ver",
        f"{given(f'{req}.`from`.user.type')} as from_user",
        f"{given(f'{req}.`from`.channel.type')} as from_channel",
        f"{given_items(f'{req}.to')} as to",
    )


LOG_ORDER = ["timestamp", "topic", "partition", "offset"]


def created_event(index: str, doc_id: str, version: str) -> str:
    """Change event for a new document. Its time stays 0."""
    created = f"named_struct('index', {index}, 'id', {doc_id}, 'type', '{DOCUMENT_TYPE}', 'ver', {version})"
    return tagged(STORE_MSG_CREATED, ("msgCreated", created), "0")


def created_events(folded: DataFrame) -> DataFrame:
    """One event per created document, keyed by sender, at its source offset."""
    return folded.where("outcome = 'created'").selectExpr(
        "topic",
        "partition",
        "offset",
        "timestamp",
        "sender",
        f"{created_event('index', 'doc_id', 'version')} as event",
    )


def outcome_action(status: str, outcome: str) -> str:
    """What a stored row leads to: an event, nothing, or a report of the failure."""
    return f"""case when {status} div 100 = 2 and {outcome} = 'created' then 'emit'
        when {status} div 100 = 2 and {outcome} = 'noop' then 'silent' else 'report' end"""


def correlate(requests: DataFrame, responses: DataFrame, how: str = "inner") -> DataFrame:
    """Match responses to requests by log position rather than by place in the batch."""
    return requests.join(responses, ["topic", "partition", "offset"], how)


def lookup_existing(batch: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Batch rows with the version their document has in the table, null when it is new."""
    stored = documents.selectExpr(key, "version as stored_version")
    return batch.join(stored, key, "left")
