"""Ordered computations over keys of any size.

A window over ``topic, partition`` would put a whole partition into one task. Instead each key
is cut into blocks of consecutive sequence numbers. Blocks are reduced to one row each, the
small block table is windowed, and the result is carried back into the blocks by an equi-join
on ``key, block``. The window inside the blocks comes first, so that the join finds its rows
partitioned and sorted: one shuffle and one sort of the data. Because sequence numbers are unique
within a key, no block exceeds ``2 ** bits`` rows. The block table is blocked in turn, so that sparse
sequences, such as arrival times, don't put a key's blocks into one task.

Keys and sequence numbers must not be null; rows where they are make the job fail with a message, as
leaving them out would lose them. Aggregates are given as SQL: sums, minima and last values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.session import settle

BLOCK_BITS = 20
BLOCK = "_block"


def _named(columns: dict[str, str] | None, over: str = "") -> list[str]:
    return [f"{agg} {over} as {name}" for name, agg in (columns or {}).items()]


def with_prefix(
    df: DataFrame,
    keys: list[str],
    seq: str,
    *,
    partials: dict[str, str],
    before: dict[str, str] | None = None,
    overall: dict[str, str] | None = None,
    local: dict[str, str] | None = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add per-block carry columns.

    ``local`` are columns with windows inside the block. ``partials`` are aggregates of each
    block. ``before`` are aggregates of the partials over all earlier blocks of the key (null in
    the first), ``overall`` over all of its blocks.
    """
    # the checks are part of the columns joined on, so that no filter on nulls can come before them
    refused = f"raise_error('rows to be numbered need keys and a sequence number ({', '.join((*keys, seq))})')"
    named = [f"if(`{c}` is null, {refused}, `{c}`) as `{c}`" if c in keys else f"`{c}`" for c in df.columns]
    blocked = df.selectExpr(*named, f"shiftright(if({seq} is null, {refused}, {seq}), {bits}) as {BLOCK}")
    table = blocked.groupBy(*keys, BLOCK).agg(*[F.expr(p) for p in _named(partials)])
    carry = _carried(table, keys, before or {}, overall or {}, bits)
    if local:
        blocked = blocked.selectExpr("*", *_named(local))
    return blocked.join(carry, [*keys, BLOCK])


#: How the aggregates of two neighbouring stretches make that of both.
_BOTH = {
    "sum": "if({0} is null and {1} is null, null, coalesce({0}, 0) + coalesce({1}, 0))",
    "last": "if(_head, {0}, {1})",
    "min": "least({0}, {1})",
}


def _carried(table: DataFrame, keys: list[str], before: dict, overall: dict, bits: int) -> DataFrame:
    """Carry columns of a block table, by windows over blocks of blocks.

    Where sequence numbers are far apart there are nearly as many blocks as rows. Blocks are therefore
    blocked themselves, so a window holds ``2 ** bits`` of them at most, and what comes from earlier
    ones of these is added.
    """
    upper = "_upper"
    aggregates = {**before, **overall}
    folds = {name: agg.split("(")[0] for name, agg in aggregates.items()}
    table = table.selectExpr("*", f"shiftright({BLOCK}, {bits}) as {upper}")
    ordered = {n: (f"max_by({a.split('(')[1][:-1]}, {BLOCK})" if folds[n] == "last" else a) for n, a in aggregates.items()}
    tops = table.groupBy(*keys, upper).agg(*[F.expr(f"{a} as _t_{n}") for n, a in ordered.items()])
    key = ", ".join(keys)
    earlier = f"over (partition by {key} order by {upper} rows between unbounded preceding and 1 preceding)"
    tops = tops.selectExpr(
        *keys,
        upper,
        *[f"{folds[n]}(_t_{n}) {earlier} as _top_{n}" for n in before],
        *[f"{folds[n]}(_t_{n}) over (partition by {key}) as {n}" for n in overall],
    )
    inside = f"over (partition by {key}, {upper} order by {BLOCK} rows between unbounded preceding and 1 preceding)"
    head = f"row_number() over (partition by {key}, {upper} order by {BLOCK}) = 1 as _head"
    local = table.selectExpr("*", head, *[f"{a} {inside} as _in_{n}" for n, a in before.items()])
    joined = local.join(tops, [*keys, upper])
    both = [f"{_BOTH[folds[n]].format(f'_top_{n}', f'_in_{n}')} as {n}" for n in before]
    return joined.selectExpr(*keys, BLOCK, *both, *overall)


def in_block(keys: list[str], seq: str) -> str:
    """Window over the rows of a block, for SQL."""
    return f"partition by {', '.join(keys)}, {BLOCK} order by {seq}"


def _without(df: DataFrame, *helpers: str) -> list[str]:
    return [f"`{c}`" for c in df.columns if c not in helpers]


def number_rows(
    df: DataFrame, keys: list[str], seq: str, name: str = "n", *, start: int = 0, bits: int = BLOCK_BITS
) -> DataFrame:
    """Dense numbers ``start + 1, start + 2, ...`` per key in ``seq`` order."""
    carried = with_prefix(
        df,
        keys,
        seq,
        partials={"_rows": "count(1)"},
        before={"_base": "sum(_rows)"},
        local={"_place": f"row_number() over ({in_block(keys, seq)})"},
        bits=bits,
    )
    return carried.selectExpr(
        *_without(carried, BLOCK, "_base", "_place"), f"cast(_place + coalesce(_base, 0) + {start} as bigint) as {name}"
    )


def running_sum(
    df: DataFrame, keys: list[str], seq: str, value: str, name: str, *, bits: int = BLOCK_BITS
) -> DataFrame:
    """Sum of ``value`` from the first row of the key up to and including each row."""
    upto = f"{in_block(keys, seq)} rows between unbounded preceding and current row"
    carried = with_prefix(
        df,
        keys,
        seq,
        partials={"_sum": f"sum({value})"},
        before={"_base": "sum(_sum)"},
        local={"_upto": f"sum({value}) over ({upto})"},
        bits=bits,
    )
    return carried.selectExpr(
        *_without(carried, BLOCK, "_base", "_upto"), f"coalesce(_upto, 0) + coalesce(_base, 0) as {name}"
    )


def previous_value(
    df: DataFrame, keys: list[str], seq: str, value: str, name: str, *, bits: int = BLOCK_BITS
) -> DataFrame:
    """``value`` of the preceding row of the key; null on its first row."""
    within = f"over ({in_block(keys, seq)})"
    carried = with_prefix(
        df,
        keys,
        seq,
        partials={"_last": f"max_by({value}, {seq})"},
        before={"_carry": "last(_last)"},
        local={"_first": f"row_number() {within} = 1", "_lag": f"lag({value}) {within}"},
        bits=bits,
    )
    return carried.selectExpr(
        *_without(carried, BLOCK, "_carry", "_first", "_lag"), f"if(_first, _carry, _lag) as {name}"
    )


def number_by_range(
    df: DataFrame, keys: list[str], order: list[str], name: str = "n", *, start: int = 0, slices: int
) -> DataFrame:
    """As ``number_rows`` for an order that is not one integer column.

    Rows are range-partitioned by key and order, so a large key spreads over several slices.
    Range bounds are sampled, hence the slices are written once before they are counted.
    """
    sliced = settle(
        df.repartitionByRange(slices, *keys, *order).selectExpr("*", f"spark_partition_id() as {BLOCK}")
    )
    key = ", ".join(keys)
    base = (
        sliced.groupBy(*keys, BLOCK)
        .agg(F.expr("count(1) as _rows"))
        .selectExpr(
            *keys,
            BLOCK,
            f"""sum(_rows) over (partition by {key} order by {BLOCK}
                rows between unbounded preceding and 1 preceding) as _base""",
        )
    )
    place = f"row_number() over (partition by {key}, {BLOCK} order by {', '.join(order)}) as _place"
    carried = sliced.selectExpr("*", place).join(base, [*keys, BLOCK])
    return carried.selectExpr(
        *_without(carried, BLOCK, "_base", "_place"), f"cast(_place + coalesce(_base, 0) + {start} as bigint) as {name}"
    )
