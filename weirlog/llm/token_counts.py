"""Token counts by a two-tier lookup: a broadcast table of frequent units, then worker caches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import texts, tokens

#: Entries of the broadcast table at most, and the length of a unit in it: under 4 MB in all.
FREQUENT_UNITS = 1 << 16
FREQUENT_BYTES = 48
#: A batch names the units that make up at least this share of its units, so 8,192 at most.
SHARE = 1 / 8192

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def frequent_units(docs: DataFrame, limit: int = FREQUENT_UNITS) -> list[str]:
    """The most frequent units of all texts, from what each batch finds frequent in itself.

    Only these summaries are shuffled, never the units. The list affects speed, not results.
    """

    def local(batches):
        for batch in batches:
            for part in texts.slices(batch, "text", texts.UNIT_SLICE_BYTES):
                codes, _, values, _, _ = tokens.unit_codes(part.column("text"))
                n = np.bincount(codes, minlength=len(values))
                keep = np.flatnonzero(n >= max(2.0, len(codes) * SHARE))
                units = values.take(pa.array(keep)).cast(pa.string())
                short = pc.less_equal(pc.binary_length(units), FREQUENT_BYTES)
                yield pa.record_batch(
                    {"unit": units.filter(short), "n": pa.array(n[keep]).filter(short)}
                )

    top = (
        docs.mapInArrow(local, "unit string, n bigint")
        .groupBy("unit")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "unit")
        .limit(limit)
    )
    return [r.unit for r in top.collect()]


def token_counts(
    docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 512
) -> DataFrame:
    """Bytes and tokens of every whole text.

    One row per row of ``docs``, repeated and null ids included. A null text counts as empty: no
    bytes, no tokens, not over the limit. White space alone is counted as the library does. Extra
    columns are ignored whatever their names. An empty table gives an empty result.
    """
    docs = texts.pick(docs, id_column, text_column).toDF("doc_id", "text")
    spark = docs.sparkSession
    frequent = frequent_units(docs)
    lengths = [len(x) // 4 for x in tokens.encode_units(path, frequent)]
    table = spark.sparkContext.broadcast((frequent, np.asarray(lengths, np.int32)))

    def count(batches):
        first = dict(zip(table.value[0], table.value[1].tolist(), strict=True))
        second = _counts_cache(path)
        tokens.only(second)
        for batch in batches:
            for part in texts.slices(batch, "text", texts.UNIT_SLICE_BYTES):
                codes, rows, values, raw, at = tokens.unit_codes(part.column("text"))
                units = values.to_pylist()
                found = [first.get(u) for u in units]
                miss = [i for i, v in enumerate(found) if v is None]
                for i, v in zip(miss, second.values([units[i] for i in miss]), strict=True):
                    found[i] = v
                each = np.asarray(found, np.int64)
                n = texts.sums_by_row(rows, each[codes], part.num_rows)
                size = texts.sums_by_row(rows, at[1:] - at[:-1], part.num_rows)
                yield pa.record_batch(
                    {"doc_id": part.column("doc_id").cast(pa.int64()), "n_bytes": size, "n_tokens": n, "over_limit": n > limit}
                )

    return docs.mapInArrow(count, SCHEMA)


_COUNTS: dict[str, tokens.Cache] = {}


def _counts_cache(path: str) -> tokens.Cache:
    if path not in _COUNTS:
        _COUNTS[path] = tokens.Cache(lambda many: [len(x) // 4 for x in tokens.encode_units(path, many)])
    return _COUNTS[path]
