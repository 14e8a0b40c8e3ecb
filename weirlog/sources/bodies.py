"""Landed request bodies: one JSON array of requests per text value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirlog.operators.envelope import CORRUPT, LONG_MAX, compute_once, not_an_object, parse_json, record
from weirlog.schemas import MSG_REQ, MSG_REQ_WIDE

# The time a body landed is that of its file, so that reading it again gives the same.
_BODY = ("_metadata.file_path as body_id", "value", "_metadata.file_modification_time as landed")


def read_bodies(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Bodies under ``path``: one per file, or one per line."""
    return spark.read.text(path, wholetext=whole_files).selectExpr(*_BODY)


def stream_bodies(
    spark: SparkSession, path: str, whole_files: bool = True, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.option("wholetext", whole_files)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).selectExpr(*_BODY)


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """Add ``elements`` and ``problem``. A body fails as a whole when any element does.

    Everything happens inside the row, so bodies never shuffle. Elements are cut out as text
    first: parsing straight into an array of records would keep damaged ones.
    """
    rows = compute_once(bodies, "_parts", "from_json(value, 'array<string>')")
    rows = compute_once(rows, "elements", f"transform(_parts, e -> {parse_json('e', MSG_REQ)})")
    beyond = f"exists(_parts, e -> coalesce({parse_json('e', MSG_REQ_WIDE)}.msg.tsNanos > {LONG_MAX}, false))"
    damaged = f"exists(elements, e -> e is null or e.{CORRUPT} is not null)"
    problem = f"""case when _parts is null then 'not_an_array'
        when exists(_parts, e -> {not_an_object('e')}) then 'bad_element'
        when {damaged} then if({beyond}, 'ts_out_of_range', 'bad_element') end"""
    return rows.selectExpr(*bodies.columns, "elements", f"{problem} as problem")


def requests_of(parsed: DataFrame) -> DataFrame:
    """The requests of good parsed bodies: ``place`` in the body and ``req``."""
    rest = [c for c in parsed.columns if c not in ("value", "elements", "problem")]
    rows = parsed.where("problem is null").selectExpr(*rest, "posexplode(elements) as (place, req)")
    return rows.selectExpr(*rest, "place", f"{record('req', MSG_REQ)} as req")


def bad_bodies(parsed: DataFrame) -> DataFrame:
    """Parsed bodies set aside, as hex dumps."""
    bad = parsed.where("problem is not null")
    return bad.selectExpr("body_id", "hex(value) as value_hex", "problem as reason")
