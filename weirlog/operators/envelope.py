"""Decode log values into typed records and set bad ones aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"
LONG_MAX = 2**63 - 1


def parse_json(text: str, schema: T.StructType) -> str:
    """SQL for a struct of ``schema`` plus a corrupt-record field that is null when the text fits."""
    checked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = f"map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '{CORRUPT}')"
    return f"from_json({text}, '{checked.simpleString()}', {options})"


def not_an_object(text: str) -> str:
    """True for text that is not one JSON object: another value, none, or an object with more behind it.

    The parser would skip what follows the first object, so the text is counted as an array's element.
    """
    first = f"left(trim(leading ' \\t\\n\\r' from {text}), 1)"
    return f"({first} <> '{{' or coalesce(json_array_length(concat('[', {text}, ']')), 0) <> 1)"


def record(parsed: str, schema: T.StructType) -> str:
    """A parsed struct without its corrupt-record field."""
    fields = ", ".join(f"'{name}', {parsed}.`{name}`" for name in schema.names)
    return f"if({parsed} is null, null, named_struct({fields}))"


def compute_once(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Add an expensive column that is evaluated once per row.

    Filters on it would otherwise be pushed below it, each with its own copy of the expression.
    They stop at a generator, here one that gives back a single element.
    """
    return rows.selectExpr("*", f"explode(array({value})) as {name}")


def parse_problem(text: str, parsed: str, wide: T.StructType | None = None, nanos: list[str] | None = None) -> str:
    """Null for a record that decoded, otherwise why it did not.

    Text that is not one object is refused: the parser would take an array of one record for the
    record, and skip what follows a record. ``wide`` is the schema with decimal nanosecond fields and ``nanos`` their paths. It is
    consulted for corrupt records only.
    """
    reason = "'undecodable'"
    if wide is not None:
        again = parse_json(text, wide)
        over = " or ".join(f"coalesce({again}.{path} > {LONG_MAX}, false)" for path in nanos or [])
        reason = f"if({again}.{CORRUPT} is null and ({over}), 'ts_out_of_range', {reason})"
    return f"""case when {text} is null then 'null_record'
        when {parsed} is null or {not_an_object(text)} then 'undecodable'
        when {parsed}.{CORRUPT} is not null then {reason} end"""


def decode(
    log: DataFrame,
    schema: T.StructType,
    wide: T.StructType | None = None,
    nanos: list[str] | None = None,
    problem: str | None = None,
) -> DataFrame:
    """Add ``data`` (the record) and ``problem`` (null when it is good) to log rows.

    ``problem`` is SQL over ``data`` for what may be wrong with a record that decoded.
    """
    rows = compute_once(log.selectExpr("*", "cast(value as string) as _text"), "data", parse_json("_text", schema))
    reason = parse_problem("_text", "data", wide, nanos)
    if problem is not None:
        reason = f"coalesce({reason}, {problem})"
    return rows.selectExpr(*log.columns, f"{record('data', schema)} as data", f"{reason} as problem")


def decode_protobuf(log: DataFrame, message: str, descriptor_file: str) -> DataFrame:
    """As ``decode`` for protobuf values; needs the spark-protobuf package on the cluster."""
    from pyspark.sql.protobuf.functions import from_protobuf

    options = {"mode": "PERMISSIVE", "enums.as.ints": "true"}
    rows = log.withColumn("data", from_protobuf("value", message, descriptor_file, options))
    return rows.selectExpr(
        "*", "case when value is null then 'null_record' when data is null then 'undecodable' end as problem"
    )


def good(rows: DataFrame) -> DataFrame:
    return rows.where("problem is null").drop("problem")


def quarantine(rows: DataFrame) -> DataFrame:
    """Bad rows as hex dumps with their reason. Null records are skipped, not set aside."""
    return rows.where("problem <> 'null_record'").selectExpr(
        "topic", "partition", "offset", "hex(key) as key_hex", "hex(value) as value_hex", "problem as reason"
    )


def confirmed(rows: DataFrame) -> DataFrame:
    """Offsets to confirm: of good, bad and skipped rows alike, so that progress never sticks."""
    return rows.select("topic", "partition", "offset")


def of_type(rows: DataFrame, code: int) -> DataFrame:
    """Rows whose record carries the given tag."""
    return rows.where(f"data.type = {code}")


def type_counts(rows: DataFrame) -> DataFrame:
    """How many records carry each tag, per topic."""
    return rows.groupBy("topic", F.col("data.type").alias("type")).agg(F.expr("count(1) as records"))
