"""Partitioned logs: batch and streaming readers with the Kafka row layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirlog.operators.progress import EARLIEST, LATEST, PARTITION
from weirlog.schemas import LOG
from weirlog.session import join_lookup, settle


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a file log."""
    return spark.read.schema(LOG).parquet(path).select(LOG.names)


def stream_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A file log as a stream that takes at most ``files_per_batch`` files at a time."""
    reader = spark.readStream.schema(LOG)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).select(LOG.names)


def kafka_options(
    brokers: str, topic: str, starting_offsets: str = "earliest", rows_per_batch: int | None = None
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": "true",
    }
    if rows_per_batch is not None:
        options["maxOffsetsPerTrigger"] = str(rows_per_batch)
    return options


def stream_kafka(spark: SparkSession, brokers: str, topic: str, **limits) -> DataFrame:
    """The same rows from Kafka; needs the Spark Kafka connector on the cluster."""
    return spark.readStream.format("kafka").options(**kafka_options(brokers, topic, **limits)).load().select(LOG.names)


# Up to this many partitions, start positions become part of the scan's filter.
FILTER_PARTITIONS = 200


def from_starts(log: DataFrame, resume: DataFrame, filter_partitions: int = FILTER_PARTITIONS) -> DataFrame:
    """Rows at or after the start position of their partition (see ``resume_offsets``).

    There is one start per topic partition. Partitions whose start could not be resolved are
    left out. With few partitions the starts are written into the filter, where a file scan can
    skip everything older by its statistics; with many they are joined.
    """
    starts = settle(resume.where(f"start <> {LATEST}").select(*PARTITION, "start"))
    few = starts.limit(filter_partitions + 1).collect()
    if len(few) > filter_partitions:
        wanted = f"start = {EARLIEST} or offset >= start"
        return join_lookup(log, starts, PARTITION).where(wanted).drop("start")

    def rows_of(topic: str, partition: int, start: int) -> str:
        name = topic.replace("\\", "\\\\").replace("'", "\\'")
        since = "true" if start == EARLIEST else f"offset >= {start}"
        return f"(topic = '{name}' and partition = {partition} and {since})"

    return log.where(" or ".join(rows_of(*row) for row in few) or "false")
