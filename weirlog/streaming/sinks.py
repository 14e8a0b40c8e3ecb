"""Sinks for micro-batches.

Everything a batch writes goes to a folder named by its batch id, once: a folder that an earlier attempt
at the batch completed is left alone, so a replay neither adds rows nor takes files from under a
reader. What an attempt left unfinished is replaced. Batch ids count from a stream's checkpoint, so a
root belongs to one stream: another one, such as the same stream with a new checkpoint, is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.schemas import LOG

Sink = Callable[[DataFrame, int], None]


OWNER = "_owner-"


class OtherStream(ValueError):
    """A sink's root was written by another stream, whose batch ids mean other rows."""


def batch_path(root: str, batch_id: int) -> str:
    return f"{root}/batch={batch_id}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def claim(spark: SparkSession, root: str) -> None:
    """Make the running stream the owner of a root, or refuse. Outside a stream nothing is checked."""
    stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if stream is None:
        return
    files, at = hadoop_path(spark, root)
    found = [s.getPath().getName() for s in files.globStatus(hadoop_path(spark, f"{root}/{OWNER}*")[1]) or []]
    if not found:
        files.create(hadoop_path(spark, f"{root}/{OWNER}{stream}")[1], True).close()
    elif f"{OWNER}{stream}" not in found:
        raise OtherStream(f"{root} belongs to stream {found[0].removeprefix(OWNER)}, not {stream}: keep its checkpoint or use a new root")


def write_once(rows: DataFrame, root: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    """Write a batch unless an earlier attempt at it was completed."""
    spark, path = rows.sparkSession, batch_path(root, batch_id)
    claim(spark, root)
    files, done = hadoop_path(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        rows.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def log_rows(rows: DataFrame, topic: str, key: str, record: str) -> DataFrame:
    """Rows in log layout: the record as JSON, keyed, at their source positions. ``topic``,
    ``key`` and ``record`` are SQL.

    A broker assigns positions of its own and ignores the last three columns.
    """
    return rows.selectExpr(
        f"encode({key}, 'UTF-8') as key",
        f"encode(to_json({record}), 'UTF-8') as value",
        f"{topic} as topic",
        "partition",
        "offset",
        "timestamp",
    )


def file_topics(root: str) -> Sink:
    """Append log rows under ``root``, one folder per batch and topic."""

    def write(rows: DataFrame, batch_id: int) -> None:
        write_once(rows, root, batch_id, ["topic"])

    return write


def kafka_topics(brokers: str) -> Sink:
    """Send log rows to Kafka, acknowledged by the leader; needs the Spark Kafka connector."""

    def write(rows: DataFrame, batch_id: int) -> None:
        sender = rows.select("key", "value", "topic").write.format("kafka")
        sender.option("kafka.bootstrap.servers", brokers).option("kafka.acks", "1").save()

    return write


_TOPIC_FILES = T.StructType([*LOG.fields, T.StructField("batch", T.LongType())])


def read_topic(spark: SparkSession, root: str, topic: str | None = None) -> DataFrame:
    rows = spark.read.schema(_TOPIC_FILES).parquet(root).select(LOG.names)
    return rows if topic is None else rows.where(F.col("topic") == topic)


def stream_topic(spark: SparkSession, root: str, topic: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(_TOPIC_FILES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(root).select(LOG.names).where(F.col("topic") == topic)


def table(root: str, partition_by: list[str] | None = None) -> Sink:
    """Append any rows under ``root``, one folder per batch."""

    def write(rows: DataFrame, batch_id: int) -> None:
        write_once(rows, root, batch_id, partition_by)

    return write


def fan_out(*sinks: Sink) -> Sink:
    """Give every sink the whole batch, which is computed once. A sink may be listed once only."""
    if len(set(map(id, sinks))) != len(sinks):
        raise ValueError("existing subscriber")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            for sink in sinks:
                sink(rows, batch_id)
        finally:
            rows.unpersist()

    return write


def progress(root: str) -> Sink:
    """Append the frontier of each partition after a batch."""

    def write(frontiers: DataFrame, batch_id: int) -> None:
        rows = frontiers.select("topic", "partition", "frontier").withColumn("batch_id", F.lit(batch_id).cast("long"))
        write_once(rows, root, batch_id)

    return write


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """What ``progress`` has saved: (topic, partition, frontier, batch_id)."""
    return spark.read.schema("topic string, partition int, frontier bigint, batch_id bigint").parquet(root)
