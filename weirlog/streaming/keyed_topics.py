"""Topics whose rows are dealt to partitions by key and numbered there without gaps.

A broker gives each row of a partition the next position. File topics written here do the same, so a topic derived
from another one, of which some rows were set aside, has no gaps, and its frontier reaches its end. Positions go on
from batch to batch. They follow from the order of the rows alone, not from tasks, and a batch is written once, so
running it again gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.operators.blocks import number_by_range
from weirlog.operators.progress import PARTITION
from weirlog.schemas import LOG
from weirlog.session import join_lookup
from weirlog.streaming.keyed_table import KeyedTable
from weirlog.streaming.sinks import Sink, batch_path, claim, hadoop_path, read_topic, write_once

ENDS = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("last", T.LongType()),
        T.StructField("version", T.LongType()),
    ]
)
#: Order of a batch's rows: that of the source, its partitions in turn.
ORDER = ["offset", "source", "timestamp", "digest"]


def rows_root(root: str) -> str:
    """Where the rows are, for ``sinks.read_topic`` and ``sinks.stream_topic``."""
    return f"{root}/rows"


def ends(root: str) -> KeyedTable:
    """The last position of each partition."""
    return KeyedTable(f"{root}/ends", ENDS, ("topic", "partition"), "version", buckets=1)


def target_partition(partitions: int, spread: int = 1) -> str:
    """SQL for the partition a row goes to, by its ``key``.

    All rows of a key go to one partition. Where few keys hold most rows, ``spread`` lets a key have up to so many,
    told apart by the source partition: rows of a key that come from one partition still stay in order. Rows
    without a key are dealt by source partition and stretches of 1,024 positions.
    """
    salt = f"pmod(partition, {spread})" if spread > 1 else "0"
    text = "if(key is null, encode(concat(partition, '/', offset div 1024), 'UTF-8'), key)"
    return f"cast(pmod(cast(conv(left(md5({text}), 8), 16, 10) as bigint) + if(key is null, 0, {salt}), {partitions}) as int)"


def placed(rows: DataFrame, root: str, batch_id: int, partitions: int, spread: int = 1, slices: int | None = None) -> DataFrame:
    """A batch's log rows with the partition and position they get."""
    spark = rows.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.selectExpr(
        "key", "value", "topic", f"{target_partition(partitions, spread)} as partition", "offset", "partition as source", "timestamp", "xxhash64(value) as digest"
    )
    numbered = number_by_range(dealt, PARTITION, ORDER, "place", start=-1, slices=slices)
    last = ends(root)
    known = last.rows_of(spark, last.segments(spark, before=batch_id)).select(*PARTITION, "last")
    both = join_lookup(numbered, known, PARTITION, "left")
    return both.selectExpr("key", "value", "topic", "partition", "place + coalesce(last, -1L) + 1 as offset", "timestamp")


def keyed_topics(root: str, partitions: int, spread: int = 1, slices: int | None = None) -> Sink:
    """Sink for log rows like ``sinks.file_topics``, for topics of so many partitions, with positions of their own.

    Rows of a batch are in the order of their source positions. A partition that holds most rows of a batch is numbered by
    ranges, in ``slices`` tasks (as many as a shuffle has if not told otherwise). Rows need a topic, a source partition and
    an offset, as all rows of a log have.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark, store = rows.sparkSession, rows_root(root)
        claim(spark, root)
        files, done = hadoop_path(spark, f"{batch_path(store, batch_id)}/_SUCCESS")
        if not files.exists(done):
            write_once(placed(rows, root, batch_id, partitions, spread, slices), store, batch_id, ["topic"])
        # the ends are those of what was written, whichever attempt did it
        written = read_batch(spark, root, batch_id).groupBy(*PARTITION).agg(F.max("offset").alias("last"))
        ends(root).change(written.withColumn("version", F.lit(batch_id).cast("long")), batch_id)

    return write


def read_batch(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    store = rows_root(root)
    return spark.read.schema(LOG).option("basePath", batch_path(store, batch_id)).parquet(batch_path(store, batch_id)).select(LOG.names)


def read_keyed(spark: SparkSession, root: str, topic: str | None = None) -> DataFrame:
    return read_topic(spark, rows_root(root), topic)
