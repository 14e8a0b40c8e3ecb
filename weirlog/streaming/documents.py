"""The document table: the latest state of each document, by month and hash bucket of its id.

A document id contains the time that names its month, so a batch's rows lead to the parts that can hold
their documents. Batch N looks only at what batches before N stored, so a replay has the same outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.operators.upsert import DOCUMENT_FIELDS, LOG_ORDER, fold_upserts, latest_documents
from weirlog.schemas import ADDR, PROPERTY
from weirlog.streaming.keyed_table import KeyedTable
from weirlog.streaming.sinks import claim

_KINDS = {
    "session_type": T.IntegerType(),
    "session_data": T.ArrayType(PROPERTY),
    "msg_type": T.IntegerType(),
    "msg_ver": T.LongType(),
    "from_user": T.IntegerType(),
    "from_channel": T.IntegerType(),
    "to": T.ArrayType(ADDR),
}
DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.StringType())]
    + [T.StructField(name, _KINDS.get(name, T.StringType())) for name in DOCUMENT_FIELDS]
    + [
        T.StructField("ts_nanos", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("month", T.StringType()),
    ]
)


#: Hash buckets of a month. A table keeps the number it began with.
BUCKETS = 4


def documents(root: str) -> KeyedTable:
    return KeyedTable(root, DOCUMENTS, ("doc_id",), "version", coarse="month", buckets=BUCKETS)


def read_documents(spark: SparkSession, root: str, batch: int | None = None) -> DataFrame:
    """The document table as it is now, or as it was after a batch; empty where nothing was ever stored."""
    return documents(root).read(spark, batch)


def document_versions(batch: DataFrame, root: str) -> DataFrame:
    """(doc_id, version) of the documents of a batch (doc_id, month) that are stored; no payload is read."""
    return documents(root).versions(batch).select("doc_id", "version")


def fold_batch(updates: DataFrame, root: str, batch_id: int, **limits: int) -> DataFrame:
    """Outcome and version of a batch of updates against the table before the batch."""
    claim(updates.sparkSession, root)
    table = documents(root)
    stored = table.find(updates, before=batch_id) if table.segments(updates.sparkSession, before=batch_id) else None
    return fold_upserts(updates, "doc_id", LOG_ORDER, DOCUMENT_FIELDS, stored=stored, **limits)


def store_documents(folded: DataFrame, root: str, batch_id: int) -> None:
    """Store the final state of each document the batch changed."""
    changed = folded.where(F.col("outcome") != "noop").select(*DOCUMENTS.names)
    documents(root).change(latest_documents(changed, "doc_id"), batch_id)
