"""Token ids in ORC: integer run-length encoding, row index and Bloom filter on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirlog.llm import texts, tokens

#: Bytes of text for one file; the number of files follows the input.
FILE_BYTES = 64 << 20
STRIPE_BYTES = 16 << 20
#: Bytes of text encoded at a time (twice that takes some 80 MB more in each worker), and units that a worker
#: remembers.
SLICE_BYTES = 8 << 20
CACHED_UNITS = 1_000_000
#: Arrow batches of long id lists are kept to this many ids.
BATCH_IDS = 2 << 20

ENCODED = "doc_id bigint, tie bigint, n_tokens bigint, tokens array<int>"


def encode_documents(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """(doc_id, tie, n_tokens, tokens) of (doc_id, text, tie); a null text is empty."""

    def encode(batches):
        tokens.only(tokens.ids_cache(path, CACHED_UNITS))
        for batch in batches:
            for part in texts.slices(batch, "text", SLICE_BYTES):
                ids, counts = tokens.encode_rows(part.column("text"), path)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                off = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=off[1:])
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").cast(pa.int64()),
                        "tie": part.column("tie"),
                        "n_tokens": counts.astype(np.int64),
                        "tokens": lists,
                    }
                )
                del ids, counts, off, lists
        texts.release()

    return docs.mapInArrow(encode, ENCODED)


def write_tokens(
    docs: DataFrame,
    out: str,
    path: str,
    *,
    end_id: int | None = 1,
    files: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write the ids of every whole text to ORC files in ascending document order.

    Files are ranges of document ids, so a reader prunes files, stripes and row groups by their
    statistics, and single ids by the Bloom filter; stripes are read in parallel. Ids must fit in
    31 bits, as those of all public vocabularies do. ``files`` is the number of ranges, by default
    one for 64 MB of text. Null ids come first, repeated ids in the order
    of a digest of their text. A null text is empty and has the end id alone. An empty table
    leaves a folder with the schema. Extra columns are left out.
    """
    docs = texts.pick(docs, id_column, text_column).toDF("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    if files is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1 + int(total) // FILE_BYTES, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    # Range bounds come from a sample of the sorted rows: texts are dealt out before they are encoded.
    ranges = docs.repartitionByRange(files, "doc_id", "tie")
    (
        encode_documents(ranges, path, end_id)
        .sortWithinPartitions("doc_id", "tie")
        .withColumn("part", F.spark_partition_id())
        .write.format("orc")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.compress", "ZSTD")
        .save(out)
    )


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ENCODED + ", part int").orc(out)


def index_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files.

    ``start`` counts the ids of all documents before: running sums inside a file, whose range
    bounds them, over the totals of the files before it.
    """
    stored = read_tokens(spark, out)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))

    def digest(batches):
        for batch in batches:
            lists = batch.column("tokens")
            off = np.asarray(lists.offsets)
            ids = np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.record_batch(
                {
                    **{c: batch.column(c) for c in ("doc_id", "tie", "part")},
                    "n_tokens": np.diff(off).astype(np.int64),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    digests = stored.select("doc_id", "tie", "part", "tokens").mapInArrow(
        digest, "doc_id bigint, tie bigint, part int, n_tokens bigint, ids_crc32 bigint"
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = digests.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
