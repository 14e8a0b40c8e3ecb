"""Exact Jaccard links between documents' word shingles: a grouped prefix join.

Shingles are ordered by how many documents hold them, rarest first, so that what only one document
holds leads. A document with more than a quarter of such shingles can link to none and drops out;
the others carry on their shared shingles alone. Documents that link share a shingle among the first
quarter of each, their prefixes. Documents with the same shingles are one class, classes with the same
prefix and size one group; groups that hold a shingle in their prefixes meet if their sizes allow a link, and
what meets is expanded and verified member by member with exact intersections of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import buckets as bk
from weirlog.llm import components as cc
from weirlog.llm import shared_keys as sk
from weirlog.llm import texts
from weirlog.session import join_lookup, settle

SHINGLE = 5
#: Bytes of text of a slice: it has one key per word.
SLICE_BYTES = 3 << 20
#: Bytes hashed at a time.
HASHED_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, in order of rows."""
    raw, off = texts.bytes_of(column)
    raw = _LOWER[raw]
    starts, ends, rows = texts.words(raw, off, texts.table_of(texts.SPACE))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        word = word_hashes(raw, starts, ends)
        counts = texts.sums_by_row(rows, None, len(column))
        first = np.cumsum(counts) - counts
        key = np.zeros(len(word), np.uint64)
        length = np.minimum(counts, size)[rows]
        for j in range(size):
            part = np.zeros(len(word), np.uint64)
            part[: len(word) - j] = word[j:] if j else word
            inside = j < length
            key = np.where(inside, (key ^ part) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j), key)
            key ^= key >> np.uint64(32)
        keep = np.arange(len(word)) - first[rows] <= (counts - np.minimum(counts, size))[rows]
        rows, key = rows[keep], bk.mix(key[keep])
    order = np.lexsort((key, rows))
    rows, key = rows[order], key[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])]
    return rows[new], key[new]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending byte spans: sums of their bytes scattered by place."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + HASHED_BYTES)))
        first, last = starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        part = raw[starts[lo] : ends[hi - 1]].astype(np.uint64)
        begin = np.zeros(len(part), np.int64)
        begin[first] = first
        np.maximum.accumulate(begin, out=begin)
        place = (np.arange(len(part)) - begin).astype(np.uint64)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(bk.mix((part + np.uint64(1)) | (place << np.uint64(8))), out=total[1:])
        out[lo:hi] = bk.mix(total[last] - total[first] + (last - first).astype(np.uint64))
        lo = hi
    return out


SETS = "rid bigint, doc_id bigint, tie bigint, n bigint, own bigint, keys binary"


def shared_sets(docs: DataFrame, least: int) -> DataFrame:
    """(rid, doc_id, tie, n, own, keys) of every row: a number for it, a digest of its text, its set's size, how many elements
    are its own, and the shared ones in ascending order of owners (null where it can't link)."""
    buckets = bk.bucket_count(docs)
    numbered = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("real"), F.xxhash64("text").alias("tie"), "text"
    ).withColumnRenamed("rid", "doc_id")

    def keys_of(part: pa.RecordBatch):
        rows, key = shingles(part.column("text"))
        ids = texts.ids_of(part.column("doc_id"))
        return ids, np.zeros(len(ids), np.int32), rows, key

    def sizes(part: pa.RecordBatch, found: tuple):
        rows = found[2]
        ids, real, tie = (texts.ids_of(part.column(c)) for c in ("doc_id", "real", "tie"))
        n = texts.sums_by_row(rows, None, len(ids))
        for to, i, r, t, c in bk.split(bk.home(ids, buckets), ids, real, tie, n):
            yield to, "sizes", bk.pack(ids=i, real=r, tie=t, n=c)

    def survive(key, frame):
        got = bk.received(frame)
        size = got.get("sizes", [])
        if not size:
            kinds = {c: pa.binary() if c == "keys" else pa.int64() for c in ("rid", "doc_id", "tie", "n", "own", "keys")}
            return pa.schema(kinds).empty_table()
        ids, real, tie, n = (np.concatenate([b[c] for b in size]) for c in ("ids", "real", "tie", "n"))
        order = np.argsort(ids)
        ids, real, tie, n = ids[order], real[order], tie[order], n[order]
        who, _, keys, count = sk.replies(got.get("keys", []))
        row = np.searchsorted(ids, who)
        order = np.lexsort((keys, count, row))
        row, keys = row[order], keys[order]
        held = np.bincount(row, minlength=len(ids))
        at = np.concatenate([[0], np.cumsum(held)])
        can = (held > 0) & (100 * held >= least * n)
        data = [keys[at[r] : at[r + 1]].tobytes() if can[r] else None for r in range(len(ids))]
        texts.release()
        return pa.table(
            {"rid": ids, "doc_id": texts.ids_back(real), "tie": tie, "n": n, "own": n - held, "keys": pa.array(data, pa.binary())}
        )

    told = sk.shared_keys(numbered, keys_of, buckets, extra=sizes, columns=("doc_id", "real", "tie", "text"), slice_bytes=SLICE_BYTES, whole=True)
    return told.groupBy("bucket").applyInArrow(survive, SETS)


def prefixes(groups: DataFrame, least: int) -> DataFrame:
    """(id, n, key) of the shared shingles in the sets' prefixes."""

    def run(batches):
        for batch in batches:
            n, own = (np.asarray(batch.column(c), np.int64) for c in ("n", "own"))
            take = np.maximum(n - -(-least * n // 100) + 1 - own, 0)
            keys = [np.frombuffer(k, np.uint64)[:t] for k, t in zip(batch.column("keys").to_pylist(), take.tolist(), strict=True)]
            size = [len(k) for k in keys]
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).astype(np.int64)
            yield pa.record_batch({"id": np.repeat(np.asarray(batch.column("id"), np.int64), size), "n": np.repeat(n, size), "key": flat})

    return groups.select("id", "n", "own", "keys").mapInArrow(run, "id bigint, n bigint, key bigint")


def met(held: DataFrame, least: int) -> DataFrame:
    """(id, root) of the groups that share a prefix shingle and whose sizes let them link: the smaller is at least
    ``least`` hundredths of the larger.

    Groups of a shingle meet under its smallest one. Where their sizes differ by more than a link allows, they meet there
    by classes of size, each as wide as a link: a group is in its own class and in the next, so two that may
    link are in one together, and two that are more than two classes apart don't meet under that shingle.
    """
    keys = held.groupBy("key").agg(
        F.min("id").alias("root"), F.max("id").alias("last"), F.min("n").alias("low"), F.max("n").alias("high")
    ).where("root < last").selectExpr("key", "root", f"100 * low >= {least} * high as near")
    # a little wider than a link, as logarithms are rounded
    size = f"cast(floor(ln(n) / ln({100 / least} * (1 + 1e-9D))) as bigint)"
    places = f"if(near, array(root), array(xxhash64(root, {size}), xxhash64(root, {size} + 1)))"
    return join_lookup(held, keys, ["key"]).selectExpr("id", f"explode({places}) as root").distinct()


def similar_documents(
    docs: DataFrame, *, least: int = 75, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, leader, tie) of every row: documents link when 100 * intersection >=
    least * union of their distinct shingles; a component is named by its smallest document id. One row
    of each component is its ``leader``, one with that id; ``tie`` is a digest of the row's text.

    A text of fewer than five words is one shingle; one without words, or null, has none and stays
    alone. Rows that repeat an id are documents of their own. A null id is named by itself unless
    it links to documents with ids. Extra columns are ignored whatever their names. An empty table
    gives an empty result.
    """
    docs = texts.pick(docs, id_column, text_column).toDF("doc_id", "text")
    sets = settle(shared_sets(docs, least).withColumn("class", F.expr("if(own = 0 and keys is not null, md5(concat(keys, cast(n as string))), null)")))
    some = sets.where("keys is not null")
    whole = settle(some.where("class is not null").groupBy("class").agg(F.min("rid").alias("id")))
    member = settle(
        join_lookup(some.select("rid", "doc_id", "class"), whole, ["class"], "left").selectExpr("rid", "doc_id", "coalesce(id, rid) as id")
    )
    # sets are large, so they are not shuffled to be told apart: those alone in their class stay where they are
    firsts = join_lookup(some.where("class is not null"), whole, ["class"]).where("id = rid")
    columns = "rid as id", "n", "own", "keys"
    reps = settle(some.where("class is null").selectExpr(*columns).unionByName(firsts.selectExpr(*columns)))
    # classes with the same prefix and size are one group
    take = f"greatest(n - cast(ceil({least} * n / 100.0) as bigint) + 1 - own, 0)"
    grouped = reps.withColumn(
        "grp", F.expr(f"if(own = 0, md5(concat(substring(keys, 1, cast(8 * {take} as int)), cast(n as string))), cast(id as string))")
    )
    lead = grouped.groupBy("grp").agg(F.min("id").alias("lead"))
    ledger = settle(grouped.select("id", "grp").join(lead, "grp").select("id", "lead"))
    leads = join_lookup(reps, ledger.where("id <> lead").select("id"), ["id"], "left_anti")
    groups = met(prefixes(leads, least), least).withColumnRenamed("id", "lead")
    cluster = ledger.join(groups, "lead").select("id", "root")
    bins = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), reps.count() // (2 * cc.BLOCK))
    found = cc.components(cc.links(reps.select("id", "n", "keys"), cluster, bins, least))
    named = settle(member.join(found.withColumnRenamed("node", "id"), "id", "left").selectExpr("rid", "doc_id", "coalesce(root, id) as root"))
    smallest = named.groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "rid")).alias("first"), F.count("*").alias("c")
    ).where("c > 1")
    named = join_lookup(named, smallest, ["root"]).selectExpr("rid", "component_id", "rid = first.rid as leader")
    return sets.select("rid", "doc_id", "tie", "n").join(named, "rid", "left").selectExpr(
        "doc_id", "n as n_shingles", "coalesce(component_id, doc_id) as component_id", "coalesce(leader, true) as leader", "tie"
    )
