"""Packed exchange: rows of small numbers or texts dealt to buckets as compressed blobs.

Operators that match billions of short strings would spend most of a shuffle on row overhead. Here
a slice of documents sends each bucket one row with columns of numpy arrays, sorted so that they
compress. Buckets follow the input's size, so that each is a few megabytes of work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import texts

#: Text for one bucket. More buckets than that are made for small inputs, for even tasks.
BUCKET_BYTES = 16 << 20
#: Bytes of text of a slice of documents.
SLICE_BYTES = 8 << 20

ROW = "bucket int, kind string, blob binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("blob", pa.binary())])


def bucket_count(docs: DataFrame, column: str = "text") -> int:
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * partitions, int(total) // BUCKET_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def home(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document id."""
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def pack(**columns: np.ndarray | bytes) -> bytes:
    """Arrays (or bytes) by name, with integers as differences where these are small, compressed."""
    parts = []
    for name, value in columns.items():
        if isinstance(value, bytes):
            kind, data = "b", value
        else:
            kind, data = value.dtype.str[1:], np.ascontiguousarray(value).view(np.uint8).reshape(-1, value.itemsize).T.tobytes()
        head = f"{name}:{kind}:{len(data)};".encode()
        parts += [head, data]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> dict[str, np.ndarray | bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = {}, 0
    while at < len(data):
        end = data.index(b";", at)
        name, kind, size = data[at:end].decode().split(":")
        at, to = end + 1, end + 1 + int(size)
        if kind == "b":
            out[name] = data[at:to]
        else:
            kind = np.dtype(kind)
            out[name] = np.frombuffer(data[at:to], np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()
        at = to
    return out


def rows(found: Iterable[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a few megabytes."""
    held, size = [], 0
    for row in found:
        held.append(row)
        size += len(row[2])
        if size > (4 << 20):
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list) -> pa.RecordBatch:
    a, b, c = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b), pa.array(c, pa.binary())], schema=_ARROW)


def table(found: Iterable[tuple[int, str, bytes]]) -> pa.Table:
    out = pa.Table.from_batches(rows(found), _ARROW)
    texts.release()
    return out


def split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, its part of each column), keeping the order of rows."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(at.tolist(), np.append(at[1:], len(bucket)).tolist(), strict=True):
        yield (int(bucket[a]), *[c[order[a:b]] for c in columns])


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, its first value first."""
    return np.diff(values, prepend=values.dtype.type(0))


def sent_documents(docs: DataFrame, buckets: int, carry: list[str] | None = None) -> DataFrame:
    """Whole texts of (doc_id, text) dealt to the buckets of their ids, with the columns ``carry``."""

    def run(batches):
        def found():
            for batch in batches:
                for part in texts.slices(batch, "text", SLICE_BYTES):
                    raw, off = texts.bytes_of(part.column("text"))
                    ids = texts.ids_of(part.column("doc_id"))
                    for to, pick in split(home(ids, buckets), np.arange(len(ids))):
                        pick = pick[np.argsort(ids[pick], kind="stable")]
                        size = (off[1:] - off[:-1])[pick]
                        text = b"".join([raw[off[i] : off[i + 1]].tobytes() for i in pick.tolist()])
                        null = np.packbits(np.asarray(part.column("text").is_null())[pick])
                        more = {"side": _written(part.select(carry).take(pa.array(pick)))} if carry else {}
                        yield to, "docs", pack(ids=steps(ids[pick]), size=size, null=null, text=text, **more)

        yield from rows(found())
        texts.release()

    return docs.select("doc_id", "text", *(carry or [])).mapInArrow(run, ROW)


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def carried(blobs: list[dict], order: np.ndarray) -> pa.Table:
    """The carried columns of a bucket, in the order that ``received_in_order`` gives."""
    return pa.concat_tables([pa.ipc.open_stream(b["side"]).read_all() for b in blobs]).take(pa.array(order))


def received(frame: pa.Table) -> dict[str, list[dict]]:
    """The unpacked blobs of a bucket by kind."""
    out: dict[str, list] = {}
    for kind, blob in zip(frame.column("kind").to_pylist(), frame.column("blob").to_pylist(), strict=True):
        out.setdefault(kind, []).append(unpack(blob))
    return out


def received_order(blobs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(order of the rows by id, then text; ids, sizes and bytes as they came)."""
    if not blobs:
        none = np.zeros(0, np.int64)
        return none, none, none, b""
    ids = np.concatenate([np.cumsum(b["ids"]) for b in blobs])
    size = np.concatenate([b["size"] for b in blobs])
    raw = b"".join([b["text"] for b in blobs])
    at = np.cumsum(size) - size
    if len(np.unique(ids)) < len(ids):
        keys = [(int(i), raw[a : a + n]) for i, a, n in zip(ids, at.tolist(), size.tolist(), strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
    else:
        order = np.argsort(ids)
    return order, ids, size, raw


def received_in_order(blobs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, ids, bytes, offsets) with the documents ascending by id, then by text."""
    order, ids, size, raw = received_order(blobs)
    at = np.cumsum(size) - size
    text = b"".join([raw[a : a + n] for a, n in zip(at[order].tolist(), size[order].tolist(), strict=True)])
    return order, ids[order], np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(size[order])])


def received_documents(blobs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of a bucket's documents in ascending order of ids, then of texts."""
    return received_in_order(blobs)[1:]


def received_nulls(blobs: list[dict], order: np.ndarray) -> np.ndarray:
    """Which texts were null, in order."""
    if not blobs:
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(b["null"], count=len(b["ids"])).astype(bool) for b in blobs])[order]
