"""Which keys (hashes of short strings) occur with two or more owners, told to the owners.

Slices send their distinct keys to buckets; a bucket sorts them and answers the owners of those that
are shared with the number of owners. A key with many owners in one slice is sent once for all of
them and its owners are told at once: a key that a third of all documents hold costs a bucket one
entry per slice. Whoever holds such a key is told ``MANY``, in every slice alike.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weirlog.llm import buckets as bk
from weirlog.llm import texts, tokens

#: Owners of a key in one slice from which on they are told there.
LOCAL = 64
#: The count of keys with more than LOCAL owners in some slice.
MANY = 2**31 - 1


def place_of(keys: np.ndarray, buckets: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, key in it) of 64-bit keys: their upper half, or if ``whole`` all that the bucket does not tell."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    return bucket, keys // np.uint64(buckets) if whole else (keys >> np.uint64(32)).astype(np.uint32)


def full(bucket: np.ndarray | int, short: np.ndarray, buckets: int = 0) -> np.ndarray:
    """The number that replies carry for a key: the key itself where it was placed ``whole`` in one of ``buckets``."""
    if short.dtype == np.uint64:
        return short * np.uint64(buckets) + np.asarray(bucket).astype(np.uint64)
    return (np.asarray(bucket).astype(np.uint64) << np.uint64(32)) | short.astype(np.uint64)


def kind_of(turn: int) -> str:
    """The kind of the replies of a turn."""
    return f"keys{turn}" if turn else "keys"


def _reply(ids, sub, key, count, buckets, turns=1):
    for turn in range(turns):
        mine = slice(None) if turns == 1 else np.flatnonzero((key >> np.uint64(32)) % np.uint64(turns) == turn)
        for to, i, s, k, c in bk.split(bk.home(ids[mine], buckets), ids[mine], sub[mine], key[mine], count[mine]):
            order = np.lexsort((k, s, i))
            yield to, kind_of(turn), bk.pack(
                ids=bk.steps(i[order]), sub=s[order].astype(np.int32), key=k[order], count=c[order].astype(np.int32)
            )


def _send(ids: np.ndarray, sub: np.ndarray, owner: np.ndarray, key: np.ndarray, buckets: int, whole: bool, turns: int = 1):
    """Rows for the distinct (key, owner) of a slice; ``ids`` and ``sub`` name the owners."""
    if not len(key):
        return
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
    key, owner = key[keep], owner[keep]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.append(at, len(key)))
    often = np.repeat(count > LOCAL, count)
    first = np.zeros(len(key), bool)
    first[at] = True
    bucket, short = place_of(key, buckets, whole)
    if often.any():
        told = owner[often]
        yield from _reply(
            ids[told], sub[told], full(bucket[often], short[often], buckets), np.full(len(told), MANY), buckets, turns
        )
    keep = ~often | first
    for to, s, o, many in bk.split(bucket[keep], short[keep], owner[keep], often[keep]):
        order = np.argsort(s, kind="stable")
        s, o, many = s[order], o[order], many[order]
        who, index = np.unique(o, return_inverse=True)
        small = np.uint16 if len(who) < 65536 else np.uint32
        yield to, "sent", bk.pack(
            key=bk.steps(s), owner=index.astype(small), many=np.packbits(many), ids=bk.steps(ids[who]), sub=sub[who].astype(np.int32)
        )


def _judge(bucket: int, blobs: list[dict], buckets: int, turns: int = 1):
    keys = np.concatenate([np.cumsum(b["key"], dtype=b["key"].dtype) for b in blobs])
    many = np.concatenate([np.unpackbits(b["many"], count=len(b["key"])).astype(bool) for b in blobs])
    ids = np.concatenate([np.cumsum(b["ids"])[b["owner"]] for b in blobs])
    sub = np.concatenate([b["sub"][b["owner"]] for b in blobs])
    order = np.argsort(keys, kind="stable")
    keys, many, ids, sub = keys[order], many[order], ids[order], sub[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.append(at, len(keys)))
    count = np.where(np.logical_or.reduceat(many, at), MANY, count)
    each = np.repeat(count, np.diff(np.append(at, len(keys))))
    tell = (each > 1) & ~many
    yield from _reply(ids[tell], sub[tell], full(bucket, keys[tell], buckets), each[tell], buckets, turns)


def shared_keys(
    docs: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple], buckets: int, extra: Callable | None = None,
    columns: tuple[str, ...] = ("doc_id", "text"),
    slice_bytes: int = bk.SLICE_BYTES,
    whole: bool = False,
    turns: int = 1,
) -> DataFrame:
    """Replies (bucket of the id, kind ``keys``, blob) to the owners of shared keys.

    ``keys_of`` takes a slice of the columns and gives (ids, sub, owner, key): the id and number
    of each owner, and for each key the index of its owner. ``extra`` (of the
    slice and its keys) may add rows of other kinds, which go to their buckets unchanged. Keys are told apart by 32
    bits and their bucket, and replies carry these, which is enough to find candidates; with ``whole`` by all 64.
    With ``turns`` (and not ``whole``) replies are of as many kinds, see ``kind_of``; all for a key are of one.
    """

    def send(batches):
        tokens.forget()

        def found():
            for batch in batches:
                for part in texts.slices(batch, "text", slice_bytes):
                    keys = keys_of(part)
                    yield from _send(*keys, buckets, whole, turns)
                    if extra is not None:
                        yield from extra(part, keys)

        yield from bk.rows(found())
        texts.release()

    def judge(key, frame):
        kinds = frame.column("kind").to_pylist()
        sent = pa.array([k == "sent" for k in kinds])
        rest = frame.filter(pa.array([k != "sent" for k in kinds])).select(["bucket", "kind", "blob"])
        blobs = [bk.unpack(x) for x in frame.filter(sent).column("blob").to_pylist()]
        answers = bk.table(_judge(key[0].as_py(), blobs, buckets, turns) if blobs else [])
        return pa.concat_tables([rest.cast(answers.schema), answers])

    sent = texts.pick(docs, *columns).mapInArrow(send, bk.ROW)
    return sent.groupBy("bucket").applyInArrow(judge, bk.ROW)


def replies(blobs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sub, key, count) of all replies of a bucket."""
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    ids = np.concatenate([np.cumsum(b["ids"]) for b in blobs])
    return ids, *[np.concatenate([b[c] for b in blobs]) for c in ("sub", "key", "count")]
