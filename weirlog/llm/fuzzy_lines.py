"""Line dedup by MinHash: near-equal lines of all documents, one of each group is kept.

Lines are compared by their distinct shingles. A line's signature is a few permutations
in bins, each holding the least hash that fell into it; bands of bins are keys. Lines that share a band
key with others are told so; the distinct ones among them that meet in a key form clusters, which are
verified with exact Jaccard and joined by distributed union-find. Of each component the first line, by
document id and place, stays.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weirlog.llm import buckets as bk
from weirlog.llm import components as cc
from weirlog.llm import shared_keys as sk
from weirlog.llm import texts
from weirlog.session import join_lookup, passing, settle, store

#: Characters of a shingle, unless told otherwise; the queries and the pipeline take five.
SHINGLE = 7
#: 30 bands of 7, taken from the 64 bins of each permutation: of pairs at the threshold of 0.8, 999 in 1,000 share
#: a band. Of lines that share a twentieth of their shingles 2 in 10^8 do (12 bands of 4 would find 998 and 7 in 10^5):
#: the number of those grows with the square of the input, and with it what travels.
BANDS, ROWS, BIN_BITS = 30, 7, 6
#: Multipliers that make further permutations of a hash.
_ORDERS = (1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: The bins, each in an order of its own, that an empty one looks at for a value.
_LOOK = np.argsort(np.random.Generator(np.random.PCG64(9)).random((BANDS * ROWS, 1 << BIN_BITS)), axis=1).astype(np.int16)
LEAST = 80
#: Characters hashed at a time.
CHUNK = 1 << 20
#: Bytes of lines whose shingles are compared whole, at a time: little enough to stay in a processor's cache.
PART = 1 << 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, number in its row) of the lines with ink, without white space around them."""
    newline = np.zeros(256, bool)
    newline[10] = True
    starts, ends, rows = texts.words(raw, off, newline)
    if not len(starts):
        return starts, ends, rows, rows
    breaks = np.flatnonzero(raw == 10)
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, off[rows])
    space = texts.table_of(texts.SPACE)
    starts, ends = starts.copy(), ends.copy()
    live = np.arange(len(starts))
    while len(live):
        live = live[starts[live] < ends[live]]
        live = live[space[raw[starts[live]]]]
        starts[live] += 1
    live = np.arange(len(starts))
    while len(live):
        live = live[starts[live] < ends[live]]
        live = live[space[raw[ends[live] - 1]]]
        ends[live] -= 1
    keep = starts < ends
    return starts[keep], ends[keep], rows[keep], number[keep]


def _hashes(chars: np.ndarray, shingle: int) -> np.ndarray:
    """32-bit hashes of all shingles of code points, by doubling."""
    base = 0x9E3779B1
    n = len(chars) - shingle + 1
    power = chars * np.uint32(0x85EBCA77)
    h, width, done = None, 1, 0
    while True:
        if shingle & width:
            part = power[done : done + n]
            h = part.copy() if h is None else h * np.uint32(pow(base, width, 1 << 32)) + part
            done += width
        if done == shingle:
            break
        power = power[:-width] * np.uint32(pow(base, width, 1 << 32)) + power[width:]
        width *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(16))


def _distinct_shingles(payloads: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, begins): the sorted distinct shingles of each line as 64-bit numbers, one line after another."""
    words = [p.decode(errors="replace") for p in payloads]
    size = np.array([len(w) for w in words], np.int64)
    # each line has a place for its end, so that an empty one has a place, too
    text = "\n".join(words) + "\n" + "\0" * shingle
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size + 1) - size - 1
    n = len(chars) - shingle
    key = np.zeros(n, np.uint64)
    for j in range(shingle):
        key ^= chars[j : j + n]
        if j < shingle - 1:
            key *= np.uint64(0x9E3779B97F4A7C15)
    key = bk.mix(key)
    # a shorter line is one number, which stands at its first place
    for line in np.flatnonzero(size < shingle).tolist():
        at, one = begin[line], np.array([size[line]], np.uint64)
        for c in chars[at : at + size[line]]:
            one = bk.mix(one ^ c)
        key[at] = one[0]
    count = np.maximum(size - shingle + 1, 1)
    edge = np.zeros(n + 1, np.int8)
    edge[begin] += 1
    edge[begin + count] -= 1
    key = key[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    begin = np.cumsum(count) - count
    for lo, hi in zip(begin.tolist(), (begin + count).tolist(), strict=True):
        key[lo:hi].sort()
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    new[begin] = True
    return key[new], np.append(0, np.cumsum(new))[np.append(begin, len(key))]


def _chunks(payloads: list[bytes]):
    """Runs of payloads of about ``PART`` bytes; a longer one is a run of its own."""
    at = np.append(0, np.cumsum([len(p) for p in payloads]))
    lo = 0
    while lo < len(payloads):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PART, "right")) - 1)
        yield payloads[lo:hi]
        lo = hi


def elements(payloads: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingles of each line as 64-bit numbers; a shorter line is one of its own."""
    out = []
    for some in _chunks(payloads):
        numbers, at = _distinct_shingles(some, shingle)
        out += [numbers[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def sketches(payloads: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, list[bytes]]:
    """(number of distinct shingles, how many of them fall in each of ``cc.COUNTERS`` classes as bytes) of each
    line; the second is empty where a byte does not hold a count."""
    n, counts = [np.zeros(0, np.int64)], []
    for some in _chunks(payloads):
        numbers, at = _distinct_shingles(some, shingle)
        size = np.diff(at)
        cell = np.repeat(np.arange(len(some)) * cc.COUNTERS, size) + (numbers % np.uint64(cc.COUNTERS)).astype(np.int64)
        held = np.bincount(cell, minlength=len(some) * cc.COUNTERS).reshape(len(some), cc.COUNTERS)
        n.append(size)
        counts += [c.tobytes() if fits else b"" for c, fits in zip(held.astype(np.uint8), (held < 256).all(axis=1).tolist(), strict=True)]
    return np.concatenate(n), counts


def band_keys(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Band keys (lines x BANDS) of trimmed, lower-cased lines."""
    n = len(column)
    raw, off = texts.bytes_of(column)
    at = off - np.searchsorted(np.flatnonzero((raw & 0xC0) == 0x80), off)
    chars = np.frombuffer(raw.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
    empty = np.uint32(0xFFFFFFFF)
    full = np.full((len(_ORDERS), (n + 1) << BIN_BITS), empty, np.uint32)
    size = at[1:] - at[:-1]
    with np.errstate(over="ignore"):
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
            part = chars[at[lo] : at[hi]]
            if len(part) >= shingle:
                first = _hashes(part, shingle)
                line = np.repeat(np.arange(lo, hi, dtype=np.int64) << BIN_BITS, size[lo:hi])[: len(first)]
                # shingles that reach over the end of their line
                over = (at[lo + 1 : hi + 1, None] - at[lo] - np.arange(1, shingle)).ravel()
                over = over[(over >= 0) & (over < len(first))]
                for sig, order in zip(full, _ORDERS, strict=True):
                    h = first if order == 1 else first * np.uint32(order)
                    h = h if order == 1 else (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                    flat = line | (h >> np.uint32(32 - BIN_BITS))
                    flat[over] = n << BIN_BITS
                    np.minimum.at(sig, flat, h & np.uint32((1 << (32 - BIN_BITS)) - 1))
            lo = hi
        bins = BANDS * ROWS
        # the bins of a line side by side, those of its first permutation first
        full = full.reshape(len(_ORDERS), n + 1, 1 << BIN_BITS)[:, :n].transpose(1, 0, 2).reshape(n, len(_ORDERS) << BIN_BITS)
        bare = full == empty
        none = bare.all(axis=1)
        sig = full[:, :bins].copy()
        # an empty bin takes the value of one that is not, each looking in an order of its own, so that
        # the bands of short lines are not copies of each other
        row, col = np.nonzero(bare[:, :bins] & ~none[:, None])
        for look in range(1 << BIN_BITS):
            if not len(row):
                break
            at_bin = (col >> BIN_BITS << BIN_BITS) + _LOOK[col, look]
            hit = ~bare[row, at_bin]
            sig[row[hit], col[hit]] = full[row[hit], at_bin[hit]] + (at_bin[hit] + 1).astype(np.uint32) * np.uint32(0x632BE5AB)
            row, col = row[~hit], col[~hit]
        for r in np.flatnonzero(none).tolist():
            key = np.uint32(xxhash.xxh32_intdigest(raw[off[r] : off[r + 1]].tobytes()))
            sig[r] = key + np.arange(bins, dtype=np.uint32)
        key = np.zeros((n, BANDS), np.uint64)
        for j in range(ROWS):
            key = bk.mix(key ^ sig[:, j * BANDS : (j + 1) * BANDS].astype(np.uint64))
        return bk.mix(key ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(40)))


CLASSES = "cls bigint, doc_id bigint, twin int, line int, text binary, bands binary, n bigint, sketch binary"


def _line_keys(part: pa.RecordBatch, shingle: int = SHINGLE):
    raw, off = texts.bytes_of(part.column("text"))
    raw = _LOWER[raw]
    starts, ends, rows, number = lines(raw, off)
    codes, values = texts.distinct(texts.strings(raw, starts, ends))
    keys = band_keys(values, shingle)
    ids = texts.ids_of(part.column("doc_id"))
    n = len(starts)
    return ids[rows], number.astype(np.int32), np.repeat(np.arange(n), BANDS), keys[codes].ravel()


def _classes(got: dict, shingle: int) -> pa.Table:
    """The lines of a bucket's documents that share keys, and each distinct one's text and sketch once."""
    ids, raw, off = bk.received_documents(got.get("docs", []))
    who, line, key, _ = sk.replies(got.get("keys", []))
    raw = _LOWER[raw]
    starts, ends, rows, number = lines(raw, off)
    order = np.lexsort((line, who))
    who, line, key = who[order], line[order], key[order]
    head = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (line[1:] != line[:-1])]) if len(who) else np.zeros(0, np.int64)
    stop = np.append(head[1:], len(who))
    told = {(w, l): k for k, (w, l) in enumerate(zip(who[head].tolist(), line[head].tolist(), strict=True))}
    twin = np.arange(len(ids)) - np.searchsorted(ids, ids)
    data = raw.tobytes()
    seen: set[int] = set()
    cls, at, text, bands = [], [], [], []
    for i, (s, e, w, l) in enumerate(zip(starts.tolist(), ends.tolist(), ids[rows].tolist(), number.tolist(), strict=True)):
        k = told.get((w, l))
        if k is None:
            continue
        one = data[s:e]
        c = xxhash.xxh3_64_intdigest(one) - 2**63
        first = c not in seen
        seen.add(c)
        cls.append(c)
        at.append(i)
        text.append(one if first else None)
        bands.append(key[head[k] : stop[k]].tobytes() if first else None)
    n, sketch = sketches([x for x in text if x is not None], shingle)
    place = np.cumsum([x is not None for x in text]) - 1
    pick = pa.array(place, pa.int64(), mask=np.array([x is None for x in text], bool))
    return pa.table({
        "cls": pa.array(cls, pa.int64()), "doc_id": ids[rows[at]], "twin": twin[rows[at]].astype(np.int32), "line": number[at].astype(np.int32),
        "text": pa.array(text, pa.binary()), "bands": pa.array(bands, pa.binary()),
        "n": pa.array(n, pa.int64()).take(pick), "sketch": pa.array(sketch, pa.binary()).take(pick),
    })


def repeated_lines(docs: DataFrame, buckets: int, least: int = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, twin, line) of every line that goes; ``twin`` numbers rows of one id by their texts."""

    def gather(key, frame):
        out = _classes(bk.received(frame), shingle)
        texts.release()
        return out

    def bands(batches):
        for batch in batches:
            keys = [np.frombuffer(k, np.int64) for k in batch.column("bands").to_pylist()]
            yield pa.record_batch(
                {
                    "id": np.repeat(np.asarray(batch.column("cls"), np.int64), [len(k) for k in keys]),
                    "key": np.concatenate([*keys, np.zeros(0, np.int64)]),
                }
            )

    with passing(docs.sparkSession, "lines") as folder:
        with passing(docs.sparkSession, "lines-told") as aside:
            # the keys of lines without a near one are most of what is sent; once the others are told they go
            told = store(sk.shared_keys(docs, partial(_line_keys, shingle=shingle), buckets), f"{aside}/told")
            held = bk.sent_documents(docs, buckets).unionByName(told).groupBy("bucket").applyInArrow(gather, CLASSES)
            held = store(held, f"{folder}/held", compression="zstd")
        some = held.where("text is not null")
        keys = some.select("cls", "bands").mapInArrow(bands, "id bigint, key bigint")
        # only lines that the counts leave a chance send their texts
        counts = some.selectExpr("cls as id", "n", "sketch").dropDuplicates(["id"])
        counts = store(counts, f"{folder}/counts", compression="zstd")
        members = some.selectExpr("cls as id", "0L as n", "text as keys")
        bins = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = cc.gathered(keys)
        found = cc.components(cc.links(members, met, bins, least, partial(elements, shingle=shingle), counts))
        place = held.select("cls", "doc_id", "twin", "line").join(found.withColumnRenamed("node", "cls"), "cls", "left")
        place = settle(place.selectExpr("coalesce(root, cls) as root", "doc_id", "twin", "line"))
    first = place.groupBy("root").agg(F.min(F.struct("doc_id", "twin", "line")).alias("first"), F.count("*").alias("c"))
    return (
        join_lookup(place, first.where("c > 1"), ["root"])
        .where("struct(doc_id, twin, line) <> first")
        .select("doc_id", "twin", "line")
    )


def dedup_lines(
    docs: DataFrame, *, least: int = LEAST, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """All columns of ``docs`` with the repeated lines taken out of the text, and ``n_lines`` and
    ``n_removed`` (lines with ink, and those taken out), unless columns have these names already.

    Lines are compared without white space around them and without regard to ASCII case; two are
    alike when 100 * intersection >= least * union of their shingles. A line of fewer than ``shingle``
    characters is like equal ones only. Lines without ink are left as they are. The first of a group
    by document id, then by text among rows of one id, then by place, stays. A null text stays null,
    a null id counts as the smallest. An empty table gives an empty result.
    """
    other = [c for c in docs.columns if c not in (id_column, text_column)]
    names = {c: f"c{i}" for i, c in enumerate(other)}
    plain = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"),
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
    )
    buckets = bk.bucket_count(plain)
    gone = repeated_lines(plain.select("doc_id", "text"), buckets, least, shingle)

    def tell(batches):
        for batch in batches:
            ids = texts.ids_of(batch.column("doc_id"))
            twin, line = (np.asarray(batch.column(c), np.int32) for c in ("twin", "line"))
            found = [
                (to, "gone", bk.pack(ids=bk.steps(i), twin=t, line=l))
                for to, i, t, l in bk.split(bk.home(ids, buckets), ids, twin, line)
            ]
            yield from bk.rows(found)

    carry = list(names.values())
    sent = bk.sent_documents(plain, buckets, carry)
    schema = StructType([*plain.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])

    def cut(key, frame):
        got = bk.received(frame)
        blobs = got.get("docs", [])
        order, ids, raw, off = bk.received_in_order(blobs)
        null = bk.received_nulls(blobs, order)
        drop: dict[int, set] = {}
        for b in got.get("gone", []):
            rows = np.searchsorted(ids, np.cumsum(b["ids"])) + b["twin"]
            for r, l in zip(rows.tolist(), b["line"].tolist(), strict=True):
                drop.setdefault(r, set()).add(l)
        _, _, inked, _ = lines(raw, off)
        total = np.bincount(inked, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
        text = []
        for r in range(len(ids)):
            one = raw[off[r] : off[r + 1]].tobytes()
            if r in drop:
                one = b"\n".join([x for k, x in enumerate(one.split(b"\n")) if k not in drop[r]])
            text.append(None if null[r] else one)
        side = bk.carried(blobs, order) if carry and blobs else None
        texts.release()
        out = {"doc_id": texts.ids_back(ids), "text": pa.array(text, pa.binary()).cast(pa.string())}
        for c in carry:
            out[c] = side.column(c) if side is not None else pa.array([], pa.null())
        out["n_lines"] = pa.array(total.astype(np.int64))
        out["n_removed"] = pa.array([len(drop.get(r, ())) for r in range(len(ids))], pa.int64())
        return pa.table(out)

    done = sent.unionByName(gone.mapInArrow(tell, bk.ROW)).groupBy("bucket").applyInArrow(cut, schema)
    inner = {id_column: "doc_id", text_column: "text"} | names
    return done.select(
        *[F.col(inner[c]).alias(c) for c in docs.columns], *[c for c in ("n_lines", "n_removed") if c not in docs.columns]
    )
