"""Texts in numpy: Arrow columns as bytes, words, units, spans. Used inside Spark tasks.

A *unit* is a run of white space and the run of other characters after it. Tokenizers whose tokens
never go from other characters into white space treat units alone as they treat the whole text,
so each distinct unit of a batch is encoded once.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A null id takes part as the smallest id and is null again in results.
NULL_ID = -(2**63)
#: Bytes of text that are worked on at a time. It bounds memory; nothing is cut by it.
SLICE_BYTES = 4 << 20
#: The same for work on distinct units, which repeat less in small slices.
UNIT_SLICE_BYTES = 12 << 20
#: White space of the word contracts, in ASCII.
SPACE = b" \t\n\x0b\x0c\r"


def release() -> None:
    """Give free memory back to the system: idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with those of the operator."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def table_of(chars: bytes) -> np.ndarray:
    """Truth table over byte values."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), NULL_ID))


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, off = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans that don't overlap, in order, as a string column."""
    if len(starts) and np.array_equal(starts[1:], ends[:-1]):
        offsets, data = np.append(starts, ends[-1]), raw
    else:
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        edge = np.zeros(len(raw) + 1, np.int8)
        if (starts < ends).all():  # then no start and no end is there twice
            edge[starts] += 1
            edge[ends] -= 1
        else:
            np.add.at(edge, starts, 1)
            np.subtract.at(edge, ends, 1)
        data = raw[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    data = np.ascontiguousarray(data)
    return pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)
    )


def words(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that aren't separators, and the row of each."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~separators[raw]
    edge = inside[1:] != inside[:-1]
    # a word ends where its row ends
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    joined = cut[inside[cut] & inside[cut + 1]]
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(joined):
        joined = np.unique(joined)
        starts = np.sort(np.concatenate([starts, joined]))
        ends = np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def units(
    raw: np.ndarray, off: np.ndarray, space: np.ndarray, whole: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets of the units (with the end of the last one appended) and the row of each.

    ``whole``: rows that are one unit each.
    """
    n = len(raw)
    ws = space[raw]
    start = np.zeros(n + 1, bool)
    if n:
        start[1:n] = ws[1:] & ~ws[:-1]
        if whole is not None and whole.any():
            for r in np.flatnonzero(whole):
                start[off[r] : off[r + 1]] = False
        begins = off[:-1][off[1:] > off[:-1]]
        start[begins] = True
    at = np.flatnonzero(start)
    return np.append(at, n), np.searchsorted(off, at, "right") - 1


def distinct(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the rows and the distinct values."""
    coded = column.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def spread(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after another."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(lengths) - lengths, lengths)


def gather(codes: np.ndarray, offsets: np.ndarray, values: np.ndarray, at_once: int = 1 << 17) -> np.ndarray:
    """The values of each code's list, in the order of ``codes``."""
    sizes = offsets[1:] - offsets[:-1]
    out = np.empty(int(sizes[codes].sum()), values.dtype)
    done = 0
    for lo in range(0, len(codes), at_once):
        part = codes[lo : lo + at_once]
        lengths = sizes[part]
        found = values[np.repeat(offsets[:-1][part], lengths) + spread(lengths)]
        out[done : done + len(found)] = found
        done += len(found)
    return out


def sums_by_row(rows: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(rows, values, n).astype(np.int64)
