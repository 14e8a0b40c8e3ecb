"""Benchmark decontamination with a positional inverted index over the training texts.

The index is a table of postings: for each segment of documents (some megabytes of text) and each
term, the positions of the term counted through the segment. Segments are bounded, so neither a
common term nor a large source makes a large row or a large group. A search takes the phrases of
the benchmark to every segment, starts from the postings of each phrase's rarest term there and
intersects them with the postings of the other terms, rarest next, after taking off the offsets.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import texts, tokens
from weirlog.session import scratch

#: Bytes of text of a segment at most (a longer text is a segment of its own).
SEGMENT_BYTES = 8 << 20
#: Terms and phrases are broadcast in blocks of benchmark items of about this many bytes of text.
BLOCK_BYTES = 16 << 20
WINDOW = 13
#: Word characters: everything but ASCII other than digits and lower-case letters.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

INDEX = "segment string, kind string, term string, n int, row bigint, places binary"


def item_words(column: pa.Array) -> list[list[str]]:
    """Lower-cased words of each text."""
    raw, off = texts.bytes_of(column)
    raw = _LOWER[raw]
    starts, ends, rows = texts.words(raw, off, texts.table_of(SEPARATORS))
    found = texts.strings(raw, starts, ends).to_pylist()
    cuts = np.searchsorted(rows, np.arange(len(column) + 1))
    return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def build_index(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Postings of (doc_id, text): one row per segment and term, and one per document.

    ``kind`` is ``term`` (``n`` postings, ``places`` their positions as int32) or ``doc`` (``term``
    is the document's id or null, ``n`` its number of words, ``row`` its place in the segment). With
    ``terms``, a sorted list, only these are indexed. Write the result before it is searched: a
    segment is named by the task that made it.
    """
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        tokens.forget()
        only = None if known.value is None else pa.array(known.value, pa.large_string())
        task, number_of = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            for part in texts.slices(batch, "text", SEGMENT_BYTES):
                raw, off = texts.bytes_of(part.column("text"))
                raw = _LOWER[raw]
                starts, ends, rows = texts.words(raw, off, texts.table_of(SEPARATORS))
                codes, values = texts.distinct(texts.strings(raw, starts, ends))
                keep = np.arange(len(values))
                if only is not None:
                    keep = np.flatnonzero(np.asarray(pc.is_in(values, value_set=only)))
                number = np.full(len(values), -1, np.int64)
                number[keep] = np.arange(len(keep))
                mine = number[codes]
                place = np.flatnonzero(mine >= 0).astype(np.int32)
                order = np.argsort(mine[place], kind="stable")
                place, counts = place[order], np.bincount(mine[place], minlength=len(keep))
                data, cut = place.tobytes(), np.concatenate([[0], 4 * np.cumsum(counts)])
                words = texts.sums_by_row(rows, None, part.num_rows)
                ids = part.column("doc_id").cast(pa.int64())
                n, m = len(keep), part.num_rows
                yield pa.record_batch(
                    {
                        "segment": pa.array([f"{task}-{next(number_of)}"] * (n + m)),
                        "kind": pa.array(["term"] * n + ["doc"] * m),
                        "term": pa.concat_arrays([values.take(pa.array(keep)).cast(pa.string()), ids.cast(pa.string())]),
                        "n": np.concatenate([counts, words]).astype(np.int32),
                        "row": np.concatenate([np.zeros(n, np.int64), np.arange(m)]),
                        "places": pa.array(
                            [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] + [None] * m,
                            pa.binary(),
                        ),
                    }
                )

        texts.release()

    return texts.pick(docs, "doc_id", "text").mapInArrow(run, INDEX)


class Segment:
    """Postings of one segment."""

    def __init__(self, terms: list[str], places: list[np.ndarray], n_words: int):
        self.number = {t: i for i, t in enumerate(terms)}
        self.sizes = np.array([len(p) for p in places] + [0], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.places = np.concatenate([*places, np.zeros(0, np.int32)]).astype(np.int64)
        self.n_words = n_words
        # (term, position) as one ascending number, for membership
        self.span = n_words + 1
        self.keys = np.repeat(np.arange(len(self.sizes)), self.sizes) * self.span + self.places

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term * self.span + place
        if not len(self.keys):
            return np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0) & (place < self.n_words)

    def phrases(self, phrases: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of each occurrence of phrases of equal length."""
        none = np.zeros(0, np.int64)
        if not phrases:
            return none, none
        absent = len(self.sizes) - 1
        terms = np.array([[self.number.get(w, absent) for w in p] for p in phrases], np.int64)
        live = np.flatnonzero((self.sizes[terms] > 0).all(axis=1))
        if not len(live):
            return none, none
        terms = terms[live]
        # rarest first
        order = np.argsort(self.sizes[terms], axis=1, kind="stable")
        rarest = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
        counts = self.sizes[rarest]
        which = np.repeat(np.arange(len(live)), counts)
        start = self.places[np.repeat(self.at[rarest], counts) + texts.spread(counts)] - order[which, 0]
        for k in range(1, terms.shape[1]):
            offset = order[which, k]
            ok = self.has(terms[which, offset], start + offset)
            which, start = which[ok], start[ok]
        inside = (start >= 0) & (start + terms.shape[1] <= self.n_words)
        return live[which[inside]], start[inside]

    def near(self, words: list[str], slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Spans of at most ``len(words) + slack`` words that start with one of ``words`` and hold
        all of them."""
        ids = [self.number.get(w) for w in dict.fromkeys(words)]
        none = np.zeros(0, np.int64)
        if not ids or None in ids:
            return none, none
        ids.sort(key=lambda i: self.sizes[i])
        lists = [self.places[self.at[i] : self.at[i] + self.sizes[i]] for i in ids]
        reach = len(words) + slack
        # only what stands within reach of the rarest word can start a span
        start = np.unique(np.concatenate(lists))
        at = np.searchsorted(lists[0], start)
        ok = at < len(lists[0])
        start = start[ok][lists[0][at[ok]] < start[ok] + reach]
        end = start + 1
        for places in lists:
            at = np.searchsorted(places, start)
            ok = at < len(places)
            start, end, at = start[ok], end[ok], at[ok]
            end = np.maximum(end, places[at] + 1)
            ok = end <= start + reach
            start, end = start[ok], end[ok]
        return start, end


def windows_of(words: list[str], window: int = WINDOW) -> list[tuple[str, ...]]:
    if not words:
        return []
    if len(words) < window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


HITS = "segment string, row bigint, doc_id bigint, n_words bigint, spans array<int>, items array<string>"


def search(
    index: DataFrame, items: list[tuple[str, list[str]]], window: int = WINDOW, slack: int | None = None, whole: bool = False
) -> DataFrame:
    """Per indexed document: words, hit spans (int32 pairs, counted inside it) and item ids; or if ``items`` are the
    ``whole`` benchmark, its row of the result: a step of its own for that would keep a second Python worker
    beside each.

    ``slack`` asks for proximity: an item also matches where all words of one of its windows stand
    in any order within that many more words.
    """
    known = index.sparkSession.sparkContext.broadcast(items)
    names = [f.name for f in index.schema]

    def run(key, frame):
        rows = {c: frame.column(c) for c in names}
        kind = rows["kind"].to_pylist()
        isdoc = np.array([k == "doc" for k in kind], bool)
        docs = frame.filter(pa.array(isdoc)).sort_by("row")
        posts = frame.filter(pa.array(~isdoc))
        n = np.asarray(docs.column("n"), np.int64)
        first = np.cumsum(n) - n
        segment = Segment(
            posts.column("term").to_pylist(),
            [np.frombuffer(p, np.int32) for p in posts.column("places").to_pylist()],
            int(n.sum()),
        )
        by_length: dict[int, dict[tuple, set]] = {}
        for item, words in known.value:
            for w in windows_of(words, window):
                by_length.setdefault(len(w), {}).setdefault(w, set()).add(item)
        # documents without words share positions with their neighbours and never match
        solid = np.flatnonzero(n)
        spans: dict[int, set] = {}
        found: dict[int, set] = {}
        for length, phrases in sorted(by_length.items()):
            names_of = list(phrases)
            which, start = segment.phrases(names_of)
            end = start + length
            if slack is not None:
                loose = [(p, *segment.near(list(w), slack)) for p, w in enumerate(names_of)]
                which = np.concatenate([which, *[np.full(len(a), p) for p, a, _ in loose]])
                start = np.concatenate([start, *[a for _, a, _ in loose]])
                end = np.concatenate([end, *[b for _, _, b in loose]])
            if not len(which):
                continue
            doc = solid[np.searchsorted(first[solid], start, "right") - 1]
            ok = end <= (first + n)[doc]
            for p, d, a, b in zip(*(x[ok].tolist() for x in (which, doc, start, end)), strict=True):
                spans.setdefault(d, set()).add((a - int(first[d]), b - int(first[d])))
                found.setdefault(d, set()).update(phrases[names_of[p]])
        ids = docs.column("term").cast(pa.int64())
        flat = [[x for span in sorted(spans.get(d, ())) for x in span] for d in range(len(n))]
        return pa.table(
            {
                "segment": docs.column("segment"),
                "row": docs.column("row"),
                "doc_id": ids,
                "n_words": n,
                "spans": pa.array(flat, pa.list_(pa.int32())),
                "items": pa.array([sorted(found.get(d, ())) for d in range(len(n))], pa.list_(pa.string())),
            }
        )

    def judged(key, frame):
        out = pa.Table.from_batches(_finish(run(key, frame).to_batches()))
        texts.release()
        return out

    return index.groupBy("segment").applyInArrow(judged, RESULT) if whole else index.groupBy("segment").applyInArrow(run, HITS)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    slack: int | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every whole text.

    One row per row of ``docs``; ids may be null or repeat. A null or empty text has no words and is
    clean. Items without words match nothing, repeated items count once per id, a null item id is
    named ``null``. An empty benchmark leaves all texts clean; an empty table of documents gives an
    empty result. Extra columns are ignored whatever their names.

    Postings are written once to the shared folder: those of the benchmark's terms, or of all terms
    if the benchmark is larger than a block. Each block of items is then read by the driver,
    broadcast, and searched in the stored index.
    """
    spark = docs.sparkSession
    docs = texts.pick(docs, id_column, text_column).toDF("doc_id", "text")
    marks = texts.pick(benchmark, item_column, item_text_column).toDF("item_id", "text")
    marks = marks.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    total = marks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(total) // BLOCK_BYTES

    def block(b: int) -> list[tuple[str, list[str]]]:
        rows = marks.where(f"pmod(xxhash64(item_id, text), {blocks}) = {b}").orderBy("item_id", "text").collect()
        return [(r.item_id, w) for r, w in zip(rows, item_words(pa.array([r.text for r in rows], pa.string())), strict=True)]

    only = sorted({w for _, words in block(0) for w in words}) if blocks == 1 else None
    out = scratch(spark, "postings")
    build_index(docs, only).write.parquet(out)
    index = spark.read.schema(INDEX).parquet(out)
    found = [search(index, block(b), window, slack, blocks == 1) for b in range(blocks)]
    if blocks == 1:
        return found[0]
    both = functools.reduce(DataFrame.unionByName, found)
    met = both.groupBy("segment", "row", "doc_id", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return met.mapInArrow(_finish, RESULT)


RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, contaminated boolean"


def _finish(batches):
    for batch in batches:
        n = np.asarray(batch.column("n_words"), np.int64)
        hit = np.zeros(len(n), np.int64)
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            reach = 0
            for a, b in sorted(zip(spans[0::2], spans[1::2], strict=True)):
                hit[i] += max(0, b - max(a, reach))
                reach = max(reach, b)
        items = batch.column("items")
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": n,
                "n_hit": hit,
                "n_items": pc.list_value_length(items).cast(pa.int64()),
                "items": items,
                "contaminated": (hit > 0) & (20 * hit >= n),
            }
        )
