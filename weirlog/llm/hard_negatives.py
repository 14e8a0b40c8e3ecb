"""Hard negatives of anchors among labelled vectors, from exact integer inner products.

Anchors meet candidates in tiles: a block of anchors times a block of candidates, multiplied by
Strassen's recursion on 64-bit integers, odd sides padded with zeros. Every tile keeps a short heap per
anchor; heaps merge by Spark's ranked windows, which trim each task's rows before the shuffle. The
first round finds the positives, in tiles of the anchors' own labels only; the second one fills a heap for
the score window of each positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import texts
from weirlog.session import settle

#: Sides of a product up to which it is multiplied plainly.
LEAF = 32
#: Bytes of vectors in the blocks of a tile; its scores are made in strips of STRIP anchors and candidates.
ANCHOR_BYTES, CANDIDATE_BYTES = 4 << 20, 2 << 20
STRIP = (512, 4096)
#: Labels are dealt to so many buckets in the first round; a bucket is cut into blocks like the whole table.
LABEL_BUCKETS = 64
_LEAST = np.iinfo(np.int64).min


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of 64-bit integers by Strassen's seven products. Additions wrap around, so the result is
    exact wherever it fits 64 bits, whatever the sums on the way."""
    (m, k), n = a.shape, b.shape[0]
    if min(m, k, n) <= LEAF:
        return a @ b.T
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if n % 2 or k % 2:
        b = np.pad(b, ((0, n % 2), (0, k % 2)))
    hm, hk, hn = a.shape[0] // 2, a.shape[1] // 2, b.shape[0] // 2
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b21, b12, b22 = b[:hn, :hk], b[:hn, hk:], b[hn:, :hk], b[hn:, hk:]
    out = np.empty((2 * hm, 2 * hn), np.int64)
    c11, c12, c21, c22 = out[:hm, :hn], out[:hm, hn:], out[hm:, :hn], out[hm:, hn:]
    p = multiply(a11 + a22, b11 + b22)
    c11[:] = p
    c22[:] = p
    p = multiply(a21 + a22, b11)
    c21[:] = p
    c22 -= p
    p = multiply(a11, b12 - b22)
    c12[:] = p
    c22 += p
    p = multiply(a22, b21 - b11)
    c11 += p
    c21 += p
    p = multiply(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += multiply(a21 - a11, b11 + b12)
    c11 += multiply(a12 - a22, b21 + b22)
    return out[:m, :n]


class Heaps:
    """The best (score, id) of each row, higher scores first, ties by smaller id."""

    def __init__(self, rows: int, width: int):
        self.held = np.zeros((rows, width), bool)
        self.score = np.full((rows, width), _LEAST)
        self.id = np.zeros((rows, width), np.int64)

    def merge(self, held: np.ndarray, score: np.ndarray, ids: np.ndarray, at: slice = slice(None)) -> None:
        width = self.held.shape[1]
        both = [np.concatenate([mine[at], new], axis=1) for mine, new in ((self.held, held), (self.score, score), (self.id, ids))]
        order = np.lexsort((both[2], ~both[1], ~both[0]))[:, :width]
        self.held[at], self.score[at], self.id[at] = (np.take_along_axis(x, order, 1) for x in both)

    def push(self, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, at: slice) -> None:
        """Take in the allowed ones of a strip of scores; ``ids`` ascend."""
        rows, width = len(score), self.held.shape[1]
        masked = np.where(allowed, score, _LEAST)
        every = np.arange(rows)
        held, best, who = np.zeros((rows, width), bool), np.zeros((rows, width), np.int64), np.zeros((rows, width), np.int64)
        for place in range(width):
            col = masked.argmax(axis=1)
            held[:, place] = allowed[every, col] & (masked[every, col] > _LEAST)
            if not held[:, place].any():
                break
            best[:, place], who[:, place] = score[every, col], ids[col]
            masked[every, col] = _LEAST
        self.merge(held, best, who, at)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pc.list_value_length(column), np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(size)), size), texts.spread(size)] = np.asarray(column.flatten(), np.int64)
    return out


def _sides(frame: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(anchors, candidates by ascending id) of a tile."""
    anchor = frame.column("anchor")
    return frame.filter(anchor), frame.filter(pc.invert(anchor)).sort_by([("vec_id", "ascending"), ("n", "ascending")])


def _strips(a: np.ndarray, c: np.ndarray):
    """(anchors, candidates, scores) of a tile, a strip at a time."""
    width = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
    for i in range(0, len(a), STRIP[0]):
        for j in range(0, len(c), STRIP[1]):
            yield slice(i, min(i + STRIP[0], len(a))), slice(j, min(j + STRIP[1], len(c))), multiply(a[i : i + STRIP[0]], c[j : j + STRIP[1]])


def _column(frame: pa.Table, name: str) -> np.ndarray:
    return np.asarray(frame.column(name), np.int64)


def _positives(count: int):
    def run(key, frame):
        anchors, others = _sides(frame)
        a, c = _matrix(anchors.column("vec")), _matrix(others.column("vec"))
        an, cn, al, cl, ids = (_column(t, x) for t, x in ((anchors, "n"), (others, "n"), (anchors, "label"), (others, "label"), (others, "vec_id")))
        heaps = Heaps(len(a), count)
        for i, j, score in _strips(a, c):
            heaps.push(score, (al[i, None] == cl[None, j]) & (an[i, None] != cn[None, j]), ids[j], i)
        row, place = np.nonzero(heaps.held)
        out = {"aid": an[row], "positive_id": heaps.id[row, place], "positive_score": heaps.score[row, place]}
        texts.release()
        return pa.table(out)

    return run


def _negatives(count: int, low: int, high: int):
    def window(score: int) -> tuple[int, int]:
        return -(-low * score // 100), high * score // 100

    def run(key, frame):
        anchors, others = _sides(frame)
        a, c = _matrix(anchors.column("vec")), _matrix(others.column("vec"))
        al, cl, ids = _column(anchors, "label"), _column(others, "label"), _column(others, "vec_id")
        scores = anchors.column("scores").to_pylist()
        most = max(map(len, scores), default=0)
        # windows in Python's integers, which don't overflow; an absent one is empty
        bounds = np.array([[window(s) for s in row] + [(1, 0)] * (most - len(row)) for row in scores], np.int64).reshape(-1, most, 2)
        heaps = [Heaps(len(a), count) for _ in range(most)]
        for i, j, score in _strips(a, c):
            other = al[i, None] != cl[None, j]
            for k, heap in enumerate(heaps):
                heap.push(score, other & (score >= bounds[i, k, 0, None]) & (score <= bounds[i, k, 1, None]), ids[j], i)
        parts = []
        for k, heap in enumerate(heaps):
            row, place = np.nonzero(heap.held)
            parts.append((_column(anchors, "n")[row], np.full(len(row), k), heap.id[row, place], heap.score[row, place]))
        names = ("aid", "place", "negative_id", "negative_score")
        texts.release()
        return pa.table({x: np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i, x in enumerate(names)})

    return run


_TILE = ("anchor", "n", "vec_id", "label", "vec")


def _tiles(anchors: DataFrame, rows: DataFrame, a_parts: str, c_parts: str, *more: str) -> DataFrame:
    """Rows of all tiles: every anchor block with every candidate block of the same ``bucket``."""
    extra = [f"{x}" for x in more]
    left = anchors.selectExpr("bucket", f"pmod(xxhash64(n), {a_parts}) as a", f"explode(sequence(0, {c_parts} - 1)) as c", "true as anchor", *_TILE[1:], *extra)
    right = rows.selectExpr("bucket", f"explode(sequence(0, {a_parts} - 1)) as a", f"pmod(xxhash64(n, 1), {c_parts}) as c", "false as anchor", *_TILE[1:])
    same = "cast({} as bigint) as {}".format
    columns = ["bucket", *(same(x, x) for x in "ac"), *_TILE]
    right = right.selectExpr(*columns, *(f"cast(null as {dict(anchors.dtypes)[x]}) as {x}" for x in extra))
    return left.selectExpr(*columns, *extra).unionByName(right).groupBy("bucket", "a", "c")


def _best(rows: DataFrame, keys: str, score: str, who: str, count: int) -> DataFrame:
    ranked = rows.selectExpr("*", f"row_number() over (partition by {keys} order by {score} desc, {who}) as rank")
    return ranked.where(f"rank <= {count}")


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def hard_negatives(
    vectors: DataFrame,
    *,
    anchors: str = "vec_id % 50 = 0",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``; scores are their inner products. ``anchors`` is SQL for which rows
    are anchors and ``label`` for a row's label, over (vec_id, label). An anchor's positives are its best
    ``positives`` other rows of the same label; the negatives of a positive are the best ``negatives`` rows of
    other labels with low % to high % of the positive's score. Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that
    repeat another in id, label and components count once; rows that share an id only are rows of their
    own. A vector that is shorter than another is filled up with zeros, an empty one included. Components
    beyond 64 bits become the nearest 64-bit number, and scores beyond 64 bits are taken modulo 2^64.
    A positive with a negative score has an empty window. Extra columns are ignored whatever their names;
    an empty table gives an empty result.
    """
    x = f"cast({scale} as double) * cast(x as double)"
    found = texts.pick(vectors, id_column, label_column, vector_column).toDF("vec_id", "label", "vec").selectExpr(
        "cast(vec_id as bigint) as vec_id", "cast(label as bigint) as label", "vec"
    )
    sound = "not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    found = found.where("vec_id is not null and label is not null and vec is not null").where(sound)
    found = found.selectExpr("vec_id", f"cast({label} as bigint) as label", f"transform(vec, x -> floor({x})) as vec").where("label is not null")
    bucket = f"pmod(xxhash64(label), {LABEL_BUCKETS})"
    # equal rows meet by map-side aggregation, so that a row that is a third of the table costs nothing
    settled = settle(found.groupBy("vec_id", "label", "vec").agg(F.lit(1)).selectExpr("vec_id", "label", "vec", f"({anchors}) as is_anchor"))
    rows = settled.selectExpr("*", "monotonically_increasing_id() as n", f"{bucket} as bucket")

    counts = {r.bucket: r for r in rows.groupBy("bucket").agg(
        F.count("*").alias("c"), F.expr("count_if(is_anchor)").alias("a"), F.max(F.size("vec")).alias("d")).collect()}
    width = 8 * max([1, *(r.d for r in counts.values())])
    per_anchor, per_candidate = max(1, ANCHOR_BYTES // width), max(1, CANDIDATE_BYTES // width)

    def parts(of: str, size: int) -> str:
        each = [str(_blocks(getattr(counts[b], of), size)) if b in counts else "1" for b in range(LABEL_BUCKETS)]
        return f"element_at(array({', '.join(each)}), cast(bucket as int) + 1)"

    asked = rows.where("is_anchor")
    # buckets without an anchor are not dealt at all
    live = [b for b, r in counts.items() if r.a]
    there = rows.where(F.col("bucket").isin(live)) if live else rows.where("false")
    tiles = _tiles(asked, there, parts("a", per_anchor), parts("c", per_candidate))
    best = tiles.applyInArrow(_positives(positives), "aid bigint, positive_id bigint, positive_score bigint")
    best = settle(_best(best, "aid", "positive_score", "positive_id", positives))

    lists = best.groupBy("aid").agg(F.expr("array_sort(collect_list(struct(rank, positive_id, positive_score)))").alias("found"))
    windows = asked.join(lists, asked.n == lists.aid).selectExpr("0L as bucket", *_TILE[1:], "found.positive_score as scores")
    a_parts = _blocks(sum(r.a for r in counts.values()), per_anchor)
    c_parts = _blocks(sum(r.c for r in counts.values()), per_candidate)
    tiles = _tiles(windows, rows.drop("bucket").selectExpr("0L as bucket", *_TILE[1:]), str(a_parts), str(c_parts), "scores")
    mined = tiles.applyInArrow(_negatives(negatives, low, high), "aid bigint, place bigint, negative_id bigint, negative_score bigint")
    mined = _best(mined, "aid, place", "negative_score", "negative_id", negatives)
    named = best.join(asked.selectExpr("n as aid", "vec_id as anchor_id"), "aid").selectExpr(
        "aid", "anchor_id", "positive_id", "positive_score", "cast(rank - 1 as bigint) as place"
    )
    return mined.join(named, ["aid", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
