"""SimHash near duplicates by anchor points.

Fingerprints that differ in at most four of 64 bits differ in one bit at most of the first 23, in one at
most of the next 23, or in none of the last 18. Each of the three views has a linear code as its anchors:
the Golay code (every 23-bit word is within 3 bits of exactly one codeword) for the first two, all words
for the third. A fingerprint goes to every anchor within the code's covering radius plus the view's share of the
threshold (six, six and one at most), so two that link meet at the anchor nearest to either, and are
compared there on all 64 bits.

Only distinct fingerprints are dealt. Where more of them than LOAD meet at one anchor, its members are
dealt further by combinations of chunks of their other bits, some of which must be equal in a linked
pair; what still meets in larger numbers is compared in blocks of LOAD, so no task depends on how
crowded an anchor is. Links are never listed: an anchor gives a spanning forest.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import components as cc
from weirlog.llm import texts
from weirlog.session import join_lookup, settle

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints that are compared at one anchor, or in one block of a crowded one, at a time.
LOAD = 8192
#: Entries that a task compares.
UNIT = 1 << 17
#: Generator polynomial of the binary Golay code of length 23 (a fixed value).
GOLAY = 0xC75
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- fingerprints ---------------------------------------------------------------------------


def _joined(raw: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words with one space after each: (bytes, starts, ends, words per row)."""
    raw = _LOWER[raw]
    starts, ends, rows = texts.words(raw, off, texts.table_of(texts.SPACE))
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, ends, 1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    gap = np.ones(len(out), bool)
    gap[to + size] = False
    out[gap] = raw[inside]
    return out.tobytes(), to, to + size, texts.sums_by_row(rows, None, len(off) - 1)


def fingerprints(column: pa.Array, size: int = SHINGLE, at_once: int = 1 << 18) -> np.ndarray:
    """The 64-bit fingerprint of each text. Bit j is set where more than half of the shingles' hashes have it."""
    raw, off = texts.bytes_of(column)
    out = np.zeros(len(column), np.uint64)
    if not len(raw):
        return out
    data, starts, ends, words = _joined(raw, off)
    taken = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    first = np.cumsum(words) - words
    row = np.repeat(np.arange(len(words)), taken)
    lead = first[row] + texts.spread(taken)
    last = lead + np.minimum(words, size)[row] - 1
    begin, end = starts[lead], ends[last]
    ones = np.zeros((len(column), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(row), at_once):
        some = slice(lo, lo + at_once)
        spans = zip(begin[some].tolist(), end[some].tolist(), strict=True)
        found = np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, len(row[some]))
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.flatnonzero(np.r_[True, row[some][1:] != row[some][:-1]])
        ones[row[some][at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > taken[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(majority).view(np.uint64).ravel()


def fingerprinted(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of rows (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in texts.slices(batch, "text"):
                fps = fingerprints(part.column("text"), size).view(np.int64)
                yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "fp": fps})
        texts.release()

    return docs.mapInArrow(run, "doc_id bigint, fp bigint")


# --- anchors --------------------------------------------------------------------------------


@dataclass(frozen=True)
class View:
    """Some consecutive bits of a fingerprint with a code for its anchors."""

    shift: int
    bits: int
    radius: int
    share: int
    generator: int = 1  # 1: every word is a codeword

    @functools.cached_property
    def patterns(self) -> tuple[np.ndarray, np.ndarray]:
        """Error patterns up to radius + share by syndrome, lightest first: (offsets of the syndromes, patterns)."""
        errors = [0]
        for weight in range(1, self.radius + self.share + 1):
            errors += [sum(1 << i for i in places) for places in itertools.combinations(range(self.bits), weight)]
        errors = np.array(errors, np.int64)
        syndrome = self.syndrome(errors)
        order = np.argsort(syndrome, kind="stable")
        counts = np.bincount(syndrome, minlength=1 << (self.generator.bit_length() - 1))
        return np.concatenate([[0], np.cumsum(counts)]), errors[order]

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        """Remainders by the generator polynomial; zero for codewords."""
        rest, degree = words.copy(), self.generator.bit_length() - 1
        for bit in range(self.bits - 1, degree - 1, -1):
            rest ^= ((rest >> bit) & 1) * (self.generator << (bit - degree))
        return rest

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the fingerprint, anchor, whether it is the nearest one) of all anchors in reach."""
        words = ((fps >> np.uint64(self.shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        off, errors = self.patterns
        s = self.syndrome(words)
        count = off[s + 1] - off[s]
        place = texts.spread(count)
        who = np.repeat(np.arange(len(fps)), count)
        return who, words[who] ^ errors[off[s][who] + place], place == 0


VIEWS = (View(0, 23, 3, 1, GOLAY), View(23, 23, 3, 1, GOLAY), View(46, 18, 0, 0))
ENTRY = "view int, k1 bigint, k2 bigint, fp bigint, home boolean"


def _entries(fps: DataFrame) -> DataFrame:
    """One row per fingerprint and anchor in reach."""

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp"), np.int64)
            for lo in range(0, len(fp), 65536):
                some = fp[lo : lo + 65536]
                for number, view in enumerate(VIEWS):
                    who, anchor, home = view.anchors(some.view(np.uint64))
                    yield pa.record_batch({
                        "view": np.full(len(who), number, np.int32), "k1": anchor, "k2": np.zeros(len(who), np.int64), "fp": some[who], "home": home
                    })

    return fps.select("fp").mapInArrow(run, ENTRY)


def _chunks(view: View, level: int) -> list[int]:
    """Masks of the bits outside a view, cut into level + DISTANCE chunks: a linked pair has ``level`` of them equal."""
    rest = [b for b in range(64) if not view.shift <= b < view.shift + view.bits]
    n = level + DISTANCE
    return [sum(1 << b for b in rest[i * len(rest) // n : (i + 1) * len(rest) // n]) for i in range(n)]


#: Levels at which crowded anchors are dealt further, and how much less meets at each.
LEVELS = range(1, 6)


def _dealt_further(entries: DataFrame) -> DataFrame:
    """Entries of crowded anchors (with ``level``) under the values of combinations of chunks of their other bits."""

    def run(batches):
        for batch in batches:
            view, k1, fp, level = (np.asarray(batch.column(c)) for c in ("view", "k1", "fp", "level"))
            home = np.asarray(batch.column("home").to_numpy(zero_copy_only=False), bool)
            for v, n in sorted(set(zip(view.tolist(), level.tolist(), strict=True))):
                pick = np.flatnonzero((view == v) & (level == n))
                for number, masks in enumerate(itertools.combinations(_chunks(VIEWS[v], n), n)):
                    value = fp[pick].view(np.uint64) & np.uint64(sum(masks))
                    # the view itself has 23 bits at most, so that number and anchor fit one key
                    yield pa.record_batch({
                        "view": view[pick], "k1": k1[pick] | np.int64((n * 1024 + number + 1) << 24), "k2": value.view(np.int64), "fp": fp[pick], "home": home[pick]
                    })

    return entries.select("view", "k1", "fp", "home", "level").mapInArrow(run, ENTRY)


_KEY = ["view", "k1", "k2"]


def _crowded(entries: DataFrame, load: int) -> DataFrame:
    return settle(entries.groupBy(*_KEY).agg(F.count("*").alias("members")).where(f"members > {load}"))


def dealt(fps: DataFrame, load: int = LOAD) -> DataFrame:
    """Entries with the block of their home side (``a``) and of their visiting side (``b``) at the anchor."""
    entries = settle(_entries(fps))
    crowded = _crowded(entries, load)
    if crowded.isEmpty():
        return entries.selectExpr("*", "0L as a", "0L as b")
    level = " ".join(f"when members <= {load}L << {n * 41 // (n + DISTANCE)} then {n}" for n in LEVELS)
    crowded = crowded.selectExpr(*_KEY, f"case {level} else {LEVELS[-1]} end as level")
    rest = join_lookup(entries, crowded, _KEY, "left_anti")
    further = settle(_dealt_further(join_lookup(entries, crowded, _KEY)))
    crowded = _crowded(further, load)
    entries = rest.unionByName(join_lookup(further, crowded, _KEY, "left_anti")).selectExpr("*", "0L as a", "0L as b")
    if crowded.isEmpty():
        return entries
    # the rest in a grid: a block of those at home meets every block of the others
    blocks = crowded.selectExpr(*_KEY, f"cast(ceil(members / {load}) as bigint) as blocks")
    grid = join_lookup(further, blocks, _KEY).selectExpr("*", "pmod(xxhash64(fp), blocks) as mine")
    columns = [*_KEY, "fp"]
    at_home = grid.where("home").selectExpr(*columns, "true as home", "mine as a", "explode(sequence(0, blocks - 1)) as b")
    visiting = grid.selectExpr(*columns, "false as home", "explode(sequence(0, blocks - 1)) as a", "mine as b")
    return entries.unionByName(at_home).unionByName(visiting)


# --- links ----------------------------------------------------------------------------------


def _labels(home: np.ndarray, fps: np.ndarray, distance: int, at_once: int = 1 << 20) -> np.ndarray:
    """For each of the sorted ``fps`` the smallest index it is joined with by links to ``home``."""
    label = np.arange(len(fps))
    mine = np.searchsorted(fps, home)
    step = max(1, at_once // max(1, len(fps)))
    for lo in range(0, len(mine), step):
        some = mine[lo : lo + step]
        i, j = np.nonzero(np.bitwise_count(fps[some, None] ^ fps[None, :]) <= distance)
        i = some[i]
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    return label


def links(entries: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between fingerprints with the components of all links of ``dealt`` entries."""

    def run(key, frame):
        columns = [np.asarray(frame.column(c), np.int64) for c in ("view", "k1", "k2", "a", "b")]
        fp = np.asarray(frame.column("fp"), np.int64).view(np.uint64)
        home = np.asarray(frame.column("home").to_numpy(), bool)
        order = np.lexsort((~home, fp, *columns))
        fp, home = fp[order], home[order]
        columns = [c[order] for c in columns]
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]
        # a fingerprint once in each group, as one at home where it is both
        once = new | np.r_[True, fp[1:] != fp[:-1]]
        group, fp, home = np.cumsum(new)[once], fp[once], home[once]
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.append(at[1:], len(group))
        found = [np.zeros((0, 2), np.uint64)]
        for lo, hi in zip(at[ends - at > 1].tolist(), ends[ends - at > 1].tolist(), strict=True):
            some = fp[lo:hi]
            label = _labels(some[home[lo:hi]], some, distance)
            joined = np.flatnonzero(label != np.arange(len(some)))
            if len(joined):
                found.append(np.stack([some[label[joined]], some[joined]], axis=1))
        edges = np.concatenate(found).view(np.int64)
        texts.release()
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    bins = max(2 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.count() // UNIT)
    units = entries.selectExpr("*", f"pmod(xxhash64({', '.join(_KEY)}, a, b), {bins}) as unit")
    return units.groupBy("unit").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, load: int = LOAD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; ``fp`` is the fingerprint as a signed number.

    Words are runs of other than ASCII white space, with A-Z in lower case; a shingle is four words in a row,
    repeats included, or all words where there are fewer. Texts without words and null texts have
    fingerprint zero and link like any other. A component is named by its smallest document id. Rows that
    repeat an id or a text are rows of their own. A null id is named by itself unless it links to
    documents with ids. Extra columns are ignored whatever their names. An empty table gives an empty result.
    """
    rows = settle(fingerprinted(texts.pick(docs, id_column, text_column).toDF("doc_id", "text")))
    fps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")))
    roots = cc.components(links(dealt(fps, load))).withColumnRenamed("node", "fp")
    rooted = settle(fps.join(roots, "fp", "left").selectExpr("fp", "first", "members", "coalesce(root, fp) as root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("members").alias("size")).where("size > 1")
    names = rooted.join(named, "root").select("fp", "component_id")
    return join_lookup(rows, names, ["fp"], "left").selectExpr("doc_id", "fp", "coalesce(component_id, doc_id) as component_id")
