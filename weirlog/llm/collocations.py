"""Phrase collocations from FM-indexes of shards of the corpus.

A shard is some megabytes of texts as word ids, with zeros where a phrase can't go on. Its index is the
Burrows-Wheeler transform of the ids in either direction, sorted by as many words as a phrase has at
most. Phrases grow by a word at a time: what precedes (follows) the occurrences of a phrase is its interval in the
forward (backward) transform, so a shard's counts of all its one-word extensions are counts inside
intervals, and an interval of a longer phrase follows from that of a shorter one by two ranks.

Counts are summed across shards, length by length. Only extensions whose two parts are frequent across all
shards are counted (no other can be frequent), and a shard is told which of its phrases are. Pairs come
from an index of all frequent words, longer phrases from one of the words in frequent pairs. Words and
phrases are told apart by numbers given to frequent ones, never by hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import buckets as bk
from weirlog.llm import texts
from weirlog.session import join_lookup, passing, settle, store

#: Bytes of text in a shard. A longer text is cut between pieces; a longer piece is a shard of its own.
SHARD_BYTES = 12 << 20
#: Fixed bytes of the contract: ends of pieces, and what separates words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
NO_LANGUAGE = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END, _GAP = texts.table_of(PIECE_ENDS), texts.table_of(PIECE_ENDS + BLANKS)


# --- shards ---------------------------------------------------------------------------------


def _stretches(batch: pa.RecordBatch, most: int):
    """(bytes, offsets of rows, language of each row) of about ``most`` bytes."""
    for part in texts.slices(batch, "text", most):
        raw, off = texts.bytes_of(part.column("text"))
        langs = [NO_LANGUAGE if x is None else x for x in part.column("lang").to_pylist()]
        if len(raw) <= most:
            yield raw, off, langs
            continue
        ends = np.flatnonzero(_END[raw]) + 1
        lo = 0
        while lo < len(raw):
            i = np.searchsorted(ends, lo + most, "right") - 1
            if i < 0 or ends[i] <= lo:
                i += 1
            hi = int(ends[i]) if lo + most < len(raw) and i < len(ends) else len(raw)
            yield raw[lo:hi], np.array([0, hi - lo]), langs
            lo = hi


def _word_ids(raw: np.ndarray, off: np.ndarray, langs: list[str]):
    """(ids with zeros between pieces, language, word and count of each id) of a shard; ids count from 1."""
    raw = _LOWER[raw]
    starts, ends, rows = texts.words(raw, off, _GAP)
    names, lang = np.unique(np.array(langs, object), return_inverse=True) if langs else (np.zeros(0, object), np.zeros(0, int))
    code, words = texts.distinct(texts.strings(raw, starts, ends))
    key = lang[rows] * max(1, len(words)) + code
    counts = np.bincount(key, minlength=1)
    used = np.flatnonzero(counts)
    count, number = counts[used], np.zeros(len(counts), np.int32)
    number[used] = np.arange(1, len(used) + 1)
    ids = number[key]
    del key, code, counts, number
    piece = np.cumsum(_END[raw])[starts] if len(starts) else starts
    cut = np.flatnonzero((piece[1:] != piece[:-1]) | (rows[1:] != rows[:-1])) + 1
    ids = np.insert(ids, cut, 0)
    return ids, pa.array(names[used // max(1, len(words))], pa.string()), words.take(pa.array(used % max(1, len(words)))), count


_SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("id", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])
SHARDS = "shard bigint, lang string, word string, id int, n bigint, ids binary"


def shards(docs: DataFrame, size: int = SHARD_BYTES) -> DataFrame:
    """Rows of shards: one with ``ids`` each, and one for each distinct word (lang, word, id, n)."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for raw, off, langs in _stretches(batch, size):
                ids, lang, word, count = _word_ids(raw, off, langs)
                if not len(count):
                    continue
                for lo in range(0, len(count), 65536):
                    n = len(count[lo : lo + 65536])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, number)), lang.slice(lo, n), word.slice(lo, n).cast(pa.string()),
                        pa.array(np.arange(lo + 1, lo + n + 1), pa.int32()), pa.array(count[lo : lo + n], pa.int64()), pa.nulls(n, pa.binary()),
                    ], schema=_SHARDS)
                blob = zstandard.ZstdCompressor(level=1).compress(ids.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.nulls(1, f.type) for f in list(_SHARDS)[1:5]], pa.array([blob], pa.binary())], schema=_SHARDS)
                number += 1
                texts.release()

    return docs.mapInArrow(run, SHARDS)


# --- the index ------------------------------------------------------------------------------


class Transform:
    """A Burrows-Wheeler transform with ranks. Suffixes are sorted by their first ``depth`` words, which is
    as far as intervals are asked for."""

    def __init__(self, bwt: np.ndarray, words: int):
        self.bwt = bwt
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=words + 1))])
        # the places of each word, one word after another: a rank is a place among them
        self.places = np.argsort(bwt, kind="stable").astype(np.int64) + np.repeat(np.arange(words + 1), np.diff(self.first)) * (len(bwt) + 1)

    @classmethod
    def of(cls, ids: np.ndarray, words: int, depth: int) -> Transform:
        n, reach = len(ids), 1
        rank = ids.astype(np.int64)
        while reach < depth:
            step = min(reach, depth - reach)
            later = np.zeros(n, np.int64)
            later[: n - step] = rank[step:]
            key = rank * (int(rank.max(initial=0)) + 1) + later
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]]) if n else 0
            reach += step
        order = np.argsort(rank, kind="stable")
        return cls(ids[order - 1], words)

    def rank(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where suffixes that ``word`` and those before place ``at`` make up begin."""
        return np.searchsorted(self.places, word * (len(self.bwt) + 1) + at)

    def step(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of phrases of which the interval without ``word`` is [lo, hi)."""
        return self.rank(word, lo), self.rank(word, hi)

    def extensions(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(interval, word, count) of all one-word extensions in the transform's direction."""
        size = hi - lo
        word = self.bwt[np.repeat(lo, size) + texts.spread(size)].astype(np.int64)
        key = np.repeat(np.arange(len(lo)), size)[word > 0] * len(self.first) + word[word > 0]
        key.sort()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return key[at] // len(self.first), key[at] % len(self.first), np.diff(np.append(at, len(key)))


class Index:
    """A shard's ids in both directions. Phrases are numbered from 1 within their length, 0 is the empty one."""

    def __init__(self, left: Transform, right: Transform):
        self.left, self.right = left, right
        words = len(left.first) - 2
        n = np.arange(words + 1)
        # of the phrases of the current length: first and last word, parts without the last and first word, intervals
        self.first = self.last = n
        self.head = self.tail = np.zeros(words + 1, np.int64)
        self.lo, self.hi = left.first[:-1], left.first[1:]
        self.back, self.back_to = right.first[:-1], right.first[1:]

    @classmethod
    def of(cls, ids: np.ndarray, words: int, depth: int) -> Index:
        return cls(Transform.of(ids, words, depth), Transform.of(ids[::-1], words, depth))

    def grow(self, head: np.ndarray, tail: np.ndarray) -> None:
        """Go on to the phrases made of those two parts."""
        first, last = self.first[head], self.last[tail]
        lo, hi = self.left.step(first, self.lo[tail], self.hi[tail])
        back, back_to = self.right.step(last, self.back[head], self.back_to[head])
        none = np.zeros(1, np.int64)
        self.first, self.last, self.head, self.tail, self.lo, self.hi, self.back, self.back_to = (
            np.concatenate([none, x]) for x in (first, last, head, tail, lo, hi, back, back_to)
        )

    def longer(self, leftward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(head, tail, count) of the phrases that are a word longer and have both parts among the current ones."""
        if leftward:
            base, word, count = self.left.extensions(self.lo[1:], self.hi[1:])
            tail = base + 1
            head, known = self._with(self.tail, self.first, self.head[tail], word)
        else:
            base, word, count = self.right.extensions(self.back[1:], self.back_to[1:])
            head = base + 1
            tail, known = self._with(self.head, self.last, self.tail[head], word)
        return head[known], tail[known], count[known]

    def _with(self, part: np.ndarray, end: np.ndarray, of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases made of a part and a word at its end, and which of them there are."""
        scale = len(self.left.first)
        keys = part[1:] * scale + end[1:]
        order = np.argsort(keys)
        sought = of * scale + word
        at = np.minimum(np.searchsorted(keys[order], sought), max(0, len(keys) - 1))
        known = keys[order][at] == sought if len(keys) else np.zeros(len(sought), bool)
        return (order[at] + 1 if len(keys) else at), known

    def packed(self) -> bytes:
        return _packed(self.left.bwt, self.right.bwt)

    @classmethod
    def unpacked(cls, blob: bytes, words: int) -> Index:
        """Of what ``packed`` gave."""
        left, right = _unpacked(blob, 2)
        return cls(Transform(left, words), Transform(right, words))


def _packed(*ids: np.ndarray) -> bytes:
    """Arrays of one length, the bytes of a place in the numbers together."""
    planes = np.stack(ids).astype(np.int32).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blob: bytes, arrays: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).reshape(arrays, -1)


def _compact(ids: np.ndarray) -> np.ndarray:
    """Ids without words that have no neighbour, and with one zero at each gap and end."""
    lone = np.r_[True, ids[:-1] == 0] & np.r_[ids[1:] == 0, True]
    ids = np.where(lone, 0, ids)
    return np.concatenate([[0], ids[(ids > 0) | np.r_[True, ids[:-1] > 0]], [0]]).astype(np.int32)


def _in_pairs(ids: np.ndarray, first: np.ndarray, second: np.ndarray, words: int) -> np.ndarray:
    """Ids cut wherever two neighbours aren't one of the pairs, without words that are in none."""
    pairs = np.sort(first * (words + 1) + second)
    mine = ids[:-1].astype(np.int64) * (words + 1) + ids[1:]
    at = np.minimum(np.searchsorted(pairs, mine), max(0, len(pairs) - 1))
    joined = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
    return _compact(np.insert(ids, np.flatnonzero(~joined) + 1, 0))


# --- rounds ---------------------------------------------------------------------------------

_FOUND = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("index", pa.binary()), ("words", pa.binary())])
FOUND = "shard bigint, bucket int, blob binary, index binary, words binary"


def _found(shard: int, head: np.ndarray, tail: np.ndarray, count: np.ndarray, buckets: int, **blobs: bytes) -> pa.Table:
    """The phrases of a shard and their counts, packed for the buckets that add them up."""
    to = (bk.mix(head.astype(np.uint64) ^ bk.mix(tail)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((tail, head))
    rows = [
        (shard, bucket, bk.pack(head=bk.steps(h), tail=t, n=n.astype(np.int32)), None, None)
        for bucket, h, t, n in bk.split(to[order], head[order], tail[order], count[order])
    ]
    if blobs:
        rows.append((shard, None, None, blobs["index"], blobs["words"]))
    return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5, schema=_FOUND)


def _first_round(buckets: int):
    """Index a shard by its frequent words, and count pairs of them."""

    def run(key, frame):
        told = frame.filter(frame.column("ids").is_null())
        blobs = frame.filter(frame.column("ids").is_valid()).column("ids").to_pylist()
        shard = key[0].as_py()
        old, gid = (np.asarray(told.column(c), np.int64) for c in ("id", "gid"))
        order = np.argsort(gid)
        old, gid = old[order], gid[order]
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(blobs[0]), np.int32)
        number = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
        number[old] = np.arange(1, len(old) + 1)
        ids = number[ids]
        # rare words end a phrase as pieces do; words without a neighbour lead nowhere
        ids = _compact(ids)
        head, tail, count = Index.of(ids, len(old), 2).longer(True)
        gid = np.concatenate([[0], gid])
        out = _found(shard, gid[head], gid[tail], count, buckets, index=_packed(ids), words=gid[1:].tobytes())
        texts.release()
        return out

    return run


def _next_round(length: int, depth: int, buckets: int):
    """Count the phrases of ``length`` + 1 words of a shard, told its frequent ones up to ``length``. The pairs
    come with the ids, of which those in frequent pairs are indexed once more, for all longer phrases."""

    def run(key, frame):
        stored = frame.filter(frame.column("index").is_valid())
        told = frame.filter(frame.column("index").is_null())
        size = np.asarray(told.column("length"), np.int64)
        blobs = [bk.unpack(x) for x in told.column("blob").to_pylist()]
        known = np.frombuffer(stored.column("words")[0].as_py(), np.int64)
        blob, more = stored.column("index")[0].as_py(), {}
        if length == 2:
            first, second = (np.searchsorted(known, np.concatenate([b[c] for b in blobs])) + 1 for c in ("head", "tail"))
            index = Index.of(_in_pairs(_unpacked(blob, 1)[0], first, second, len(known)), len(known), depth)
            more = {"index": index.packed(), "words": known.tobytes()}
        else:
            index = Index.unpacked(blob, len(known))
        for n in range(2, length + 1):
            some = [blobs[i] for i in np.flatnonzero(size == n)]
            gid = np.concatenate([np.cumsum(b["gid"]) for b in some])
            head, tail = (np.concatenate([b[c] for b in some]) for c in ("head", "tail"))
            order = np.argsort(gid)
            index.grow(*[np.searchsorted(known, x[order]) + 1 for x in (head, tail)])
            known = gid[order]
        head, tail, count = index.longer(length % 2 == 1)
        known = np.concatenate([[0], known])
        out = _found(key[0].as_py(), known[head], known[tail], count, buckets, **more)
        texts.release()
        return out

    return run


_SUMMED = pa.schema([(c, pa.int64()) for c in ("gid", "head", "tail", "f", "shard")] + [("blob", pa.binary())])
SUMMED = "gid bigint, head bigint, tail bigint, f bigint, shard bigint, blob binary"


def _summed(least: int):
    """Add up the counts of a bucket's phrases. The frequent ones are rows (gid, head, tail, f), and each shard
    is told, packed, which of them it has."""

    def run(key, frame):
        blobs = [bk.unpack(x) for x in frame.column("blob").to_pylist()]
        shard = np.repeat(np.asarray(frame.column("shard"), np.int64), [len(b["n"]) for b in blobs])
        head = np.concatenate([np.cumsum(b["head"]) for b in blobs])
        tail, n = (np.concatenate([b[c] for b in blobs]) for c in ("tail", "n"))
        del blobs
        order = np.lexsort((tail, head))
        shard, head, tail, n = shard[order], head[order], tail[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        f = np.add.reduceat(n, at)
        often = f >= least
        gid = (key[0].as_py() << 32) + np.cumsum(often)
        keep = np.repeat(often, np.diff(np.append(at, len(n))))
        owned = np.repeat(gid, np.diff(np.append(at, len(n))))[keep]
        at, keys = at[often], int(often.sum())
        rows = [
            (to, bk.pack(gid=bk.steps(g), head=h, tail=t))
            for to, g, h, t in bk.split(shard[keep], owned, head[keep], tail[keep])
        ]
        told, blob = [list(c) for c in zip(*rows, strict=True)] if rows else [[], []]
        out = [pa.table([gid[often], head[at], tail[at], f[often], pa.nulls(keys, pa.int64()), pa.nulls(keys, pa.binary())], schema=_SUMMED)]
        out.append(pa.table([*[pa.nulls(len(told), pa.int64())] * 4, told, blob], schema=_SUMMED))
        texts.release()
        return pa.concat_tables(out)

    return run


def _frequent(rows: DataFrame, keys: str, least: int) -> DataFrame:
    """Rows of shards whose keys are frequent across all shards, with the sum ``f`` and a number ``gid`` for the
    keys. The rows are stored, so that their numbers stay; a key has a row per shard at most."""
    over = f"over (partition by {keys})"
    return rows.selectExpr("*", "monotonically_increasing_id() + 1 as row").selectExpr(
        "*", f"sum(n) {over} as f", f"min(row) {over} as gid"
    ).where(f"f >= {least}")


def frequent_phrases(docs: DataFrame, *, least: int, longest: int, shard_bytes: int = SHARD_BYTES) -> list[DataFrame]:
    """Frequent phrases by length: (gid, lang, word, f, n) of words, then (gid, head, tail, f) of two, three, ... of
    them; head and tail are the gids of a phrase without its last and first word."""
    with passing(docs.sparkSession, "phrases") as folder:
        return _levels(docs, least, longest, shard_bytes, folder)


def _levels(docs: DataFrame, least: int, longest: int, shard_bytes: int, folder: str) -> list[DataFrame]:
    stored = store(shards(docs, shard_bytes), f"{folder}/shards", compression="zstd")
    local = stored.where("word is not null").select("shard", "lang", "word", "id", "n")
    totals = local.groupBy("lang").agg(F.sum("n").alias("n"))
    told = store(_frequent(local, "lang, word", least).select("shard", "id", "gid", "lang", "word", "f"), f"{folder}/told", compression="zstd")
    words = told.groupBy("gid").agg(*[F.first(c).alias(c) for c in ("lang", "word", "f")])
    levels = [settle(join_lookup(words, totals, ["lang"]))]
    # shards without a frequent word have nothing to say
    live = told.select("shard").distinct()
    blobs = stored.where("ids is not null").select("shard", "ids").join(live, "shard", "left_semi")
    buckets = 2 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), live.count())
    rows = told.select("shard", "id", "gid").unionByName(blobs, allowMissingColumns=True)
    found = store(rows.groupBy("shard").applyInArrow(_first_round(buckets), FOUND), f"{folder}/found-2")
    known = indexes = None
    for length in range(2, longest + 1):
        if length < 4:
            indexes = found.where("index is not null").select("shard", "index", "words")
        counted = found.where("blob is not null").select("bucket", "shard", "blob")
        summed = store(counted.groupBy("bucket").applyInArrow(_summed(least), SUMMED), f"{folder}/summed-{length}")
        levels.append(settle(summed.where("gid is not null").select("gid", "head", "tail", "f")))
        if length == longest:
            break
        mine = summed.where("blob is not null").selectExpr("shard", f"{length} as length", "blob")
        known = mine if known is None else known.unionByName(mine)
        # shards where no phrase of this length is frequent have none that is longer
        live = mine.select("shard").distinct()
        rows = known.unionByName(indexes, allowMissingColumns=True).join(live, "shard", "left_semi")
        found = store(rows.groupBy("shard").applyInArrow(_next_round(length, longest, buckets), FOUND), f"{folder}/found-{length + 1}")
    return levels


# --- scores ---------------------------------------------------------------------------------


def _quotient(a: str, b: str) -> str:
    """``a`` div ``b`` of numbers of up to 38 digits."""
    return f"cast(({a}) div ({b}) as bigint)"


def collocations(
    docs: DataFrame,
    *,
    least: int = 100,
    longest: int = 5,
    share: int = 100,
    most: int = 2000,
    text_column: str = "text",
    lang_column: str = "lang",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``most`` phrases of two to ``longest`` words.

    Texts are split at ``. , ; : ! ?`` and line ends into pieces, these at blanks and tabs into words, A-Z in
    lower case. ``a`` counts a phrase, ``n`` all words of its language, ``l`` and ``r`` the two parts of the
    cut with the lowest score, floor(1000 * a * n / (l * r)), the first such one. Phrases under ``least`` are no candidates.
    A candidate goes if a longer one (kept or not) contains it and has at least ``share`` % of its
    count (``share`` up to 100). Ranks go by score, then count, both descending, then phrase in byte order.

    Null texts are empty, a null language is ``und``, repeated rows count again. Extra columns are ignored
    whatever their names. An empty table gives an empty result.
    """
    rows = texts.pick(docs, text_column, lang_column).toDF("text", "lang")
    words, *levels = frequent_phrases(rows, least=least, longest=longest, shard_bytes=shard_bytes)
    # heads and tails: counts of the phrase's first 1, 2, ... and last 1, 2, ... words
    level = words.selectExpr("gid", "lang", "n", "word as phrase", "word as last", "f", "array(f) as heads", "array(f) as tails")
    scored = []
    for place, found in enumerate(levels):
        h = level.selectExpr("gid as head", "lang", "n", "phrase as start", "heads")
        t = level.selectExpr("gid as tail", "last", "tails")
        level = settle(found.join(h, "head").join(t, "tail").selectExpr(
            "gid", "head", "tail", "lang", "n", "concat(start, ' ', last) as phrase", "last", "f",
            "concat(heads, array(f)) as heads", "concat(tails, array(f)) as tails",
        ))
        longer = None
        if place + 1 < len(levels):
            above = levels[place + 1]
            longer = above.selectExpr("head as gid", "f").unionByName(above.selectExpr("tail as gid", "f")).groupBy("gid").agg(F.max("f").alias("above"))
        kept = level if longer is None else level.join(longer, "gid", "left").where(f"above is null or 100L * above < {share} * f")
        scored.append(kept.select("lang", "n", "phrase", "f", "heads", "tails"))
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    wide = "cast({} as decimal(19,0))".format
    score = _quotient(f"{wide('f')} * {wide('n')} * 1000", f"{wide('get(heads, k - 1)')} * {wide('get(tails, size(tails) - k - 1)')}")
    cuts = f"transform(sequence(1, size(heads) - 1), k -> struct({score} as score, k as k, get(heads, k - 1) as l, get(tails, size(tails) - k - 1) as r))"
    out = out.selectExpr("lang", "phrase", "f as a", "n", f"array_min({cuts}) as cut").selectExpr("lang", "phrase", "a", "cut.l as l", "cut.r as r", "n", "cut.score as score")
    # a language's phrases are ranked in parts first, so that none passes one task whole
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = out.selectExpr("*", f"pmod(xxhash64(phrase), {parts}) as part")
    for keys in ("lang, part", "lang"):
        ranked = ranked.drop("place").selectExpr("*", f"row_number() over (partition by {keys} order by score desc, a desc, phrase) as place")
        ranked = ranked.where(f"place <= {most}")
    return ranked.selectExpr("lang", "cast(place as bigint) as rank", "phrase", "a", "l", "r", "n", "score")
