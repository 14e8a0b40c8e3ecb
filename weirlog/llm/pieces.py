"""Encoding and decoding with a SentencePiece BPE vocabulary by suffix-array matching.

The distinct units of a batch are laid out as one array of characters and indexed by a suffix array
to the depth of the longest piece. Every piece is looked up by binary search; the range it finds
holds its occurrences, which become edges between character positions. Edges are sorted by the
position they end at and relaxed from left to right: a position keeps the one edge whose piece
stands beside the piece before it just as merging would leave the two. That is what makes the path
the result of merging by score and not of adding up scores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weirlog.llm import texts, tokens

BLANK = "▁"
#: White space that no piece has after another character.
CUTS = b" \n\t"
#: Longer units are relaxed one position at a time instead of side by side.
LONG = 256
#: Bytes of text encoded at a time, which bounds memory.
SLICE_BYTES = 3 << 20
#: Slots of the table of piece pairs that were judged before. A slot is overwritten when needed.
PAIR_SLOTS = 1 << 21


class Vocabulary:
    """Pieces, how each is merged, and which pieces may stand side by side."""

    def __init__(self, path: str):
        tool = tokens.tokenizer(path)
        size = len(tool)
        self.size = size
        usable = [
            i for i in range(size)
            if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i) or tool.is_unused(i))
        ]
        text = {i: tool.id_to_piece(i) for i in usable}
        self.byte_ids = np.zeros(256, np.uint32)
        for i in range(size):
            if tool.is_byte(i):
                self.byte_ids[int(tool.id_to_piece(i)[1:-1], 16)] = i
        self.is_byte = np.array([tool.is_byte(i) for i in range(size)])
        self.raw = [
            bytes([int(tool.id_to_piece(i)[1:-1], 16)]) if self.is_byte[i]
            else text[i].replace(BLANK, " ").encode() if i in text else b""
            for i in range(size)
        ]
        known = {p: i for i, p in text.items()}
        self.cuttable = not any(
            a not in (BLANK, "\n", "\t") and b in (BLANK, "\n", "\t") for p in known for a, b in zip(p, p[1:])
        )
        # characters that occur inside pieces only, then one number for all others
        inner = sorted({c for p in known for c in p} - set(known))
        symbols = dict(known) | {c: size + k for k, c in enumerate(inner)}
        self.other = size + len(inner)
        self.known, self.symbols = known, symbols
        self.depth = max(map(len, known), default=1)
        score = {i: tool.get_score(i) for i in usable}
        order = sorted({score[i] for i in usable if len(text[i]) > 1}, reverse=True)
        step = {s: k for k, s in enumerate(order)}
        self.rank = np.full(self.other + 1, -1, np.int64)
        for i in usable:
            if len(text[i]) > 1:
                self.rank[i] = step[score[i]]
        self.left = np.arange(self.other + 1)
        self.right = np.arange(self.other + 1)
        self.whole = np.ones(self.other + 1, bool)
        keys, made = [], []
        for p, i in known.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * (self.other + 1) + b)
                    made.append(self.rank[i])
        at = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[at], np.array(made, np.int64)[at]
        for p, i in known.items():
            if len(p) > 1:
                parts = self.merge(p, stop=2)
                self.whole[i] = len(parts) == 2 and "".join(parts) == p
                if self.whole[i]:
                    self.left[i], self.right[i] = symbols[parts[0]], symbols[parts[1]]
        self.slots = np.full(PAIR_SLOTS, -1, np.int64)
        self.verdicts = np.zeros(PAIR_SLOTS, bool)
        pieces = sorted(p for p, i in known.items() if self.whole[i])
        self.piece_ids = np.array([known[p] for p in pieces], np.int64)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.chars = np.zeros((len(pieces), self.depth), np.uint32)
        for r, p in enumerate(pieces):
            self.chars[r, : len(p)] = [ord(c) for c in p]

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Merging itself, best score first and leftmost among equals, for single strings."""
        parts = list(text)
        while len(parts) > stop:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = self.known.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, where = self.rank[i], k
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves ``a`` and ``b`` as they are when they stand side by side."""
        key = a * (self.other + 1) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        out = self.verdicts[slot]
        new = np.flatnonzero(self.slots[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            judged = self._judge(fresh // (self.other + 1), fresh % (self.other + 1))
            out[new] = judged[back]
            at = ((fresh.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
            self.slots[at], self.verdicts[at] = fresh, judged
            clash = self.slots[at] != fresh
            if clash.any():
                self.slots[at[clash]] = -1
        return out

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later of the two pieces' last merges again and again. Before each of them, the
        symbols that touched must not have merged with each other first."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * (self.other + 1) + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[live])
            good[live[joins]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~joins & ((rx >= 0) | (ry >= 0))
            first = more & (rx > ry)
            second = more & ~first
            a[live[first]], limit[live[first]] = self.right[x[first]], rx[first]
            b[live[second]], limit[live[second]] = self.left[y[second]], ry[second] + 1
            live = live[more]
        return good

    def encode(self, units: list[str]) -> list[bytes]:
        """Ids of each unit (white space still as such) as little-endian uint32."""
        units = [u.replace(" ", BLANK) for u in units]
        out: list = [None] * len(units)
        # pieces of blanks have equal scores; merging depends on where a run starts
        for i, u in enumerate(units):
            if BLANK * 2 in u:
                head = len(u) - len(u.lstrip(BLANK + "\n\t"))
                if len(u) <= 64 or head == len(u):
                    out[i] = self._ids(self.merge(u) if len(u) <= 64 else self._blanks(u))
        some = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(some, self._match([units[i] for i in some]), strict=True):
            out[i] = x
        return out

    def _blanks(self, text: str) -> list[str]:
        """Merging of a long run of white space, in parts between its control characters."""
        parts, at = [], 0
        while at < len(text):
            to = at + 1
            while to < len(text) and (text[to] == BLANK) == (text[at] == BLANK):
                to += 1
            parts += self.merge(text[at:to]) if text[at] == BLANK else list(text[at:to])
            at = to
        return parts

    def _ids(self, parts: list[str]) -> bytes:
        ids: list = []
        for p in parts:
            i = self.known.get(p)
            ids += [i] if i is not None else self.byte_ids[list(p.encode())].tolist()
        return np.array(ids, "<u4").tobytes()

    def _match(self, units: list[str]) -> list[bytes]:
        if not units:
            return []
        chars = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(u) + 1 for u in units]) - 1
        starts = np.append(0, ends[:-1] + 1)
        n = len(chars)
        # dense letters, of which as many as fit make one key
        letters = np.unique(chars)
        letters = letters if letters[0] == 0 else np.append(np.uint32(0), letters)
        code = np.searchsorted(letters, chars).astype(np.uint64)
        bits = max(1, int(len(letters)).bit_length())
        per = 64 // bits
        words = -(-self.depth // per)
        padded = np.concatenate([code, np.zeros(per * words, np.uint64)])
        keys = []
        for w in range(words):
            key = np.zeros(n, np.uint64)
            for k in range(per):
                key = (key << np.uint64(bits)) | padded[w * per + k : w * per + k + n]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        # binary search of all pieces whose letters occur
        place = np.minimum(np.searchsorted(letters, self.chars), len(letters) - 1)
        held = ((letters[place] == self.chars) | (self.chars == 0)).all(axis=1)
        which = np.flatnonzero(held)
        place, length = place[which].astype(np.uint64), self.piece_len[which]
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), n, np.int64)
        top = np.uint64((1 << bits) - 1)
        for w in range(words):
            low, high = np.zeros(len(which), np.uint64), np.zeros(len(which), np.uint64)
            for k in range(per):
                at = w * per + k
                col = place[:, at] if at < self.depth else np.zeros(len(which), np.uint64)
                low = (low << np.uint64(bits)) | col
                high = (high << np.uint64(bits)) | np.where(at < length, col, top)
            if w == 0:
                lo, hi = np.searchsorted(keys[0], low, "left"), np.searchsorted(keys[0], high, "right")
            else:
                deep = np.flatnonzero((length > w * per) & (hi > lo))
                lo[deep], hi[deep] = (
                    _bisect(keys[w], lo[deep], hi[deep], low[deep], False),
                    _bisect(keys[w], lo[deep], hi[deep], high[deep], True),
                )
        counts = np.maximum(hi - lo, 0)
        begin = suffixes[np.repeat(lo, counts) + texts.spread(counts)]
        piece = np.repeat(self.piece_ids[which], counts)
        size = np.repeat(length, counts)
        # every character that no piece matches is an edge of its own
        bare = np.ones(n, bool)
        bare[begin[size == 1]] = False
        bare[ends] = False
        alone = np.flatnonzero(bare)
        inner = np.array([self.symbols.get(chr(c), self.other) for c in letters], np.int64)
        begin = np.concatenate([begin, alone])
        piece = np.concatenate([piece, inner[code[alone].astype(np.int64)]])
        size = np.concatenate([size, np.ones(len(alone), np.int64)])
        last, back = self._relax(begin, size, piece, starts, ends, n)
        return self._paths(chars, starts, ends, last, back)

    def _relax(self, begin, size, piece, starts, ends, n):
        """The last piece of the path to each position, and that piece's length."""
        unit = np.searchsorted(starts, begin, "right") - 1
        to = begin + size
        within = to - starts[unit]
        last, back = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        long = (ends - starts)[unit] > LONG
        order = np.lexsort((to, within, long))
        begin, size, piece, to, within, long = (x[order] for x in (begin, size, piece, to, within, long))
        first = within - size == 0
        short_n = int(np.searchsorted(long, True))
        bounds = np.searchsorted(within[:short_n], np.arange(1, (within[:short_n].max() if short_n else 0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            before = last[begin[a:b]]
            fits = first[a:b].copy()
            ask = np.flatnonzero(~fits & (before >= 0))
            fits[ask] = self.beside(before[ask], piece[a:b][ask])
            last[to[a:b][fits]], back[to[a:b][fits]] = piece[a:b][fits], size[a:b][fits]
        if short_n < len(begin):
            rest = np.argsort(to[short_n:], kind="stable") + short_n
            memo: dict = {}
            for e in rest.tolist():
                b, p, t = int(begin[e]), int(piece[e]), int(to[e])
                ok = bool(first[e])
                if not ok and last[b] >= 0:
                    pair = (int(last[b]), p)
                    ok = memo.get(pair)
                    if ok is None:
                        ok = memo[pair] = bool(self.beside(np.array(pair[:1]), np.array(pair[1:]))[0])
                if ok:
                    last[t], back[t] = p, size[e]
        return last, back

    def _paths(self, chars, starts, ends, last, back) -> list[bytes]:
        """Follow all paths back at once, then deal the ids out to the units."""
        at = ends.copy()
        unit = np.arange(len(ends))
        found_unit, found_at = [], []
        while len(at):
            keep = at > starts[unit]
            at, unit = at[keep], unit[keep]
            if (back[at] == 0).any():
                raise ValueError("a position was not reached")
            found_unit.append(unit)
            found_at.append(at)
            at = at - back[at]
        if not found_at:
            return [b""] * len(starts)
        at = np.sort(np.concatenate(found_at))
        ids = last[at]
        odd = np.flatnonzero(ids >= self.size)
        counts = np.ones(len(at), np.int64)
        raws = [chr(chars[at[k] - 1]).encode() for k in odd]
        counts[odd] = [len(r) for r in raws]
        flat = np.repeat(ids, counts).astype("<u4")
        if len(odd):
            where = np.repeat((np.cumsum(counts) - counts)[odd], counts[odd]) + texts.spread(counts[odd])
            flat[where] = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
        edge = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(at, ends, "right")]
        data, edge = flat.tobytes(), (4 * edge).tolist()
        return [data[a:b] for a, b in zip([0, *edge[:-1]], edge, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD. The blank added before is removed."""
        text = b"".join([self.raw[i] for i in ids.tolist() if i < self.size]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _bisect(keys, lo, hi, value, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, len(keys) - 1)
        go = (lo < hi) & ((keys[mid] <= value) if right else (keys[mid] < value))
        stay = (lo < hi) & ~go
        lo[go], hi[stay] = mid[go] + 1, mid[stay]
    return lo


@tokens.loaded
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_CACHES: dict[str, tokens.Cache] = {}


def _cache(path: str) -> tokens.Cache:
    if path not in _CACHES:
        _CACHES[path] = tokens.Cache(lambda many: vocabulary(path).encode(many), at_once=1 << 14)
    return _CACHES[path]


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows, one after another, and the number of ids of each row."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(
        pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    raw, off = texts.bytes_of(column)
    # a blank written as such would stand beside a cut
    whole = np.asarray(pc.match_substring(column, BLANK).to_numpy(zero_copy_only=False), bool)
    if not vocabulary(path).cuttable:
        whole[:] = True
    at, rows = texts.units(raw, off, texts.table_of(CUTS), whole)
    codes, values = texts.distinct(texts.strings(raw, at[:-1], at[1:]))
    each = _cache(path).values(values.to_pylist())
    offsets = np.zeros(len(each) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in each], out=offsets[1:])
    ids = texts.gather(codes, offsets, np.frombuffer(b"".join(each), "<u4"))
    return ids, texts.sums_by_row(rows, (offsets[1:] - offsets[:-1])[codes], len(column))


def encode(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, tokens, ids_crc32, round_trip) of every whole text.

    ``tokens`` are the ids of the vocabulary, with bytes for characters it lacks; ``round_trip``
    says whether decoding them gives the text again, which a text with U+2581 does not. One row per
    row of ``docs``; ids may be null or repeat. A null text counts as empty and has no tokens. Extra
    columns are ignored whatever their names. An empty table gives an empty result.
    """
    docs = texts.pick(docs, id_column, text_column).toDF("doc_id", "text")

    def run(batches):
        tokens.only(_cache(path))
        for batch in batches:
            for part in texts.slices(batch, "text", SLICE_BYTES):
                ids, counts = encode_column(part.column("text"), path)
                off = np.concatenate([[0], np.cumsum(counts)])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
                for lo in range(0, part.num_rows, 1024):
                    hi = min(part.num_rows, lo + 1024)
                    piece = ids[off[lo] : off[hi]]
                    yield pa.record_batch(
                        {
                            "doc_id": part.column("doc_id").slice(lo, hi - lo).cast(pa.int64()),
                            "n_tokens": counts[lo:hi],
                            "tokens": pa.ListArray.from_arrays(
                                pa.array((off[lo : hi + 1] - off[lo]).astype(np.int32)), pa.array(piece.astype(np.int32))
                            ),
                            "ids_crc32": pa.array(crc[lo:hi], pa.int64()),
                            "round_trip": pa.array(
                                same_bytes(part.column("text").slice(lo, hi - lo), piece, off[lo : hi + 1] - off[lo], path)
                            ),
                        }
                    )

        # a worker may stay idle beside those of the next job
        tokens.only()

    return docs.mapInArrow(
        run, "doc_id bigint, n_tokens bigint, tokens array<int>, ids_crc32 bigint, round_trip boolean"
    )


@tokens.loaded
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    raw = vocabulary(path).raw
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(raw), np.uint8)


def same_bytes(column: pa.Array, ids: np.ndarray, off: np.ndarray, path: str) -> np.ndarray:
    """Whether the bytes of the ids are a blank and the row's text."""
    offsets, data = _piece_bytes(path)
    sizes = (offsets[1:] - offsets[:-1])[ids]
    got = texts.gather(ids, offsets, data)
    got_at = np.concatenate([[0], np.cumsum(sizes)])[off]
    raw, at = texts.bytes_of(column)
    out = np.zeros(len(column), bool)
    for r in range(len(column)):
        a, b = got_at[r], got_at[r + 1]
        n = at[r + 1] - at[r]
        out[r] = (n == 0 and a == b) or (b - a == n + 1 and got[a] == 32 and np.array_equal(got[a + 1 : b], raw[at[r] : at[r + 1]]))
    return out


def decode(encoded: DataFrame, path: str, *, id_column: str = "doc_id", tokens_column: str = "tokens") -> DataFrame:
    """(doc_id, text) of lists of ids. A null list counts as empty; ids beyond the vocabulary and
    control pieces stand for nothing."""
    encoded = texts.pick(encoded, id_column, tokens_column).toDF("doc_id", "tokens")

    def run(batches):
        for batch in batches:
            words = vocabulary(path)
            text = [words.decode(np.asarray(x or [], np.int64)) for x in batch.column("tokens").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "text": pa.array(text, pa.string())})

    return encoded.mapInArrow(run, "doc_id bigint, text string")
