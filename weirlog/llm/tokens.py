"""Public tokenizers inside Spark tasks: distinct units are encoded once, frequent ones cached."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weirlog.llm import texts

#: Units of a generation of a worker's cache. Results don't depend on it.
CACHE_UNITS = 100_000
#: Longer units are encoded each time they occur.
CACHE_BYTES = 48
#: Units that may be joined where a file changes case, as in ``sizes_of``.
JOINABLE = "\\A[ \\n]+[!-;=-~\\x{c0}-\\x{ff}]+\\z"
#: White space beyond ASCII: a text that holds one is one unit, for it could stand beside a cut.
WIDE_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


_LOADED: list = []


def loaded(fn):
    """What ``fn`` makes of a file is made once in a worker, until ``forget``."""
    fn = lru_cache(maxsize=8)(fn)
    _LOADED.append(fn)
    return fn


@loaded
def tokenizer(path: str):
    """The library's tokenizer of a file; one per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_units(path: str, units: list[str]) -> list[bytes]:
    """Token ids of each string as little-endian uint32, as the library gives them for it alone.

    Calls are dear, so many strings share one. Units that start with white space are joined as they
    stand: no token reaches over their borders, and as tokens have known sizes in bytes, the ids
    are dealt back by running sums. Other strings are kept apart by a special token: the library
    treats what stands between two of those as texts of their own.
    """
    if path.endswith(".model"):
        return [np.asarray(x, "<u4").tobytes() for x in tokenizer(path).encode(units, num_threads=1)]
    tool, (sizes, joinable) = tokenizer(path), sizes_of(path)
    out: list = [None] * len(units)
    places = [i for i, u in enumerate(units) if joinable(u)]
    for lo in range(0, len(places), 4096):
        part = places[lo : lo + 4096]
        ids = _ids(tool, "".join([units[i] for i in part]))
        ends = np.cumsum([len(_DROPPED(units[i]) if sizes[0] else units[i].encode()) for i in part])
        data, cuts = ids.tobytes(), (4 * _cuts(sizes[1][ids], ends)).tolist()
        for i, a, b in zip(part, [0, *cuts[:-1]], cuts, strict=True):
            out[i] = data[a:b]
    mark, mark_id = next((t.content, i) for i, t in tool.get_added_tokens_decoder().items() if t.special)
    places = [i for i, x in enumerate(out) if x is None and "<|" not in units[i]]
    for lo in range(0, len(places), 1024):
        part = places[lo : lo + 1024]
        ids = _ids(tool, mark.join([units[i] for i in part]))
        cuts = np.flatnonzero(ids == mark_id).tolist()
        for i, a, b in zip(part, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True):
            out[i] = ids[a:b].tobytes()
    for i, x in enumerate(out):
        if x is None:
            out[i] = _ids(tool, units[i]).tobytes()
    return out


def _ids(tool, text: str) -> np.ndarray:
    fast = getattr(tool, "encode_batch_fast", tool.encode_batch)
    return np.asarray(fast([text], add_special_tokens=False)[0].ids, "<u4")


def _cuts(size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the ids of each unit end, of ids for ``size`` bytes each and units that end at ``ends``."""
    reach = np.cumsum(size)
    cuts = np.searchsorted(reach, ends) + 1
    if not len(reach) or reach[-1] != ends[-1] or (reach[cuts - 1] != ends).any():
        raise ValueError("token sizes do not add up to the units")
    return cuts


def _DROPPED(unit: str) -> bytes:
    return unit.lstrip(" \n").encode()


@loaded
def sizes_of(path: str):
    """((white space is dropped, bytes of text behind each id), test for units that may be joined).

    Where a file changes case, only characters that keep their size under it may be joined.
    """
    tool = tokenizer(path)
    vocab = tool.get_vocab(with_added_tokens=False)
    table = np.zeros(tool.get_vocab_size() + 1, np.int64)
    suffix = getattr(tool.model, "end_of_word_suffix", None) or ""
    for piece, i in vocab.items():
        table[i] = len(piece.removesuffix(suffix) if suffix else piece)
    if tool.normalizer is None:
        return (False, table), re.compile(r"[ \n]+(?:[^\s<]|[^\s<][^<]*[^\s<])").fullmatch
    return (True, table), re.compile("[ \n]+[!-;=-~\u00c0-\u00ff]+").fullmatch


_ALL: list[Cache | Table] = []


def only(*caches: Cache) -> None:
    """Empty the other caches of this worker, which may have come from another operator's tasks, and give
    memory back that earlier tasks left free."""
    for c in _ALL:
        if c not in caches:
            c.clear()
    texts.release()


def forget() -> None:
    """Drop vocabularies and caches: a worker of an operator without them may have come from one that had them."""
    held = any(fn.cache_info().currsize for fn in _LOADED) or any(map(len, _ALL))
    for fn in _LOADED:
        fn.cache_clear()
    if held:
        only()


class Cache:
    """Unit -> value, for the life of a worker. ``encode`` gives the values of missing units.

    Two generations: when the young one is full it becomes the old one, and what is asked for again
    is taken over from there.
    """

    def __init__(self, encode, at_once: int = 8192, most: int = CACHE_UNITS):
        self.encode, self.at_once, self.most, self.young, self.old = encode, at_once, most, {}, {}
        _ALL.append(self)

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def values(self, units: list[str]) -> list:
        young, old = self.young, self.old
        found = [young.get(u) for u in units]
        miss = []
        for i in [i for i, v in enumerate(found) if v is None]:
            v = found[i] = old.get(units[i])
            if v is None:
                miss.append(i)
            else:
                young[units[i]] = v
        for lo in range(0, len(miss), self.at_once):
            part = miss[lo : lo + self.at_once]
            for i, v in zip(part, self.encode([units[i] for i in part]), strict=True):
                found[i] = v
                if len(units[i]) <= CACHE_BYTES:
                    young[units[i]] = v
        if len(young) > self.most:
            self.young, self.old = {}, young
        return found


def encode_column(path: str, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each unit, all ids) as ``encode_units`` gives them."""
    fits = np.zeros(len(units), bool)
    if not path.endswith(".model") and sizes_of(path)[0][0]:
        fits = np.asarray(pc.match_substring_regex(units, JOINABLE).to_numpy(zero_copy_only=False), bool)
    places, rest = np.flatnonzero(fits), np.flatnonzero(~fits)
    other = encode_units(path, units.take(pa.array(rest)).to_pylist())
    counts, parts = [np.array([len(x) // 4 for x in other], np.int64)], [np.frombuffer(b"".join(other), "<u4")]
    if len(places):
        tool, table = tokenizer(path), sizes_of(path)[0][1]
        some = units.take(pa.array(places))
        raw, off = texts.bytes_of(some)
        size = np.asarray(pc.binary_length(pc.utf8_ltrim(some, " \n")))
        for lo in range(0, len(places), 4096):
            ids = _ids(tool, raw[off[lo] : off[min(lo + 4096, len(places))]].tobytes().decode())
            cuts = _cuts(table[ids], np.cumsum(size[lo : lo + 4096]))
            counts.append(np.diff(cuts, prepend=0))
            parts.append(ids)
    order = np.empty(len(units), np.int64)
    order[np.concatenate([rest, places])] = np.arange(len(units))
    count = np.concatenate(counts)
    return count[order], texts.gather(order, np.append(0, np.cumsum(count)), np.concatenate(parts))


class Table:
    """Unit -> ids, for the life of a worker: units of a slice are looked up and kept all at once.

    Beyond ``most`` units, those go that were not asked for longest, the newest of these first.
    """

    def __init__(self, path: str):
        self.path, self.most = path, CACHE_UNITS
        self.clear()
        _ALL.append(self)

    def clear(self) -> None:
        self.units, self.counts, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.used, self.turn = np.zeros(0, np.int32), 0

    def __len__(self) -> int:
        return len(self.units)

    def values(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each unit, offsets of the places, ids) of distinct units."""
        place = np.asarray(pc.fill_null(pc.index_in(units, value_set=self.units), -1)).astype(np.int64)
        miss = np.flatnonzero(place < 0)
        new = units.take(pa.array(miss))
        counts, ids = encode_column(self.path, new)
        self.turn += 1
        self.used[place[place >= 0]] = self.turn
        place[miss] = len(self) + np.arange(len(miss))
        counts, ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        offsets = np.append(0, np.cumsum(counts))
        short = np.asarray(pc.binary_length(new)) <= CACHE_BYTES
        keep = np.concatenate([np.arange(len(self)), len(self) + np.flatnonzero(short)])
        used = np.concatenate([self.used, np.full(len(miss), self.turn, np.int32)])
        if len(keep) > self.most:
            keep = np.sort(keep[np.argsort(-used[keep], kind="stable")[: self.most]])
        self.units = pa.concat_arrays([self.units, new]).take(pa.array(keep))
        self.counts, self.ids, self.used = counts[keep], texts.gather(keep, offsets, ids), used[keep]
        return place, offsets, ids


_IDS: dict[str, Table] = {}


def ids_cache(path: str, most: int | None = None) -> Table:
    """Ids of units."""
    if path not in _IDS:
        _IDS[path] = Table(path)
    if most is not None:
        _IDS[path].most = most
    return _IDS[path]


def whole_rows(column: pa.Array) -> np.ndarray:
    """Rows that must not be cut into units."""
    found = pc.match_substring_regex(column, WIDE_SPACE)
    return np.asarray(pc.fill_null(found, False).to_numpy(zero_copy_only=False), bool)


def unit_codes(column: pa.Array, space: bytes = texts.SPACE):
    """(code of each unit, row of each unit, distinct units, bytes, starts) of a column."""
    raw, off = texts.bytes_of(column)
    at, rows = texts.units(raw, off, texts.table_of(space), whole_rows(column))
    codes, values = texts.distinct(texts.strings(raw, at[:-1], at[1:]))
    return codes, rows, values, raw, at


def encode_rows(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows, one after another, and the number of ids of each row."""
    codes, rows, values, _, _ = unit_codes(column)
    place, offsets, flat = ids_cache(path).values(values)
    codes = place[codes]
    ids = texts.gather(codes, offsets, flat)
    per_unit = (offsets[1:] - offsets[:-1])[codes]
    return ids, texts.sums_by_row(rows, per_unit, len(column))
