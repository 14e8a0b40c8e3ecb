"""Quality rules: counts of a base rule, then tokenizer fertility within bands per language and length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import texts, tokens
from weirlog.session import join_lookup, settle

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Bytes of text measured at a time: with twice that a worker takes half as much memory again, and is no faster.
SLICE_BYTES = 2 << 20
MIN_WORDS = 20
MAX_REPEAT = 0.3

#: Measures of fertility, how many spreads (half the distance of the quartiles) below and above the middle
#: of texts of its language and length a text may lie, and the least spread that counts, so that uniform
#: texts don't reject what differs by little. Few byte tokens are no fault.
BANDS = {
    "chars_per_piece": ("chars_per_piece", 5.5, 5.5, 0.008),
    "chars_per_byte_token": ("chars_per_byte_token", 5.5, 5.5, 0.012),
    "piece_ratio": ("chars_per_piece / nullif(chars_per_byte_token, 0)", 5.5, 5.5, 0.005),
    "byte_share": ("byte_share", None, 8.0, 0.001),
    "token_entropy": ("token_entropy", 5.5, 5.5, 0.03),
}
#: Texts that the whole counts for against a language's own middle, and against the quartiles of a length
#: or of a language's length.
PULL, BAND_PULL = 5, 20
#: Bands are broadcast up to this many rows (under 3 MB), and joined by shuffle beyond.
LANGUAGES = 10_000

MEASURES = (
    "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_pieces bigint, chars_per_piece double, chars_per_byte_token double, "
    "byte_share double, token_entropy double"
)


def _repeated(codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that lie in windows found twice or more in the row."""
    if len(codes) < WINDOW:
        return np.zeros(n, np.int64)
    last = len(codes) - WINDOW + 1
    key = np.zeros(last, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            word = (codes[j : j + last].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            key = (key ^ word ^ (word >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        key = (key ^ rows[:last].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    start = np.flatnonzero(rows[:last] == rows[WINDOW - 1 :])
    order = start[np.argsort(key[start], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    found = np.zeros(len(order), bool)
    found[1:] |= same
    found[:-1] |= same
    edge = np.zeros(len(codes) + 1, np.int32)
    # each place is there once
    edge[order[found]] += 1
    edge[order[found] + WINDOW] -= 1
    return texts.sums_by_row(rows[np.cumsum(edge[:-1]) > 0], None, n)


def _dup_lines(raw: np.ndarray, off: np.ndarray, solid: np.ndarray, n: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    newline = np.zeros(256, bool)
    newline[10] = True
    starts, ends, rows = texts.words(raw, off, newline)
    inked = np.concatenate([[0], np.cumsum(solid)])
    keep = inked[ends] > inked[starts]
    starts, ends, rows = starts[keep], ends[keep], rows[keep]
    codes, values = texts.distinct(texts.strings(raw, starts, ends))
    key = rows.astype(np.int64) * max(1, len(values)) + codes
    firsts = np.unique(key) // max(1, len(values))
    return texts.sums_by_row(rows, None, n) - texts.sums_by_row(firsts, None, n)


def _entropy(rows: np.ndarray, ids: np.ndarray, n: int, size: int) -> np.ndarray:
    """Bits per token of each row's own token distribution."""
    key = np.sort(rows.astype(np.int64) * size + ids)
    if not len(key):
        return np.zeros(n)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.append(at, len(key)))
    row = key[at] // size
    total = np.bincount(rows, minlength=n)
    part = count * np.log2(count)
    return np.log2(np.maximum(total, 1)) - np.bincount(row, part, n) / np.maximum(total, 1)


def measure(docs: DataFrame, piece_path: str, byte_path: str) -> DataFrame:
    """Counts and fertility of (doc_id, lang, text)."""

    def rows_of(batches):
        tool = tokens.tokenizer(piece_path)
        is_byte = np.array([tool.is_byte(i) for i in range(len(tool))])
        space, symbol = texts.table_of(texts.SPACE), texts.table_of(SYMBOLS)
        cache = _both_cache(piece_path, byte_path)
        tokens.only(cache)
        for batch in batches:
            for part in texts.slices(batch, "text", SLICE_BYTES):
                n = part.num_rows
                raw, off = texts.bytes_of(part.column("text"))
                solid = ~space[raw]
                starts, ends, rows = texts.words(raw, off, space)
                codes, _ = texts.distinct(texts.strings(raw, starts, ends))
                char = (raw & 0xC0) != 0x80
                inked = np.concatenate([[0], np.cumsum(solid & char)])
                marks = np.concatenate([[0], np.cumsum(symbol[raw])])
                chars = (inked[off[1:]] - inked[off[:-1]]).astype(np.int64)

                unit, unit_row, values, _, _ = tokens.unit_codes(part.column("text"))
                at, ids, lengths = _parted(cache.values(values.to_pylist()))
                ids = texts.gather(unit, at, ids)
                id_row = np.repeat(unit_row, (at[1:] - at[:-1])[unit])
                pieces = texts.sums_by_row(id_row, None, n)
                byte_tokens = texts.sums_by_row(unit_row, lengths[unit], n)
                entropy = _entropy(id_row, ids, n, len(tool))
                some = np.maximum(pieces, 1)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").cast(pa.int64()),
                        "lang": part.column("lang"),
                        "n_words": texts.sums_by_row(rows, None, n),
                        "word_chars": chars,
                        "n_symbols": (marks[off[1:]] - marks[off[:-1]]).astype(np.int64),
                        "n_dup_lines": _dup_lines(raw, off, solid, n),
                        "n_repeat_words": _repeated(codes, rows, n),
                        "n_pieces": pieces,
                        "chars_per_piece": chars / some,
                        "chars_per_byte_token": chars / np.maximum(byte_tokens, 1),
                        "byte_share": texts.sums_by_row(id_row, is_byte[ids].astype(np.float64), n) / some,
                        "token_entropy": entropy,
                    }
                )

        # a worker may stay idle beside those of the next stages
        tokens.only()

    return docs.mapInArrow(rows_of, MEASURES)


def verdicts(measured: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``reason`` (the first rule broken, or null) and ``kept``.

    The middle of each language is shrunk towards that of all texts. What texts depart from it has
    quartiles per length (doublings of the tokens) and language, shrunk towards those of the length, and
    these towards those of all texts, so that a text in a language or of a length seen rarely is judged,
    too. A middle that is known from few texts widens its band by how much languages differ. All are taken
    over the texts that pass the base rule, from values rounded to a thousandth, so their number is
    bounded and the result does not depend on partitions.
    """
    based = measured.withColumns(
        {
            "base_failed": F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {round(100 * MAX_REPEAT)} * n_words"),
            "lang_key": F.coalesce("lang", F.lit("")),
            "size": F.expr("cast(floor(log2(greatest(n_pieces, 1))) as int)"),
            **{f"m_{m}": F.expr(value) for m, (value, *_) in BANDS.items()},
        }
    )
    middles = settle(
        based.where("not base_failed")
        .rollup("lang_key")
        .agg(F.count("*").alias("n"), *[F.expr(f"percentile(round(m_{m}, 3), 0.5)").alias(f"c_{m}") for m in BANDS])
    )
    whole = middles.where("lang_key is null").first()
    known = whole is not None and whole["n"] > 0
    mid = {m: f"{whole[f'c_{m}'] if known else 0.0!r}D" for m in BANDS}
    languages = middles.where("lang_key is not null")
    apart = languages.agg(*[F.expr(f"round(sum(n * pow(c_{m} - {mid[m]}, 2)) / sum(n), 9)").alias(m) for m in BANDS]).first()
    centres = languages.selectExpr(
        "lang_key",
        *[f"(n * c_{m} + {PULL} * {mid[m]}) / (n + {PULL}) as c_{m}" for m in BANDS],
        *[f"{apart[m] if known else 0.0!r}D * {PULL} / (n + {PULL}) as u_{m}" for m in BANDS],
    )
    centred = join_lookup(based, centres, ["lang_key"], "left", LANGUAGES)
    centred = centred.withColumns({f"r_{m}": F.expr(f"round(m_{m} - c_{m}, 3)") for m in BANDS})
    quartiles = settle(
        centred.where("not base_failed")
        .rollup("size", "lang_key")
        .agg(F.count("*").alias("n"), *[F.expr(f"percentile(r_{m}, array(0.25D, 0.5D, 0.75D))").alias(f"q_{m}") for m in BANDS])
    )

    def pulled(inner: DataFrame, outer: DataFrame, on: list[str]) -> DataFrame:
        outer = outer.select(*on, *[F.col(f"q_{m}").alias(f"o_{m}") for m in BANDS])
        both = inner.join(outer, on) if on else inner.crossJoin(outer)
        return both.select(
            "size", "lang_key", "n",
            *[F.expr(f"zip_with(q_{m}, o_{m}, (q, o) -> (n * q + {BAND_PULL} * o) / (n + {BAND_PULL}))").alias(f"q_{m}") for m in BANDS],
        )

    sizes = pulled(quartiles.where("size is not null and lang_key is null"), quartiles.where("size is null"), [])
    bands = pulled(quartiles.where("lang_key is not null"), sizes, ["size"]).drop("n")
    joined = join_lookup(centred, bands, ["size", "lang_key"], "left", LANGUAGES)
    rules = ["when base_failed then 'base'"]
    for m, (_, below, above, least) in BANDS.items():
        far = f"(r_{m} - q_{m}[1]) / sqrt(pow(greatest((q_{m}[2] - q_{m}[0]) / 2, {least}D), 2) + u_{m})"
        if below is not None:
            rules.append(f"when {far} < -{below}D then '{m}'")
        rules.append(f"when {far} > {above}D then '{m}'")
    return joined.withColumn("reason", F.expr(f"case {' '.join(rules)} end")).select(
        *measured.columns, "base_failed", "reason", F.col("reason").isNull().alias("kept")
    )


def quality_rules(
    docs: DataFrame,
    piece_path: str,
    byte_path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """Counts, fertility and verdict of every whole text.

    Fertility is measured with two public vocabularies: characters per token of both, the share of
    byte-fallback tokens and the entropy of the tokens; the bands also hold the first two against each
    other. One row per row of ``docs``; ids may be
    null or repeat. A null or empty text has no words and fails the base rule. A null language is a
    language of its own. Extra columns are ignored whatever their names. An empty table gives an
    empty result.
    """
    docs = texts.pick(docs, id_column, lang_column, text_column).toDF("doc_id", "lang", "text")
    # measured once: the bands and the verdicts both read it
    return verdicts(settle(measure(docs, piece_path, byte_path)))


_BOTH: dict[tuple[str, str], tokens.Cache] = {}


def _both_cache(piece_path: str, byte_path: str) -> tokens.Cache:
    """Piece ids of units and, behind them, the number of byte tokens, as little-endian uint32 bytes: each unit is
    looked up and kept once for both vocabularies."""

    def encode(many: list[str]) -> list[bytes]:
        pieces, other = tokens.encode_units(piece_path, many), tokens.encode_units(byte_path, many)
        return [p + (len(b) // 4).to_bytes(4, "little") for p, b in zip(pieces, other, strict=True)]

    if (piece_path, byte_path) not in _BOTH:
        _BOTH[piece_path, byte_path] = tokens.Cache(encode)
    return _BOTH[piece_path, byte_path]


def _parted(each: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the units' piece ids, these ids, numbers of byte tokens) of values of ``_both_cache``."""
    flat = np.frombuffer(b"".join(each), "<u4")
    end = np.cumsum(np.fromiter(map(len, each), np.int64, len(each))) // 4
    own = np.ones(len(flat), bool)
    own[end - 1] = False
    return np.append(0, end - np.arange(1, len(each) + 1)), flat[own], flat[end - 1].astype(np.int64)
