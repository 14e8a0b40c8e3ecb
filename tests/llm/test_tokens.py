"""Token operators against the libraries themselves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from weirlog.llm import pieces, texts, token_counts, token_files, tokens

PARTS = ["a", "B", "the", " ", "  ", "\n", "\t", "\r", "\xa0", "é", "中", "🙂", "'s", "1", "22", "!", "<|endoftext|>", "<s>",
         "\x1c", "\x85", "İ", "ß", "Σ", "\x00", "|", "ing", "▁", ";\r", "é"]


def odd_texts(n=3000, seed=1):
    rng = random.Random(seed)
    return [None, ""] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + [" " * k for k in range(20)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_encode_as_whole_texts_do(vocab, name):
    rows = odd_texts()
    ids, counts = tokens.encode_rows(pa.array(rows), vocab(name))
    tool = Tokenizer.from_file(vocab(name))
    off = np.append(0, np.cumsum(counts))
    for i, t in enumerate(rows):
        assert ids[off[i] : off[i + 1]].tolist() == tool.encode(t or "", add_special_tokens=False).ids


def test_pieces_encode_as_the_library_does(vocab):
    rows = [t.replace("\x00", "") if t else t for t in odd_texts(seed=2)] + ["abc中文" * 200, "x" + " " * 40 + "y"]
    path = vocab("piece_bpe_32k.model")
    ids, counts = pieces.encode_column(pa.array(rows), path)
    off = np.append(0, np.cumsum(counts))
    want = tokens.tokenizer(path).encode([t or "" for t in rows])
    for i, w in enumerate(want):
        assert ids[off[i] : off[i + 1]].tolist() == w, rows[i]


def test_pieces_round_trip(spark, docs_of, vocab):
    path = vocab("piece_bpe_32k.model")
    rows = [r for r in ODD if "▁" not in (r[1] or "") and "\x00" not in (r[1] or "")]
    out = pieces.encode(docs_of(rows), path)
    assert out.where("not round_trip").count() == 0
    back = sorted((r.doc_id or 0, r.text) for r in pieces.decode(out, path).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)


def test_counts(spark, docs_of, vocab):
    path = vocab("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    got = sorted(tuple(r) for r in token_counts.token_counts(docs_of(ODD).fillna({"doc_id": 0}), path).collect())
    want = []
    for i, t in ODD:
        n = len(tool.encode(t or "", add_special_tokens=False).ids)
        want.append((i or 0, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_files(spark, docs_of, vocab, place):
    path = vocab("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    out = place("tokens")
    token_files.write_tokens(docs_of(ODD), out, path, end_id=1, files=3)
    got = {}
    for r in token_files.index_tokens(spark, out).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    stored = token_files.read_tokens(spark, out)
    flat = [x for r in stored.orderBy("part", "doc_id", "tie").collect() for x in r.tokens]
    for i, t in ODD:
        ids = np.array(tool.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        crc = zlib.crc32(ids.tobytes())
        places = [s for s, n, c in got[i] if (n, c) == (len(ids), crc)]
        assert places and all(flat[s : s + len(ids)] == ids.tolist() for s in places)
    order = sorted(((-(2**63) if i is None else i, s) for i, rows in got.items() for s, _, _ in rows))
    assert [s for _, s in order] == sorted(s for _, s in order)
    bloom = stored.where("doc_id = 7").count()
    assert bloom == 1


def test_empty(spark, docs_of, vocab, place):
    none = docs_of([])
    assert token_counts.token_counts(none, vocab("byte_bpe_50k.json")).count() == 0
    assert pieces.encode(none, vocab("piece_bpe_32k.model")).count() == 0
    out = place("none")
    token_files.write_tokens(none, out, vocab("word_bpe_49k.json"))
    assert token_files.index_tokens(spark, out).count() == 0


def test_slices_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "", "b" * 100, "c"])})
    parts = list(texts.slices(batch, "text", 20))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1


def test_long_batches_are_encoded_in_slices_of_8_mb():
    from weirlog.llm.queries import vocabulary

    path = vocabulary("word_bpe_49k.json")
    column = pa.array([f"row {i} " + "some words in a long text. " * 4000 for i in range(120)] + [None, ""])
    batch = pa.record_batch({"text": column})
    parts = list(texts.slices(batch, "text", token_files.SLICE_BYTES))
    assert len(parts) > 1 and max(p.column("text").nbytes for p in parts) <= (8 << 20) + (1 << 17)
    whole, counts = tokens.encode_rows(column, path)
    each = [tokens.encode_rows(p.column("text"), path) for p in parts]
    assert np.array_equal(np.concatenate([e[0] for e in each]), whole)
    assert np.array_equal(np.concatenate([e[1] for e in each]), counts)


def test_rules_measure_long_batches_in_slices_of_2_mb():
    from weirlog.llm import quality_rules
    from weirlog.llm.queries import vocabulary

    class Here:
        def mapInArrow(self, run, schema):
            return run

    run = quality_rules.measure(Here(), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json"))
    text = [f"text {i} " + "with words, lines\nand numbers 12 | 3 " * (300 + i) for i in range(400)]
    batch = pa.record_batch({"doc_id": pa.array(range(400)), "lang": pa.array(["en"] * 400), "text": pa.array(text)})
    parts = list(run([batch]))
    assert len(parts) >= batch.column("text").nbytes // (2 << 20) >= 2
    single = [r for i in (0, 199, 399) for r in run([batch.slice(i, 1)])]
    assert pa.Table.from_batches(parts).take([0, 199, 399]).to_pylist() == pa.Table.from_batches(single).to_pylist()


def test_rules_look_a_unit_up_once_for_both_vocabularies(vocab):
    from weirlog.llm import quality_rules

    piece, byte = vocab("piece_bpe_32k.model"), vocab("byte_bpe_50k.json")
    units = [" the", "\n中文", " a1", "x" * 60, "é🙂", " the"]
    cache = quality_rules._both_cache(piece, byte)
    for _ in range(2):
        at, ids, lengths = quality_rules._parted(cache.values(units))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == tokens.tokenizer(piece).encode(units)
        tool = Tokenizer.from_file(byte)
        assert lengths.tolist() == [len(tool.encode(u, add_special_tokens=False).ids) for u in units]
    at, ids, lengths = quality_rules._parted([])
    assert at.tolist() == [0] and not len(ids) and not len(lengths)


def test_spans_with_empty_ones():
    raw = np.frombuffer(b"abcdef", np.uint8)
    for starts, ends in (([0, 3], [2, 5]), ([0, 3, 3], [2, 3, 5])):
        got = texts.strings(raw, np.array(starts), np.array(ends)).to_pylist()
        assert got == [b"abcdef"[s:e].decode() for s, e in zip(starts, ends)]


def test_operators_without_vocabularies_drop_those_of_earlier_ones(vocab):
    path = vocab("piece_bpe_32k.model")
    pieces.encode_column(pa.array(["some words"]), path)
    tokens.encode_rows(pa.array(["some words"]), vocab("word_bpe_49k.json"))
    tokens.forget()
    assert not any(f.cache_info().currsize for f in (tokens.tokenizer, tokens.sizes_of, pieces.vocabulary, pieces._piece_bytes))
    ids, _ = pieces.encode_column(pa.array(["some words"]), path)
    assert ids.tolist() == tokens.tokenizer(path).encode("some words")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_table_of_units_forgets_and_learns_again(vocab, name):
    path = vocab(name)
    units = sorted({u for t in odd_texts(400, 5) if t for u in (t, " " + t.strip(), "\n ab" + t[:2])} - {""}) + [" plain", "\n\nÀÿ", " ×", " " + "x" * 60]
    assert [tokens.JOINABLE and bool(tokens.pc.match_substring_regex(pa.array([u]), tokens.JOINABLE)[0].as_py()) for u in units] == [
        bool(tokens.sizes_of(vocab("word_bpe_49k.json"))[1](u)) for u in units
    ]
    want = [np.frombuffer(x, "<u4").tolist() for x in tokens.encode_units(path, units)]
    table = tokens.Table(path)
    table.most = 50
    for part in (slice(0, 40), slice(20, None), slice(0, 1), slice(0, 0), slice(None)):
        place, offsets, ids = table.values(pa.array(units[part], pa.large_string()))
        assert [ids[offsets[p] : offsets[p + 1]].tolist() for p in place] == want[part]
        assert len(table) <= 50 and len(table.counts) == len(table.used) == len(table)
    table.clear()
    assert not len(table)
