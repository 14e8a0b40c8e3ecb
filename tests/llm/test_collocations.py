"""Phrases against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tests.llm.conftest import ODD
from weirlog.llm import buckets, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most=2000, share=100, longest=5):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^ \t]+", piece))
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", words[i : i + k]] += 1
    found = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= least}
    gone = set()
    for (lang, w), f in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * f >= share * counts[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    by = {}
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            n = totals[lang]
            cuts = [(1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], n))
    out = []
    for lang, rows in by.items():
        for rank, (s, a, w, left, right, n) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, w.decode(), -a, left, right, n, -s))
    return sorted(out)


def corpus(seed, n=200):
    rng = random.Random(seed)
    names = ["Über", "den", "see", "ab", "ba", "a", "New", "york", "city", "\x00", "é😀", "(x)", "'"]
    fixed = ["new York city hall", "a a a a", "see see ab"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice([rng.choice(names), rng.choice(fixed)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        out.append((text, rng.choice(["en", "en", "de", None])))
    return out


@pytest.mark.parametrize("size", [200, 3000, 12 << 20])
def test_phrases(spark, size):
    rows = corpus(size) + [(None, "en"), ("", "fr"), (". , ;", "fr"), ("lonely words", "und")]
    table = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, gid string")
    for least, most, share in ((5, 2000, 100), (2, 30, 60)):
        got = collocations.collocations(table, least=least, most=most, share=share, shard_bytes=size)
        assert sorted(map(tuple, got.collect())) == brute(rows, least, most, share)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(t, "en") for _, t in ODD]], ids=["none", "null", "odd"])
def test_odd_tables(spark, rows):
    table = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(table, least=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3)


def test_scores_beyond_64_bits(spark):
    big = [(3 * 10**12, 9 * 10**12, 3 * 10**12 + 7, 5 * 10**12), (10**12 + 1, 10**13, 10**12 + 1, 10**12 + 1), (100, 10**13, 100, 100), (999, 7, 10**6, 10**6)]
    table = spark.createDataFrame(big, "a bigint, n bigint, l bigint, r bigint")
    wide = "cast({} as decimal(19,0))".format
    score = collocations._quotient(f"{wide('a')} * {wide('n')} * 1000", f"{wide('l')} * {wide('r')}")
    assert sorted(r[0] for r in table.selectExpr(score).collect()) == sorted(1000 * a * n // (left * r) for a, n, left, r in big)


def test_intervals_hold_what_is_counted():
    """Every phrase of the index in both directions, grown leftward and rightward in turn."""
    rng = np.random.default_rng(5)
    ids = np.concatenate([[0], rng.integers(0, 5, 3000), [0]]).astype(np.int32)
    index = collocations.Index.of(ids, 4, 5)
    index = collocations.Index.unpacked(index.packed(), 4)
    phrases = {i: (i,) for i in range(1, 5)}
    for length in range(1, 5):
        want = Counter(w for i in range(len(ids) - length) if 0 not in (w := tuple(ids[i : i + length + 1].tolist())))
        for leftward in (True, False):
            head, tail, count = index.longer(leftward)
            got = {phrases[h] + phrases[t][-1:]: c for h, t, c in zip(head.tolist(), tail.tolist(), count.tolist())}
            assert got == want
        index.grow(head, tail)
        assert (index.hi[1:] - index.lo[1:] == count).all() and (index.back_to[1:] - index.back[1:] == count).all()
        phrases = {i + 1: phrases[h] + phrases[t][-1:] for i, (h, t) in enumerate(zip(head.tolist(), tail.tolist()))}


def test_shards_send_packed_counts():
    """A shard has a row per bucket, not one per phrase, and is told packed what is frequent across shards."""
    rng = np.random.default_rng(6)
    sent, want, owners = [], Counter(), {}
    for shard in (3, 4, 1 << 33):
        pairs = np.unique(rng.integers(1, 40, (600, 2)) << 33, axis=0)
        count = rng.integers(1, 9, len(pairs))
        sent.append(collocations._found(shard, pairs[:, 0], pairs[:, 1], count, 5, index=b"i", words=b"w"))
        assert sent[-1].num_rows <= 6
        for (h, t), n in zip(pairs.tolist(), count.tolist(), strict=True):
            want[h, t] += n
            owners.setdefault((h, t), set()).add(shard)
    rows = pa.concat_tables(sent)
    keys, told = {}, {}
    for bucket in range(5):
        out = collocations._summed(10)((pa.scalar(bucket, pa.int32()),), rows.filter(pc.equal(rows.column("bucket"), bucket)))
        for r in out.to_pylist():
            if r["gid"] is not None:
                assert r["gid"] > 0 and r["gid"] not in keys
                keys[r["gid"]] = r["head"], r["tail"], r["f"]
            else:
                b = buckets.unpack(r["blob"])
                for g, h, t in zip(np.cumsum(b["gid"]).tolist(), b["head"].tolist(), b["tail"].tolist(), strict=True):
                    told.setdefault((g, h, t), set()).add(r["shard"])
    assert sorted(keys.values()) == sorted((h, t, n) for (h, t), n in want.items() if n >= 10)
    assert told == {(g, h, t): owners[h, t] for g, (h, t, _) in keys.items()}
