"""Fingerprints and their components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.conftest import ODD
from weirlog.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    """Index of the component of each fingerprint."""
    left, out = set(range(len(fps))), [None] * len(fps)
    while left:
        queue = [left.pop()]
        name = queue[0]
        while queue:
            i = queue.pop()
            out[i] = name
            near = [j for j in left if (fps[i] ^ fps[j]).bit_count() <= distance]
            left -= set(near)
            queue += near
    return out


def texts(seed, n=400):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdeéÜ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(names)
        else:
            words = [rng.choice(names) for _ in range(rng.randint(1, 400))]
        out.append((i * 3, " ".join(words)))
    return out


@pytest.mark.parametrize("rows", [texts(1), ODD, []], ids=["copies", "odd", "none"])
def test_documents(docs_of, rows):
    got = simhash.near_duplicates(docs_of(rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    name = brute_components(fps)
    smallest = {}
    for (i, _), c in zip(rows, name):
        smallest[c] = min([x for x in (smallest.get(c), i) if x is not None], default=None)
    want = [(i, fp, smallest[c]) for (i, _), fp, c in zip(rows, fps, name)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.fp % 2**64, r.component_id)) for r in got)
    if len(rows) > 100:
        assert len(set(fps)) > 150 and len(set(name)) < len(set(fps))


def flips(rng, base, count):
    for b in rng.sample(range(64), count):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("load", [8192, 40, 4])
def test_components_of_crowded_anchors(spark, load):
    """Balls of fingerprints around some centres, chains of links, and lone ones; small loads deal and cut further."""
    rng = random.Random(load)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        fps |= {flips(rng, centre, rng.randint(0, 5)) for _ in range(120)}
    for _ in range(100):
        fps.add(flips(rng, rng.choice(sorted(fps)), rng.choice([3, 4, 4, 5])))
    fps = sorted(fps)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    entries = simhash.dealt(spark.createDataFrame(signed, "fp bigint"), load)
    edges = simhash.links(entries).collect()
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        assert (e.a % 2**64) in parent and (e.b % 2**64) in parent
        parent[find(e.a % 2**64)] = find(e.b % 2**64)
    groups = {}
    for x, c in zip(fps, brute_components(fps)):
        groups.setdefault(c, set()).add(x)
    got = {}
    for x in fps:
        got.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_every_word_is_near_one_anchor():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    for view in simhash.VIEWS:
        who, anchor, home = view.anchors(fps)
        words = (fps >> np.uint64(view.shift)) & np.uint64((1 << view.bits) - 1)
        away = np.bitwise_count(words[who].astype(np.int64) ^ anchor)
        assert (np.bincount(who[home], minlength=len(fps)) == 1).all()
        assert away[home].max() <= view.radius and away.max() <= view.radius + view.share
        assert (view.syndrome(anchor) == 0).all() if view.generator > 1 else (anchor == words[who].astype(np.int64)).all()
    who, _, _ = simhash.VIEWS[0].anchors(fps)
    assert np.bincount(who).max() == 6


def test_long_text():
    text = "Some words " * 300_000
    assert simhash.fingerprints(pa.array([text, None, "a"]), at_once=1000).tolist() == [brute_fingerprint(text), 0, brute_fingerprint("a")]
