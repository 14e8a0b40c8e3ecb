"""Dedup, decontamination and quality operators against brute force."""

import hashlib
import os
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import ODD
from weirlog import session
from weirlog.llm import buckets as bk
from weirlog.llm import components, fuzzy_lines, jaccard, phrase_index, quality_rules, repeats, shared_keys, site_quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NULL = -(2**63)


def corpus(seed, n=120, words=200, vocabulary=400):
    """Documents with copies, near copies, shared passages and lines, and short ones."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    passage = " ".join(rng.choice(names) for _ in range(40))
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            text = rng.choice(out)[1] or ""
            parts = text.split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if parts:
                    parts[rng.randrange(len(parts))] = rng.choice(names)
            text = " ".join(parts)
        else:
            text = " ".join(rng.choice(names) + rng.choice(["", "", "", ".\n", "  "]) for _ in range(rng.randint(0, words)))
        if rng.random() < 0.3:
            at = rng.randint(0, len(text))
            text = text[:at] + " " + passage + " " + text[at:]
        out.append((i, text))
    rng.shuffle(out)
    return out


def brute_repeats(rows, length):
    first = {}
    data = sorted(((NULL if i is None else i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    for i, b in data:
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("rows", [corpus(1), corpus(2, 40, 2000), ODD, [(5, "a" * 49), (6, "a" * 49)], []], ids=["a", "long", "odd", "short", "none"])
@pytest.mark.parametrize("length", [50, 12])
def test_repeats(spark, docs_of, rows, length):
    got = repeats.remove_repeats(docs_of(rows), length=length).collect()
    got = sorted((NULL if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    assert got == brute_repeats(rows, length)


def test_repeats_with_hot_digits(spark, docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    rows = corpus(3, 60)
    got = repeats.remove_repeats(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(rows, 50)


def shingle_sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append((i, set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    return out


def brute_components(sets, linked):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                parent[find(a)] = find(b)
    return [find(x) for x in range(len(sets))]


def alike(a, b, least):
    both = len(a & b)
    return both > 0 and 100 * both >= least * (len(a) + len(b) - both)


@pytest.mark.parametrize("rows", [corpus(4), corpus(5, 200, 60), ODD, []], ids=["a", "b", "odd", "none"])
@pytest.mark.parametrize("block", [128, 3])
def test_jaccard(spark, docs_of, rows, block, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", block)
    monkeypatch.setattr(components, "HUBS", 2)
    sets = shingle_sets(rows)
    root = brute_components([s for _, s in sets], lambda a, b: alike(a, b, 75))
    names = defaultdict(list)
    for (i, _), r in zip(sets, root):
        names[r].append(i)
    want = sorted(
        (i or 0, len(s), min((x for x in names[r] if x is not None), default=0)) for (i, s), r in zip(sets, root)
    )
    out = jaccard.similar_documents(docs_of(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == want
    assert sum(r.leader for r in out) == len(set(root))


def of_sizes(seed):
    """Texts that share their first words and differ in length, by as much as a link allows, a little more, and much more."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = [(n, " ".join(words[:n])) for n in (7, 8, 9, 20, 26, 27, 60, 79, 80, 81, 200, 265, 266, 267, 268, 400)]
    return rows + [(1000 + k, " ".join(words[a : a + rng.choice([24, 30, 39, 40, 52])])) for k in range(60) for a in [rng.randrange(60)]]


@pytest.mark.parametrize("least", [75, 50, 100])
def test_jaccard_of_unlike_sizes(spark, docs_of, least):
    rows = of_sizes(9)
    sets = shingle_sets(rows)
    root = brute_components([s for _, s in sets], lambda a, b: alike(a, b, least))
    low = {r: min(i for (i, _), x in zip(sets, root) if x == r) for r in root}
    out = jaccard.similar_documents(docs_of(rows), least=least).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: low[r] for (i, _), r in zip(sets, root)}


def test_groups_far_apart_in_size_do_not_meet(spark):
    held = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 1000, 5), (4, 1100, 5), (5, 10, 6), (6, 12, 6)], "id bigint, n bigint, key bigint")
    groups = defaultdict(set)
    for r in jaccard.met(held, 75).collect():
        groups[r.root].add(r.id)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset({1, 2}), frozenset({3, 4}), frozenset({5, 6})}


@pytest.mark.parametrize("whole", [True, False])
def test_keys_that_differ_in_their_lower_bits(spark, docs_of, whole):
    """One hash a document, all of them alike in their upper half and in their bucket."""

    def keys_of(part):
        ids = np.asarray(part.column("doc_id"), np.int64)
        key = (np.uint64(77) << np.uint64(32)) + (ids // 2 * 8).astype(np.uint64)
        return ids, np.zeros(len(ids), np.int32), np.arange(len(ids)), key

    docs = docs_of([(i, "x") for i in (2, 3, 4, 6, 8)]).select("doc_id", "text")
    blobs = [bk.unpack(r.blob) for r in shared_keys.shared_keys(docs, keys_of, 8, whole=whole).collect()]
    ids, _, key, _ = shared_keys.replies(blobs)
    assert set(ids.tolist()) == ({2, 3} if whole else {2, 3, 4, 6, 8})
    assert not whole or set(key.tolist()) == {(77 << 32) + 8}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2200)] + [(k, k + 1) for k in range(5000, 5600)] + [(7, x) for x in range(8000, 8300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def brute_lines(rows, least):
    order = sorted(range(len(rows)), key=lambda k: (NULL if rows[k][0] is None else rows[k][0], (rows[k][1] or "").encode()))
    where, sets = [], []
    for k in order:
        for n, line in enumerate((rows[k][1] or "").split("\n")):
            x = line.translate(LOWER).strip(" \t\n\x0b\x0c\r")
            if x:
                where.append((k, n))
                sets.append({x} if len(x) < 7 else {x[j : j + 7] for j in range(len(x) - 6)})
    root = brute_components(sets, lambda a, b: alike(a, b, least))
    seen, gone = set(), defaultdict(set)
    for (k, n), r in zip(where, root):
        if r in seen:
            gone[k].add(n)
        seen.add(r)
    out = []
    for k, (i, t) in enumerate(rows):
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k])
        out.append((NULL if i is None else i, kept or "", t is None, len(gone[k])))
    return sorted(out)


@pytest.mark.parametrize("rows", [corpus(7, 40, 120), corpus(8, 25, 200, 40), ODD, []], ids=["a", "b", "odd", "none"])
def test_lines(spark, docs_of, rows):
    frame = docs_of(rows)
    out = fuzzy_lines.dedup_lines(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_removed"]
    got = sorted((NULL if r.doc_id is None else r.doc_id, r.text or "", r.text is None, r.n_removed) for r in out.collect())
    assert got == brute_lines(rows, 80)


def test_band_recall():
    """Pairs at the threshold share a band nearly always."""
    rng = random.Random(9)
    met = total = 0
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh ") for _ in range(300))
        b = list(a)
        for _ in range(3):
            b[rng.randrange(300)] = "z"
        b = "".join(b)
        x, y = ({s[j : j + 7] for j in range(294)} for s in (a, b))
        if alike(x, y, 80):
            k = fuzzy_lines.band_keys(pa.array([a, b]))
            total += 1
            met += bool((k[0] == k[1]).any())
    assert total > 100 and met / total >= 0.98


def test_bands_leave_unlike_lines_apart():
    """Lines with a tenth of their shingles in common rarely meet: such pairs grow with the square of the input."""
    rng = random.Random(3)
    pool = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(12)) for _ in range(100)]
    lines = ["".join(rng.sample(pool, 25)) for _ in range(600)]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in lines]
    shared = [len(a & b) / len(a | b) for a, b in zip(sets, sets[1:])]
    assert 0.05 < sum(shared) / len(shared) < 0.15 and max(shared) < 0.5
    k = fuzzy_lines.band_keys(pa.array(lines), 5)
    met = {(i, j) for c in range(k.shape[1]) for x in [k[:, c]] for i, j in zip(*np.nonzero(x[:, None] == x[None])) if i < j}
    assert len(met) < 10


@pytest.mark.parametrize("shingle", [5, 7])
@pytest.mark.parametrize("union", [5, 10, 20, 25, 30, 50, 100, 300])
def test_band_recall_by_length(union, shingle):
    """Of pairs just at the threshold nearly all share a band, however short the lines are."""
    rng = random.Random(union)
    lines = []
    for _ in range(2000):
        b = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(union + shingle - 1))
        lines += [b, b[: union * 4 // 5 + shingle - 1]]
    k = fuzzy_lines.band_keys(pa.array(lines), shingle)
    assert (k[::2] == k[1::2]).any(axis=1).mean() >= 0.98


def test_lines_of_49_characters_with_a_typo(spark, docs_of):
    """One changed character leaves such lines near copies by five-character shingles."""
    a = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVW".lower()[:26] + "0123456789-+=/,;:!?()[]{"[:23]
    b = a[:24] + "~" + a[25:]
    out = fuzzy_lines.dedup_lines(docs_of([(1, a), (2, b)]), shingle=5).collect()
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: 1}


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_hits(rows, items):
    out = []
    for i, t in rows:
        w = item_words(t)
        hit, names = set(), set()
        for item, text in items:
            v = item_words(text)
            size = min(13, len(v))
            for s in range(len(v) - size + 1) if v else []:
                for k in range(len(w) - size + 1):
                    if w[k : k + size] == v[s : s + size]:
                        hit.update(range(k, k + size))
                        names.add(str(item))
        out.append((i or 0, len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("most", [16 << 20, 300], ids=["one", "blocks"])
def test_phrases(spark, docs_of, most, monkeypatch):
    monkeypatch.setattr(phrase_index, "BLOCK_BYTES", most)
    monkeypatch.setattr(phrase_index, "SEGMENT_BYTES", 5000)
    rows = corpus(10, 60, 80, 30) + ODD
    rng = random.Random(11)
    items = [(1, "one two three"), (2, ""), (3, None), (4, "One, TWO three four five six seven eight nine ten eleven twelve thirteen fourteen!")]
    for k in range(12):
        w = item_words(rng.choice(rows)[1])
        at = rng.randrange(max(1, len(w) - 14))
        items.append((10 + k, " ".join(w[at : at + rng.choice([3, 13, 20])])))
    marks = spark.createDataFrame(items, "item_id bigint, text string")
    out = phrase_index.decontaminate(docs_of(rows), marks)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in out.collect())
    assert got == brute_hits(rows, items)


def test_proximity(spark, docs_of):
    marks = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    rows = [(1, "blue so red and green"), (2, "red x x x x x x green blue"), (3, "a red green"), (4, "blue")]
    out = phrase_index.decontaminate(docs_of(rows), marks, slack=2)
    assert {r.doc_id: r.n_hit for r in out.collect()} == {1: 5, 2: 0, 3: 0, 4: 0}
    assert phrase_index.decontaminate(docs_of(rows), marks.limit(0)).where("contaminated").count() == 0
    assert phrase_index.decontaminate(docs_of([]), marks).count() == 0


def test_a_search_takes_one_python_worker_a_task(spark, docs_of):
    marks = spark.createDataFrame([(1, "some words of an item")], "item_id bigint, text string")
    plan = phrase_index.decontaminate(docs_of([(1, "here are some words of an item"), (2, "none")]), marks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") + plan.count("MapInArrow ") == 1


def test_quality_counts(spark, docs_of, vocab):
    rows = corpus(12, 50) + ODD + [(99, "same line\nsame line\n\n \n## | & <b>\n" + "a b c d e f g h i " * 3)]
    out = quality_rules.quality_rules(docs_of(rows), vocab("piece_bpe_32k.model"), vocab("byte_bpe_50k.json"))
    got = sorted(
        (r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()
    )
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        places = defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        marked = {x for ks in places.values() if len(ks) > 1 for k in ks for x in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
        want.append((i or 0, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked), failed))
    assert got == sorted(want)
    assert out.where("kept and base_failed").count() == 0
    empty = quality_rules.quality_rules(docs_of([]), vocab("piece_bpe_32k.model"), vocab("byte_bpe_50k.json"))
    assert empty.count() == 0


def test_quality_rejects_noise_and_keeps_prose(spark, vocab):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.quality_rules(docs, vocab("piece_bpe_32k.model"), vocab("byte_bpe_50k.json")).join(labels, "doc_id")
    found = {(r.quality, r.kept): r["count"] for r in out.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert found.get((1, False), 0) <= 0.01 * found[(1, True)]
    assert found.get((0, True), 0) <= 0.1 * found.get((0, False), 0)


@pytest.fixture(scope="module")
def rated(spark, vocab):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    paths = vocab("piece_bpe_32k.model"), vocab("byte_bpe_50k.json")
    yield quality_rules.quality_rules(docs, *paths).join(labels, "doc_id").where("not base_failed").cache()


def test_bands_reject_low_quality_without_symbols(rated):
    found = {(r.quality, r.kept): r["count"] for r in rated.groupBy("quality", "kept").count().collect()}
    assert rated.where("reason = 'symbols'").count() == 0
    assert found.get((0, True), 0) <= 0.1 * found.get((0, False), 0)
    assert found.get((1, False), 0) <= 0.01 * found[(1, True)]
    bare = rated.where("quality = 0 and n_symbols = 0")
    assert bare.where("not kept").count() >= 0.75 * bare.count() > 0


def test_rare_language_is_judged(spark, vocab):
    """A few texts of a language have a band, in a table of any size."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "lang", "text")
    noise = " ".join("%x" % (7919**k % (1 << 61)) for k in range(1, 200))
    prose = docs.where("lang = 'en' and length(text) > 2000").orderBy("doc_id").first().text
    more = spark.createDataFrame([(10**6 + k, "xx", t) for k, t in enumerate([noise, prose, prose[:-9]])], docs.schema)
    out = quality_rules.quality_rules(docs.unionByName(more), vocab("piece_bpe_32k.model"), vocab("byte_bpe_50k.json"))
    assert {r.doc_id - 10**6: r.kept for r in out.where("lang = 'xx'").collect()} == {0: False, 1: True, 2: True}


def test_site_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.where("pmod(xxhash64(doc_id), 4) > 0"), labels.where("pmod(xxhash64(doc_id), 4) = 0")
    out = site_quality.site_quality(docs, fit).join(held.selectExpr("doc_id", "quality as good", "toxic as bad"), "doc_id")
    right, n = out.selectExpr("sum(int((good = 1 and bad = 0) = kept))", "count(*)").first()
    assert right / n >= 0.95


def test_site_quality_on_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 0), (3, None, 0), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert site_quality.site_quality(docs_of(ODD), labels).count() == len(ODD)
    out = site_quality.site_quality(docs_of(ODD), labels.limit(0))
    assert out.count() == out.where("kept").count() == len(ODD)
    assert site_quality.site_quality(docs_of([]), labels).count() == 0


def test_sparse_sites_shrink(spark):
    """A site of one document stays near its parent; one with many bad documents does not."""
    rows = [(i, "good words here " * 9, "en", f"a{i % 7}", 1) for i in range(200)]
    rows += [(1000 + i, "### %%% $$$ " * 20, "en", "bad", 1) for i in range(60)] + [(2000, "### %%% $$$ " * 20, "en", "single", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows], "doc_id bigint, quality int, toxic int")
    by = {r.host: r.host_quality for r in site_quality.site_quality(docs, labels).select("host", "host_quality").distinct().collect()}
    assert by["bad"] < by["single"] < by["a1"]


def test_digest_of_kept_bytes(spark, docs_of):
    out = repeats.remove_repeats(docs_of([(1, "a" * 60), (2, "b" + "a" * 60 + "c")])).orderBy("doc_id").collect()
    assert hashlib.sha256(bytes(out[1].kept)).hexdigest() == hashlib.sha256(b"bc").hexdigest()
    assert out[1].spans == [1, 61]


def test_line_shingles_of_many_lines_at_once():
    rng = random.Random(4)
    rows = ["".join(rng.choice("abé🙂 x") for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 30, 300]))) for _ in range(500)] + ["ab" * 40000]
    for shingle in (1, 5, 7):
        found = fuzzy_lines.elements([t.encode() for t in rows], shingle)
        n, counts = fuzzy_lines.sketches([t.encode() for t in rows], shingle)
        sets = [{t[i : i + shingle] for i in range(len(t) - shingle + 1)} or {t} for t in rows]
        assert [len(f) for f in found] == [len(s) for s in sets] == n.tolist()
        for i in range(0, 400, 2):
            both = len(np.intersect1d(found[i], found[i + 1]))
            assert both == len(sets[i] & sets[i + 1])
            assert both <= np.minimum(np.frombuffer(counts[i], np.uint8), np.frombuffer(counts[i + 1], np.uint8)).sum()
    long = "".join(rng.choice("abcdefghij") for _ in range(60000)).encode()
    assert fuzzy_lines.sketches([b"short", long], 5)[1][1] == b""  # more than a byte holds


def test_lines_without_a_near_one_send_no_text(spark):
    """Only members that may link with another of their part go on; where nothing is counted all of like size do."""
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(120))
    other = ["".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(4)]
    rows = {1: base, 2: base[:60] + "z" + base[61:], 3: other[0], 4: other[1], 5: other[2], 6: other[3], 7: base[:60]}
    n, counts = fuzzy_lines.sketches([t.encode() for t in rows.values()], 5)
    sets = [(i, int(k), b"" if i in (5, 6) else c) for i, k, c in zip(rows, n, counts)]
    parts = [(9, i) for i in (1, 2, 3, 4, 7)] + [(8, 5), (8, 6), (8, 7), (7, 1)]
    got = components.promising(
        spark.createDataFrame(parts, "part bigint, id bigint"), spark.createDataFrame(sets, "id bigint, n bigint, sketch binary"), 80
    )
    assert sorted(map(tuple, got.collect())) == [(8, 5), (8, 6), (9, 1), (9, 2)]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_what_is_stored_leaves_no_shuffle_files(spark, place):
    """They would stay until the driver collects its garbage."""
    counted = spark.range(10000).selectExpr("id % 100 as k").groupBy("k").count()
    before = _shuffle_files(spark)
    kept = session.settle(counted), session.store(counted, place("counted"))
    for _ in range(50):  # they are removed in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert [df.selectExpr("count(*)", "sum(count)").first()[:] for df in kept] == [(100, 10000)] * 2


def test_repeats_are_told_in_turns_that_leave_no_files(spark, docs_of, monkeypatch):
    """What one turn over the digits sends is gone before the next; what they tell is the whole."""
    monkeypatch.setattr(bk, "bucket_count", lambda docs: 16)  # its sum leaves a shuffle file
    rows = corpus(5, 60)
    there = lambda: {n for n in os.listdir(session.shared_dir(spark)) if n.startswith("weirlog-repeats")}
    before, tables = _shuffle_files(spark), there()
    told, buckets = repeats.removed_spans(docs_of(rows))
    blobs = [bk.unpack(r.blob) for r in told.where("kind = 'gone'").collect()]
    for _ in range(50):  # they are removed in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and there() == tables
    got = {(int(i), int(k)) for b in blobs for i, s, c in zip(np.cumsum(b["ids"]), b["start"], b["count"]) for k in range(s, s + c)}
    first = {}
    windows = [(i, k, t.encode()[k : k + 50]) for i, t in sorted(rows) for k in range(len(t.encode()) - 49)]
    for i, _, w in windows:
        first.setdefault(w, i)
    assert got == {(i, k) for i, k, w in windows if first[w] < i}


def test_replies_of_a_key_are_of_one_turn(spark, docs_of):
    def keys_of(part):
        ids = np.asarray(part.column("doc_id"), np.int64)
        return ids, np.zeros(len(ids), np.int32), np.repeat(np.arange(len(ids)), 40), np.tile(bk.mix(np.arange(40)), len(ids))

    rows = shared_keys.shared_keys(docs_of([(i, "text") for i in range(300)]), keys_of, 8, turns=2).collect()
    kinds = [{(int(i), int(k)) for r in rows if r.kind == shared_keys.kind_of(t) for b in [bk.unpack(r.blob)] for i, k in zip(np.cumsum(b["ids"]), b["key"])} for t in (0, 1)]
    assert len(kinds[0] | kinds[1]) == 300 * 40 and not {k for _, k in kinds[0]} & {k for _, k in kinds[1]}
    assert kinds[0] and kinds[1]


def test_line_dedup_leaves_no_tables(spark, docs_of):
    rows = [(i, f"a line of its own, number {i * i}\nthe same line of words as elsewhere, more or less {i % 3}") for i in range(40)]
    there = lambda: {n for n in os.listdir(session.shared_dir(spark)) if n.startswith(("weirlog-lines", "weirlog-links"))}
    before = there()
    got = {r.doc_id: r.n_removed for r in fuzzy_lines.dedup_lines(docs_of(rows), shingle=5).collect()}
    assert sum(got.values()) > 0 and got[0] == 0
    assert there() == before


def test_links_in_clusters_of_all_sizes(spark):
    """Small clusters and blocks of large ones are compared at once; none of their links is lost."""
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**62, 20, dtype=np.uint64) for _ in range(60)]
    sets = {i: np.sort(np.append(base[i % 60], np.uint64(i))) for i in range(1, 361)}
    members = spark.createDataFrame([(i, len(x), x.tobytes()) for i, x in sets.items()], "id bigint, n bigint, keys binary")
    clusters = [(i, 1000) for i in sets if i <= 300] + [(i, 2000 + i % 60) for i in sets if i > 300 or i <= 60]
    found = components.links(members, spark.createDataFrame(clusters, "id bigint, root bigint"), 4, 75)
    roots = {r.node: r.root for r in components.components(found).collect()}
    assert roots == {i: (i - 1) % 60 + 1 for i in sets}
