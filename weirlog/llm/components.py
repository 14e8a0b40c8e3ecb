"""Connected components of links, and links inside clusters, on Spark at scale."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import texts
from weirlog.session import join_lookup, passing, settle, store

#: Members of a cluster that are compared in one task; a larger cluster is cut into blocks.
BLOCK = 128
#: Members that every block of a large cluster is compared with first.
HUBS = 8
#: Counters of a set's sketch, and members whose sketches are compared in one task.
COUNTERS, SKETCHES = 64, 8192


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each partition keeps one edge per member it joins."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while (p := parent.get(root, root)) != root:
                root = p
            while (p := parent.get(x, x)) != root:
                parent[x] = root
                x = p
            return root

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    lo, hi = (a, b) if a < b else (b, a)
                    parent[hi] = lo
        nodes = list(parent)
        for lo in range(0, len(nodes), 65536):
            some = nodes[lo : lo + 65536]
            yield pa.record_batch({"a": pa.array([find(x) for x in some], pa.int64()), "b": pa.array(some, pa.int64())})

    return edges.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b bigint); root is the smallest of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks, and goes on with the
    edges between different roots, which shrink quickly. Only minima are aggregated, so a node with
    any number of neighbours costs no more than its partial sums. Rounds end when no edge is left.
    """
    edges = settle(forest(edges).where("a <> b"))
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = settle(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as root"))
        hooks = _followed(hooks)
        maps.append(hooks)
        left = hooks.selectExpr("node as a", "root as ra")
        right = hooks.selectExpr("node as b", "root as rb")
        moved = edges.join(left, "a").join(right, "b").selectExpr("ra as a", "rb as b").where("a <> b")
        edges = settle(forest(moved).where("a <> b"))
    if not maps:
        return edges.selectExpr("a as node", "b as root")
    out = maps[0]
    for m in maps[1:]:
        later = m.selectExpr("node as root", "root as later")
        out = out.join(later, "root", "left").selectExpr("node", "coalesce(later, root) as root")
    return settle(out)


def _followed(hooks: DataFrame) -> DataFrame:
    """Hooks followed to the end; each step doubles the way, as hooks lead to smaller nodes only."""
    while True:
        up = hooks.selectExpr("node as root", "root as up")
        hooks = settle(hooks.join(up, "root", "left").selectExpr("node", "coalesce(up, root) as root", "up < root as moved"))
        if hooks.where("moved").isEmpty():
            return hooks.select("node", "root")


def links(
    members: DataFrame, cluster: DataFrame, bins: int, least: int = 75, elements: Callable | None = None,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Spanning edges (a, b) of all links between members of the same cluster.

    ``members`` are (id bigint, n bigint, keys binary): a set's size and those of its elements that
    can be shared, as 64-bit numbers, unless ``elements`` turns a list of ``keys`` into arrays. Two link when 100 * intersection >= least * union. ``cluster``
    is (id, root); a member may be in several. Small clusters are dealt whole to ``bins``. A large one
    is cut into blocks that are compared with the members of fewest elements of their own, its hubs; then
    members outside the largest group found are compared, block by block, with all. Pairs are never
    rows. With ``sketches``, see ``promising``, only members that these leave a chance are looked up; ``members``
    may then hold one several times.
    """

    with passing(members.sparkSession, "links") as folder:
        return _links(members, cluster, bins, least, elements, sketches, folder)


def _links(members, cluster, bins, least, elements, sketches, folder) -> DataFrame:
    def linked(units: DataFrame, name: str) -> DataFrame:
        if sketches is None:
            return settle(compare(units.join(members, "id"), least, elements))
        parts = store(units.selectExpr("xxhash64(unit, part) as part", "id"), f"{folder}/{name}")
        kept = store(promising(parts, sketches, least), f"{folder}/{name}-kept")
        count = max(2 * int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), kept.count() // (2 * BLOCK))
        some = join_lookup(members, kept.select("id").distinct(), ["id"], "left_semi").dropDuplicates(["id"])
        kept = kept.selectExpr(f"pmod(xxhash64(part), {count}) as unit", "part", "id")
        return settle(compare(kept.join(some, "id"), least, elements))

    cluster = store(cluster.select("id", "root").distinct(), f"{folder}/cluster")
    sizes = cluster.groupBy("root").agg(F.count("*").alias("size")).where("size > 1")
    sized = join_lookup(cluster, sizes, ["root"])
    small = sized.where(f"size <= {BLOCK}").selectExpr(f"pmod(xxhash64(root), {bins}) as unit", "root as part", "id")
    large = store(
        sized.where(f"size > {BLOCK}")
        .selectExpr("root", "id", f"cast(ceil(size / {BLOCK}) as bigint) as blocks")
        .selectExpr("*", "pmod(xxhash64(id), blocks) as block"),
        f"{folder}/large",
    )
    if large.isEmpty():
        return linked(small, "near")
    shares = members.selectExpr("id", "length(keys) / greatest(n, 1) as share")
    if sketches is not None:
        shares = shares.dropDuplicates(["id"])
    ranked = large.join(shares, "id").selectExpr(
        "root", "blocks", "id", "row_number() over (partition by root order by share desc, id) as place"
    )
    hubs = ranked.where(f"place <= {HUBS}").selectExpr("root", "id", "explode(sequence(0, blocks - 1)) as block")
    first = large.select("root", "id", "block").unionByName(hubs).selectExpr("xxhash64(root, block) as unit", "0L as part", "id").distinct()
    near = linked(small.unionByName(first), "near")
    label = components(near).selectExpr("node as id", "root as label")
    labelled = store(large.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")), f"{folder}/labelled")
    counts = labelled.groupBy("root", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("root").agg(F.expr("max_by(label, struct(c, label))").alias("main"))
    out = join_lookup(labelled, main, ["root"]).where("label <> main").select("root", "blocks", "id")
    parts = out.groupBy("root").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as bigint)").alias("parts"))
    out = join_lookup(out, parts, ["root"]).selectExpr("root", "blocks", "id", "pmod(xxhash64(id, 1), parts) as part")
    one = out.selectExpr("root", "part", "explode(sequence(0, blocks - 1)) as block", "id")
    other = join_lookup(labelled, parts, ["root"]).selectExpr("root", "explode(sequence(0, parts - 1)) as part", "block", "id")
    units = one.unionByName(other).selectExpr("xxhash64(root, part, block) as unit", "0L as part", "id").distinct()
    return near.unionByName(linked(units, "far"))


def gathered(keys: DataFrame) -> DataFrame:
    """(id, root) from (id, key): every member of a key goes to the group of the key's smallest member,
    so all members of a key meet in one group."""
    lead = keys.groupBy("key").agg(F.min("id").alias("root"), F.max("id").alias("last")).where("root < last").select("key", "root")
    return join_lookup(keys, lead, ["key"]).select("id", "root").distinct()


def promising(parts: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """The rows of ``parts`` (part, id), distinct ones of some hundred members a part, whose member may link with another of its part.

    ``counts`` are (id, n, sketch): a set's size and, as bytes, how many of its elements fall in each of
    ``COUNTERS`` classes, or nothing if a byte is too small for that. Two sets share at most the sum of the
    smaller counts, so no link is lost.
    """

    def run(key, frame):
        frame = frame.sort_by([("part", "ascending"), ("n", "ascending")])
        part, n = (np.asarray(frame.column(c), np.int64) for c in ("part", "n"))
        held = frame.column("sketch").to_pylist()
        unknown = np.array([len(x) == 0 for x in held], bool)
        count = np.frombuffer(b"".join([x or bytes(COUNTERS) for x in held]), np.uint8).reshape(-1, COUNTERS)
        keep = np.zeros(len(part), bool)
        a = np.arange(len(part))
        for far in range(1, len(part)):
            # sizes ascend: a set that is too small for one is too small for those behind it
            a = a[a + far < len(part)]
            a = a[(part[a] == part[a + far]) & (100 * n[a] >= least * n[a + far])]
            if not len(a):
                break
            b = a + far
            both = np.where(unknown[a] | unknown[b], n[a], np.minimum(count[a], count[b]).sum(axis=1, dtype=np.int32))
            some = 100 * both >= least * (n[a] + n[b] - both)
            keep[a[some]] = keep[b[some]] = True
        texts.release()
        return frame.select(["part", "id"]).filter(pa.array(keep))

    bins = max(2 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts.count() // SKETCHES)
    units = parts.withColumn("unit", F.expr(f"pmod(xxhash64(part), {bins})")).join(counts, "id")
    return units.groupBy("unit").applyInArrow(run, "part bigint, id bigint")


def compare(units: DataFrame, least: int, elements: Callable | None = None) -> DataFrame:
    """Spanning edges of the links between the sets (unit, part, id, n, keys) of each part of a unit.

    With ``elements`` sets are whole and ``n`` is their size, otherwise ``n`` counts what they can't
    share, too.
    """

    def run(key, frame):
        frame = frame.sort_by("part")
        part, ids, n = (np.asarray(frame.column(c), np.int64) for c in ("part", "id", "n"))
        keys = frame.column("keys").to_pylist()
        sets = elements(keys) if elements else [np.frombuffer(k, np.uint64) for k in keys]
        if elements:
            n = np.array([len(x) for x in sets], np.int64)
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        a, b = [], []
        for lo, hi in zip(at.tolist(), np.append(at[1:], len(part)).tolist(), strict=True):
            if hi - lo == 2:
                if not elements and 100 * min(n[lo], n[lo + 1]) < least * max(n[lo], n[lo + 1]):
                    continue
                both = len(np.intersect1d(sets[lo], sets[lo + 1], assume_unique=True))
                if both and 100 * both >= least * (n[lo] + n[lo + 1] - both):
                    a.append(int(ids[lo]))
                    b.append(int(ids[lo + 1]))
            elif hi - lo > 2:
                more = _spanning(ids[lo:hi], n[lo:hi], sets[lo:hi], least)
                a += more[0]
                b += more[1]
        texts.release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return units.groupBy("unit").applyInArrow(run, "a bigint, b bigint")


def _spanning(ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray], least: int) -> tuple[list, list]:
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    values, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    holder = owner[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
    begin = np.cumsum(size) - size
    new = np.ones(len(ids), bool)
    a, b = [], []
    for seed in range(len(ids)):
        if not new[seed]:
            continue
        new[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            mine = code[begin[i] : begin[i] + size[i]]
            count = at[mine + 1] - at[mine]
            met = holder[np.repeat(at[mine], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))]
            both = np.bincount(met, minlength=len(ids))
            linked = np.flatnonzero(new & (both > 0) & (100 * both >= least * (n + n[i] - both)))
            new[linked] = False
            for j in linked.tolist():
                a.append(int(ids[i]))
                b.append(int(ids[j]))
                queue.append(j)
    return a, b
