"""Contiguous frontier of a stream whose offsets are confirmed out of order.

State between batches is the frontier of each partition and the runs of offsets held back beyond it. Runs
end at the borders of blocks of ``BLOCK`` offsets, so merging never looks past a block, and a gap that
stays open for long holds back one run a block. A batch writes what changed: runs gone, runs new,
frontiers that moved. Every ``FULL_EVERY`` batches the whole state is written, too, and what came before the
one before that is removed. Batch N reads the state before N, so a replay starts from the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.operators.progress import PARTITION, confirmed_bits
from weirlog.streaming.sinks import Sink, batch_path, hadoop_path, write_once

#: Offsets of a block; no run crosses a border.
BLOCK = 1 << 20
FULL_EVERY = 16
#: ``held`` is 1 for a run that came, -1 for one that went; a row without a run tells a frontier.
STATE = "topic string, partition int, frontier bigint, start bigint, stop bigint, held int"
RUN = ["start", "stop"]


def runs_of(confirmed: DataFrame) -> DataFrame:
    """``topic, partition, start, stop`` (both included) of runs of confirmed offsets, within 64 offsets each."""
    places = "filter(sequence(0, 63), i -> shiftrightunsigned({}, i) & 1L = 1L)"
    words = confirmed_bits(confirmed).groupBy(*PARTITION, "word").agg(F.expr("bit_or(mask) as mask"))
    first, last = "mask & ~shiftleft(mask, 1)", "mask & ~shiftrightunsigned(mask, 1)"
    pairs = words.selectExpr(*PARTITION, "word", f"inline(arrays_zip({places.format(f'({first})')}, {places.format(f'({last})')})) as (a, b)")
    return pairs.selectExpr(*PARTITION, "word * 64 + a - 1 as start", "word * 64 + b - 1 as stop")


def merged_runs(runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs that touch or overlap as one, cut at the borders of blocks. Runs given cross at most one border."""
    cut = f"(start div {block} + 1) * {block}"
    pieces = runs.selectExpr(
        *PARTITION,
        f"""inline(if(stop < {cut}, array(struct(start, stop)),
            array(struct(start, {cut} - 1 as stop), struct({cut} as start, stop))))""",
    ).selectExpr(*PARTITION, f"start div {block} as block", *RUN)
    within = "partition by topic, partition, block order by start, stop"
    heads = pieces.selectExpr(
        "*", f"max(stop) over ({within} rows between unbounded preceding and 1 preceding) as reach"
    ).selectExpr("*", f"sum(if(reach is null or start > reach + 1, 1, 0)) over ({within} rows between unbounded preceding and current row) as run")
    return heads.groupBy(*PARTITION, "block", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def advanced(runs: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """Frontier of each partition of ``known`` (topic, partition, frontier), given merged runs that end beyond it."""
    at = runs.join(known, PARTITION)
    # the first offset of a block that matters is the one after the frontier, or the block's own
    begin = f"greatest(frontier + 1, block * {block})"
    opens = at.groupBy(*PARTITION, "block").agg(
        F.expr("any_value(frontier) as frontier"), F.expr(f"max(if(start <= {begin} and stop >= {begin}, stop + 1, {begin})) as open")
    )
    own = known.selectExpr(*PARTITION, f"(frontier + 1) div {block} as block", "frontier", "frontier + 1 as open")
    blocks = opens.unionByName(own).groupBy(*PARTITION, "block").agg(F.max("frontier").alias("frontier"), F.max("open").alias("open"))
    gap = f"""case when open < (block + 1) * {block} then open
        when coalesce(lead(block) over (partition by topic, partition order by block), -1) <> block + 1 then open end as gap"""
    return blocks.selectExpr(*PARTITION, "block", "frontier", gap).groupBy(*PARTITION).agg(F.expr("min(gap) - 1 as frontier"))


def _stored(spark: SparkSession, root: str) -> list[int]:
    """Ids of the batches completed under a root; what is removed in time keeps them few."""
    files, at = hadoop_path(spark, root)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    ids = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return [i for i in ids if files.exists(hadoop_path(spark, f"{batch_path(root, i)}/_SUCCESS")[1])]


def _state(spark: SparkSession, root: str, before: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(frontiers, held runs, number of batches since the last whole state) before a batch, or after the last one."""
    early = [i for i in _stored(spark, f"{root}/full") if before is None or i < before]
    full = early[-1] if early else None
    changes = [i for i in _stored(spark, f"{root}/changes") if (before is None or i < before) and (full is None or i > full)]
    paths = [batch_path(f"{root}/changes", i) for i in changes]
    if full is not None:
        paths.append(batch_path(f"{root}/full", full))
    rows = spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)
    frontiers = rows.where("start is null").groupBy(*PARTITION).agg(F.max("frontier").alias("frontier"))
    held = rows.where("start is not null").groupBy(*PARTITION, *RUN).agg(F.sum("held").alias("held")).where("held > 0").drop("held")
    return frontiers, held, len(changes)


def _forget(spark: SparkSession, root: str) -> None:
    """Remove what no batch reads again: all before the whole state before the last."""
    whole = _stored(spark, f"{root}/full")
    if len(whole) < 2:
        return
    for part, keep in (("full", whole[-2]), ("changes", whole[-2] + 1)):
        for i in _stored(spark, f"{root}/{part}"):
            if i < keep:
                files, at = hadoop_path(spark, batch_path(f"{root}/{part}", i))
                files.delete(at, True)


def track_frontier(root: str, seeds: DataFrame, block: int = BLOCK, full_every: int = FULL_EVERY) -> Sink:
    """Sink for streams of confirmed ``topic, partition, offset`` rows.

    ``seeds`` gives the frontier of each partition before the stream began; one without a seed starts at -1. Offsets
    up to the frontier are confirmed again without effect, those below 0 are left out.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in _stored(spark, f"{root}/changes"):
            return
        last, held, since = _state(spark, root, batch_id)
        used: list[DataFrame] = []

        def shared(df: DataFrame) -> DataFrame:
            used.append(df.persist())
            return df

        try:
            fresh = shared(runs_of(batch))
            begun = fresh.select(*PARTITION).distinct().selectExpr(*PARTITION, "-1L as frontier")
            known = last.unionByName(seeds.selectExpr(*PARTITION, "greatest(frontier, -1L) as frontier")).unionByName(begun)
            known = shared(known.groupBy(*PARTITION).agg(F.max("frontier").alias("frontier")))
            beyond = fresh.join(known, PARTITION).where("stop > frontier")
            beyond = beyond.selectExpr(*PARTITION, "greatest(start, frontier + 1) as start", "stop")
            runs = shared(merged_runs(held.unionByName(beyond), block))
            now = shared(advanced(runs, known, block))
            kept = runs.join(now, PARTITION).where("stop > frontier").select(*PARTITION, *RUN)
            moved = now.join(last.withColumnRenamed("frontier", "was"), PARTITION, "left").where("not (frontier <=> was)").drop("was")
            both = kept.selectExpr("*", "1 as held").unionByName(held.selectExpr("*", "-1 as held"))
            turned = both.groupBy(*PARTITION, *RUN).agg(F.expr("cast(sum(held) as int) as held")).where("held <> 0")
            told = "cast(null as bigint) as start", "cast(null as bigint) as stop", "1 as held"
            if since + 1 >= full_every:
                whole = now.selectExpr("*", *told).unionByName(kept.selectExpr("*", "1 as held"), allowMissingColumns=True)
                write_once(_few(whole), f"{root}/full", batch_id)
            changes = moved.selectExpr("*", *told).unionByName(turned, allowMissingColumns=True)
            write_once(_few(changes), f"{root}/changes", batch_id)
        finally:
            for df in used:
                df.unpersist()
        _forget(spark, root)

    return run


def _few(rows: DataFrame) -> DataFrame:
    """In the order of runs, in as many files as adaptive execution finds worth it."""
    return rows.selectExpr("topic", "partition", "frontier", "start", "stop", "held").hint("rebalance")


def current_frontier(spark: SparkSession, root: str) -> DataFrame:
    return _state(spark, root)[0]


def held_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs of confirmed offsets that wait for a gap to fill: ``topic, partition, start, stop``."""
    return _state(spark, root)[1]


def held_words(spark: SparkSession, root: str) -> DataFrame:
    """The same as masks of 64 offsets: ``topic, partition, word, mask``."""
    offsets = held_runs(spark, root).selectExpr(*PARTITION, "explode(sequence(start, stop)) as offset")
    return confirmed_bits(offsets).groupBy(*PARTITION, "word").agg(F.expr("bit_or(mask) as mask"))
