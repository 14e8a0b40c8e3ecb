"""Which offsets exist, where to resume, and up to where everything is confirmed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.operators.blocks import previous_value
from weirlog.session import join_lookup, settle

PARTITION = ["topic", "partition"]

# Special start positions, also those of the Kafka source's offset JSON.
EARLIEST = -2
LATEST = -1


def partition_ranges(log: DataFrame) -> DataFrame:
    """Oldest offset and next offset (exclusive end) of each partition."""
    return log.groupBy(*PARTITION).agg(F.expr("min(offset) as oldest"), F.expr("max(offset) + 1 as newest"))


def resume_offsets(ranges: DataFrame, saved: DataFrame, strict: bool = False) -> DataFrame:
    """First offset to expect and the position to start reading from, per partition.

    ``saved`` has ``topic, partition, saved``. ``problem`` is ``rows_lost`` when rows after the
    saved offset are no longer in the log. By default a saved offset of 0 is never a problem and
    one just before the oldest row is; ``strict`` reports exactly the cases that lose rows.
    """
    lost = "saved >= 0 and saved < oldest - 1" if strict else "saved > 0 and saved < oldest"
    case = f"""case when newest <= 0 then 'empty' when saved < 0 then 'unsaved' when {lost} then 'lost'
        when saved + 1 >= newest then 'done' else 'next' end"""
    known = ranges.join(saved, PARTITION, "left").selectExpr(
        *PARTITION, "oldest", "newest", "coalesce(saved, -1L) as saved"
    )
    return known.selectExpr("*", f"{case} as _case").selectExpr(
        *PARTITION,
        "oldest",
        "newest",
        "saved",
        """case _case when 'empty' then 0L when 'unsaved' then oldest when 'done' then newest
           when 'next' then saved + 1 end as first_offset""",
        f"""case when _case in ('empty', 'unsaved') then {EARLIEST}L when _case = 'done' then {LATEST}L
            when _case = 'next' then saved + 1 end as start""",
        "if(_case = 'lost', 'rows_lost', null) as problem",
    )


def starting_offsets(resume: DataFrame) -> DataFrame:
    """One row: the start positions as the JSON that the Kafka source takes.

    There is one entry per topic partition, the same list a Kafka source plans with.
    """
    starts = "map_from_entries(array_sort(collect_list(struct(cast(partition as string), start))))"
    per_topic = resume.groupBy("topic").agg(F.expr(f"to_json({starts}) as starts"))
    entries = """array_join(array_sort(collect_list(concat('"', topic, '":', starts))), ',')"""
    return per_topic.agg(F.expr(f"concat('{{', {entries}, '}}') as starting_offsets"))


# --- contiguous frontier -------------------------------------------------------------------
#
# Confirmed offsets are packed 64 to a bit mask ("word"). The masks are OR-ed together before
# the shuffle, so repeated confirmations and hot partitions cost one long per 64 offsets. The
# first gap is then found inside blocks of words, and after that over the blocks. Positions are
# offsets plus one, which makes room for the seed -1 of an unread log.

BLOCK_WORD_BITS = 14


def confirmed_bits(confirmed: DataFrame) -> DataFrame:
    """One mask per confirmation: ``topic, partition, word, mask``."""
    return confirmed.where("offset >= 0").selectExpr(
        *PARTITION, "shiftright(offset + 1, 6) as word", "shiftleft(1L, cast((offset + 1) & 63 as int)) as mask"
    )


def merge_words(masks: DataFrame, seeds: DataFrame) -> DataFrame:
    """One mask per word. A seed sets every bit of its word up to and including its own, and is
    marked, so that the words below it can be left out."""
    at = seeds.selectExpr(*PARTITION, "greatest(frontier, -1L) + 1 as position").selectExpr(
        *PARTITION,
        "shiftright(position, 6) as word",
        "shiftrightunsigned(-1L, 63 - cast(position & 63 as int)) as mask",
        "1 as seed",
    )
    rows = masks.selectExpr(*PARTITION, "word", "mask", "0 as seed").unionByName(at)
    merged = rows.groupBy(*PARTITION, "word").agg(F.expr("bit_or(mask) as mask"), F.expr("max(seed) as seed"))
    return merged.selectExpr(*PARTITION, "word", "if(word = 0, mask | 1L, mask) as mask", "seed")


def _block_gaps(words: DataFrame, block_bits: int) -> DataFrame:
    """Per block of merged words: the first gap in or right after it, and the seed's block."""
    size = 64 << block_bits
    # a mask that is not full opens after its trailing ones
    ones = "coalesce(bit_count(mask ^ try_add(mask, 1L)) - 1, 63)"
    inside = "partition by topic, partition, block order by word"
    first = f"shiftleft(block, {block_bits})"
    blocks = (
        words.selectExpr("*", f"shiftright(word, {block_bits}) as block")
        .selectExpr(
            *PARTITION,
            "block",
            "word",
            f"""case when mask <> -1 then word * 64 + {ones}
                when coalesce(lead(word) over ({inside}), -1) <> word + 1 then (word + 1) * 64 end as gap""",
            f"""max(if(seed = 1, word, null)) over ({inside}
                rows between unbounded preceding and unbounded following) as seed_word""",
        )
        .groupBy(*PARTITION, "block")
        .agg(
            F.expr(
                f"""if(max(seed_word) is null and min(word) > {first}, {first} * 64,
                    min(gap) filter (where seed_word is null or word >= seed_word)) as open"""
            ),
            F.expr("max(seed_word) is not null as seeded"),
        )
    )
    across = "partition by topic, partition order by block"
    return blocks.selectExpr(
        *PARTITION,
        "block",
        f"""case when open < (block + 1) * {size} then open
            when coalesce(lead(block) over ({across}), -1) <> block + 1 then (block + 1) * {size} end as gap""",
        f"""max(if(seeded, block, null)) over ({across}
            rows between unbounded preceding and unbounded following) as seed_block""",
    )


# Over the block gaps of a partition. A partition without a seed starts at its very first block.
_FRONTIER = """greatest(-1L, if(max(seed_block) {over} is null and min(block) {over} > 0, 0L,
    min(if(seed_block is null or block >= seed_block, gap, null)) {over}) - 2) as frontier"""


def frontier_of_words(words: DataFrame, block_bits: int = BLOCK_WORD_BITS) -> DataFrame:
    """Frontier of each partition from its merged words."""
    return _block_gaps(words, block_bits).groupBy(*PARTITION).agg(F.expr(_FRONTIER.format(over="")))


def frontier_of_blocks(words: DataFrame, block_bits: int = BLOCK_WORD_BITS) -> DataFrame:
    """The same, repeated for every block of the partition: a join key as fine as the blocks, so
    that a single large partition does not end up in one task."""
    over = "over (partition by topic, partition)"
    return _block_gaps(words, block_bits).selectExpr(*PARTITION, "block", _FRONTIER.format(over=over))


def frontier(confirmed: DataFrame, seeds: DataFrame, block_bits: int = BLOCK_WORD_BITS) -> DataFrame:
    """Greatest offset up to which everything after the seed is confirmed, per partition.

    ``confirmed`` has ``topic, partition, offset`` in any order, with repeats. ``seeds`` has one
    row ``topic, partition, frontier`` per partition: the last offset confirmed before, that is
    the first offset to read minus one. A partition with no confirmation keeps its seed, one
    with no seed starts at -1.
    """
    return frontier_of_words(merge_words(confirmed_bits(confirmed), seeds), block_bits)


def words_beyond(words: DataFrame, frontiers: DataFrame, block_bits: int = BLOCK_WORD_BITS) -> DataFrame:
    """Of merged words, the masks that hold a confirmed offset past the frontier, given
    ``frontier_of_blocks``."""
    # positions run one ahead of offsets; bits up to the frontier are cleared
    beyond = """case when word > shiftright(frontier + 2, 6) then mask
        when word = shiftright(frontier + 2, 6) then mask & shiftleft(-1L, cast((frontier + 2) & 63 as int))
        else 0L end"""
    return (
        words.selectExpr(*PARTITION, "word", "mask", f"shiftright(word, {block_bits}) as block")
        .join(frontiers, [*PARTITION, "block"])
        .selectExpr(*PARTITION, "frontier", "word", f"{beyond} as mask")
        .where("mask <> 0")
    )


def offsets_of_words(words: DataFrame) -> DataFrame:
    """The offsets a set of masks stands for."""
    rest = [c for c in words.columns if c not in (*PARTITION, "word", "mask")]
    places = "filter(sequence(0, 63), i -> shiftrightunsigned(mask, i) & 1L = 1L)"
    return words.selectExpr(*PARTITION, *rest, "word", f"explode({places}) as _place").selectExpr(
        *PARTITION, "word * 64 + _place - 1 as offset", *rest
    )


def held_offsets(confirmed: DataFrame, seeds: DataFrame, block_bits: int = BLOCK_WORD_BITS) -> DataFrame:
    """Confirmed offsets past the frontier, held back by a gap."""
    # one long per 64 offsets is stored, so that the log is read once
    words = settle(merge_words(confirmed_bits(confirmed), seeds))
    return offsets_of_words(words_beyond(words, frontier_of_blocks(words, block_bits), block_bits))


def frontier_changes(reports: DataFrame, seq: str, initial: int | None = None) -> DataFrame:
    """Reports whose frontier differs from the report before. The first one is compared with
    ``initial``, and kept when that is not given."""
    known = previous_value(reports, PARTITION, seq, "frontier", "previous")
    before = "previous" if initial is None else f"coalesce(previous, {initial})"
    return known.where(f"not (frontier <=> {before})")


def frontier_history(confirmed: DataFrame, seeds: DataFrame, batch: str, block: int = 1 << 20) -> DataFrame:
    """Frontiers after the batches that moved them, in one pass over all batches: ``topic, partition, batch, frontier``.

    ``confirmed`` has ``topic, partition, offset`` in any order, with repeats, and the whole number of the batch that
    confirmed a row. An offset is reached with the last of the batches that the offsets before it and
    itself waited for, so the frontier after a batch is the last offset reached with it. Offsets meet in blocks; what
    goes on from block to block is one row each.
    """
    start = seeds.groupBy(*PARTITION).agg(F.expr("greatest(max(frontier), -1L) + 1 as begin"))
    rows = confirmed.selectExpr(*PARTITION, "offset", f"cast({batch} as bigint) as batch")
    rows = join_lookup(rows, start, PARTITION, "left").selectExpr(*PARTITION, "offset", "batch", "coalesce(begin, 0L) as begin")
    rows = rows.where("offset >= begin").selectExpr("*", f"offset div {block} as block").repartition(*PARTITION, "block")
    first = rows.groupBy(*PARTITION, "block", "begin", "offset").agg(F.min("batch").alias("batch"))
    inside = "partition by topic, partition, block order by offset"
    chain = first.selectExpr(
        "*", f"max(batch) over ({inside}) as reached", f"greatest(begin, block * {block}) as low", f"row_number() over ({inside}) as place"
    ).where("offset = low + place - 1")
    steps = settle(chain.groupBy(*PARTITION, "begin", "block", "reached").agg(F.max("offset").alias("last")))
    blocks = steps.groupBy(*PARTITION, "begin", "block").agg(F.max("reached").alias("reached"), F.max("last").alias("last"))
    # a block counts when all from the first one on are there, and those before it are full
    before = "partition by topic, partition order by block rows between unbounded preceding and 1 preceding"
    along = blocks.selectExpr(
        *PARTITION, "block", f"max(reached) over ({before}) as waited",
        f"coalesce(bool_and(last = (block + 1) * {block} - 1) over ({before}), true) as full",
        f"row_number() over (partition by topic, partition order by block) = block - begin div {block} + 1 as follows",
    ).where("full and follows")
    met = steps.join(along, [*PARTITION, "block"]).selectExpr(*PARTITION, "greatest(reached, waited) as batch", "last")
    return met.groupBy(*PARTITION, "batch").agg(F.max("last").alias("frontier"))


def latest_progress(progress: DataFrame) -> DataFrame:
    """Last saved frontier of each partition from the append-only progress table."""
    return progress.groupBy(*PARTITION).agg(
        F.expr("max_by(frontier, batch_id) as frontier"), F.expr("max(batch_id) as batch_id")
    )
