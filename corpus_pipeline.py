"""A corpus cleaned and encoded: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of ``documents``. Rows may repeat, ids and texts may be null, further columns may come along
and are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import fuzzy_lines, jaccard, phrase_index, pieces, quality_rules
from weirlog.llm.queries import vocabulary
from weirlog.session import join_lookup, scratch

#: Digests of an id, a text and a language: rows that are equal in these share every verdict.
ROW, TIE = "_pipeline_row", "_pipeline_tie"
#: Verdicts are broadcast up to this many rows (some 30 MB), and joined by shuffle beyond.
VERDICTS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``docs`` without the rows whose keys are in ``gone``."""
    return join_lookup(docs, gone.distinct(), on, "left_anti", VERDICTS)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text", "lang"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    marked = _marked(docs)
    rated = quality_rules.quality_rules(
        marked, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json"), id_column=ROW
    )
    gone = rated.where("not kept").select(F.col("doc_id").alias(ROW))
    return _without(marked, gone, [ROW]).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which nothing is left by that."""
    # a table's own columns of these names must not stand in for the counts
    aside = {c: f"_pipeline_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    cut = fuzzy_lines.dedup_lines(docs.withColumnsRenamed(aside), shingle=5).where("n_removed = 0 or n_removed < n_lines")
    kept = cut.drop("n_lines", "n_removed").withColumnsRenamed({name: c for c, name in aside.items()})
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies of one another, the one with the smallest id stays."""
    found = jaccard.similar_documents(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias(ROW), F.col("tie").alias(TIE), "leader")
    path = scratch(spark, "near")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    gone = found.where("not leader").select(ROW, TIE)
    # repeats of a leader's own row go, but one of them stays
    twins = gone.join(found.where("leader").select(ROW, TIE), [ROW, TIE], "left_semi").distinct()
    marked = docs.withColumn(ROW, F.coalesce("doc_id", F.lit(-(2**63)))).withColumn(TIE, F.xxhash64("text"))
    kept = _without(marked, gone, [ROW, TIE])
    if not twins.isEmpty():
        kept = kept.unionByName(join_lookup(marked, twins, [ROW, TIE], "left_semi", VERDICTS).dropDuplicates([ROW, TIE]))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    marked = _marked(docs)
    found = phrase_index.decontaminate(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column=ROW)
    return _without(marked, found.where("contaminated").select(F.col("doc_id").alias(ROW)), [ROW]).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fertility bands, MinHash and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
