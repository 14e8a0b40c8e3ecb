"""The pipeline's stages, and the queries with SQL."""

import os
import random

import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from tests.llm.conftest import ODD
from tests.oracle import connect, differences
from weirlog import session
from weirlog.llm import buckets as bk
from weirlog.llm import fuzzy_lines, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_registered():
    found = driver.queries()
    assert "pipeline" in found
    for n in range(1, 14):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1


def prose(seed, n=60):
    import random

    rng = random.Random(seed)
    words = ["water", "stone", "river", "house", "green", "under", "walks", "small", "light", "there", "again", "early"]
    return " ".join(f"{rng.choice(words)}{rng.randrange(60)}" for _ in range(n))


def test_stages(spark, tmp_path_factory, place):
    item = prose(1000, 30)
    rows = [(i, prose(i), "en", "s") for i in range(80)]
    near = rows[5][1].split(" ")
    near[7] = "changed"
    rows += [
        (200, rows[3][1], "en", "s"),
        (201, " ".join(near), "en", "s"),
        (202, prose(300) + " " + item, "en", "s"),
        (203, "### $$$ %%% " * 40, "en", "s"),
        (204, None, None, None),
        (205, "short", "en", "s"),
        (206, prose(301) + "\n" + prose(302, 20), "en", "s"),
        (207, prose(303) + "\n" + prose(302, 20), "en", "s"),
    ]
    base = place("tables")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    left = {}
    now = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = place(name)
        stage(spark, now, base).write.parquet(out)
        now = spark.read.parquet(out)
        assert now.columns == docs.columns
        left[name] = {r.doc_id: r.text for r in now.collect()}
        assert all(r.n_chars == len(r.text) for r in now.collect())
    assert set(range(80)) | {200, 201, 202, 206, 207} == set(left["quality_rules"])
    # exact and near copies are one line each, so they go with their line; a shared line goes from the second
    assert set(left["line_dedup"]) == set(range(80)) | {202, 206, 207}
    assert left["line_dedup"][207] == prose(303) and left["line_dedup"][206] == prose(301) + "\n" + prose(302, 20)
    assert set(left["jaccard_join"]) == set(left["line_dedup"])
    assert set(left["decontamination"]) == set(left["jaccard_join"]) - {202}
    tokens = corpus_pipeline.run(spark, base)
    assert {r.doc_id for r in tokens.collect()} == set(left["decontamination"])


def test_near_duplicates_keep_one_of_each_group(spark, docs_of):
    out = corpus_pipeline.near_duplicates(spark, docs_of(ODD), SF).collect()
    kept = [(i, t) for i, t in ODD if (i, t) not in [(2, ODD[0][1]), (10, "one two three")]]
    assert sorted(repr((r.doc_id, r.text)) for r in out) == sorted(map(repr, kept))


def test_columns_named_like_counts(spark):
    """A table's own n_lines and n_removed decide nothing and are kept."""
    rows = [(i, prose(i), "en", "s", 1, 5, 3) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed int, N_Lines int")
    out = corpus_pipeline.lines(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.n_removed, r.N_Lines) for r in out.collect()) == [(i, 5, 3) for i in range(10)]


def test_rows_that_differ_in_language_have_verdicts_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (1, "a", "de"), (1, "a", None), (1, "a", "en")], "doc_id bigint, text string, lang string")
    assert len({r[corpus_pipeline.ROW] for r in corpus_pipeline._marked(docs).collect()}) == 3


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_empty_tables_and_odd_rows(spark, docs_of, stage):
    assert stage[1](spark, docs_of([]), SF).count() == 0
    assert stage[1](spark, docs_of(ODD), SF).count() <= len(ODD)


def test_unlike_lines_are_told_nothing(spark, docs_of, monkeypatch):
    """The line stage stores what lines are told; unlike ones, met by chance, would make that grow with their pairs."""
    rng = random.Random(3)
    pool = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(12)) for _ in range(100)]
    rows = [(i, "".join(rng.sample(pool, 25))) for i in range(600)]
    rows += [(600, rows[0][1]), (601, rows[1][1][:-1])]
    told = []

    def stored(df, path, **options):
        out = session.store(df, path, **options)
        if path.endswith("/told"):
            told.extend(int(i) for r in out.collect() for i in np.cumsum(bk.unpack(r.blob)["ids"]))
        return out

    monkeypatch.setattr(fuzzy_lines, "store", stored)
    kept = corpus_pipeline.lines(spark, docs_of(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(600))
    assert {0, 1, 600, 601} <= set(told) and len(set(told)) < 20
