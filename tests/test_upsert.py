import random

import pytest

from weirlog.operators import upsert

ROWS = "doc string, seq bigint, a string, b int"
STORED = "doc string, a string, b int, version bigint"


def folded(rows, stored=()):
    """Plain sequential statement of the rule."""
    state = {doc: ({"a": a, "b": b}, version) for doc, a, b, version in stored}
    result = {}
    for doc, seq, a, b in sorted(rows, key=lambda r: r[1]):
        old, version = state.get(doc, (None, 0))
        new = dict(old or {"a": None, "b": None})
        new.update({k: v for k, v in (("a", a), ("b", b)) if v is not None})
        outcome = "created" if old is None else "noop" if new == old else "updated"
        version += outcome != "noop"
        state[doc] = (new, version)
        result[doc, seq] = (outcome, version, new["a"], new["b"])
    return result


def run(spark, rows, stored=None, **limits):
    df = spark.createDataFrame(rows, ROWS)
    before = None if stored is None else spark.createDataFrame(stored, STORED)
    out = upsert.fold_upserts(df, "doc", ["seq"], ["a", "b"], stored=before, **limits)
    assert set(out.columns) == {"doc", "seq", "a", "b", "outcome", "version"}
    got = [((r.doc, r.seq), (r.outcome, r.version, r.a, r.b)) for r in out.collect()]
    assert len(got) == len(rows)
    return dict(got)


def test_outcomes(spark):
    rows = [("d", 1, "x", None), ("d", 2, "x", None), ("d", 3, None, 4), ("d", 4, "x", 4), ("d", 5, "y", None)]
    got = run(spark, rows)
    assert [got["d", s] for s in range(1, 6)] == [
        ("created", 1, "x", None),
        ("noop", 1, "x", None),
        ("updated", 2, "x", 4),
        ("noop", 2, "x", 4),
        ("updated", 3, "y", 4),
    ]


def test_an_empty_first_row_creates(spark):
    assert run(spark, [("d", 1, None, None), ("d", 2, None, None)])["d", 2] == ("noop", 1, None, None)


@pytest.mark.parametrize("with_stored", [False, True])
def test_hot_documents_are_split_without_changing_the_result(spark, with_stored):
    rng = random.Random(11)
    rows = []
    for seq in range(900):
        doc = "hot" if rng.random() < 0.4 else f"d{rng.randrange(60)}"
        rows.append((doc, seq, rng.choice([None, None, "x", "y"]), rng.choice([None, None, None, 1, 2])))
    stored = [("hot", "x", None, 9), ("d1", None, 2, 3), ("unseen", "z", 1, 1)] if with_stored else None
    expected = folded(rows, stored or ())
    assert run(spark, rows, stored) == expected
    assert run(spark, rows, stored, hot_rows=50, slice_rows=20) == expected
    assert run(spark, rows, stored, hot_rows=3, slice_rows=7) == expected


def test_replaying_a_batch_is_silent(spark):
    rows = [(f"d{i}", 0, "x", i) for i in range(20)]
    again = [(d, 1, a, b) for d, _, a, b in rows]
    got = run(spark, rows + again)
    assert {v[0] for (_, s), v in got.items() if s == 1} == {"noop"}


def test_actions(spark):
    df = spark.createDataFrame(
        [(201, "created"), (200, "noop"), (200, "updated"), (429, "created"), (500, "noop")],
        "status int, outcome string",
    )
    got = df.selectExpr(f"{upsert.outcome_action('status', 'outcome')} as action").collect()
    assert [r.action for r in got] == ["emit", "silent", "report", "report", "report"]


def test_correlation_survives_skipped_rows(spark):
    key = "topic string, partition int, offset bigint"
    requests = spark.createDataFrame([("t", 0, o) for o in (1, 2, 3)], key)
    responses = spark.createDataFrame([("t", 0, 1, "a"), ("t", 0, 3, "c")], key + ", result string")
    got = upsert.correlate(requests, responses).collect()
    assert {r.offset: r.result for r in got} == {1: "a", 3: "c"}
