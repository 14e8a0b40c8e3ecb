"""The levelled table: merging, earlier states, replays, lookups that read keys only."""

import random

import pytest
from pyspark.sql import types as T

from weirlog.streaming.keyed_table import KeyedTable

_KINDS = {"version": T.LongType()}
SCHEMA = T.StructType([T.StructField(c, _KINDS.get(c, T.StringType())) for c in ("id", "month", "version", "payload", "state")])


def table_of(root, **options):
    return KeyedTable(root, SCHEMA, ("id",), "version", coarse="month", **{"buckets": 2, "fan": 3, **options})


def batch(spark, rows):
    return spark.createDataFrame([(i, f"m{int(i) % 2}", v, p, s) for i, v, p, s in rows], SCHEMA)


def test_batches_are_merged_and_earlier_states_stay_readable(spark, place):
    table, rng = table_of(place("levels")), random.Random(1)
    now, states, most = {}, {}, 0
    for n in range(14):
        some = rng.sample(range(30), 6)
        rows = [(str(i), n + 1, f"{i} at {n}", "x") for i in some]
        now = {**now, **{r[0]: r for r in rows}}
        states[n] = dict(now)
        for _ in range(1 + n % 2):  # every other batch is run twice
            table.change(batch(spark, rows), n)
        most = max(most, len(table.segments(spark)))
    # two segments on each of three levels at most
    assert most <= 6
    for n in table.batches(spark):
        got = {r.id: (r.id, r.version, r.payload, r.state) for r in table.read(spark, n).collect()}
        assert got == states[n]
    assert table.batches(spark) == [10, 11, 12, 13]
    with pytest.raises(LookupError):
        table.read(spark, 3)
    with pytest.raises(LookupError):
        table.segments(spark, before=10)
    found = {r.id: r.version for r in table.find(batch(spark, [(str(i), 0, "", "") for i in range(25, 40)]), before=12).collect()}
    assert found == {k: v[1] for k, v in states[11].items() if int(k) >= 25}


def test_what_no_state_names_is_removed(spark, place):
    table = table_of(place("tidy"), keep=2)
    spark.range(1).write.parquet(f"{table.root}/segments/segment=0-0-failed")
    for n in range(7):
        table.change(batch(spark, [(str(n), 1, "p", "x")]), n)
    from weirlog.streaming.sinks import hadoop_path

    files, at = hadoop_path(spark, f"{table.root}/segments/*")
    there = {s.getPath().getName() for s in files.globStatus(at)}
    assert there == {f"segment={s['name']}" for n in (5, 6) for s in table.segments(spark, n)}
    assert table.read(spark).count() == 7


def test_done_rows_are_forgotten_where_nothing_older_is_stored(spark, place):
    table = table_of(place("done"), fan=2, done="state = 'acked'")
    table.change(batch(spark, [("1", 1, "p", "new"), ("2", 1, "p", "new")]), 0)
    table.change(batch(spark, [("1", 2, "p", "acked")]), 1)
    assert [(r.id, r.state) for r in table.read(spark).collect()] == [("2", "new")]
    (only,) = table.segments(spark)
    assert spark.read.parquet(f"{table.root}/segments/segment={only['name']}").count() == 1
    # the row of an older level must not come back
    table.change(batch(spark, [("2", 2, "p", "acked")]), 2)
    assert table.read(spark).count() == 0
    table.change(batch(spark, [("3", 1, "p", "new")]), 3)
    assert [r.id for r in table.read(spark).collect()] == ["3"]


def _scans(df):
    return [str(x) for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in str(x)]


def test_lookups_read_keys_and_versions_of_the_parts_asked_for(spark, place):
    table = table_of(place("probe"))
    for n in range(2):
        table.change(batch(spark, [(str(i), n + 1, "payload " * 9, "x") for i in range(200)]), n)
    wanted = batch(spark, [("4", 0, "", ""), ("1000", 0, "", "")])
    found = table.versions(wanted)
    assert [(r.id, r.version) for r in found.collect()] == [("4", 2)]
    scan = _scans(found)[0]
    assert "ReadSchema: struct<id:string,version:bigint>" in scan and "PartitionFilters" in scan and "m0-" in scan and "m1-" not in scan
    # nothing is found, so no part is named in the scan of whole rows
    missing = table.find(batch(spark, [("1001", 0, "", ""), ("1002", 0, "", "")]))
    assert not _scans(missing)
    assert missing.count() == 0
    assert table.get(spark, "5").first().version == 2


def test_bloom_filters_spare_files_without_the_key(spark, place):
    table = table_of(place("bloom"))
    table.change(batch(spark, [(str(i), 1, "payload", "x") for i in range(0, 4000, 2)]), 0)

    def scanned(key):
        rows = table._rows(spark, table.segments(spark)).where(f"id = '{key}'")
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().apply(0)
        return plan.metrics().apply("numOutputRows").value()

    # within the range of the keys, so that minima and maxima don't tell
    assert scanned("2000") > 0
    assert sum(scanned(str(i)) == 0 for i in range(1001, 1021, 2)) >= 8


def _folders(spark, table):
    from weirlog.streaming.sinks import hadoop_path

    files, at = hadoop_path(spark, f"{table.root}/segments/*/*")
    return [len({s.getPath().getName() for s in files.globStatus(at) if s.getPath().getParent().getName() == f"segment={seg['name']}"} - {"_SUCCESS"})
            for seg in table.segments(spark)]


@pytest.mark.parametrize(("rows", "folders"), [(1 << 18, 1), (10, 8), (1, 48)])
def test_folders_follow_the_rows_not_the_parts(spark, place, monkeypatch, rows, folders):
    from weirlog.streaming import keyed_table

    monkeypatch.setattr(keyed_table, "FOLDER_ROWS", rows, raising=False)
    table = table_of(place("folders"), fan=2)
    schema = SCHEMA

    def of_month(n, ids):
        return spark.createDataFrame([(str(i), f"m{i % 24}", n, f"{i} at {n}", "x") for i in ids], schema)

    table.change(of_month(1, range(96)), 0)
    (found,) = _folders(spark, table)
    assert found == folders if rows > 1 else 24 < found <= 48
    # rows of a key lie in unlike folders of unlike segments, and are merged all the same
    table.change(of_month(2, range(0, 96, 2)), 1)
    table.change(of_month(3, range(0, 3)), 2)
    latest = {str(i): 3 if i < 3 else 1 + (i % 2 == 0) for i in range(96)}
    assert {r.id: r.version for r in table.read(spark).collect()} == latest
    assert {r.id: r.version for r in table.find(of_month(9, range(90, 99))).collect()} == {k: v for k, v in latest.items() if int(k) >= 90}
    versions = table.versions(of_month(9, [1, 95])).collect()
    assert sorted((r.id, r.version) for r in versions) == [("1", 3), ("95", 1)] and all(r.part.startswith("m") for r in versions)


def test_rows_without_a_part_stay_apart_in_shared_folders(spark, place):
    table = table_of(place("bare"), fan=2)

    def rows(*some):
        return spark.createDataFrame([(i, m, v, "p", "x") for i, m, v in some], SCHEMA)

    table.change(rows(("1", None, 1), ("2", "m0", 1)), 0)
    table.change(rows(("1", "m0", 5), ("3", None, 1)), 1)
    assert sorted((r.id, r.month, r.version) for r in table.read(spark).where("id <> '1'").collect()) == [("2", "m0", 1), ("3", None, 1)]
    assert {(r.month, r.version) for r in table.read(spark).where("id = '1'").collect()} == {(None, 1), ("m0", 5)}
    wanted = rows(("1", "m0", 0), ("1", None, 0), ("3", None, 0))
    assert [(r.id, r.month, r.version) for r in table.find(wanted).collect()] == [("1", "m0", 5)]
