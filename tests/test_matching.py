"""Streams of sends and answers, and repeats, with state that shrinks."""

from weirlog.streaming import sinks, stages
from weirlog.streaming.matching import match_answers, once, unanswered


def landed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).selectExpr("id", "timestamp_seconds(s) as at").coalesce(1).write.mode("append").parquet(path)


def run(stream, out, checkpoint):
    query = stages.start(stream, sinks.table(out), checkpoint)
    query.awaitTermination()
    return [op["numRowsTotal"] for op in query.lastProgress["stateOperators"]]


def test_answers_in_time_too_late_and_absent(spark, place):
    root, kind = place("answers"), "id bigint, s bigint"

    def stream(name, at):
        landed(spark, f"{root}/{name}", [], kind)
        return spark.readStream.schema("id bigint, at timestamp").parquet(f"{root}/{name}").withColumnRenamed("at", at)

    matched = match_answers(stream("sends", "sent_at"), stream("answers", "answered_at"), ["id"], "60 seconds", "5 seconds")
    landings = [
        ([(1, 100), (2, 101), (3, 102), (None, 103)], [(1, 130), (4, 90)]),
        # 2 is answered in time but in a later batch, 3 too late; 5 has its answer before it is sent
        ([(5, 140), (6, 141)], [(2, 160), (3, 163), (5, 139)]),
        ([(7, 400)], [(7, 401)]),
        ([(8, 900)], [(9, 900)]),
    ]
    kept = []
    for sends, answers in landings:
        landed(spark, f"{root}/sends", sends, kind)
        landed(spark, f"{root}/answers", answers, kind)
        kept.append(sum(run(matched, f"{root}/out", f"{root}/progress")))
    out = spark.read.schema("id bigint, sent_at timestamp, answered_at timestamp").parquet(f"{root}/out")
    got = {(r.id, r.waited) for r in out.selectExpr("id", "unix_seconds(answered_at) - unix_seconds(sent_at) as waited").collect()}
    assert got == {(1, 30), (2, 59), (3, None), (None, None), (5, None), (6, None), (7, 1)}
    assert {r.id for r in unanswered(out).collect()} == {None, 3, 5, 6}
    # what is over leaves the state
    assert max(kept) >= 6 and kept[-1] <= 3


def test_repeats_over_batches_are_dropped_and_forgotten(spark, place):
    root = place("repeats")
    landed(spark, f"{root}/in", [], "id bigint, s bigint")
    stream = once(spark.readStream.schema("id bigint, at timestamp").parquet(f"{root}/in"), ["id"], "at", "100 seconds")
    kept = []
    for rows in ([(1, 100), (1, 100), (2, 101), (None, 102)], [(2, 103), (3, 104), (None, 105)], [(4, 1000)], [(5, 1001), (4, 1002)]):
        landed(spark, f"{root}/in", rows, "id bigint, s bigint")
        kept += run(stream, f"{root}/out", f"{root}/progress")
    got = [r.id for r in spark.read.schema("id bigint, at timestamp").parquet(f"{root}/out").collect()]
    assert sorted(got, key=str) == [1, 2, 3, 4, 5, None]
    assert kept[1] == 4 and kept[-1] == 2
