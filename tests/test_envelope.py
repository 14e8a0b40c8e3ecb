import json

import pytest
from pyspark.sql import types as T


from weirlog.functions import codes, identity, times, unions
from weirlog.operators import delivery, envelope, routing
from weirlog.schemas import ENUMS
from weirlog.sources import bodies, logs

REQ = {
    "id": "m1",
    "app": "chat",
    "session": {"type": 1, "data": [{"name": "p", "value": {"format": 1, "data": "aGk="}}]},
    "msg": {"type": 2, "id": "m1", "ver": 3, "tsNanos": 1514764799999999999},
    "from": {"user": {"type": 32}, "channel": {"type": 33}},
    "to": [{"user": {"type": 64}}, {"user": {"type": 65}}],
}


def log(spark, *values):
    rows = [(b"k", v.encode() if isinstance(v, str) else v, "t", 0, o) for o, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset bigint")
    return df.selectExpr("*", "timestamp_micros(offset) as timestamp")


def request(**changes):
    return json.dumps({"type": 1, "tsNanos": 5, "msgReq": {**REQ, **changes}})


def test_decoding_and_quarantine(spark):
    wide = request(msg={**REQ["msg"], "tsNanos": 2**64 - 1})
    rows = delivery.requests(
        log(
            spark,
            request(),
            "{bad",
            None,
            wide,
            json.dumps({"type": 0}),
            request(to=[]),
            json.dumps({"type": 1}),
            request(msg=None),
            request(msg="oops"),
            json.dumps({"type": 1, "tsNanos": 2**64 - 1, "msgReq": REQ}),
            "",
            f"[{request()}]",
        )
    )
    problems = [r.problem for r in rows.orderBy("offset").collect()]
    assert problems == [
        None,
        "undecodable",
        "null_record",
        "ts_out_of_range",
        None,
        "no_recipient",
        "payload_missing",
        "no_document_id",
        "undecodable",
        "ts_out_of_range",
        "undecodable",
        "undecodable",
    ]
    aside = envelope.quarantine(rows)
    assert {r.offset for r in aside.collect()} == {1, 3, 5, 6, 7, 8, 9, 10, 11}
    first = aside.where("offset = 1").first()
    assert (first.key_hex, first.value_hex) == ("6B", b"{bad".hex().upper())
    assert envelope.confirmed(rows).count() == 12
    counts = {r.type: r.records for r in envelope.type_counts(envelope.good(rows)).collect()}
    assert counts == {1: 1, 0: 1}


def test_accepted_event(spark):
    rows = delivery.accept(envelope.good(delivery.requests(log(spark, request(), json.dumps({"type": 0})))))
    (row,) = rows.collect()
    event = row.event.asDict(recursive=True)
    assert row.sender == "32:33"
    assert (event["type"], event["tsNanos"]) == (10, 0)
    (report,) = event["msgDelivery"]["report"]
    assert report["to"]["user"]["type"] == 64 and report["stat"]["code"] == 1
    assert report["from"] == event["msgDelivery"]["req"]["from"]
    assert event["msgDelivery"]["req"]["session"]["data"][0]["value"]["data"] == b"hi"


def test_event_survives_its_json(spark):
    accepted = delivery.accept(envelope.good(delivery.requests(log(spark, request()))))
    again = accepted.selectExpr(
        "encode(sender, 'UTF-8') as key", "encode(to_json(event), 'UTF-8') as value", "topic", "partition", "offset", "timestamp"
    )
    (row,) = delivery.delivery_events(again).collect()
    assert row.problem is None
    assert row.data.asDict(recursive=True) == accepted.first().event.asDict(recursive=True)


def test_ids_months_and_keys(spark):
    df = spark.createDataFrame(
        [("m", "a", 1514764799999999999), ("m", "a", 1514764800000000000), ("m", None, 0)],
        "id string, app string, nanos bigint",
    )
    df = df.selectExpr("named_struct('id', id, 'app', app, 'msg', named_struct('tsNanos', nanos)) as req", "nanos")
    rows = df.selectExpr(
        f"{identity.document_id('req')} as id",
        f"{identity.month_index('nanos', 'docs')} as month",
        f"date_format({times.event_time('nanos')}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') as at",
    ).collect()
    # an absent field is at its default
    assert [r.id for r in rows] == ["a_m_1514764799999999999", "a_m_1514764800000000000", "_m_0"]
    none = spark.range(1).selectExpr("named_struct('id', 'x', 'app', 'a', 'msg', cast(null as struct<tsNanos:bigint>)) as req")
    assert none.selectExpr(f"{identity.document_id('req')} as id").first().id is None
    assert [r.month for r in rows] == ["docs_2017-12", "docs_2018-01", "docs_1970-01"]
    assert rows[0].at == "2017-12-31 23:59:59.999999"
    for tz in ("America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        try:
            again = df.selectExpr(f"{identity.month_index('nanos', 'docs')} as month").collect()
            assert [r.month for r in again] == [
                "docs_2017-12",
                "docs_2018-01",
                "docs_1970-01",
            ]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    address = "named_struct('user', named_struct('type', {}), 'channel', {})"
    some = [
        address.format(32, "named_struct('type', 33)"),
        address.format(32, "cast(null as struct<type:int>)"),
        address.format("cast(null as int)", "named_struct('type', 0)"),
    ]
    keys = [spark.range(1).selectExpr(f"{a} as a").selectExpr(f"{identity.sender_key('a')} as k").first().k for a in some]
    assert keys == ["32:33", "32:-", "0:0"]


def test_body_leaves_defaults_out(spark):
    empty = {"id": "x", "app": "", "session": {"type": 0, "data": []}, "msg": {"type": 0, "ver": 0, "tsNanos": 7}, "to": []}
    parsed = envelope.compute_once(
        spark.createDataFrame([(json.dumps(REQ),), (json.dumps(empty),)], "value string"),
        "req",
        envelope.parse_json("value", delivery.REQUEST["msgReq"].dataType),
    )
    full, bare = [json.loads(r.body) for r in parsed.selectExpr(f"{identity.document_body('req')} as body").collect()]
    assert full == REQ
    assert bare == {"id": "x", "session": {}, "msg": {"tsNanos": 7}}


def test_unions(spark):
    df = spark.createDataFrame(
        [(1, "p", None), (1, None, None), (2, "p", "q"), (0, None, None), (None, None, None), (2, None, "q")],
        "type int, one string, two string",
    )
    got = df.selectExpr(f"{unions.union_problem('type', {1: 'one', 2: 'two'})} as problem").collect()
    assert [r.problem for r in got] == [
        None, "payload_missing", "payload_mismatch", "unknown_type", "unknown_type", None,
    ]
    made = spark.range(1).selectExpr(f"{unions.tagged(32)} as u", f"{unions.tagged(1, ('x', 'id'), '9')} as r").first()
    assert made.u.asDict() == {"type": 32} and made.r.asDict() == {"type": 1, "tsNanos": 9, "x": 0}


def test_codes(spark):
    df = spark.createDataFrame([(e, c) for e, names in ENUMS.items() for c in [*names, 99]], "enum string, code int")
    got = df.selectExpr("enum", "code", f"{codes.enum_name('enum', 'code')} as name").collect()
    assert all(r.name == ENUMS[r.enum].get(r.code, "99") for r in got)
    df = spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 64, 128, 129)], "code int")
    got = df.selectExpr(f"{codes.delivery_class('code')} as c", f"{codes.retryable('code')} as r").collect()
    assert [r.c for r in got] == ["unknown", "progress", "progress", "progress", "pending", "failed", "aborted"]
    assert [r.r for r in got] == [False] * 5 + [True, False]


def test_bodies_fail_whole(spark):
    good, number = json.dumps([REQ, {**REQ, "id": "m2"}]), json.dumps([REQ, {"id": 7, "msg": "oops"}])
    far = json.dumps([{**REQ, "msg": {"tsNanos": 2**64 - 1}}])
    values = [good, number, good[:-3], json.dumps(REQ), far, "[]", "[null]", "null", f"[{json.dumps([REQ])}]"]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "body_id string, value string")
    assert sorted((r.body_id, r.place, r.req.id) for r in bodies.requests_of(bodies.parse_bodies(df)).collect()) == [
        ("0", 0, "m1"),
        ("0", 1, "m2"),
    ]
    assert {r.body_id: r.reason for r in bodies.bad_bodies(bodies.parse_bodies(df)).collect()} == {
        "1": "bad_element",
        "2": "not_an_array",
        "3": "not_an_array",
        "4": "ts_out_of_range",
        "6": "bad_element",
        "7": "not_an_array",
        "8": "bad_element",
    }


def test_bodies_from_files(spark, place):
    root = place("bodies")
    text = json.dumps([REQ], indent=1)
    spark.createDataFrame([(text,)], "value string").write.text(root)
    (row,) = bodies.requests_of(bodies.parse_bodies(bodies.read_bodies(spark, root))).collect()
    assert row.req.id == "m1"


@pytest.mark.parametrize("filter_partitions", [200, 1])
def test_start_positions(spark, filter_partitions):
    rows = spark.createDataFrame(
        [("it's", p, o) for p in range(4) for o in range(10)], "topic string, partition int, offset bigint"
    )
    resume = spark.createDataFrame(
        [("it's", 0, -2), ("it's", 1, -1), ("it's", 2, 7), ("it's", 3, None)], "topic string, partition int, start bigint"
    )
    got = {(r.partition, r.offset) for r in logs.from_starts(rows, resume, filter_partitions).collect()}
    assert got == {(0, o) for o in range(10)} | {(2, o) for o in (7, 8, 9)}
    assert logs.from_starts(rows, resume.where("start = -1"), filter_partitions).count() == 0


def test_kafka_options():
    got = logs.kafka_options("b:9092", "t", '{"t":{"0":5}}', rows_per_batch=5000)
    assert got["subscribe"] == "t" and got["startingOffsets"] == '{"t":{"0":5}}'
    assert got["maxOffsetsPerTrigger"] == "5000"


def test_routing(spark):
    df = spark.range(10).selectExpr("id as offset")
    assert [r.subscriber for r in routing.route(df, 4).orderBy("offset").collect()] == [i % 4 for i in range(10)]
    twice = routing.chain(df, lambda d: d.where("offset > 3"), lambda d: d.where("offset < 6"))
    assert {r.offset for r in twice.collect()} == {4, 5}
    assert routing.chain(df).count() == 10


def test_one_record_and_nothing_else(spark):
    good = json.dumps(REQ)
    values = [good, f"\n\t {good}\r\n ", good + "and more", good + good, f"{good},{good}", f"[{good}]", "", "   ", "{", None]
    log = spark.createDataFrame([("t", 0, i, v) for i, v in enumerate(values)], "topic string, partition int, offset bigint, value string")
    schema = T.StructType([T.StructField("id", T.StringType())])
    rows = envelope.decode(log, schema).orderBy("offset").collect()
    assert [r.problem for r in rows] == [None, None] + ["undecodable"] * 7 + ["null_record"]


def test_times_below_zero_are_set_aside(spark):
    req = {**REQ, "msg": {**REQ["msg"], "tsNanos": -1}}
    log = spark.createDataFrame(
        [("t", 0, 0, json.dumps({"type": 1, "tsNanos": 5, "msgReq": req}))], "topic string, partition int, offset bigint, value string"
    )
    assert delivery.requests(log).first().problem == "ts_out_of_range"
