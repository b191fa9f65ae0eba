from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weirflow import streaming as st
from weirflow.sources.kafka import KafkaOptions, KafkaSink
from weirflow.streaming.windows import seconds
from weirflow.validation import DeadLetters, RangeRule, RuleSet


def test_spans():
    assert [seconds(x) for x in ("60s", "5m", "1h", "250ms", 7, "2d", "3")] == [60, 300, 3600, 0.25, 7, 172800, 3]
    with pytest.raises(ValueError):
        seconds("soon")
    with pytest.raises(ValueError):
        st.TimeWindow("hopping")


def test_tumbling_over_epoch_seconds(spark):
    df = spark.createDataFrame([("food", 10, 1000), ("food", 20, 1010), ("fuel", 5, 1079), ("food", None, 1080)], "category string, amount int, ts long")
    got = st.windowed_aggregate(df, st.TimeWindow("tumbling", 60), {"total": "sum(amount)", "mean": "avg(amount)", "n": "count(*)", "low": "min(amount)"}, ["category"], "ts")
    assert sorted(tuple(r) for r in got.collect()) == [(960.0, 1020.0, "food", 30, 15.0, 2, 10, 2), (1020.0, 1080.0, "fuel", 5, 5.0, 1, 5, 1), (1080.0, 1140.0, "food", 0, 0.0, 1, None, 1)]


def test_sliding_and_gaps_between_windows(spark):
    df = spark.createDataFrame([(3,), (7,)], "ts long")
    got = st.windowed_aggregate(df, st.TimeWindow("sliding", 10, 5), {"n": "count(*)"}, [], "ts")
    assert sorted((r._window_start, r.n) for r in got.collect()) == [(-5.0, 1), (0.0, 2), (5.0, 1)]
    got = st.windowed_aggregate(df, st.TimeWindow("sliding", 4, 5), {"n": "count(*)"}, [], "ts")
    assert sorted((r._window_start, r._window_end, r.n) for r in got.collect()) == [(0.0, 4.0, 1), (5.0, 9.0, 1)]


def test_sessions(spark):
    df = spark.createDataFrame([(t,) for t in (1, 2, 3, 100, 101)], "ts long")
    window = st.TimeWindow("session", gap=5)
    for strict in (False, True):
        got = st.windowed_aggregate(df, window, {"n": "count(*)"}, [], "ts", strict_sessions=strict)
        assert sorted(r.n for r in got.collect()) == [2, 3]
    apart = spark.createDataFrame([(0,), (9,)], "ts long")
    assert st.windowed_aggregate(apart, window, {"n": "count(*)"}, [], "ts").count() == 2
    strict = st.windowed_aggregate(apart, window, {"n": "count(*)"}, [], "ts", strict_sessions=True).collect()
    assert [(r._window_start, r._window_end, r.n) for r in strict] == [(0.0, 9.0, 2)]


def test_unknown_aggregates_are_errors(spark):
    df = spark.createDataFrame([(1,)], "ts long")
    for spec in ("median(ts)", "first(ts)", "sum(nothing)"):
        with pytest.raises((ValueError, KeyError)):
            st.windowed_aggregate(df, st.TimeWindow(), {"x": spec}, [], "ts")


def test_late_rows(spark):
    df = spark.createDataFrame(list(enumerate([205, 190, 196, 100, 210])), "seq int, ts long")
    kept = st.drop_late(df, "ts", ["seq"], 10)
    assert [r.ts for r in kept.orderBy("seq").collect()] == [205, 196, 210]
    assert sorted(r.ts for r in st.late_rows(df, "ts", ["seq"], 10).collect()) == [100, 190]
    assert st.drop_late(df.limit(0), "ts", ["seq"]).count() == 0


def test_interval_join(spark):
    left = spark.createDataFrame([("k", "a", 100), ("k", "b", 1000), (None, "c", 100)], "id string, x string, ts long")
    right = spark.createDataFrame([("k", "p", 401), ("k", "q", 399), ("k", "r", 0), (None, "s", 100)], "id string, y string, ts long")
    got = st.interval_join(left, right, "id", "id", "ts", "ts", 300)
    assert sorted((r.x, r.y) for r in got.collect()) == [("a", "q"), ("a", "r")]
    assert st.interval_join(left, right, "id", "id", "ts", "ts", 600).filter("x = 'b'").count() == 1


def test_first_by_id(spark):
    df = spark.createDataFrame([(1, "1", "a"), (2, "2", "b"), (3, "1", "c"), (4, "", "d"), (5, None, "e")], "seq int, id string, v string")
    assert sorted(r.v for r in st.first_by_id(df, "id", ["seq"]).collect()) == ["a", "b"]


def test_batches(spark):
    got = st.in_batches(spark.range(10), 3, ["id"]).groupBy("batch").count()
    assert sorted(tuple(r) for r in got.collect()) == [(0, 3), (1, 3), (2, 3), (3, 1)]
    now = [0.0]
    window = st.BatchWindow(3, 10, lambda: now[0])
    assert [window.add(i) for i in range(4)] == [None, None, [0, 1, 2], None]
    now[0] = 11
    assert window.add(4) == [3, 4] and window.flush() == [] and len(window) == 0
    assert window.trigger() == {"processingTime": "10 seconds"}


@pytest.fixture
def stream(spark, tmp_path):
    def make(name, *batches, schema):
        folder = tmp_path / name
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def test_a_stream_is_transformed_validated_and_written(spark, tmp_path, stream):
    source = stream("in", [(1, 50), (2, -1)], [(3, 150), (1, 50)], schema="id int, amount int")
    out, dead = [], []
    runner = st.StreamRunner(
        source,
        lambda df, n: out.extend(r.id for r in df.collect()),
        [lambda df: st.first_by_id(df, "id")],
        RuleSet([RangeRule("amount", 0)]).validate,
        lambda df, n: dead.extend((r.source, r.record) for r in df.collect()),
        name="payments",
    )
    metrics = runner.run(str(tmp_path / "check"))
    assert sorted(out) == [1, 3] and dead == [("payments", '{"id":2,"amount":-1}')]
    assert metrics.to_dict() == {"records_read": 3, "records_written": 2, "records_failed": 1, "batches_processed": metrics.batches}
    assert runner.run(str(tmp_path / "check")).read == 3


def test_windows_of_a_stream_close_by_watermark(spark, tmp_path, stream):
    at = [datetime(2024, 1, 1, 0, m) for m in (0, 1, 30, 31, 32)]
    source = stream("in", [(at[0], 1), (at[1], 2)], [(at[2], 3)], [(at[3], 4)], [(at[0], 100), (at[4], 5)], schema="ts timestamp_ntz, v int")
    out = []
    runner = st.StreamRunner(source, lambda df, n: out.extend(tuple(r) for r in df.collect()), [lambda df: st.windowed_aggregate(df, st.TimeWindow("tumbling", "5m"), {"s": "sum(v)"}, [], "ts", "1m")])
    runner.run(str(tmp_path / "check"))
    assert [(r[2], r[3]) for r in out] == [(3, 2)]


def test_streams_are_joined(spark, tmp_path, stream):
    a = stream("a", [("k", datetime(2024, 1, 1), 1)], schema="id string, at timestamp, x int")
    b = stream("b", [("k", datetime(2024, 1, 1, 0, 2), 2), ("k", datetime(2024, 1, 1, 1), 3)], schema="id string, at timestamp, y int")
    out = []
    st.StreamRunner(st.interval_join(a, b, "id", "id", "at", "at", "5m"), lambda df, n: out.extend((r.x, r.y) for r in df.collect())).run(str(tmp_path / "check"))
    assert out == [(1, 2)]


def test_routes(spark):
    from weirflow.streaming.runner import route

    got = {}
    df = spark.createDataFrame([(5,), (20000,)], "total int")
    route(df, {n: (c, lambda d, n=n: got.update({n: d.count()})) for n, c in (("all", "total != None"), ("alerts", "total > 10000"))})
    assert got == {"all": 2, "alerts": 1}


def test_a_consumer_hands_out_messages(spark, tmp_path, stream):
    messages = stream("in", [(b'{"id": 1}', 0), (b"bad", 1)], schema="value binary, offset long")
    good, bad = [], []
    consumer = st.KafkaConsumer(KafkaOptions(schema="id int"), lambda df: good.extend(r.id for r in df.collect()), lambda df: bad.append(df.count()), lambda df: bad.extend(r.original_message for r in df.collect()))
    consumer.start(spark, str(tmp_path / "check"), messages, availableNow=True).awaitTermination()
    assert good == [1] and bad == [1, "bad"]
    m = consumer.metrics.to_dict()
    assert (m["messages_consumed"], m["messages_failed"], m["dead_letter_count"], m["last_offset"]) == (1, 1, 1, 1)


def test_a_producer_sends_frames(spark):
    sent, told = [], []
    producer = st.KafkaProducer(KafkaSink(topic="t", key_field="id"), told.append, lambda df: sent.extend(tuple(r) for r in df.collect()) or df.count())
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    assert producer.send(df) == 1 and producer.send(df, "other", F.upper("v")) == 1
    assert sent == [("1", '{"id":1,"v":"a"}'), ("A", '{"id":1,"v":"a"}')] and told == [1, 1] and producer.metrics.sent == 2
    with pytest.raises(ValueError):
        st.KafkaProducer(KafkaSink()).send(df)


def test_registry():
    calls = []

    def call(method, path, body):
        calls.append((method, path))
        answers = {"/schemas/ids/7": {"schema": '{"type": "object"}', "schemaType": "JSON"}, "/subjects/a%2Fb/versions": {"id": 7} if method == "POST" else [1, 2], "/subjects": ["a/b"], "/subjects/a%2Fb/versions/latest": {"schema": "{}", "subject": "a/b", "version": 2, "id": 7}, "/compatibility/subjects/a%2Fb/versions/latest": {"is_compatible": True}, "/subjects/a%2Fb": [1, 2]}
        return answers[path]

    registry = st.SchemaRegistry(call=call)
    assert registry.register("a/b", {"type": "object"}) == 7 and registry.get(7).schema == {"type": "object"}
    registry.get(7)
    assert calls.count(("GET", "/schemas/ids/7")) == 1
    assert registry.latest("a/b").version == 2 and registry.versions("a/b") == [1, 2] and registry.subjects() == ["a/b"]
    assert registry.check("a/b", {}) and registry.delete("a/b") == [1, 2]


def test_compatibility():
    old = {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}}}
    wider = {"type": "object", "required": ["id"], "properties": {"id": {"type": "number"}, "note": {"type": "string"}}}
    stricter = {"type": "object", "required": ["id", "x"], "properties": {"id": {"type": "integer"}}}
    level = st.CompatibilityLevel
    assert st.compatible(wider, [old]) and not st.compatible(stricter, [old]) and st.compatible(stricter, [old], level.NONE)
    assert not st.compatible(wider, [old], level.FORWARD) and st.compatible(stricter, [old], level.FORWARD)
    assert not st.compatible(old, [wider, old], level.BACKWARD_TRANSITIVE) and st.compatible(old, [old], level.FULL)


def test_dead_letters_keep_the_latest(spark):
    letters = DeadLetters(3)
    for i in range(5):
        letters.add(spark.createDataFrame([(f'{{"id":{i}}}', "e", "s" if i % 2 else "t", datetime(2024, 1, 1, 0, i))], "record string, error string, source string, timestamp timestamp"))
    assert [r.record for r in letters.get().collect()] == ['{"id":4}', '{"id":3}', '{"id":2}']
    assert letters.size() == 3 and letters.get("s").count() == 1 and letters.flush().count() == 3 and letters.size() == 0
    with pytest.raises(ValueError):
        DeadLetters(0)


def test_dead_letters_that_were_added_first_go_first(spark):
    letters = DeadLetters(2)
    for name in ("z-first", "m-second", "a-third"):
        letters.add(spark.createDataFrame([(name, "e")], "name string, _errors string"), "s")
    assert [r.record for r in letters.get().collect()] == ['{"name":"a-third"}', '{"name":"m-second"}']


def test_dead_letters_without_a_bound_are_all_kept(spark):
    letters = DeadLetters(None)
    for first in (0, 6000):
        letters.add(spark.range(first, first + 6000).selectExpr("id", "'e' AS _errors"), "s")
    assert letters.size() == 12_000 and letters.get("s").count() == 12_000 and letters.flush().distinct().count() == 12_000 and letters.size() == 0
