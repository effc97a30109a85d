"""Streams: equal to the batch roll-ups, safe to replay, closed when idle."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import embedding, events, rollups
from lorekeep.plans import inputs
from lorekeep.session import fresh_path, settings
from lorekeep.sources.schemas import SCHEMAS
from lorekeep.streaming import index, lifecycle, sink

T0 = datetime(2024, 1, 1)
EVENT = "event_id string, session_id string, conversation_id string, turn_id string, user_id string, interaction_type string, event_type string, timestamp timestamp, data map<string,string>, metadata map<string,string>"


def event(n, kind, second, session="s", conversation=None, turn=None, data=None, form="user_interaction"):
    return (f"e{n}", session, conversation, turn, "u", kind, form, T0 + timedelta(seconds=second), data or {}, {})


def add(spark, folder, rows):
    """One more file of events."""
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, level, target, checkpoint, **kw):
    stream = lifecycle.lifecycle_stream(sink.read_events(spark, folder, spark.createDataFrame([], EVENT).schema), level, **kw)
    lifecycle.start_lifecycle(stream, target, checkpoint, drain=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def test_session_over_several_batches(spark):
    folder, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "cp"))
    add(spark, folder, [event(1, "session_start", 0), event(2, "query", 1), event(3, "hover", 2), event(9, "session_end", 3, "unknown")])
    assert run(spark, folder, "session", target, checkpoint).count() == 0
    add(spark, folder, [event(4, "click", 5), event(5, "response", 6)])
    assert run(spark, folder, "session", target, checkpoint).count() == 0
    add(spark, folder, [event(6, "session_end", 10)])
    row = run(spark, folder, "session", target, checkpoint).collect()
    assert [(r["session_id"], r["interaction_count"], r["duration_seconds"]) for r in row] == [("s", 2, 10.0)]
    assert row[0]["last_activity"] == T0 + timedelta(seconds=5)
    # A second end gives nothing, and neither does starting again from the checkpoint.
    add(spark, folder, [event(7, "session_end", 12)])
    assert run(spark, folder, "session", target, checkpoint).count() == 1
    assert run(spark, folder, "session", target, checkpoint).count() == 1


def test_idle_sessions_are_closed(spark):
    folder, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "cp"))
    kw = {"idle_seconds": 60, "delay": "0 seconds"}
    add(spark, folder, [event(1, "session_start", 0), event(2, "query", 7)])
    run(spark, folder, "session", target, checkpoint, **kw)
    add(spark, folder, [event(3, "session_start", 500, "later")])
    run(spark, folder, "session", target, checkpoint, **kw)
    add(spark, folder, [event(4, "query", 510, "later")])
    rows = run(spark, folder, "session", target, checkpoint, **kw).collect()
    assert [(r["session_id"], r["timed_out"], r["duration_seconds"]) for r in rows] == [("s", True, 7.0)]


@pytest.mark.parametrize("level", ["session", "conversation", "turn"])
def test_stream_equals_batch(spark, small, level):
    """All events in time order, over several micro-batches."""
    rows = inputs.lifecycle_events(spark, small).cache()
    folder, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "cp"))
    half = F.to_timestamp(F.lit("2024-01-16 00:00:00"))
    for part in (rows.filter(F.col("timestamp") < half), rows.filter(F.col("timestamp") >= half)):
        part.coalesce(1).write.mode("append").parquet(folder)
        got = run(spark, folder, level, target, checkpoint)
    batch = {"session": rollups.session_rollup, "conversation": rollups.conversation_rollup, "turn": rollups.turn_rollup}[level](rows)
    closed = batch.filter("end_time is not null")
    columns = [c for c in closed.columns if c in got.columns]
    a = sorted(map(tuple, got.select(columns).collect()), key=str)
    b = sorted(map(tuple, closed.select(columns).collect()), key=str)
    assert a == b and a
    rows.unpersist()


def test_sink_drops_copies_and_replays_nothing(spark):
    folder, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "cp"))
    schema = spark.createDataFrame([], EVENT).schema

    def drain():
        stream = sink.read_events(spark, folder, schema, max_files=1)
        filled = stream.withColumns({c: F.coalesce(c, F.lit("none")) for c in ("conversation_id", "turn_id")})
        sink.start_sink(filled, target, checkpoint, drain=True).awaitTermination()
        return spark.read.schema(SCHEMAS["user_interactions"]).parquet(target)

    add(spark, folder, [event(n, "click", n) for n in range(5)])
    add(spark, folder, [event(n, "click", n) for n in range(3, 8)])
    assert drain().count() == 8
    assert drain().count() == 8
    assert drain().select("event_id").distinct().count() == 8


def test_sink_keeps_late_events(spark):
    """Days of delay, copies of late events, more than one batch."""
    folder, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "cp"))
    schema = spark.createDataFrame([], EVENT).schema
    late = [event(n, "click", 60 * n) for n in (1, 2)]
    for rows in ([event(0, "click", 0), event(10, "click", 7200)], [event(11, "click", 3 * 86400)], late, [*late, event(12, "click", 5)]):
        add(spark, folder, rows)
    stream = sink.read_events(spark, folder, schema, max_files=1)
    filled = stream.withColumns({c: F.coalesce(c, F.lit("none")) for c in ("conversation_id", "turn_id")})
    sink.start_sink(filled.withColumn("created_at", F.col("timestamp")), target, checkpoint, drain=True).awaitTermination()
    ids = [r[0] for r in spark.read.parquet(target).select("event_id").collect()]
    assert sorted(ids) == sorted(["e0", "e1", "e10", "e11", "e12", "e2"])


def test_sink_sets_broken_rows_aside(spark):
    folder, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "cp"))
    whole = event(1, "click", 0, conversation="c", turn="t")
    add(spark, folder, [whole, (None, *whole[1:]), ("e2", *whole[1:7], None, *whole[8:])])
    stream = sink.read_events(spark, folder, spark.createDataFrame([], EVENT).schema)
    sink.start_sink(stream, target, checkpoint, drain=True).awaitTermination()
    assert [r.event_id for r in spark.read.parquet(target).collect()] == ["e1"]
    assert spark.read.parquet(f"{target}_rejected").count() == 2


def test_index_follows_its_stream(spark):
    folder, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "cp"))
    schema = "id long, text string, changed_at int"
    embed = lambda rows: rows.select("id", F.array(F.length("text").cast("float")).alias("embedding"))

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        index.start_index_sync(stream, target, checkpoint, embed).awaitTermination()
        return {r["id"]: r["embedding"] for r in index.current_index(spark.read.parquet(target)).collect()}

    assert step([(1, "a", 0), (2, "bb", 0), (2, "bbb", 1)]) == {1: [1.0], 2: [3.0]}
    assert step([(1, "aaaa", 2), (2, None, 3), (3, "c", 3)]) == {1: [4.0], 3: [1.0]}


def test_index_keeps_the_latest_change(spark):
    """An old change that comes late, and a new checkpoint on the same target."""
    folder, target = fresh_path(spark, "in"), fresh_path(spark, "out")
    schema = "id long, text string, changed_at int"
    embed = lambda rows: rows.select("id", F.array(F.length("text").cast("float")).alias("embedding"))

    def step(rows, folder, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        index.start_index_sync(stream, target, checkpoint, embed).awaitTermination()
        return {r["id"]: r["embedding"] for r in index.current_index(spark.read.parquet(target)).collect()}

    checkpoint = fresh_path(spark, "cp")
    assert step([(1, "aaa", 5), (2, "b", 0), (3, None, 5)], folder, checkpoint) == {1: [3.0], 2: [1.0]}
    assert step([(1, "a", 1), (3, "old", 1)], folder, checkpoint) == {1: [3.0], 2: [1.0]}
    assert step([(4, "dd", 0)], fresh_path(spark, "in"), fresh_path(spark, "cp")) == {1: [3.0], 2: [1.0], 4: [2.0]}


def test_rollup_rules(spark):
    rows = [
        event(1, "session_start", 0, "s", "c", "t"),
        event(2, "query", 1, "s", "c", "t", {"query": "q1"}),
        event(3, "response", 4, "s", "c", "t", {"response": "r1", "response_time": "2.3"}, "system_event"),
        event(4, "response", 5, "s", "c", "t", {"metric_name": "response_time", "metric_value": "2.3"}, "performance_metric"),
        event(5, "copy", 6, "s", "c", "t"),
        event(6, "hover", 7, "s", "c", "t"),
        event(7, "turn_end", 8, None, None, "t"),
        event(8, "session_end", 9),
        event(9, "query", 3, "open"),
    ]
    df = spark.createDataFrame(rows, EVENT)
    sessions = {r["session_id"]: r for r in rollups.session_rollup(df).collect()}
    assert (sessions["s"]["interaction_count"], sessions["s"]["duration_seconds"], sessions["s"]["is_active"]) == (2, 9.0, False)
    assert sessions["s"]["last_activity"] == T0 + timedelta(seconds=6)
    assert sessions["open"]["is_active"] and sessions["open"]["start_time"] == T0 + timedelta(seconds=3)
    turn = rollups.turn_rollup(df).first()
    assert (turn["query"], turn["response"], turn["response_time_seconds"], turn["is_complete"]) == ("q1", "r1", 2.3, True)
    conversation = rollups.conversation_rollup(df).first()
    # Ending a session ends neither its conversations nor its turns.
    assert conversation["is_active"] and conversation["turn_count"] == 0


def test_hot_session_is_combined_before_the_shuffle(spark):
    rows = spark.range(1000).select(
        F.lit("s").alias("session_id"), F.lit("u").alias("user_id"), F.lit("click").alias("interaction_type"),
        F.lit("user_interaction").alias("event_type"), F.timestamp_seconds("id").alias("timestamp"),
    )
    plan = rollups.session_rollup(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_min" in plan


def test_event_kinds(spark):
    base = spark.createDataFrame([("s", "c", "t", None, T0)], "session_id string, conversation_id string, turn_id string, user_id string, timestamp timestamp")
    given = {
        "query": {"query": "What is it?"}, "response": {"response": "It is.", "response_time": "2.3"},
        "click": {"element": "copy_button", "x": "100", "y": "200"}, "hover": {"element": "e", "duration": "1.5"},
        "scroll": {"scroll_depth": "0.75", "scroll_direction": "down"}, "copy": {"copied_text": "abc", "source_element": "r"},
        "dwell": {"element": "e", "dwell_time": "5.2"}, "abandonment": {"abandonment_type": "x"},
        "follow_up": {"follow_up_type": "x"}, "performance": {"metric_name": "response_time", "metric_value": "2.3"},
    }
    assert set(given) == set(events.KINDS)
    made = {}
    for kind, columns in given.items():
        df = base.withColumns({k: F.lit(v) for k, v in columns.items()})
        made[kind] = events.make_events(df, kind).first()
    assert made["query"]["data"] == {"query": "What is it?", "query_length": "11", "word_count": "3"}
    assert made["click"]["data"] == {"element": "copy_button", "position": '{"x":"100","y":"200"}', "click_type": "left_click"}
    assert made["copy"]["data"]["copied_length"] == "3"
    assert (made["dwell"]["interaction_type"], made["dwell"]["data"]["dwell_time"]) == ("hover", "5.2")
    assert (made["performance"]["interaction_type"], made["performance"]["event_type"]) == ("response", "performance_metric")
    assert made["response"]["event_type"] == "system_event"
    flat = events.flatten(events.make_events(base.withColumn("query", F.lit("q")), "query")).first()
    assert flat["timestamp"] == T0.isoformat() + "+00:00"


def test_answers_fan_out(spark):
    base = spark.createDataFrame([("s", "c", "t", "u", T0, "q", "r", 2.5)], "session_id string, conversation_id string, turn_id string, user_id string, timestamp timestamp, query string, response string, response_time double")
    rows = events.answer_events(base).collect()
    assert [(r["interaction_type"], r["event_type"]) for r in rows] == [
        ("query", "user_interaction"), ("response", "system_event"), ("response", "performance_metric"),
    ]
    assert rows[2]["data"] == {"metric_name": "response_time", "metric_value": "2.5"}
    assert len({r["event_id"] for r in rows}) == 3


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with settings(spark, {"spark.sql.shuffle.partitions": "3", "lorekeep.test": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("lorekeep.test", None) is None


def test_embedder_is_reachable_from_streams():
    assert callable(embedding.embed)


def test_a_hot_session_reaches_its_state_as_few_rows(spark):
    """Thousands of steps of one key combine before the shuffle, others stay."""
    rows = [event(n, "click", n, "hot") for n in range(3000)] + [event(9000 + n, "query", n, f"s{n}") for n in range(20)]
    df = spark.createDataFrame(rows, EVENT).coalesce(1)
    steps = lifecycle._steps(df, "session")
    combined = steps.mapInArrow(lifecycle._combine, steps.schema)
    assert combined.count() < 30
    assert combined.agg(F.sum("n")).first()[0] == 3020
    plan = lifecycle._steps(df, "turn")
    assert plan.columns == steps.columns


def test_first_answer_wins_also_without_a_time(spark):
    rows = [
        event(1, "turn_start", 0, "s", "c", "t"),
        event(2, "response", 3, "s", "c", "t", {"response": "late", "response_time": "9.0"}, "system_event"),
        event(3, "response", 2, "s", "c", "t", {"response": "first"}, "system_event"),
        event(4, "query", 1, "s", "c", "t", {"query": "b"}),
        event(5, "query", 1, "s", "c", "t", {"query": "a"}),
        event(6, "turn_end", 5, "s", "c", "t"),
    ]
    folder, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "cp"))
    add(spark, folder, rows)
    got = run(spark, folder, "turn", target, checkpoint).first()
    want = rollups.turn_rollup(spark.createDataFrame(rows, EVENT)).first()
    for r in (got, want):
        assert (r["query"], r["response"], r["response_time_seconds"]) == ("a", "first", None)


def test_stream_files_follow_the_rows(spark, monkeypatch):
    """Each part is one micro-batch, in as many files as its rows need and two at least."""
    from lorekeep.plans import registry
    from lorekeep.session import fresh_path

    monkeypatch.setattr(registry, "FILE_ROWS", 100)
    parts, source, seen = [spark.range(600), spark.range(600, 1200)], fresh_path(spark, "events"), []
    stream = registry._send(parts, source, 600)
    assert len(spark.read.parquet(source).inputFiles()) == 12
    writer = stream.writeStream.foreachBatch(lambda rows, batch: seen.append({r.id // 600 for r in rows.collect()}))
    writer.option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [{0}, {1}]
    few = fresh_path(spark, "events")
    registry._send([spark.range(9)], few, 9)
    assert len(spark.read.parquet(few).inputFiles()) == 2


def test_a_call_folds_a_bucket_of_keys(spark, monkeypatch):
    """Spark calls the processor for a bucket and not for a key, in every batch, and keys that
    share a bucket keep their own state, time-out and end."""
    monkeypatch.setattr(lifecycle, "BUCKETS", 1)
    folder, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "cp"))
    kw = {"idle_seconds": 60, "delay": "0 seconds"}
    names = [f"s{n}" for n in range(40)]
    calls = spark.sparkContext.accumulator(0)
    fold = lifecycle.Lifecycle.handleInputRows

    def counted(self, key, rows, timers):
        calls.add(1)
        return fold(self, key, rows, timers)

    monkeypatch.setattr(lifecycle.Lifecycle, "handleInputRows", counted)
    add(spark, folder, [event(n, "session_start", 0, s) for n, s in enumerate(names)])
    assert run(spark, folder, "session", target, checkpoint, **kw).count() == 0
    # One ends, one goes on, an unknown one ends, all others time out once time has passed.
    add(spark, folder, [event(50, "session_end", 9, "s0"), event(51, "click", 55, "s1"), event(52, "session_end", 9, "none")])
    add(spark, folder, [event(53, "session_start", 100, "later")])
    run(spark, folder, "session", target, checkpoint, **kw)
    add(spark, folder, [event(54, "click", 101, "later")])
    rows = run(spark, folder, "session", target, checkpoint, **kw).collect()
    got = {r["session_id"]: (r["timed_out"], r["duration_seconds"], r["interaction_count"]) for r in rows}
    assert got == {"s0": (False, 9.0, 0)} | {s: (True, 0.0, 0) for s in names[2:]}
    add(spark, folder, [event(55, "click", 200, "later")])
    rows = run(spark, folder, "session", target, checkpoint, **kw).collect()
    assert [(r["timed_out"], r["duration_seconds"], r["interaction_count"]) for r in rows if r["session_id"] == "s1"] == [(True, 55.0, 1)]
    assert len(rows) == 40 and calls.value <= 6
