"""Roll-ups and the sink of a stream: late, repeated and abandoned, over several batches."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from lorekeep.operators import rollups
from lorekeep.session import fresh_path
from lorekeep.streaming import ledger, rolling, sink

T0 = datetime(2024, 1, 1)
EVENT = "event_id string, session_id string, conversation_id string, turn_id string, user_id string, interaction_type string, event_type string, timestamp timestamp, data map<string,string>, metadata map<string,string>"


def event(n, kind, second, session="s", turn="t", data=None, form="user_interaction"):
    return (f"e{n}", session, f"c{session}", turn, "u", kind, form, T0 + timedelta(seconds=second), data or {}, {})


def rolled(spark, batches, level="session", idle=60, run="run"):
    """The table and the number of open keys after each batch."""
    table = rolling.Rolling(spark, level, fresh_path(spark, "rolled"), idle)
    out = []
    for n, rows in enumerate(batches):
        table.fold(spark.createDataFrame(rows, EVENT), run, n)
        out.append(({r[0]: r for r in table.table().collect()}, table.open_keys()))
    return table, out


def test_late_session_and_time_out(spark):
    first = [event(1, "session_start", 1000), event(2, "query", 1005), event(3, "session_start", 900, "idle"), event(4, "click", 910, "idle")]
    late = [event(5, "session_start", 10, "late"), event(6, "click", 20, "late")]
    table, out = rolled(spark, [first, late, [event(7, "session_end", 25, "late"), event(8, "session_end", 1010)]])
    (one, n1), (two, n2), (three, n3) = out
    assert one["idle"].timed_out and one["idle"].end_time == T0 + timedelta(seconds=910) and not one["s"].timed_out
    # A session that arrives after its time is there at once, and corrected by its end.
    assert two["late"].timed_out and two["late"].interaction_count == 1
    assert not three["late"].timed_out and three["late"].duration_seconds == 15.0
    assert (n1, n2, n3) == (1, 1, 0) and not any(r.is_active for r in three.values())


def test_batches_in_any_order_give_the_batch_roll_up(spark):
    rng = np.random.default_rng(4)
    kinds = ["session_start", "turn_start", "query", "response", "click", "hover", "turn_end", "session_end"]
    rows = []
    for n in range(300):
        kind, at = kinds[rng.integers(len(kinds))], int(rng.integers(5000))
        data = {"query": f"q{n}"} if kind == "query" else {"response": f"r{n}", "response_time": "1.5"} if kind == "response" else None
        rows.append(event(n, kind, at, f"s{rng.integers(12)}", f"t{rng.integers(40)}", data, "system_event" if kind == "response" else "user_interaction"))
    whole = spark.createDataFrame(rows, EVENT)
    made = {"session": rollups.session_rollup, "conversation": rollups.conversation_rollup, "turn": rollups.turn_rollup}
    for level, function in made.items():
        want = function(whole)
        rng.shuffle(rows)
        table, _ = rolled(spark, [rows[k::4] for k in range(4)], level, None)
        got = table.table()
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert table.open_keys() == want.filter("end_time is null").count()


def test_replay_compaction_and_another_run(spark, monkeypatch):
    monkeypatch.setattr(rolling, "COMPACT_EVERY", 2)
    batches = [[event(10 * k, "session_start", k, f"s{k}"), event(10 * k + 1, "session_end", k + 5, f"s{k}")] for k in range(5)]
    table, out = rolled(spark, batches)
    assert len(out[-1][0]) == 5 and out[-1][1] == 0
    assert len(table._versions("closed")) <= 3 and len(table._versions("open")) <= 2
    before = sorted(map(str, table.table().collect()))
    table.fold(spark.createDataFrame(batches[-1], EVENT), "run", 4)
    assert sorted(map(str, table.table().collect())) == before
    # A batch that failed before it was committed is written anew.
    table.fold(spark.createDataFrame([event(99, "click", 7, "s0")], EVENT), "run", 5)
    table._drop("progress", [table._versions("progress")[-1]])
    table.fold(spark.createDataFrame([event(99, "click", 7, "s0")], EVENT), "run", 5)
    # A new checkpoint counts batches from nought.
    table.fold(spark.createDataFrame([event(98, "click", 8, "s0")], EVENT), "other", 0)
    assert {r.session_id: r.interaction_count for r in table.table().collect()}["s0"] == 2
    table.fold(spark.createDataFrame([], EVENT), "other", 1)
    assert table.table().count() == 5


def test_nothing_yet(spark):
    assert rolling.Rolling(spark, "turn", fresh_path(spark, "none")).table().count() == 0


def batch(spark, ids, day):
    rows = [(i, "s", "c", "t", None, "click", "user_interaction", T0, {}, {}, T0 + timedelta(days=day)) for i in ids]
    df = spark.createDataFrame(rows, EVENT + ", created_at timestamp")
    return df.withColumn(sink.DAY, F.to_date("created_at"))


def stored(spark, target):
    return sorted(r.event_id for r in spark.read.parquet(target).collect())


def test_sent_again_on_another_day(spark):
    target = fresh_path(spark, "sink")
    for day in (1, 1, 2, 40):
        sink.append_new(batch(spark, ["a", "b", "b"], day), target)
    sink.append_new(batch(spark, ["b", "c"], 3), target)
    assert stored(spark, target) == ["a", "b", "c"]


def test_batch_that_was_not_ended(spark, monkeypatch):
    """Events are written, their ids are not: the next try, on another day, adds no copy."""
    target = fresh_path(spark, "sink")
    sink.append_new(batch(spark, ["a"], 1), target)
    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "add", lambda *_: 1 / 0)
        try:
            sink.append_new(batch(spark, ["b", "c"], 1), target)
        except ZeroDivisionError:
            pass
    sink.append_new(batch(spark, ["a", "b", "c", "d"], 2), target)
    assert stored(spark, target) == ["a", "b", "c", "d"]


def test_table_without_a_ledger(spark):
    target = fresh_path(spark, "sink")
    batch(spark, ["a", "b"], 1).write.partitionBy(sink.DAY).parquet(target)
    sink.append_new(batch(spark, ["b", "c"], 5), target)
    assert stored(spark, target) == ["a", "b", "c"]


def test_filters():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, size=(2, 4000))
    found = ledger.bloom(h[0, :1000], h[1, :1000])
    maybe = ledger.may_hold(found, h[0], h[1])
    assert maybe[:1000].all() and maybe[1000:].mean() < 0.002 and len(found) <= 8192
