"""Streams over several triggers: append output, late rows, batch deadlines, budgets."""

import pytest
from pyspark.sql import functions as F

from tierscore.operators import requests as R
from tierscore.plans import fixtures as fx
from tierscore.streaming import streams as ST
from tierscore.streaming.policies import Notes, PolicyStore, stream_score


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    ST.use_rocksdb(spark)


def feed(spark, tmp_path, batches, schema):
    """A file stream that takes one file per trigger, in order."""
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.parquet(str(tmp_path / f"b{i}"))
        src.mkdir(exist_ok=True)
        part = next((tmp_path / f"b{i}").glob("*.parquet"))
        target = src / f"{i:03d}.parquet"
        part.rename(target)
        import os

        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def test_append_windows_equal_batch(spark, sf_dir):
    events = spark.readStream.schema(fx.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = ST.run_to_table(ST.stream_decision_counts(fx.shape_requests(events), "1 day", "1 hour"), "append", "days")
    log = fx.request_log(spark, sf_dir)
    want = log.groupBy(F.unix_millis(F.window("t_sched", "1 day")["start"]).alias("t_ms")).count()
    both = out.join(want, "t_ms")
    assert both.where("rows <> count").count() == 0
    assert 0 < out.count() >= want.count() - 2


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    at = lambda h: h * 3_600_000_000
    sdf = feed(spark, tmp_path, [[(1, at(10))], [(2, at(20))], [(3, at(5))], [(4, at(40))]], "decision int, us bigint")
    sdf = sdf.select("decision", F.timestamp_micros("us").alias("t_sched"), F.lit(False).alias("used_l2"))
    counts = ST.stream_decision_counts(sdf, "1 hour", "1 hour")
    query = counts.writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert spark.table("late").where("t_ms = 18000000").count() == 0
    assert ST.late_rows(query) >= 1


REPLY = "batch_id bigint, us bigint, rows bigint, ok_rows bigint, status_code int, timeout boolean, used_l2 boolean, decision int, expected bigint, issued bigint"
S = 1_000_000


def reply(batch, at, rows=2, ok=2, code=200, timeout=False, l2=False, decision=0, expected=2, issued=None):
    return (batch, at * S, rows, ok, code, timeout, l2, decision, expected, (at if issued is None else issued) * S)


def closed(spark, tmp_path, triggers, deadline=60):
    sdf = feed(spark, tmp_path, triggers, REPLY)
    times = [F.timestamp_micros("us").alias("done_at"), F.col("issued").alias("issued_us"), (F.col("us") + 5).alias("done_us")]
    out = ST.run_to_table(ST.stream_batch_completion(sdf.select("*", *times), "10 seconds", deadline * 1000), "append", "closed")
    return out.orderBy("batch_id", "closed_at").collect()


def tick(at):
    """A batch of its own, which moves the watermark on."""
    return [reply(1_000_000 + at, at, expected=1)]


def test_batches_close_when_complete_or_late(spark, tmp_path):
    first = [reply(1, 1, l2=True, decision=1), reply(2, 1, ok=1, expected=3), reply(3, 2, rows=4, ok=0, code=0, timeout=True, l2=True, expected=1)]
    second = [reply(1, 3, ok=0, code=503, decision=9)]
    got = {r.batch_id: r for r in closed(spark, tmp_path, [first, second, tick(900), tick(2000)])}
    one, two, three = got[1], got[2], got[3]
    assert (one.closed, one.ok, one.err, one.http_5xx, one.used_l2, one.latency_us) == ("complete", 2, 2, 2, 2, 2 * S + 5)
    assert (one.bucket_0, one.bucket_1, one.bucket_4) == (0, 2, 2)
    assert (three.closed, three.timeout, three.ok, three.used_l2, three.bucket_4) == ("complete", 4, 0, 0, 4)
    assert (two.closed, two.ok, two.lost, two.replies, two.closed_at.timestamp()) == ("deadline", 1, 1, 1, 61)


def test_reply_after_closing_is_not_emitted_again(spark, tmp_path):
    triggers = [[reply(1, 100), reply(1, 101)], [reply(2, 102)], [reply(1, 103)], tick(200), [reply(2, 195)], tick(1000)]
    got = [(r.batch_id, r.closed, r.replies) for r in closed(spark, tmp_path, triggers) if r.batch_id < 1000]
    assert got == [(1, "complete", 2), (2, "deadline", 1)]


def test_marker_is_freed_after_the_linger_time(spark, tmp_path):
    triggers = [[reply(1, 100, expected=1)], tick(400), tick(800), [reply(1, 795, expected=1)], tick(2000)]
    got = [r.closed for r in closed(spark, tmp_path, triggers) if r.batch_id == 1]
    assert got == ["complete", "complete"]


def test_earlier_issue_time_moves_the_deadline(spark, tmp_path):
    # Issued at 100, as the first reply says, the deadline is 160; the second tells of an issue at 70.
    triggers = [[reply(1, 110, issued=100, expected=9)], [reply(1, 112, issued=70, expected=9)], tick(145), tick(146), tick(500)]
    (got,) = [r for r in closed(spark, tmp_path, triggers) if r.batch_id == 1]
    assert (got.closed, got.closed_at.timestamp(), got.replies) == ("deadline", 130, 2)


EVENT = "event_id bigint, ts timestamp_ntz, event_type string, user_id bigint, value double"


def events(spark, tmp_path, sf_dir, parts):
    """The events table in ``parts`` files by time, one per trigger, and a heartbeat at the end."""
    rows = fx.table(spark, sf_dir, "events").orderBy("ts").select("event_id", "ts", "event_type", "user_id", "value").collect()
    size = -(-len(rows) // parts)
    last = max(r["ts"] for r in rows)
    import datetime

    beat = [(None, last + datetime.timedelta(days=30), None, None, None)]
    chunks = [[tuple(r) for r in rows[k : k + size]] for k in range(0, len(rows), size)]
    return fx.shape_requests(feed(spark, tmp_path, [*chunks, beat], EVENT))


def test_windows_of_many_triggers_equal_batch(spark, sf_dir, tmp_path):
    out = ST.run_to_table(ST.stream_windows(events(spark, tmp_path, sf_dir, 4), None, "6 hours", "1 hour", 1), "append", "windows")
    log = fx.request_log(spark, sf_dir)
    none = spark.createDataFrame([], "closed_at timestamp, latency_us bigint")
    want = R.window_metrics(log, none, "6 hours")
    assert sorted(map(tuple, out.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_late_requests_leave_emitted_windows_alone(spark, tmp_path):
    import datetime

    at = lambda h: datetime.datetime(2024, 1, 1, h)
    row = lambda i, h: (i, at(h), "view", 1, 1.0)
    sdf = feed(spark, tmp_path, [[row(1, 1)], [row(2, 10)], [row(6, 12)], [row(3, 1)], [row(4, 20)], [row(5, 23)]], EVENT)
    out = ST.run_to_table(ST.stream_windows(fx.shape_requests(sdf), None, "1 hour", "1 hour", 1), "append", "windows")
    hours = {r["t_ms"] // 3_600_000 % 24: r["attempted"] for r in out.collect()}
    assert hours == {1: 1, 10: 1, 12: 1, 20: 1}


def test_totals_of_many_triggers(spark, sf_dir, tmp_path):
    sdf = ST.stream_totals(events(spark, tmp_path, sf_dir, 3))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ST.updates(sdf, out, state).awaitTermination()
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert folders == [f"batch={i}" for i in range(4)]
    counters = ST.newest(spark, out, ST.COUNTER_KEYS, sdf.schema)
    # Only what changed is written: less than all counters in every trigger.
    assert spark.read.parquet(out).where("batch = 2").count() < counters.count()
    want = R.measures(fx.request_log(spark, sf_dir)).groupBy("metric", "bin").count()
    assert sorted(map(tuple, counters.collect())) == sorted(map(tuple, want.collect()))
    row = ST.totals_row(counters).first()
    assert row["attempted"] == fx.request_log(spark, sf_dir).where("not dropped").count()


def test_policy_version_changes_between_triggers(spark, tmp_path):
    source = tmp_path / "in"

    def arrive(k):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(source))

    def decide(rows, global_tau, segment_tau):
        return rows.join(F.broadcast(global_tau.select("tau")), how="cross").select("id", "tau")

    tau = lambda v: spark.createDataFrame([(1, v)], "fold_id int, tau double")
    none = spark.createDataFrame([], "fold_id int, seg_key string, tau double")
    store = PolicyStore(spark, str(tmp_path / "policies"))
    run = lambda: stream_score(
        spark.readStream.schema("id bigint").parquet(str(source)), decide, store, str(tmp_path / "out"), str(tmp_path / "state")
    ).awaitTermination()
    store.publish(1, tau(0.25), none)
    arrive(0)
    run()
    # Tables without a mark are no version yet.
    tau(9.0).write.parquet(f"{store.path}/version=3/global_tau")
    store.publish(2, tau(0.5), none)
    arrive(1)
    run()
    got = {r["id"]: (r["policy_version"], r["tau"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: (1, 0.25) if i < 10 else (2, 0.5) for i in range(20)}
    # A trigger that is run again keeps its version.
    notes = Notes(spark, str(tmp_path / "state" / "policy-notes"))
    assert (notes.version_for(0, store), notes.version_for(1, store), notes.version_for(2, store)) == (1, 2, 2)


def test_budget_across_triggers(spark, tmp_path):
    one = [(i, 100_000_000 + i) for i in range(40)]
    two = [(i, 100_000_000 + i) for i in range(40, 80)] + [(100, 101_000_000)]
    sdf = feed(spark, tmp_path, [one, two], "event_id bigint, us bigint")
    sdf = sdf.select("event_id", F.timestamp_micros("us").alias("t_sched"))
    out = ST.run_to_table(ST.stream_rate_budget(sdf, 45, "1 hour"), "append", "budget")
    ids = sorted(r.event_id for r in out.collect())
    assert ids[:40] == list(range(40)) and ids[-1] == 100 and len(ids) == 46


def test_scratch_follows_the_session():
    from tierscore.session import shared_dir

    class Session:
        conf = {"spark.checkpoint.dir": "/shared/folder/"}

    assert shared_dir(Session()) == "/shared/folder"
