"""Registered queries of the request-log analytics and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierscore.operators import requests as R
from tierscore.operators.cascade import cascade
from tierscore.plans import fixtures as fx
from tierscore.plans import sql as q
from tierscore.plans.registry import query
from tierscore.plans.scoring import CASCADE
from tierscore.plans.stats_queries import BUCKETS
from tierscore.session import scratch_path
from tierscore.streaming import streams as ST
from tierscore.streaming.policies import PolicyStore, score_available

LOG = q.REQUESTS
OUTCOME_COLS = "ok:l, err:l, timeout:l, http_2xx:l, http_429:l, http_5xx:l"
WARMUP = "2024-01-02 00:00:00"


def quantile_sql(rows: str, keys: str, qs=(0.5, 0.95, 0.99)) -> str:
    """First value whose cumulative count reaches q n, from ``rows(keys, us)``."""
    cols = ", ".join(f"max(CASE WHEN i = greatest(ceil(n * {p}) - 1, 0) THEN us END) AS p{round(p * 100)}" for p in qs)
    return f"""SELECT {keys}, {cols} FROM (SELECT {keys}, us, row_number() OVER (PARTITION BY {keys} ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {rows}) GROUP BY {keys}"""


def with_over_range(source: str, keys: str) -> str:
    """Counts of the latencies beyond the recorded range, next to the quantiles ``qt``."""
    over = " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, CAST({m} AS BIGINT) > {R.LATENCY_CEILING_US} AS over FROM {source}" for m in R.LATENCIES
    )
    return f"SELECT qt.*, o.over_range FROM qt JOIN (SELECT {keys}, metric, count_if(over) AS over_range FROM ({over}) GROUP BY ALL) o USING ({keys}, metric)"


def metric_sql(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {q.recorded(m)} AS us FROM {source}" for m in R.LATENCIES)


STAGE_EXPR = {"parse": "s0", "feature": "s0 % 50", "router": "s0 % 30", "l1": "s0 % 400", "l2": "s0 % 900", "serialize": "s0 % 20"}


def stage_sql(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {q.recorded('(' + e + ')')} AS us FROM {source} WHERE s0 > 0" for m, e in STAGE_EXPR.items())


@query("recorded_only", "event_id:l", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{WARMUP}'")
def recorded_only(spark, d):
    return R.recorded_only(fx.request_log(spark, d), F.lit(WARMUP).cast("timestamp")).select("event_id")


@query("outcome_counts", f"event_type:s, {OUTCOME_COLS}, used_l2:l, bucket_0:l, bucket_1:l, bucket_2:l, bucket_3:l, bucket_4:l",
       q.with_(LOG) + f"SELECT event_type, {q.OUTCOMES}, sum(CASE WHEN used_l2 THEN 1 ELSE 0 END) AS used_l2, {q.buckets('decision')} FROM log WHERE NOT dropped GROUP BY event_type")
def outcome_counts(spark, d):
    return R.outcome_counts(fx.request_log(spark, d).where(~F.col("dropped")), ["event_type"])


SLOW = "(SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN e2e_us + 60000000 ELSE e2e_us END AS e2e_us) FROM log)"


@query("latency_quantiles", "event_type:s, metric:s, p50:l, p95:l, p99:l, over_range:l",
       q.with_(LOG, f"slow AS {SLOW}", f"m AS ({metric_sql('slow', 'event_type')})",
               "qt AS (" + quantile_sql("(SELECT * FROM m WHERE us IS NOT NULL)", "event_type, metric") + ")") + with_over_range("slow", "event_type"))
def latency_quantiles(spark, d):
    """One request in 13 takes longer than the recorded range."""
    slow = F.when(F.col("event_id") % 13 == 0, F.col("e2e_us") + R.LATENCY_CEILING_US).otherwise(F.col("e2e_us"))
    log = fx.request_log(spark, d).withColumn("e2e_us", slow)
    return R.latency_quantiles(R.metric_rows(log, ["event_type"]), ["event_type"])


@query("stage_quantiles", "metric:s, p50:l, p95:l, p99:l", q.with_(LOG, f"m AS ({stage_sql('log', '1 AS one')})") + "SELECT metric, p50, p95, p99 FROM (" + quantile_sql("m", "metric") + ")")
def stage_quantiles(spark, d):
    return R.latency_quantiles(R.stage_rows(fx.request_log(spark, d), []))


@query(
    "counter_totals", "event_type:s, name:s, total:l",
    q.with_(LOG) + " UNION ALL ".join(f"SELECT event_type, '{c}' AS name, sum(CAST({c} AS BIGINT)) AS total FROM log GROUP BY event_type" for c in ("used_l2", "timeout", "dropped", "e2e_us")),
)
def counter_totals(spark, d):
    return R.counter_totals(fx.request_log(spark, d), ["used_l2", "timeout", "dropped", "e2e_us"], ["event_type"])


SUMMARY_COLS = (
    "event_type:s, attempted:l, drop_conn_queue_full:l, dropped_after_attempt:l, drop_inflight_cap:l, ok:l, timeout:l, http_429:l, http_5xx:l, "
    "offered:l, attempted_rps:d, ok_rps:d, offered_rps:d, not_sent_share:d, under_target_rps:d, under_target_share:d, attempted_batch_rps:d, ok_batch_rps:d"
)
DURATION, TARGET = 2592000.0, 0.001
SUMMARY = f"""sm0 AS (
  SELECT event_type, count(*) FILTER (NOT dropped) AS attempted, count(*) FILTER (dropped) AS drop_conn_queue_full, count(*) FILTER (dropped_late) AS dropped_after_attempt,
    count(*) FILTER (drop_inflight) AS drop_inflight_cap, count(*) FILTER (NOT dropped AND NOT timeout AND status_code BETWEEN 200 AND 299) AS ok,
    count(*) FILTER (NOT dropped AND timeout) AS timeout, count(*) FILTER (NOT dropped AND NOT timeout AND status_code = 429) AS http_429,
    count(*) FILTER (NOT dropped AND NOT timeout AND status_code >= 500) AS http_5xx FROM log GROUP BY event_type),
sm AS (
  SELECT *, attempted + drop_conn_queue_full AS offered, attempted / 2592000e0 AS attempted_rps, ok / 2592000e0 AS ok_rps, (attempted + drop_conn_queue_full) / 2592000e0 AS offered_rps,
    drop_conn_queue_full / (attempted + drop_conn_queue_full) AS not_sent_share, greatest(1e-3 - attempted / 2592000e0, 0) AS under_target_rps,
    greatest(1e-3 - attempted / 2592000e0, 0) / 1e-3 AS under_target_share, attempted / 2592000e0 / 128 AS attempted_batch_rps, ok / 2592000e0 / 128 AS ok_batch_rps FROM sm0)"""


@query("load_summary", SUMMARY_COLS, q.with_(LOG, SUMMARY) + "SELECT * FROM sm")
def load_summary(spark, d):
    return R.load_summary(fx.request_log(spark, d), DURATION, TARGET, keys=["event_type"])


@query(
    "load_verdict", "event_type:s, verdict:s, client:s, server:s",
    q.with_(LOG, SUMMARY, f"m AS (SELECT event_type, {q.recorded('queue_delay_us')} AS us FROM log WHERE NOT dropped)", "qd AS (" + quantile_sql("m", "event_type", (0.99,)) + ")",
            """rs AS (SELECT event_type, concat_ws(';', CASE WHEN drop_inflight_cap > 0 THEN 'drop_inflight_cap=' || drop_inflight_cap END,
     CASE WHEN attempted_rps < 0.00098 THEN printf('attempted_rps=%.1f (<98%% target)', attempted_rps) END,
     CASE WHEN drop_conn_queue_full > 0 THEN 'drop_conn_queue_full=' || drop_conn_queue_full END, CASE WHEN p99 >= 5000 THEN 'queue_delay_p99=' || p99 || 'us' END) AS client,
   concat_ws(';', CASE WHEN timeout > 0 THEN 'timeout=' || timeout END, CASE WHEN http_429 > 0 THEN 'http_429=' || http_429 END, CASE WHEN http_5xx > 0 THEN 'http_5xx=' || http_5xx END) AS server
  FROM sm JOIN qd USING (event_type))""")
    + "SELECT event_type, client, server, CASE WHEN client <> '' THEN 'ClientLimited' WHEN server <> '' THEN 'ServerLimited' ELSE 'Pass' END AS verdict FROM rs",
)
def load_verdict(spark, d):
    log = fx.request_log(spark, d)
    queue = R.latency_quantiles(R.metric_rows(log.where(~F.col("dropped")), ["event_type"], ["queue_delay_us"]), ["event_type"], (0.99,))
    summary = R.load_summary(log, DURATION, TARGET, keys=["event_type"])
    rows = summary.join(queue.select("event_type", F.col("p99").alias("queue_p99")), "event_type")
    out = R.verdict(rows, TARGET)
    return out.select("event_type", "verdict", F.array_join("client_reasons", ";").alias("client"), F.array_join("server_reasons", ";").alias("server"))


def replies(log):
    """One reply per 16 requests of a batch: rows, rows answered, worst status of the group."""
    part = F.floor(F.col("event_id") / 16).cast("bigint")
    e2e = F.make_interval(secs=F.col("e2e_us") / F.lit(1_000_000.0))
    rows = log.withColumn("part", part).withColumn("done_at", F.col("t_sched") + e2e)
    return rows.groupBy("batch_id", "part").agg(
        F.min("t_sched").alias("issued_at"), F.max("done_at").alias("done_at"), F.count("*").alias("rows"),
        F.count_if(F.col("event_id") % 50 != 0).alias("ok_rows"), F.max("status_code").cast("int").alias("status_code"),
        F.min("timeout").alias("timeout"), F.max("used_l2").alias("used_l2"), F.min("decision").alias("decision"),
    ).drop("part")


REPLIES = """rep AS (
  SELECT batch_id, min(t_sched) AS issued_at, max(t_sched + to_microseconds(e2e_us)) AS done_at, count(*) AS rows, count(*) FILTER (event_id % 50 <> 0) AS ok_rows,
    max(status_code) AS status_code, min(timeout) AS timeout, max(used_l2) AS used_l2, min(decision) AS decision FROM log GROUP BY batch_id, event_id // 16)"""
GOOD, FAILED = "NOT timeout AND status_code BETWEEN 200 AND 299", "NOT timeout AND status_code NOT BETWEEN 200 AND 299"
BATCHES = f"""bat AS (
  SELECT batch_id, count(*) AS replies, epoch_us(max(done_at)) - epoch_us(min(issued_at)) AS latency_us, max(done_at) AS closed_at,
    sum(CASE WHEN {GOOD} THEN ok_rows ELSE 0 END) AS ok, sum(CASE WHEN {GOOD} THEN rows - ok_rows ELSE 0 END) AS lost, sum(CASE WHEN {FAILED} THEN rows ELSE 0 END) AS err,
    sum(CASE WHEN timeout THEN rows ELSE 0 END) AS timeout, sum(CASE WHEN {FAILED} AND status_code = 429 THEN rows ELSE 0 END) AS http_429,
    sum(CASE WHEN {FAILED} AND status_code >= 500 THEN rows ELSE 0 END) AS http_5xx, sum(CASE WHEN NOT timeout AND used_l2 THEN rows ELSE 0 END) AS used_l2,
    {q.buckets("CASE WHEN timeout THEN 4 ELSE decision END", "rows")} FROM rep GROUP BY batch_id HAVING count(*) = 8)"""


def closed_batches(log):
    seals = log.select("batch_id").distinct().withColumn("expected", F.lit(8))
    return R.batch_completion(replies(log), seals)


@query(
    "batch_completion",
    "batch_id:l, replies:l, latency_us:l, ok:l, lost:l, err:l, timeout:l, http_429:l, http_5xx:l, used_l2:l, bucket_0:l, bucket_1:l, bucket_2:l, bucket_3:l, bucket_4:l",
    q.with_(LOG, REPLIES, BATCHES) + "SELECT * EXCLUDE (closed_at) FROM bat",
)
def batch_completion(spark, d):
    return closed_batches(fx.request_log(spark, d))


def _window_sql(replies: str = f"{REPLIES},\n{BATCHES}") -> str:
    p99 = {"queue_delay_us": "queue_p99_us", "send_delay_us": "send_p99_us", "server_rtt_us": "server_rtt_p99_us", "e2e_us": "e2e_p99_us",
           "batch": "batch_e2e_p99_us", "router": "stage_router_p99_us", "l1": "stage_l1_p99_us", "l2": "stage_l2_p99_us"}
    sent = "(SELECT date_trunc('hour', t_sched) AS w, * FROM log WHERE NOT dropped)"
    measures = f"{metric_sql(sent, 'w')} UNION ALL {stage_sql(sent, 'w')} UNION ALL SELECT date_trunc('hour', closed_at) AS w, 'batch' AS metric, {q.recorded('latency_us')} AS us FROM bat"
    wide = ", ".join(f"coalesce(max(CASE WHEN metric = '{m}' THEN p99 END), 0) AS {c}" for m, c in p99.items())
    cols = ", ".join(f"coalesce(x.{c}, 0) AS {c}" for c in p99.values())
    return (
        q.with_(LOG, replies, f"m AS ({measures})", "mq AS (" + quantile_sql("(SELECT * FROM m WHERE us IS NOT NULL)", "w, metric", (0.99,)) + ")",
                f"x AS (SELECT w, {wide} FROM mq GROUP BY w)", f"oc AS (SELECT date_trunc('hour', t_sched) AS w, {q.OUTCOMES} FROM log WHERE NOT dropped GROUP BY 1)",
                """ct AS (SELECT date_trunc('hour', t_sched) AS w, count(*) FILTER (NOT dropped) AS attempted, count(*) FILTER (dropped OR drop_inflight) AS dropped,
   count(*) FILTER (drop_inflight) AS drop_inflight_cap, count(*) FILTER (dropped) AS drop_conn_queue_full FROM log GROUP BY 1)""")
        + f"""SELECT epoch_ms(ct.w) AS t_ms, attempted, dropped, drop_inflight_cap, drop_conn_queue_full, coalesce(ok, 0) AS ok, coalesce(err, 0) AS err, coalesce(timeout, 0) AS timeout,
  coalesce(http_2xx, 0) AS http_2xx, coalesce(http_429, 0) AS http_429, coalesce(http_5xx, 0) AS http_5xx, {cols} FROM ct LEFT JOIN oc USING (w) LEFT JOIN x USING (w)"""
    )


@query(
    "window_metrics",
    "t_ms:l, attempted:l, dropped:l, drop_inflight_cap:l, drop_conn_queue_full:l, " + OUTCOME_COLS + ", queue_p99_us:l, send_p99_us:l, server_rtt_p99_us:l, e2e_p99_us:l, "
    "batch_e2e_p99_us:l, stage_router_p99_us:l, stage_l1_p99_us:l, stage_l2_p99_us:l",
    _window_sql(),
)
def window_metrics(spark, d):
    log = fx.request_log(spark, d)
    return R.window_metrics(log, closed_batches(log), "1 hour")


@query("rate_budget", "event_id:l, minute:l", "SELECT event_id, minute FROM (SELECT event_id, epoch_us(ts) // 3600000000 AS minute, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def rate_budget(spark, d):
    """First five triggers of every hour, the hour standing in for the second."""
    log = fx.request_log(spark, d).select("event_id", "t_sched")
    slow = F.timestamp_micros(F.floor(F.unix_micros("t_sched") / 3600).cast("bigint"))
    return R.rate_budget(log.withColumn("t_slow", slow), 5, "t_slow").select("event_id", F.col("second").alias("minute"))


@query(
    "activity_windows", "user_id:l, second:l, n_60s:l, n_300s:l, v_60s:l, v_300s:l",
    """WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS second, count(*) AS n, sum(CAST(round(value * 1000) AS BIGINT)) AS v FROM events GROUP BY 1, 2)
SELECT user_id, second, sum(n) OVER a AS n_60s, sum(n) OVER b AS n_300s, sum(v) OVER a AS v_60s, sum(v) OVER b AS v_300s FROM s
WINDOW a AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 299 PRECEDING AND CURRENT ROW)""",
)
def activity_windows(spark, d):
    return R.activity_windows(fx.request_log(spark, d), "user_id", "e2e_us")


# --- streams: run over the whole events table, compared with the same SQL as the batch form ---


def events_stream(spark, d):
    schema = fx.table(spark, d, "events").schema
    return ST.read_file_stream(spark, d, "events.parquet", schema)


def live_log(spark, d):
    """The request log as a stream that heartbeats bring to its end."""
    return fx.shape_requests(ST.with_heartbeats(events_stream(spark, d), fx.heartbeats(spark, d), "ts"))


DEADLINE_MS = 12 * 3_600_000


def single_replies(log):
    """Replies of one row each to batches of 128; those dropped late never arrive."""
    issued = F.unix_micros("t_sched")
    return log.where(~F.coalesce("dropped_late", F.lit(False))).select(
        "batch_id", F.col("t_sched").alias("done_at"), F.when(F.col("batch_id").isNotNull(), 1).cast("bigint").alias("rows"),
        (F.col("event_id") % 50 != 0).cast("bigint").alias("ok_rows"), "status_code", "timeout", "used_l2", "decision",
        F.lit(128).cast("bigint").alias("expected"), issued.alias("issued_us"), (issued + F.col("e2e_us")).alias("done_us"),
    )


SINGLE_REPLIES = f"""rep AS (SELECT *, 1 AS rows, CASE WHEN event_id % 50 <> 0 THEN 1 ELSE 0 END AS ok_rows, t_sched AS issued_at, t_sched + to_microseconds(e2e_us) AS done_at FROM log WHERE NOT dropped_late),
all_bat AS (
  SELECT batch_id, count(*) AS replies, count(*) AS rows, epoch_us(max(done_at)) - epoch_us(min(issued_at)) AS latency_us, max(done_at) AS closed_at,
    sum(CASE WHEN {GOOD} THEN ok_rows ELSE 0 END) AS ok, sum(CASE WHEN {GOOD} THEN rows - ok_rows ELSE 0 END) AS lost, sum(CASE WHEN {FAILED} THEN rows ELSE 0 END) AS err,
    sum(CASE WHEN timeout THEN rows ELSE 0 END) AS timeout, sum(CASE WHEN {FAILED} AND status_code = 429 THEN rows ELSE 0 END) AS http_429,
    sum(CASE WHEN {FAILED} AND status_code >= 500 THEN rows ELSE 0 END) AS http_5xx, sum(CASE WHEN NOT timeout AND used_l2 THEN rows ELSE 0 END) AS used_l2,
    {q.buckets("CASE WHEN timeout THEN 4 ELSE decision END", "rows")} FROM rep GROUP BY batch_id),
bat AS (SELECT * FROM all_bat WHERE replies = 128)"""


@query("stream_windows", "t_ms:l, attempted:l, dropped:l, drop_inflight_cap:l, drop_conn_queue_full:l, " + OUTCOME_COLS + ", queue_p99_us:l, send_p99_us:l, "
       "server_rtt_p99_us:l, e2e_p99_us:l, batch_e2e_p99_us:l, stage_router_p99_us:l, stage_l1_p99_us:l, stage_l2_p99_us:l", _window_sql(SINGLE_REPLIES))  # fmt: skip
def stream_windows(spark, d):
    ST.use_rocksdb(spark)
    sdf = ST.stream_windows(live_log(spark, d), single_replies(live_log(spark, d)), "1 hour", "1 hour", DEADLINE_MS)
    return ST.run_to_table(sdf, "append", "stream-windows")


TOTAL_LATENCIES = (*R.LATENCIES, *R.STAGES)


def _totals_sql() -> str:
    stages = stage_sql("sent", "1 AS one")
    rows = f"({metric_sql('sent', '1 AS one')} UNION ALL {stages})"
    wide = ", ".join(f"max(CASE WHEN metric = '{m}' THEN p{p} END) AS {m}_p{p}" for m in TOTAL_LATENCIES for p in (50, 95, 99))
    over = " + ".join(f"count_if(CAST({m} AS BIGINT) > {R.LATENCY_CEILING_US})" for m in R.LATENCIES)
    return (
        q.with_(LOG, "sent AS (SELECT * FROM log WHERE NOT dropped)", f"m AS {rows}", "mq AS (" + quantile_sql("(SELECT * FROM m WHERE us IS NOT NULL)", "metric") + ")",
                f"x AS (SELECT {wide} FROM mq)", f"oc AS (SELECT count(*) AS attempted, {q.OUTCOMES}, count_if(used_l2) AS used_l2, {q.buckets('decision')}, {over} AS over_range FROM sent)",
                "dr AS (SELECT count_if(dropped OR drop_inflight) AS dropped, count_if(drop_inflight) AS drop_inflight_cap, count_if(dropped) AS drop_conn_queue_full FROM log)")
        + "SELECT * FROM oc, dr, x"
    )


TOTAL_COLS = (
    "attempted:l, dropped:l, drop_inflight_cap:l, drop_conn_queue_full:l, " + OUTCOME_COLS + ", used_l2:l, bucket_0:l, bucket_1:l, bucket_2:l, bucket_3:l, bucket_4:l, over_range:l, "
    + ", ".join(f"{m}_p{p}:l" for m in TOTAL_LATENCIES for p in (50, 95, 99))
)


@query("stream_totals", TOTAL_COLS, _totals_sql())
def stream_totals(spark, d):
    counters = ST.run_updates(ST.stream_totals(live_log(spark, d)), ST.COUNTER_KEYS, "stream-totals")
    return ST.totals_row(counters)


@query("stream_decisions", "t_ms:l, " + BUCKETS, q.with_(LOG) + f"SELECT epoch_ms(date_trunc('hour', t_sched)) AS t_ms, count(*) AS rows, sum(CASE WHEN used_l2 THEN 1 ELSE 0 END) AS used_l2, {q.buckets('decision')} FROM log GROUP BY 1")
def stream_decisions(spark, d):
    sdf = ST.stream_decision_counts(fx.shape_requests(events_stream(spark, d)), "1 hour", "1 hour")
    return ST.run_to_table(sdf, "complete", "stream-decisions")


@query("stream_score", "txn_id:l, tau:d, l1_score:d, l2_score:d, final_score:d, used_l2:l, decision:s, policy_version:l",
       q.with_(CASCADE) + "SELECT txn_id, tau, l1_score, l2_score, final_score, used_l2, decision, 2 AS policy_version FROM cas")
def stream_score(spark, d):
    """Both tiers over a stream of orders, under the newer of two published policies."""
    store = PolicyStore(spark, scratch_path(spark, "policies"))
    store.publish(1, fx.global_tau(spark).withColumn("tau", F.lit(0.5).cast("float")), fx.segment_tau(spark))
    store.publish(2, fx.global_tau(spark), fx.segment_tau(spark))
    orders = ST.read_file_stream(spark, d, "orders.parquet", fx.table(spark, d, "orders").schema)

    def decide(rows, global_tau, segment_tau):
        txn = fx.with_route_meta(fx.transactions(spark, d, rows))
        l1, l2 = fx.model(spark, "l1"), fx.model(spark, "l2")
        done = cascade(txn, l1, fx.L1_THRESHOLD, l2, fx.TXN_FEATURES, fx.L2_FEATURES, global_tau, segment_tau)
        return done.select("txn_id", "tau", "l1_score", "l2_score", "final_score", "used_l2", "decision")

    return score_available(orders, decide, store)


@query("stream_batches", "batch_id:l, replies:l, rows:l, ok:l, lost:l, err:l, timeout:l, http_429:l, http_5xx:l, used_l2:l, bucket_0:l, bucket_1:l, bucket_2:l, bucket_3:l, bucket_4:l, latency_us:l, closed:s",
       q.with_(LOG, SINGLE_REPLIES) + "SELECT * EXCLUDE (closed_at), CASE WHEN replies = 128 THEN 'complete' ELSE 'deadline' END AS closed FROM all_bat")
def stream_batches(spark, d):
    """Batches of 128 single-row replies, closed by state: by their last reply or at a deadline."""
    ST.use_rocksdb(spark)
    sdf = ST.stream_batch_completion(single_replies(live_log(spark, d)), "1 hour", DEADLINE_MS)
    return ST.run_to_table(sdf, "append", "stream-batches")


@query("stream_budget", "event_id:l, second:l",
       "SELECT event_id, second FROM (SELECT event_id, epoch_us(ts) // 3600000000 AS second, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def stream_budget(spark, d):
    """The rate budget as a stream; an hour of the table stands in for a second."""
    ST.use_rocksdb(spark)
    log = events_stream(spark, d)
    slow = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600).cast("bigint"))
    return ST.run_to_table(ST.stream_rate_budget(log.select("event_id", slow.alias("t_sched")), 5, "10 seconds"), "append", "stream-budget")
