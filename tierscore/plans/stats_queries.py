"""Registered queries of the run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierscore.operators import stats as A
from tierscore.operators import trees as T
from tierscore.plans import fixtures as fx
from tierscore.plans import sql as q
from tierscore.plans.registry import query
from tierscore.plans.scoring import (
    CASCADE,
    DISPATCH,
    L1_NODES,
    PREFIX_RUN,
    _multi_order_sql,
    _rescue_sql,
    anchor_run,
    decided,
    dispatch_run,
    multi_order_run,
    prefix_run,
    txn,
)

L1_RUN = ",\n".join([q.TXN, L1_NODES, q.leaves("l1", "txn", "c"), q.route("l1", "c", "txn", "0.125", "r", policy=fx.L1_POLICY),
                     "run AS (SELECT txn.priority, txn.active, txn.fold_id, r.* FROM txn JOIN r USING (txn_id))"])


def l1_run(spark, d):
    """Tier-one run with calibrated early exits; inactive rows carry no visits."""
    r = T.score_route(F.col("features"), F.lit(fx.L1_THRESHOLD), fx.model(spark, "l1"), policy=fx.L1_POLICY)
    rows = txn(spark, d).withColumn("r", r)
    return rows.select("txn_id", "priority", "active", "fold_id", "r.*")


def pct_sql(table: str, value: str, where: str = "TRUE", keys: str = "", qs=(0.5, 0.9, 0.99)) -> str:
    """Nearest-rank percentiles of a column as a subquery."""
    part = f"PARTITION BY {keys} " if keys else ""
    cols = ", ".join(f"max(CASE WHEN i = floor((n - 1) * {p} + 0.5) THEN v END) AS p{round(p * 100)}" for p in qs)
    head = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"""(SELECT {head}{cols} FROM (SELECT {head}{value} AS v, row_number() OVER ({part}ORDER BY {value}) - 1 AS i, count(*) OVER ({part}) AS n
  FROM {table} WHERE {where}){group})"""


@query(
    "infer_stats",
    "priority:s, n_rows:l, pass_rate:d, active_rate:d, avg_visited:d, full_eval_rate:d, approx_coverage:d, approx_pass_rate:d, "
    "approx_refer_rate:d, approx_fallback_rate:d, p50:l, p90:l, p99:l",
    q.with_(L1_RUN)
    + f"""SELECT s.*, p.p50, p.p90, p.p99 FROM (
  SELECT priority, count(*) AS n_rows, count(*) FILTER (active AND pass = 1) / count(*) AS pass_rate, count(*) FILTER (active) / count(*) AS active_rate,
    coalesce(sum(visited) FILTER (active), 0) / count(*) AS avg_visited, count(*) FILTER (active AND visited = 8) / count(*) AS full_eval_rate,
    count(*) FILTER (active AND exit_idx >= 0) / count(*) AS approx_coverage, count(*) FILTER (active AND exit_idx >= 0 AND pass = 1) / count(*) AS approx_pass_rate,
    count(*) FILTER (active AND exit_idx >= 0 AND pass = 0) / count(*) AS approx_refer_rate,
    (count(*) - count(*) FILTER (active AND exit_idx >= 0)) / count(*) AS approx_fallback_rate
  FROM run GROUP BY priority) s LEFT JOIN {pct_sql("run", "visited", "active", "priority")} p USING (priority)""",
)
def infer_stats(spark, d):
    return A.infer_stats(l1_run(spark, d), 8, ["priority"])


@query("approx_exits", "checkpoint:l, n:l", q.with_(L1_RUN) + "SELECT exit_idx AS checkpoint, count(*) AS n FROM run WHERE active GROUP BY exit_idx")
def approx_exits(spark, d):
    return A.exit_counts(l1_run(spark, d).where("active"), F.col("exit_idx"))


@query(
    "visit_histogram", "fold_id:l, bin:l, n:l",
    q.with_(L1_RUN)
    + """SELECT f.fold_id, b.bin, count(r.txn_id) AS n FROM (SELECT DISTINCT fold_id FROM run) f CROSS JOIN (SELECT unnest(range(9)) AS bin) b
LEFT JOIN (SELECT *, least(greatest(CASE WHEN active THEN visited ELSE 0 END, 0), 8) AS v FROM run) r ON r.fold_id = f.fold_id AND r.v = b.bin GROUP BY 1, 2""",
)
def visit_histogram(spark, d):
    rows = l1_run(spark, d).withColumn("visited", F.when(F.col("active"), F.col("visited")).otherwise(0))
    return A.visit_histogram(rows, 8, ["fold_id"])


@query("visit_percentiles", "p50:l, p90:l, p99:l", q.with_(L1_RUN) + "SELECT * FROM " + pct_sql("run", "visited", "active"))
def visit_percentiles(spark, d):
    return A.visit_percentiles(l1_run(spark, d).where("active"))


@query(
    "value_percentiles", "event_type:s, p50:l, p90:l, p99:l",
    "WITH v AS (SELECT event_type, CAST(round(value * 1000) AS BIGINT) AS us FROM events) SELECT * FROM " + pct_sql("v", "us", keys="event_type"),
)
def value_percentiles(spark, d):
    """Nearest-rank percentiles of a wide integer column, ordered bin by bin."""
    rows = fx.request_log(spark, d)
    return A.order_statistics(rows, ["event_type"], "e2e_us", {f"p{round(p * 100)}": A.nearest_rank(p) for p in (0.5, 0.9, 0.99)}, width=1 << 12)


@query(
    "dispatch_stats", "slot_id:l, rows:l, avg_visited:d, reject_rate:d, p50:l, p90:l, p99:l",
    q.with_(DISPATCH, "act AS (SELECT * FROM disp WHERE active)")
    + f"""SELECT s.*, p.p50, p.p90, p.p99 FROM (SELECT slot_id, count(*) AS rows, sum(visited_trees) / count(*) AS avg_visited, sum(reject) / count(*) AS reject_rate FROM act GROUP BY slot_id) s
JOIN {pct_sql("act", "visited_trees", keys="slot_id")} p USING (slot_id)
UNION ALL SELECT NULL, a.n, a.v, a.r, p.p50, p.p90, p.p99 FROM (SELECT count(*) AS n, sum(visited_trees) / count(*) AS v, sum(reject) / count(*) AS r FROM act) a
CROSS JOIN {pct_sql("act", "visited_trees")} p""",
)
def dispatch_stats(spark, d):
    return A.dispatch_stats(dispatch_run(spark, d))


def interval_run(spark, d, shadow_only: bool = False):
    m = fx.model(spark, "l1")
    rows = txn(spark, d).withColumn("iv", T.score_interval(F.col("features"), m, [0, 1, 2, 4, 7]))
    rows = rows.select("txn_id", "label", "active", "tau", "features", "iv.lower", "iv.upper")
    open_ = (F.col("lower") < F.col("tau")) & (F.col("upper") >= F.col("tau"))
    rows = rows.withColumn("exact", T.score_route(F.when(open_ & F.col("active"), F.col("features")), F.col("tau"), m))
    return A.interval_result(rows, shadow_only)


def _interval_sql() -> str:
    parts = ["w0 AS (SELECT s.txn_id, m.t, 0 AS n FROM txn s CROSS JOIN (SELECT DISTINCT t FROM nodes_l1) m)"]
    for k in range(3):
        parts.append(
            f"""w{k + 1} AS (
  SELECT txn_id, t, unnest(nx) AS n FROM (
    SELECT w.txn_id, w.t, CASE WHEN m.fidx NOT IN (0, 1, 2, 4, 7) THEN [m.lc, m.rc]
           WHEN s.features[m.fidx + 1] IS NULL THEN [m.mc] WHEN s.features[m.fidx + 1] < m.thr THEN [m.lc] ELSE [m.rc] END AS nx
    FROM w{k} w JOIN nodes_l1 m ON m.t = w.t AND m.n = w.n JOIN txn s ON s.txn_id = w.txn_id))"""
        )
    parts += [
        "ivt AS (SELECT txn_id, t, min(leaf) AS lo, max(leaf) AS hi FROM w3 JOIN nodes_l1 m USING (t, n) GROUP BY txn_id, t)",
        "iv AS (SELECT txn_id, sum(lo) AS lower, sum(hi) AS upper FROM ivt GROUP BY txn_id)",
        q.leaves("l1", "txn", "c"),
        q.route("l1", "c", "txn", "tau", "r"),
        """fast AS (
  SELECT txn.txn_id, txn.active, lower, upper, CASE WHEN lower >= tau THEN 1 ELSE 0 END AS shadow_reject,
    CASE WHEN lower >= tau THEN 1 WHEN upper < tau THEN 0 ELSE r.pass END AS final_reject,
    CASE WHEN lower >= tau OR upper < tau THEN 0 ELSE 1 END AS fallback_used,
    CASE WHEN lower >= tau OR upper < tau THEN 0 ELSE r.visited END AS exact_visits
  FROM txn JOIN iv USING (txn_id) JOIN r USING (txn_id))""",
    ]
    return ",\n".join(parts)


@query(
    "interval_stats",
    "active_rows:l, shadow_reject_rate:d, final_reject_rate:d, direct_reject_rate:d, direct_refer_rate:d, fallback_rate:d, exact_avg_visits:d, exact_p99_visits:l",
    q.with_(q.TXN, L1_NODES, _interval_sql(), "a AS (SELECT * FROM fast WHERE active)")
    + f"""SELECT count(*) AS active_rows, sum(shadow_reject) / count(*) AS shadow_reject_rate, sum(final_reject) / count(*) AS final_reject_rate,
  sum(shadow_reject) / count(*) AS direct_reject_rate, count(*) FILTER (fallback_used = 0 AND shadow_reject = 0) / count(*) AS direct_refer_rate,
  sum(fallback_used) / count(*) AS fallback_rate, sum(exact_visits) / greatest(sum(fallback_used), 1) AS exact_avg_visits,
  (SELECT p99 FROM {pct_sql("a", "exact_visits", "fallback_used = 1", qs=(0.99,))}) AS exact_p99_visits FROM a""",
)
def interval_stats(spark, d):
    return A.interval_stats(interval_run(spark, d))


@query(
    "prefix_stats",
    "n_rows:l, active_rate:d, active_rows:l, shadow_reject_rate:d, final_reject_rate:d, direct_reject_rate:d, direct_refer_rate:d, "
    "direct_decision_rate:d, fallback_rate:d, avg_prefix_trees:d, exact_avg_visits:d, exact_p99_visits:l, prefix_trees:l, n_trees:l",
    q.with_(PREFIX_RUN, "a AS (SELECT * FROM f WHERE active)")
    + f"""SELECT (SELECT count(*) FROM f) AS n_rows, count(*) / (SELECT count(*) FROM f) AS active_rate, count(*) AS active_rows, sum(shadow_reject) / count(*) AS shadow_reject_rate,
  sum(final_reject) / count(*) AS final_reject_rate, count(*) FILTER (fallback_used = 0 AND shadow_reject = 1) / count(*) AS direct_reject_rate,
  count(*) FILTER (fallback_used = 0 AND shadow_reject = 0) / count(*) AS direct_refer_rate, count(*) FILTER (fallback_used = 0) / count(*) AS direct_decision_rate,
  sum(fallback_used) / count(*) AS fallback_rate, sum(prefix_trees_used) / count(*) AS avg_prefix_trees, sum(exact_visits) / greatest(sum(fallback_used), 1) AS exact_avg_visits,
  (SELECT p99 FROM {pct_sql("a", "exact_visits", "fallback_used = 1", qs=(0.99,))}) AS exact_p99_visits, sum(prefix_trees_used) AS prefix_trees, 16 AS n_trees FROM a""",
)
def prefix_stats(spark, d):
    return A.prefix_stats(prefix_run(spark, d), 16)


def family_sql(rows: str, families: dict[str, tuple[str, str]]) -> str:
    """``key=n`` of each family of ``(condition, key)`` in key order, joined by commas."""
    one = "(SELECT coalesce(string_agg(k || '=' || n, ',' ORDER BY k), '') FROM (SELECT {key} AS k, count(*) AS n FROM {rows} WHERE {on} GROUP BY 1)) AS {name}"
    return ", ".join(one.format(key=key, rows=rows, on=on, name=name) for name, (on, key) in families.items())


def families_of(summary, names):
    """Map columns of a summary as strings."""
    pair = lambda e: F.concat_ws("=", e["key"], e["value"])
    return [F.array_join(F.transform(F.array_sort(F.map_entries(n)), pair), ",").alias(n) for n in names]


RUN_FAMILIES = {
    "checkpoint_exits": ("TRUE", "greatest(direct_checkpoint, fallback_entry_checkpoint)"),
    "direct_rows": ("direct_checkpoint > 0", "direct_checkpoint"),
    "fallback_entries": ("fallback_entry_checkpoint > 0", "fallback_entry_checkpoint"),
    "exact_visit_hist": ("fallback_used = 1", "exact_visits"),
    "router_choices": ("TRUE", "route"),
    "router_tau_bins": ("TRUE", "route_tau_bin"),
    "mismatch_by_checkpoint": ("direct_checkpoint > 0 AND shadow_reject <> label", "direct_checkpoint"),
}
RESCUE_FAMILIES = {
    "checkpoint_exits": ("TRUE", "CASE WHEN anchor_checkpoint > 0 THEN anchor_checkpoint ELSE fallback_entry_checkpoint END"),
    "anchor_exits": ("anchor_checkpoint > 0", "anchor_checkpoint"),
    "fallback_entries": ("anchor_checkpoint = 0 AND fallback_entry_checkpoint > 0", "fallback_entry_checkpoint"),
    "rescue_routes": ("anchor_checkpoint = 0", "rescue_route"),
    "rescue_exits": ("anchor_checkpoint = 0 AND rescue_checkpoint > 0", "rescue_route"),
    "tail_rows": ("anchor_checkpoint = 0 AND rescue_checkpoint = 0 AND fallback_used = 1", "0"),
    "mismatch_by_stage": ("anchor_checkpoint + rescue_checkpoint > 0 AND shadow_reject <> label", "CASE WHEN anchor_checkpoint > 0 THEN 0 ELSE 1 END"),
}


@query(
    "prefix_summary", "n_rows:l, active_rows:l, direct_decision_rate:d, fallback_rate:d, exact_p99_visits:l, " + ", ".join(f"{n}:s" for n in RUN_FAMILIES),
    "WITH mo AS (" + _multi_order_sql() + "), lb AS (" + q.with_(q.TXN) + "SELECT txn_id, label FROM txn), a AS (SELECT mo.*, label FROM mo JOIN lb USING (txn_id) WHERE active) "
    + f"""SELECT (SELECT count(*) FROM mo) AS n_rows, count(*) AS active_rows, count(*) FILTER (fallback_used = 0) / count(*) AS direct_decision_rate,
  sum(fallback_used) / count(*) AS fallback_rate, (SELECT p99 FROM {pct_sql("a", "exact_visits", "fallback_used = 1", qs=(0.99,))}) AS exact_p99_visits,
  {family_sql("a", RUN_FAMILIES)} FROM a""",
)
def prefix_summary(spark, d):
    """Everything about a routed run in one row, from one walk."""
    rows = multi_order_run(spark, d).withColumn("exact_positive", F.col("label") == 1)
    out = A.prefix_summary(rows, 16)
    return out.select("n_rows", "active_rows", "direct_decision_rate", "fallback_rate", "exact_p99_visits", *families_of(out, RUN_FAMILIES))


@query(
    "rescue_summary", "n_rows:l, active_rows:l, " + ", ".join(f"{n}:s" for n in RESCUE_FAMILIES),
    "WITH an AS (" + _rescue_sql() + "), lb AS (" + q.with_(q.TXN) + "SELECT txn_id, label, active FROM txn), a AS (SELECT an.*, label FROM an JOIN lb USING (txn_id) WHERE active) "
    + f"SELECT (SELECT count(*) FROM an) AS n_rows, count(*) AS active_rows, {family_sql('a', RESCUE_FAMILIES)} FROM a",
)
def rescue_summary(spark, d):
    rows = anchor_run(spark, d).withColumn("exact_positive", F.col("label") == 1)
    out = A.prefix_summary(rows, 16)
    return out.select("n_rows", "active_rows", *families_of(out, RESCUE_FAMILIES))


@query(
    "exits_by_checkpoint", "checkpoint:l, exits:l, direct_rows:l, fallback_entries:l",
    q.with_(PREFIX_RUN)
    + """SELECT c.checkpoint, count(f.txn_id) AS exits, count(*) FILTER (f.direct_checkpoint > 0) AS direct_rows, count(*) FILTER (f.direct_checkpoint = 0) AS fallback_entries
FROM (VALUES (4), (8), (12)) c(checkpoint) LEFT JOIN f ON f.active AND c.checkpoint = greatest(f.direct_checkpoint, f.fallback_entry_checkpoint) GROUP BY 1""",
)
def exits_by_checkpoint(spark, d):
    return A.exits_by_checkpoint(prefix_run(spark, d), fx.CHECKPOINTS)


@query("router_counts", "route:l, route_tau_bin:l, n:l", f"SELECT {q.TAU_BIN.format(t='((o_orderkey % 9 - 2) / 16e0)')} AS route, {q.TAU_BIN.format(t='((o_orderkey % 9 - 2) / 16e0)')} AS route_tau_bin, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1, 2")
def router_counts(spark, d):
    return A.router_counts(multi_order_run(spark, d))


@query(
    "rescue_stats", "rescue_route:l, rows:l, rescue_exits:l, tail_rows:l",
    "SELECT rescue_route, count(*) AS rows, sum(CASE WHEN rescue_checkpoint <> 0 THEN 1 ELSE 0 END) AS rescue_exits, sum(fallback_used) AS tail_rows FROM ("
    + _rescue_sql() + ") WHERE anchor_checkpoint = 0 AND txn_id % 10 <> 0 GROUP BY rescue_route",
)
def rescue_stats(spark, d):
    return A.rescue_stats(anchor_run(spark, d))


@query(
    "shadow_mismatch", "stage:s, checkpoint:l, direct_rows:l, mismatches:l",
    "WITH ex AS (" + q.with_(q.TXN, "x AS (SELECT 1)") + "SELECT txn_id, label FROM txn), an AS (" + _rescue_sql() + """),
z AS (SELECT CASE WHEN anchor_checkpoint <> 0 THEN 'anchor' ELSE 'rescue' END AS stage, greatest(anchor_checkpoint, rescue_checkpoint) AS checkpoint, shadow_reject, label
      FROM an JOIN ex USING (txn_id) WHERE anchor_checkpoint + rescue_checkpoint > 0)
SELECT stage, checkpoint, count(*) AS direct_rows, sum(CASE WHEN shadow_reject <> label THEN 1 ELSE 0 END) AS mismatches FROM z GROUP BY 1, 2""",
)
def shadow_mismatch(spark, d):
    """Shadow decisions against the known answer, here the label of the row."""
    rows = anchor_run(spark, d)
    at_anchor = F.col("anchor_checkpoint") != 0
    rows = rows.select(
        F.when(at_anchor, F.lit("anchor")).otherwise(F.lit("rescue")).alias("stage"),
        F.greatest("anchor_checkpoint", "rescue_checkpoint").alias("checkpoint"), "shadow_reject", (F.col("label") == 1).alias("exact_positive"),
    )
    return A.shadow_mismatch(rows)


BUCKETS = "rows:l, used_l2:l, bucket_0:l, bucket_1:l, bucket_2:l, bucket_3:l, bucket_4:l"


@query("decision_counts", "fold_id:l, " + BUCKETS, q.with_(CASCADE) + f"SELECT fold_id, count(*) AS rows, sum(used_l2) AS used_l2, {q.buckets('code')} FROM cas GROUP BY fold_id")
def decision_counts(spark, d):
    return A.decision_counts(decided(spark, d), ["fold_id"])


@query("batch_ack", "batch:l, ok:l, " + BUCKETS, q.with_(CASCADE) + f"SELECT txn_id // 128 AS batch, count(*) AS ok, count(*) AS rows, sum(used_l2) AS used_l2, {q.buckets('code')} FROM cas GROUP BY 1")
def batch_ack(spark, d):
    return A.batch_ack(decided(spark, d), "txn_id")


@query(
    "run_summary", "event_type:s, runs:l, best:l, worst:l, median:l, mean:d",
    """WITH r AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS rows, sum(CAST(round(value * 1000) AS BIGINT)) AS us FROM events GROUP BY 1, 2),
m AS (SELECT event_type, (rows * 1000000000) // us AS rate FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rate) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM m)
SELECT event_type, count(*) AS runs, max(rate) AS best, min(rate) AS worst, max(CASE WHEN i = n // 2 THEN rate END) AS median, CAST(sum(rate) AS DOUBLE) / count(*) AS mean
FROM o GROUP BY event_type""",
)
def run_summary(spark, d):
    """Every hour of an event type is one run: its events over its summed latency."""
    log = fx.request_log(spark, d)
    runs = log.groupBy("event_type", F.date_trunc("hour", "t_sched").alias("h")).agg(F.count("*").alias("rows"), F.sum("e2e_us").alias("elapsed_us"))
    return A.run_summary(runs, ["event_type"])


