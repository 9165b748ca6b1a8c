"""Registered queries of the scoring operators and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscore.functions.scalars import decision_code
from tierscore.operators import cascade as C
from tierscore.operators import certify as X
from tierscore.operators import relational as R
from tierscore.operators import trees as T
from tierscore.operators.skew import inline_table
from tierscore.plans import fixtures as fx
from tierscore.plans import sql as q
from tierscore.plans.registry import query

L1_NODES, L2_NODES = q.nodes("l1"), q.nodes("l2")
# The tier-two vector of every row, with the exact tier-one score as ninth feature.
L1_SCORES = ",\n".join([L1_NODES, q.leaves("l1", "txn", "c1"), q.scores("c1", "s1")])
T2 = "t2 AS (SELECT txn.* EXCLUDE (features), list_append(features, CAST(s1.score AS FLOAT)) AS features, s1.score AS l1_score FROM txn JOIN s1 USING (txn_id))"
BASE2 = ",\n".join([q.TXN, L1_SCORES, T2, L2_NODES, q.leaves("l2", "t2", "c2")])


def txn(spark: SparkSession, d: str) -> DataFrame:
    return fx.with_route_meta(fx.transactions(spark, d)).withColumn("tau", fx.row_tau())


def tier_two(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with the tier-two vector."""
    rows = txn(spark, d).withColumn("l1_score", T.score_exact(F.col("features"), fx.model(spark, "l1")))
    second = C.gather_features(F.col("features"), F.col("l1_score"), fx.TXN_FEATURES, fx.L2_FEATURES)
    return rows.withColumn("features", second)


def bundle(spark: SparkSession, kind: str = "table", order: int = 0, checkpoints=fx.CHECKPOINTS) -> X.Bundle:
    return X.Bundle(
        fx.model(spark, "l2", fx.order(order), work=kind == "mlp"),
        fx.calibration(spark, checkpoints),
        fx.atlas(spark) if kind == "atlas" else None,
        fx.mlp() if kind == "mlp" else None,
    )


@query("score_exact", "txn_id:l, score:d", q.with_(q.VEC, q.nodes("vec_small"), q.leaves("vec_small", "vec", "c")) + "SELECT txn_id, sum(leaf) AS score FROM c GROUP BY txn_id")
def score_exact(spark, d):
    m = fx.model(spark, "vec_small")
    return fx.vectors(spark, d).select(F.col("vec_id").alias("txn_id"), T.score_exact(F.col("features"), m).alias("score"))


@query("score_exact_large", "txn_id:l, score:d", q.with_(q.VEC, q.nodes("vec_large"), q.leaves("vec_large", "vec", "c")) + "SELECT txn_id, sum(leaf) AS score FROM c GROUP BY txn_id")
def score_exact_large(spark, d):
    m = fx.model(spark, "vec_large")
    return fx.vectors(spark, d).select(F.col("vec_id").alias("txn_id"), T.score_exact(F.col("features"), m).alias("score"))


@query("score_missing", "txn_id:l, score:d", q.with_(q.TXN, L1_SCORES) + "SELECT txn_id, score FROM s1")
def score_missing(spark, d):
    """Exact tier-one score of all orders, some with missing line-item features."""
    m = fx.model(spark, "l1")
    return fx.transactions(spark, d).select("txn_id", T.score_exact(F.col("features"), m).alias("score"))


@query("score_relational", "txn_id:l, score:d", q.with_(q.TXN, L1_SCORES) + "SELECT txn_id, score FROM s1")
def score_relational(spark, d):
    """The same scores from joins and leaf-set intersection only."""
    return R.score_by_masks(fx.transactions(spark, d), fx.model_nodes(spark, "l1"))


@query("route_exact", "txn_id:l, score:d, pass:l, visited:l", q.with_(q.TXN, L1_NODES, q.leaves("l1", "txn", "c"), q.route("l1", "c", "txn", "tau", "r")) + "SELECT txn_id, score, pass, visited FROM r")
def route_exact(spark, d):
    rows = txn(spark, d)
    r = T.score_route(F.col("features"), F.col("tau"), fx.model(spark, "l1"))
    return rows.select("txn_id", r.alias("r")).select("txn_id", "r.score", "r.pass", "r.visited")


@query("route_every", "txn_id:l, score:d, pass:l, visited:l", q.with_(q.TXN, L1_NODES, q.leaves("l1", "txn", "c"), q.route("l1", "c", "txn", "tau", "r", every=3)) + "SELECT txn_id, score, pass, visited FROM r")
def route_every(spark, d):
    """Early exit tested at every third tree, from the array of leaf values."""
    m = fx.model(spark, "l1")
    leaves = T.tree_leaves(F.col("features"), m)
    rows = txn(spark, d).withColumn("leaves", leaves)
    r = R.route_by_fold(F.col("leaves"), F.col("tau"), m.suffix_min.tolist(), m.suffix_max.tolist(), every=3)
    return rows.select("txn_id", r.alias("r")).select("txn_id", "r.score", "r.pass", "r.visited")


@query("route_approx", "txn_id:l, score:d, pass:l, visited:l, exit_idx:l", q.with_(q.TXN, L1_NODES, q.leaves("l1", "txn", "c"), q.route("l1", "c", "txn", "0.125", "r", policy=fx.L1_POLICY)) + "SELECT * FROM r")
def route_approx(spark, d):
    r = T.score_route(F.col("features"), F.lit(fx.L1_THRESHOLD), fx.model(spark, "l1"), policy=fx.L1_POLICY)
    return fx.transactions(spark, d).select("txn_id", r.alias("r")).select("txn_id", "r.*")


INTERVAL_SQL = """, iv AS (
  SELECT txn_id, t, min(leaf) AS lo, max(leaf) AS hi FROM w3 JOIN nodes_l1 m USING (t, n) GROUP BY txn_id, t)
SELECT txn_id, sum(lo) AS lower, sum(hi) AS upper FROM iv GROUP BY txn_id"""


def _interval_steps() -> str:
    """All nodes reachable per level when only features 0, 4 and 7 are known."""
    parts = ["w0 AS (SELECT s.txn_id, m.t, 0 AS n FROM txn s CROSS JOIN (SELECT DISTINCT t FROM nodes_l1) m)"]
    for k in range(3):
        parts.append(
            f"""w{k + 1} AS (
  SELECT txn_id, t, unnest(nx) AS n FROM (
    SELECT w.txn_id, w.t, CASE WHEN m.fidx NOT IN (0, 4, 7) THEN [m.lc, m.rc]
           WHEN s.features[m.fidx + 1] IS NULL THEN [m.mc] WHEN s.features[m.fidx + 1] < m.thr THEN [m.lc] ELSE [m.rc] END AS nx
    FROM w{k} w JOIN nodes_l1 m ON m.t = w.t AND m.n = w.n JOIN txn s ON s.txn_id = w.txn_id))"""
        )
    return ",\n".join(parts)


@query("score_interval", "txn_id:l, lower:d, upper:d", q.with_(q.TXN, L1_NODES, _interval_steps()) + INTERVAL_SQL)
def score_interval(spark, d):
    iv = T.score_interval(F.col("features"), fx.model(spark, "l1"), [0, 4, 7])
    return fx.transactions(spark, d).select("txn_id", iv.alias("iv")).select("txn_id", "iv.*")


@query("interval_relational", "txn_id:l, lower:d, upper:d", q.with_(q.TXN, L1_NODES, _interval_steps()) + INTERVAL_SQL)
def interval_relational(spark, d):
    return R.interval_by_masks(fx.transactions(spark, d), fx.model_nodes(spark, "l1"), observed=[0, 4, 7])


@query("prefix_scores", "txn_id:l, checkpoint:l, score:d", q.with_(BASE2, q.prefix("c2", fx.CHECKPOINTS, "p")) + "SELECT txn_id, checkpoint, score FROM p")
def prefix_scores(spark, d):
    rows = tier_two(spark, d)
    rows = rows.withColumn("s", T.prefix_scores(F.col("features"), fx.model(spark, "l2"), fx.CHECKPOINTS))
    cps = F.array(*[F.lit(c) for c in fx.CHECKPOINTS])
    return rows.select("txn_id", F.explode(F.arrays_zip(cps.alias("checkpoint"), F.col("s").alias("score"))).alias("z")).select("txn_id", "z.*")


@query(
    "checkpoint_deltas", "txn_id:l, checkpoint:l, gap:d, abs_gap:d, delta_prev:d, delta_64:d",
    q.with_(q.VEC, q.nodes("vec_large"), q.leaves("vec_large", "vec", "c"), q.prefix("c", (32, 64, 96, 128), "p"))
    + """SELECT txn_id, checkpoint, 0.25 - score AS gap, abs(0.25 - score) AS abs_gap,
  score - coalesce(lag(score) OVER w, 0) AS delta_prev,
  coalesce(score - max(CASE WHEN checkpoint = 64 THEN score END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS delta_64
FROM p WINDOW w AS (PARTITION BY txn_id ORDER BY checkpoint)""",
)
def checkpoint_deltas(spark, d):
    cps = (32, 64, 96, 128)
    rows = fx.vectors(spark, d).withColumn("s", T.prefix_scores(F.col("features"), fx.model(spark, "vec_large"), cps))
    zipped = F.arrays_zip(F.array(*[F.lit(c) for c in cps]).alias("checkpoint"), F.col("s").alias("score"))
    long = rows.select(F.col("vec_id").alias("txn_id"), F.explode(zipped).alias("z")).select("txn_id", "z.*", F.lit(0.25).alias("tau"))
    return X.checkpoint_features(long)


P2 = ",\n".join([BASE2, q.prefix("c2", fx.CHECKPOINTS, "p0"), "p AS (SELECT p0.*, t2.tau, t2.fold_id FROM p0 JOIN t2 USING (txn_id))", q.bands()])


def _certify_sql(kind: str) -> str:
    extra = [q.atlas_cells()] if kind == "atlas" else [q.leaf_work("c2", fx.CHECKPOINTS)] if kind == "mlp" else []
    return (
        q.with_(P2, *extra, q.certified("p", "k", kind))
        + "SELECT txn_id, checkpoint, score, CASE outcome WHEN 1 THEN 'reject' WHEN 0 THEN 'refer' ELSE 'open' END AS outcome, route_score FROM k"
    )


CERT_COLUMNS = "txn_id:l, checkpoint:l, score:d, outcome:s, route_score:d"


@query("certify_table", CERT_COLUMNS, _certify_sql("table"))
def certify_table(spark, d):
    return X.certify_long(tier_two(spark, d), bundle(spark))


@query("certify_atlas", CERT_COLUMNS, _certify_sql("atlas"))
def certify_atlas(spark, d):
    return X.certify_long(tier_two(spark, d), bundle(spark, "atlas"))


@query("certify_mlp", CERT_COLUMNS, _certify_sql("mlp"))
def certify_mlp(spark, d):
    return X.certify_long(tier_two(spark, d), bundle(spark, "mlp"))


def cascade_sql(kind: str = "table", pos: str = "t", out: str = "f", rows: str = "t2", leaf: str = "c2", cert: str = "k") -> str:
    """Prefix cascade over active rows: ``out`` with the result columns."""
    return ",\n".join(
        [
            q.first_cert(cert, f"{out}_c"),
            f"{out}_o AS (SELECT s.txn_id, s.tau, p.score FROM {rows} s JOIN p ON p.txn_id = s.txn_id AND p.slot = 2 WHERE s.active AND s.txn_id NOT IN (SELECT txn_id FROM {out}_c))",
            q.route("l2", leaf, f"{out}_o", "tau", f"{out}_r", pos, start=12, first="score"),
            f"""{out} AS (
  SELECT s.txn_id, s.active,
         CASE WHEN s.active THEN coalesce(c.score, o.score) END AS prefix_score,
         CASE WHEN s.active THEN coalesce(c.checkpoint, 12) ELSE 0 END AS prefix_trees_used,
         CASE WHEN s.active THEN coalesce(c.outcome, 0) ELSE 0 END AS shadow_reject,
         CASE WHEN s.active THEN coalesce(c.outcome, r.pass) ELSE 0 END AS final_reject,
         CASE WHEN s.active AND c.txn_id IS NULL THEN 1 ELSE 0 END AS fallback_used,
         CASE WHEN s.active THEN coalesce(c.checkpoint, 0) ELSE 0 END AS direct_checkpoint,
         CASE WHEN s.active AND c.txn_id IS NULL THEN 12 ELSE 0 END AS fallback_entry_checkpoint,
         CASE WHEN s.active THEN coalesce(c.route_score, r.score) END AS route_score,
         CASE WHEN s.active AND c.txn_id IS NULL THEN r.visited ELSE 0 END AS exact_visits
  FROM {rows} s LEFT JOIN {out}_c c ON c.txn_id = s.txn_id LEFT JOIN {out}_o o ON o.txn_id = s.txn_id LEFT JOIN {out}_r r ON r.txn_id = s.txn_id)""",
        ]
    )


PREFIX_COLS = (
    "txn_id:l, prefix_score:d, prefix_trees_used:l, shadow_reject:l, final_reject:l, fallback_used:l, direct_checkpoint:l, "
    "fallback_entry_checkpoint:l, route_score:d, exact_visits:l"
)
PREFIX_RUN = ",\n".join([P2, q.certified("p", "k"), cascade_sql()])


def prefix_run(spark: SparkSession, d: str) -> DataFrame:
    return X.prefix_cascade(tier_two(spark, d), bundle(spark), F.col("active"))


@query("prefix_cascade", PREFIX_COLS, q.with_(PREFIX_RUN) + "SELECT * FROM f")
def prefix_cascade(spark, d):
    return prefix_run(spark, d)


@query("prefix_cascade_mlp", PREFIX_COLS, q.with_(P2, q.leaf_work("c2", fx.CHECKPOINTS), q.certified("p", "k", "mlp"), cascade_sql()) + "SELECT * FROM f")
def prefix_cascade_mlp(spark, d):
    """With the network behind the bands; its inputs count work and early resolved trees."""
    return X.prefix_cascade(tier_two(spark, d), bundle(spark, "mlp"), F.col("active"))


@query("prefix_cascade_atlas", PREFIX_COLS, q.with_(P2, q.atlas_cells(), q.certified("p", "k", "atlas"), cascade_sql()) + "SELECT * FROM f")
def prefix_cascade_atlas(spark, d):
    """With cluster cells behind the bands."""
    return X.prefix_cascade(tier_two(spark, d), bundle(spark, "atlas"), F.col("active"))


def _multi_order_sql() -> str:
    """The cascade per tau bin with that bin's tree order, as a union of three runs."""
    parts = [q.TXN, L1_SCORES, T2, L2_NODES, q.bands()]
    for i, (a, b) in enumerate(fx.ORDERS):
        pos = f"(t * {a} + {b}) % 16"
        run = ",\n".join(
            [
                f"rt{i} AS (SELECT * FROM t2 WHERE {q.TAU_BIN.format(t='tau')} = {i})",
                q.leaves("l2", f"rt{i}", f"c{i}x", pos),
                q.prefix(f"c{i}x", fx.CHECKPOINTS, f"p0{i}"),
                f"p{i} AS (SELECT z.*, s.tau, s.fold_id FROM p0{i} z JOIN rt{i} s USING (txn_id))",
                q.certified(f"p{i}", f"k{i}"),
                cascade_sql(pos=pos, out=f"f{i}", rows=f"rt{i}", leaf=f"c{i}x", cert=f"k{i}").replace(" JOIN p ON p.txn_id = s.txn_id AND p.slot = 2", f" JOIN p{i} p ON p.txn_id = s.txn_id AND p.slot = 2"),
            ]
        )
        parts.append(run)
    return q.with_(*parts) + " UNION ALL ".join(f"SELECT {i} AS route, {i} AS route_tau_bin, * FROM f{i}" for i in range(3))


def multi_order_run(spark: SparkSession, d: str) -> DataFrame:
    bundles = [bundle(spark, order=i) for i in range(3)]
    routes = inline_table(spark, "tau_bin int, route int", [(i, i) for i in range(3)])
    return X.multi_order(tier_two(spark, d), bundles, routes, fx.TAU_EDGES, F.col("active"))


@query("multi_order", PREFIX_COLS + ", route:l, route_tau_bin:l", _multi_order_sql())
def multi_order(spark, d):
    return multi_order_run(spark, d)


def anchor_run(spark: SparkSession, d: str) -> DataFrame:
    def rescue(order):
        return X.Bundle(fx.model(spark, "l2", order), fx.calibration(spark, fx.RESCUE_CHECKPOINTS))

    return X.anchor_rescue(
        tier_two(spark, d), bundle(spark, checkpoints=fx.ANCHOR_CHECKPOINTS), rescue(fx.REJECT_ORDER), rescue(fx.REFER_ORDER),
        inline_table(spark, fx.RESCUE_ROW_SCHEMA, fx.RESCUE_ROWS), inline_table(spark, fx.RESCUE_DEFAULT_SCHEMA, fx.RESCUE_DEFAULTS),
        fx.TAU_EDGES, fx.RESCUE_GAP_EDGES, F.col("active"),
    )


def values(rows) -> str:
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def rescue_action_sql(rows: str, out: str) -> str:
    """Router action for rows ``txn_id, fold_id, tau, score``."""
    gap_bin = "(CASE WHEN tau - score < -0.25 THEN 0 WHEN tau - score < 0 THEN 1 WHEN tau - score < 0.25 THEN 2 ELSE 3 END)"
    return f"""{out}_s AS (SELECT *, {q.TAU_BIN.format(t="tau")} AS tb, {gap_bin} AS gb, CASE WHEN score >= tau THEN 1 ELSE -1 END AS side FROM {rows}),
{out}_a AS (SELECT * FROM (VALUES {values(fx.RESCUE_ROWS)}) v(anchor, tau_bin, fold_id, side, gap_bin, action)),
{out}_d AS (SELECT * FROM (VALUES {values(fx.RESCUE_DEFAULTS)}) v(anchor, tau_bin, side, action)),
{out} AS (
  SELECT s.*, coalesce(a1.action, a2.action, d1.action, d2.action, 'fallback') AS action
  FROM {out}_s s
  LEFT JOIN {out}_a a1 ON a1.anchor = 8 AND a1.tau_bin = s.tb AND a1.fold_id = s.fold_id AND a1.side = s.side AND a1.gap_bin = s.gb
  LEFT JOIN {out}_a a2 ON a2.anchor = -1 AND a2.tau_bin = s.tb AND a2.fold_id = s.fold_id AND a2.side = s.side AND a2.gap_bin = s.gb
  LEFT JOIN {out}_d d1 ON d1.anchor = 8 AND d1.tau_bin = s.tb AND d1.side = s.side
  LEFT JOIN {out}_d d2 ON d2.anchor = -1 AND d2.tau_bin = s.tb AND d2.side = s.side)"""


def _rescue_sql() -> str:
    parts = [
        BASE2,
        q.prefix("c2", fx.ANCHOR_CHECKPOINTS, "p0"),
        "p AS (SELECT p0.*, t2.tau, t2.fold_id FROM p0 JOIN t2 USING (txn_id) WHERE active)",
        q.bands(fx.ANCHOR_CHECKPOINTS),
        q.certified("p", "k"),
        q.first_cert("k", "ac"),
        "op AS (SELECT txn_id, fold_id, tau, score FROM p WHERE slot = 1 AND txn_id NOT IN (SELECT txn_id FROM ac))",
        rescue_action_sql("op", "act"),
        q.bands(fx.RESCUE_CHECKPOINTS).replace("bands AS", "rbands AS", 1),
    ]
    orders = {"run_reject_rescue": ("j", "(t + 8) % 16"), "run_refer_rescue": ("f", "CASE WHEN t >= 8 THEN 15 - t ELSE t + 8 END")}
    for action, (s, pos) in orders.items():
        parts += [
            f"{s}l AS (SELECT c2.txn_id, c2.leaf, {pos} AS pos, act.score AS s0, act.tau, act.fold_id FROM c2 JOIN act USING (txn_id) WHERE act.action = '{action}')",
            f"""{s}p AS (SELECT l.txn_id, c.slot, c.checkpoint, any_value(s0) + sum(leaf) AS score, any_value(tau) AS tau, any_value(fold_id) AS fold_id
  FROM {s}l l JOIN (VALUES (0, 2), (1, 4)) c(slot, checkpoint) ON l.pos < c.checkpoint GROUP BY l.txn_id, c.slot, c.checkpoint)""",
            q.certified(f"{s}p", f"{s}k").replace("JOIN bands", "JOIN rbands").replace("FROM bands", "FROM rbands"),
            q.first_cert(f"{s}k", f"{s}c"),
        ]
    want = {"run_reject_rescue": 1, "run_refer_rescue": 0}
    union = " UNION ALL ".join(
        f"""SELECT a.txn_id, {want[a]} AS want, c.checkpoint, c.outcome, c.route_score, coalesce(c.checkpoint, 4) AS used,
     coalesce(c.score, z.score) AS stop_score, '{s}' AS way
   FROM act a LEFT JOIN {s}c c USING (txn_id) JOIN {s}p z ON z.txn_id = a.txn_id AND z.slot = 1 WHERE a.action = '{a}'"""
        for a, (s, _) in orders.items()
    )
    parts += [
        f"rs AS ({union})",
        "rok AS (SELECT * FROM rs WHERE outcome = want)",
        """tl AS (
  SELECT a.txn_id, coalesce(rs.stop_score, a.score) + coalesce(sum(c2.leaf), 0) AS tail, count(c2.leaf) AS visits
  FROM act a LEFT JOIN rs USING (txn_id) LEFT JOIN c2 ON c2.txn_id = a.txn_id AND c2.pos >= 8
    AND (rs.way IS NULL OR (rs.way = 'j' AND c2.t - 8 >= rs.used) OR (rs.way = 'f' AND 15 - c2.t >= rs.used))
  WHERE a.txn_id NOT IN (SELECT txn_id FROM rok) GROUP BY a.txn_id, rs.stop_score, a.score)""",
    ]
    return (
        q.with_(*parts)
        + """SELECT s.txn_id, coalesce(ac.score, rs.stop_score, a.score) AS prefix_score,
  CASE WHEN NOT s.active THEN 0 WHEN ac.txn_id IS NOT NULL THEN ac.checkpoint ELSE 8 + coalesce(rs.used, 0) END AS prefix_trees_used,
  coalesce(ac.outcome, rok.outcome, 0) AS shadow_reject,
  coalesce(ac.outcome, rok.outcome, CASE WHEN tl.tail >= s.tau THEN 1 ELSE 0 END) AS final_reject,
  CASE WHEN tl.txn_id IS NULL THEN 0 ELSE 1 END AS fallback_used,
  coalesce(ac.checkpoint, 0) AS anchor_checkpoint, coalesce(rok.checkpoint, 0) AS rescue_checkpoint,
  CASE WHEN a.action IS NULL THEN 0 WHEN a.action = 'fallback' THEN 1 WHEN a.action = 'run_reject_rescue' THEN 2 ELSE 3 END AS rescue_route,
  CASE WHEN tl.txn_id IS NULL THEN 0 WHEN a.action = 'fallback' THEN 8 ELSE 4 END AS fallback_entry_checkpoint,
  coalesce(ac.route_score, rok.route_score, tl.tail) AS route_score, coalesce(tl.visits, 0) AS exact_visits
FROM t2 s LEFT JOIN ac USING (txn_id) LEFT JOIN act a USING (txn_id) LEFT JOIN rs USING (txn_id) LEFT JOIN rok USING (txn_id) LEFT JOIN tl USING (txn_id)"""
    )


@query(
    "anchor_rescue",
    "txn_id:l, prefix_score:d, prefix_trees_used:l, shadow_reject:l, final_reject:l, fallback_used:l, anchor_checkpoint:l, "
    "rescue_checkpoint:l, rescue_route:l, fallback_entry_checkpoint:l, route_score:d, exact_visits:l",
    _rescue_sql(),
)
def anchor_rescue(spark, d):
    return anchor_run(spark, d)


@query(
    "packet_cascade",
    "txn_id:l, prefix_score:d, prefix_trees_used:l, shadow_reject:l, final_reject:l, fallback_used:l, direct_checkpoint:l, "
    "route_score:d, exact_visits:l, packets:s",
)
def packet_cascade(spark, d):
    rows = X.packet_cascade(tier_two(spark, d), bundle(spark), fx.PACKETS, fx.packet_policy(spark), F.col("active"))
    return rows.withColumn("packets", F.array_join(F.col("packets").cast("array<string>"), ","))


def cascade_run(spark: SparkSession, d: str, policy=None) -> DataFrame:
    return C.cascade(
        txn(spark, d).drop("tau"), fx.model(spark, "l1"), fx.L1_THRESHOLD, fx.model(spark, "l2"), fx.TXN_FEATURES, fx.L2_FEATURES,
        fx.global_tau(spark), fx.segment_tau(spark), policy=policy,
    )


TAU_SQL = """tau2 AS (
  SELECT t2.txn_id, CASE WHEN fold_id IN (1, 2) THEN fold_id ELSE 1 END AS fold_used,
         coalesce(l2_tau_used, CASE WHEN fold_id <> 2 THEN CASE seg_prod_amtbin WHEN 0 THEN 0.125 WHEN 1 THEN 0.1875 WHEN 2 THEN 0.3125 END END,
                  CASE WHEN fold_id = 2 THEN 0.375 ELSE 0.25 END) AS tau FROM t2)"""
# Tier one, tier two and the decision of every row, tier two as an exact early exit.
CASCADE = ",\n".join(
    [
        BASE2,
        TAU_SQL,
        "l2in AS (SELECT tau2.* FROM tau2 JOIN t2 USING (txn_id) WHERE t2.l1_score < 0.125)",
        q.route("l2", "c2", "l2in", "tau", "r2"),
        """cas AS (
  SELECT t2.txn_id, t2.priority, t2.fold_id, t2.label, t2.l1_score, r2.score AS l2_score, coalesce(r2.score, t2.l1_score) AS final_score, tau2.tau,
         CASE WHEN r2.txn_id IS NULL THEN 0 ELSE 1 END AS used_l2,
         CASE WHEN r2.txn_id IS NULL THEN 'allow' WHEN r2.pass = 1 THEN 'deny' ELSE 'manual_review' END AS decision,
         CASE WHEN r2.txn_id IS NULL THEN 0 WHEN r2.pass = 1 THEN 1 ELSE 2 END AS code
  FROM t2 JOIN tau2 USING (txn_id) LEFT JOIN r2 USING (txn_id))""",
    ]
)


@query(
    "cascade_decisions", "priority:s, rows:l, used_l2:l, allow:l, deny:l, review:l, score_sum:d",
    q.with_(CASCADE)
    + """SELECT priority, count(*) AS rows, sum(used_l2) AS used_l2, sum(CASE WHEN decision = 'allow' THEN 1 ELSE 0 END) AS allow,
  sum(CASE WHEN decision = 'deny' THEN 1 ELSE 0 END) AS deny, sum(CASE WHEN decision = 'manual_review' THEN 1 ELSE 0 END) AS review,
  sum(final_score) AS score_sum FROM cas GROUP BY priority""",
)
def cascade_decisions(spark, d):
    """Flagship: both tiers over all orders, decisions by order priority."""
    done = F.col("decision")
    return cascade_run(spark, d).groupBy("priority").agg(
        F.count("*").alias("rows"),
        F.count_if("used_l2").alias("used_l2"),
        F.count_if(done == "allow").alias("allow"),
        F.count_if(done == "deny").alias("deny"),
        F.count_if(done == "manual_review").alias("review"),
        F.sum(F.col("final_score").cast("double")).alias("score_sum"),
    )


@query("cascade_rows", "txn_id:l, l1_score:d, l2_score:d, final_score:d, tau:d, used_l2:l, decision:s", q.with_(CASCADE) + "SELECT * FROM cas")
def cascade_rows(spark, d):
    return cascade_run(spark, d)


@query(
    "cascade_approx", "decision:s, rows:l, l1_sum:d",
    q.with_(q.TXN, L1_NODES, q.leaves("l1", "txn", "c1"), q.route("l1", "c1", "txn", "0.125", "a1", policy=fx.L1_POLICY),
            "t2 AS (SELECT txn.* EXCLUDE (features), list_append(features, CAST(a1.score AS FLOAT)) AS features, a1.score AS l1_score, a1.pass FROM txn JOIN a1 USING (txn_id))",
            L2_NODES, q.leaves("l2", "t2", "c2"), q.bands(), TAU_SQL,
            "p0x AS (SELECT 1)", q.prefix("c2", fx.CHECKPOINTS, "p0"),
            "p AS (SELECT p0.*, tau2.tau, tau2.fold_used AS fold_id FROM p0 JOIN tau2 USING (txn_id))",
            "t3 AS (SELECT t2.txn_id, t2.pass, t2.l1_score, tau2.tau, t2.pass = 0 AS active FROM t2 JOIN tau2 USING (txn_id))",
            q.certified("p", "k"), cascade_sql(rows="t3"))
    + """SELECT CASE WHEN t3.pass = 1 THEN 'allow' WHEN f.final_reject = 1 THEN 'deny' ELSE 'manual_review' END AS decision,
 count(*) AS rows, sum(t3.l1_score) AS l1_sum FROM t3 JOIN f USING (txn_id) GROUP BY 1""",
)
def cascade_approx(spark, d):
    """Calibrated early exits in tier one and the prefix cascade in tier two."""
    rows = C.cascade(
        txn(spark, d).drop("tau"), fx.model(spark, "l1"), fx.L1_THRESHOLD, bundle(spark), fx.TXN_FEATURES, fx.L2_FEATURES,
        fx.global_tau(spark), fx.segment_tau(spark), policy=fx.L1_POLICY,
    )
    return rows.groupBy("decision").agg(F.count("*").alias("rows"), F.sum(F.col("l1_score").cast("double")).alias("l1_sum"))


SIDE_OF = "(txn.txn_id * 7 + 3) % (SELECT count(*) FROM txn)"


@query(
    "cascade_sidecar", "txn_id:l, used_l2:l, l2_score:d, decision:s",
    q.with_(q.TXN, L1_SCORES, "side AS (SELECT txn_id AS side_idx, features FROM txn)",
            f"sv AS (SELECT txn.txn_id, txn.l2_tau_used AS own, side.features, txn.tau FROM txn JOIN s1 USING (txn_id) JOIN side ON side.side_idx = {SIDE_OF} WHERE s1.score < 0.125)",
            q.nodes("seg_b"), q.leaves("seg_b", "sv", "c2"), q.route("seg_b", "c2", "sv", "tau", "r"))
    + """SELECT txn.txn_id, CASE WHEN r.txn_id IS NULL THEN 0 ELSE 1 END AS used_l2, r.score AS l2_score,
  CASE WHEN r.txn_id IS NULL THEN 'allow' WHEN r.pass = 1 THEN 'deny' ELSE 'manual_review' END AS decision FROM txn LEFT JOIN r USING (txn_id)""",
)
def cascade_sidecar(spark, d):
    """Tier-two vectors from another order: the whole table is the side."""
    rows = txn(spark, d).withColumn("row_idx", F.col("txn_id") * 7 + 3).withColumn("l2_tau_used", F.col("tau"))
    side = fx.transactions(spark, d).select(F.col("txn_id").alias("side_idx"), "features")
    n_side = fx.table(spark, d, "orders").count()
    return C.cascade_sidecar(rows.drop("tau"), fx.model(spark, "l1"), fx.L1_THRESHOLD, fx.model(spark, "seg_b"), side, n_side)


def _dispatch_sql() -> str:
    parts = [q.TXN]
    runs = []
    for slot, (name, mode) in enumerate((("l1", "tau"), ("seg_a", "zero"), ("seg_b", "tau"))):
        rows = f"d{slot}"
        parts += [
            f"{rows} AS (SELECT * FROM txn WHERE active AND slot_id = {slot})",
            q.nodes(name),
            q.leaves(name, rows, f"dl{slot}"),
            q.route(name, f"dl{slot}", rows, "tau" if mode == "tau" else "0", f"dr{slot}"),
        ]
        runs.append(f"SELECT * FROM dr{slot}")
    parts.append("dr AS (" + " UNION ALL ".join(runs) + ")")
    parts.append(
        """disp AS (SELECT txn.txn_id, txn.label, txn.slot_id, txn.active, dr.score AS route_score, coalesce(dr.pass, 0) AS reject, coalesce(dr.visited, 0) AS visited_trees
  FROM txn LEFT JOIN dr USING (txn_id))"""
    )
    return ",\n".join(parts)


DISPATCH = _dispatch_sql()


def dispatch_run(spark: SparkSession, d: str) -> DataFrame:
    experts = [(fx.model(spark, "l1"), "tau"), (fx.model(spark, "seg_a"), "zero"), (fx.model(spark, "seg_b"), "tau")]
    return X.dispatch_experts(txn(spark, d), experts, F.col("active"))


@query("expert_dispatch", "txn_id:l, route_score:d, reject:l, visited_trees:l", q.with_(DISPATCH) + "SELECT * FROM disp")
def expert_dispatch(spark, d):
    return dispatch_run(spark, d)


@query("gather_l2", "txn_id:l, feature:l, value:d", q.with_(q.TXN, L1_SCORES, T2) + "SELECT txn_id, i AS feature, features[i + 1] AS value FROM t2 CROSS JOIN (SELECT unnest(range(9)) AS i)")
def gather_l2(spark, d):
    return tier_two(spark, d).select("txn_id", F.posexplode("features").alias("feature", "value"))


@query(
    "l1_survivors", "txn_id:l, score:d", q.with_(q.TXN, L1_SCORES) + "SELECT txn_id, score FROM s1 WHERE score < 0.125"
)
def l1_survivors(spark, d):
    rows = C.tier_one(fx.transactions(spark, d), fx.model(spark, "l1"), fx.L1_THRESHOLD)
    return C.l1_survivors(rows).select("txn_id", "l1.score")


@query(
    "active_rows", "txn_id:l, score:s, pass:l, visited:l",
    q.with_(q.TXN, L1_NODES, q.leaves("l1", "txn", "c"), q.route("l1", "c", "txn", "tau", "r"))
    + "SELECT txn_id, CASE WHEN active THEN printf('%.9f', r.score) ELSE 'NaN' END AS score, CASE WHEN active THEN pass ELSE 0 END AS pass, CASE WHEN active THEN visited ELSE 0 END AS visited FROM txn JOIN r USING (txn_id)",
)
def active_rows(spark, d):
    from tierscore.functions.scalars import fixed9

    r = T.score_route(F.col("features"), F.col("tau"), fx.model(spark, "l1"))
    rows = txn(spark, d).withColumn("r", r).select("txn_id", "active", "r.score", "r.pass", "r.visited")
    return C.mask_inactive(rows).withColumn("score", fixed9(F.col("score")))


@query(
    "reason_rows", "txn_id:l, decision:s, signal:s, value:d, has_trace:l",
    q.with_(CASCADE) + "SELECT txn_id, decision, 'l1_score' AS signal, l1_score AS value, 1 AS has_trace FROM cas UNION ALL SELECT txn_id, decision, 'l2_score', coalesce(l2_score, 0), 1 FROM cas",
)
def reason_rows(spark, d):
    rows = C.score_response(cascade_run(spark, d))
    rows = rows.withColumn("has_trace", (F.length("trace_id") == 36).cast("int"))
    return rows.select("txn_id", "decision", "has_trace", F.explode("reason").alias("r")).select("*", "r.*")


def decided(spark: SparkSession, d: str) -> DataFrame:
    """Cascade rows with the numeric decision code."""
    return cascade_run(spark, d).withColumn("code", decision_code(F.col("decision")))
