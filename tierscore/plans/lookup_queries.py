"""Registered queries of the binning, lookup and sampling operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscore.functions import bins as B
from tierscore.functions import scalars as S
from tierscore.operators import cascade as C
from tierscore.operators import lookups as L
from tierscore.operators import trees as T
from tierscore.operators.skew import dense_index, inline_table
from tierscore.plans import fixtures as fx
from tierscore.plans import sql as q
from tierscore.plans.registry import query
from tierscore.plans.scoring import P2, TAU_SQL, rescue_action_sql, tier_two, txn

# Cut points per transaction feature, on the grid of the model thresholds.
CUTS = tuple(
    tuple(lo + span * k / 16.0 for k in (2, 5, 9, 14)) for lo, span in zip(fx.FEATURE_LOW[:8], fx.FEATURE_SPAN[:8])
)
CUT_SQL = "[" + ", ".join(q.list_of(c) for c in CUTS) + "]"


def after_stale(side: DataFrame, **wrong: Column) -> DataFrame:
    """A side table whose keys all had other values in earlier rows: the last row of a key must win."""
    now = side if "ord" in side.columns else side.withColumn("ord", F.lit(0))
    return now.unionByName(now.withColumns({"ord": F.col("ord") - 1_000, **{c: v.cast(dict(side.dtypes)[c]) for c, v in wrong.items()}}))


@query(
    "feature_ranks", "txn_id:l, feature:l, rank:l, missing:l",
    q.with_(q.TXN)
    + f"""SELECT txn_id, i AS feature, CASE WHEN features[i + 1] IS NULL THEN 0 ELSE len([c for c in {CUT_SQL}[i + 1] if c <= features[i + 1]]) END AS rank,
  CASE WHEN features[i + 1] IS NULL THEN 1 ELSE 0 END AS missing FROM txn CROSS JOIN (SELECT unnest(range(8)) AS i)""",
)
def feature_ranks(spark, d):
    ranks, missing = B.rank_features(F.col("features"), CUTS)
    rows = fx.transactions(spark, d).select("txn_id", F.arrays_zip(ranks.alias("rank"), missing.alias("missing")).alias("z"))
    return rows.select("txn_id", F.posexplode("z").alias("feature", "z")).select("txn_id", "feature", "z.*")


GAP = "CAST(o_totalprice / 65536e0 - 4 AS FLOAT)"
TOL = "greatest(CAST(1e-6 AS FLOAT), CAST(8 * 2e0 ** -23 AS FLOAT) * greatest(abs(gap), CAST(1 AS FLOAT)))"


@query(
    "gap_bins", "txn_id:l, gap:d, bin:l, lo:l, hi:l, tau_bin:l",
    f"""WITH g AS (SELECT o_orderkey AS txn_id, CASE WHEN o_orderkey % 5 = 0 THEN CAST((o_orderkey % 280 - 140) / 32e0 AS FLOAT) ELSE {GAP} END AS gap, o_orderkey FROM orders),
b AS (SELECT *, {q.GAP_BIN.format(g="gap")} AS bin, {q.TAU_BIN.format(t="gap")} AS tau_bin FROM g)
SELECT txn_id, gap, bin, tau_bin,
  CASE WHEN bin > 0 AND abs(gap - CAST((bin - 128) / 32e0 AS FLOAT)) <= {TOL} THEN bin - 1 ELSE bin END AS lo,
  CASE WHEN bin + 1 < 256 AND abs(CAST((bin - 127) / 32e0 AS FLOAT) - gap) <= {TOL} THEN bin + 1 ELSE bin END AS hi FROM b""",
)
def gap_bins(spark, d):
    key = F.col("o_orderkey")
    on_edge = ((key % 280 - 140) / F.lit(32.0)).cast("float")
    gap = F.when(key % 5 == 0, on_edge).otherwise((F.col("o_totalprice") / 65536.0 - 4).cast("float"))
    rows = fx.table(spark, d, "orders").select(key.alias("txn_id"), gap.alias("gap"))
    rows = rows.withColumn("bin", B.bin_by_edges(F.col("gap"), fx.GAP_EDGES))
    lo, hi = B.guard_bins(F.col("gap"), fx.GAP_EDGES, F.col("bin"))
    tau_bin = B.bin_by_edges(F.col("gap"), fx.TAU_EDGES)
    return rows.select("txn_id", "gap", "bin", lo.alias("lo"), hi.alias("hi"), tau_bin.alias("tau_bin"))


@query(
    "segment_key", "txn_id:l, seg_key:s, own_key:s",
    q.with_(q.TXN)
    + r"""SELECT txn_id, coalesce(CAST(features[2] AS BIGINT)::VARCHAR, 'NA') || '|' || coalesce(CAST(features[6] AS BIGINT)::VARCHAR, 'NA') || '|' ||
  coalesce(CASE WHEN x - floor(x) <= 1e-9 THEN CAST(CAST(trunc(x) AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.15f', x), '0'), '.') END, 'NA') AS seg_key,
  CASE WHEN txn_id % 2 = 0 THEN CAST(seg_prod_amtbin AS VARCHAR) ELSE coalesce(CAST(features[2] AS BIGINT)::VARCHAR, 'NA') END AS own_key
FROM (SELECT *, CAST(features[3] AS DOUBLE) / 64 AS x FROM txn)""",
)
def segment_key(spark, d):
    f = lambda i: F.get("features", F.lit(i))
    key = S.segment_key([f(1), f(5), (f(2).cast("double") / 64).cast("float")])
    own = S.segment_key([f(1)], F.when(F.col("txn_id") % 2 == 0, F.col("seg_prod_amtbin")))
    return txn(spark, d).select("txn_id", key.alias("seg_key"), own.alias("own_key"))


@query("sample_ppm", "txn_id:l, kind:s", "SELECT o_orderkey AS txn_id, 'nth' AS kind FROM orders WHERE o_orderkey % 16 = 0 UNION ALL SELECT o_orderkey, 'all' FROM orders")
def sample_ppm(spark, d):
    """Every 16th row, and a parts-per-million sample of all of a million."""
    ids = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("txn_id"))
    nth = ids.where(S.every_nth(F.col("txn_id"), 16)).withColumn("kind", F.lit("nth"))
    return nth.unionByName(ids.where(S.sampled_ppm(F.col("txn_id"), S.PPM)).withColumn("kind", F.lit("all")))


@query("sample_rate", "sampled:l, repeatable:l")
def sample_rate(spark, d):
    """Rows of a 250,000 ppm sample over all line items, and whether a second draw agrees."""
    ids = fx.table(spark, d, "lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"))
    draw = S.sampled_ppm(F.col("id"), 250_000)
    return ids.agg(F.count_if(draw).alias("sampled"), (F.count_if(draw) == F.count_if(S.sampled_ppm(F.col("id"), 250_000))).alias("repeatable"))


@query(
    "scalar_helpers", "event_id:l, p:d, c:d",
    "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 50)), 9) AS p, greatest(least(value / 100, 1), 0) AS c FROM events",
)
def scalar_helpers(spark, d):
    v = F.col("value")
    return fx.table(spark, d, "events").select("event_id", F.round(S.sigmoid((v - 50) / 50), 9).alias("p"), S.clamp01(v / 100).alias("c"))


@query(
    "score_bands", "event_type:s, band:s, n:l",
    """SELECT event_type, CASE WHEN s >= 0.85 THEN 'deny' WHEN s >= 0.65 THEN 'review' WHEN s > 0.35 AND s < 0.65 THEN 'uncertain' ELSE 'clear' END AS band,
  count(*) AS n FROM (SELECT event_type, value / 500 AS s FROM events) GROUP BY 1, 2""",
)
def score_bands(spark, d):
    rows = fx.table(spark, d, "events").select("event_type", S.score_band(F.col("value") / 500).alias("band"))
    return rows.groupBy("event_type", "band").agg(F.count("*").alias("n"))


@query(
    "validation_report", "feature_rows:l, meta_rows:l, without_meta:l, without_features:l, wrong_width:l, repeated_features:l, repeated_meta:l, first_offender:l",
    """SELECT count(f) AS feature_rows, sum(coalesce(n, 0)) AS meta_rows, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS without_meta,
  sum(CASE WHEN f IS NULL THEN n ELSE 0 END) AS without_features, 0 AS wrong_width, 0 AS repeated_features,
  sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS repeated_meta, min(CASE WHEN f IS NULL OR n IS NULL OR n > 1 THEN id END) AS first_offender
FROM (SELECT coalesce(f, m) AS id, f, n FROM (SELECT o_orderkey AS f FROM orders) FULL JOIN (SELECT l_orderkey AS m, count(*) AS n FROM lineitem GROUP BY 1) ON f = m)""",
)
def validation_report(spark, d):
    """Orders with features against the order ids of all line items, most of them repeated."""
    meta = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn_id"))
    return C.validation_report(fx.transactions(spark, d), meta, 8)


@query("row_meta_join", "txn_id:l, fold_id:l, active:l, " + ", ".join(f"f{i}:d" for i in range(8)), q.with_(q.TXN) + "SELECT txn_id, fold_id, active, " + ", ".join(f"features[{i + 1}] AS f{i}" for i in range(8)) + " FROM txn")
def row_meta_join(spark, d):
    feats = fx.transactions(spark, d).select("txn_id", "features")
    joined = L.join_row_meta(feats, fx.route_meta(spark, d))
    return joined.select("txn_id", "fold_id", "active", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(8)])


@query("resolve_tau", "txn_id:l, fold_used:l, tau:d", q.with_("t2 AS (SELECT o_orderkey AS txn_id, o_orderkey % 3 + 1 AS fold_id, o_orderkey % 5 AS seg_prod_amtbin, CASE WHEN o_orderkey % 7 = 0 THEN 0.25 END AS l2_tau_used FROM orders)", TAU_SQL) + "SELECT * FROM tau2")
def resolve_tau(spark, d):
    meta = fx.route_meta(spark, d).withColumn("seg_key", F.col("seg_prod_amtbin").cast("string"))
    seg, fold = (after_stale(t, tau=F.lit(9.5)) for t in (fx.segment_tau(spark), fx.global_tau(spark)))
    return L.resolve_tau(meta, seg, fold)


def long_prefix(spark, d):
    """Tier-two prefix scores in long form with tau and fold."""
    rows = tier_two(spark, d).withColumn("s", T.prefix_scores(F.col("features"), fx.model(spark, "l2"), fx.CHECKPOINTS))
    cps = F.array(*[F.lit(c) for c in fx.CHECKPOINTS])
    zipped = F.explode(F.arrays_zip(cps.alias("checkpoint"), F.col("s").alias("score"))).alias("z")
    return rows.select("txn_id", "tau", "fold_id", zipped).select("txn_id", "tau", "fold_id", "z.*")


@query(
    "band_lookup", "txn_id:l, checkpoint:l, tau_bin:l, gap_bin:l, ref_hi:d, rej_lo:d",
    q.with_(P2, q.band_limits("p", "bl")) + "SELECT txn_id, checkpoint, tau_bin, gap_bin, ref_hi, rej_lo FROM bl",
)
def band_lookup(spark, d):
    rows = long_prefix(spark, d).withColumn("gap", F.col("tau") - F.col("score"))
    cal = fx.calibration(spark)
    return L.lookup_bands(rows, replace(cal, bands=after_stale(cal.bands, ref_hi=F.lit(7.0), rej_lo=F.lit(-7.0))))


CLUSTER = q.cluster_expr("(tau - score)", "dp", "0")
CLUSTER_SQL = (
    q.with_(P2, q.atlas_cells(), "dlt AS (SELECT *, score - coalesce(lag(score) OVER (PARTITION BY txn_id ORDER BY slot), 0) AS dp FROM p)")
    + f"""SELECT c.txn_id, c.checkpoint, c.cluster_id, c.tau_bin, c.gap_bin, coalesce(cells.cell, 0) AS cell
FROM (SELECT *, {CLUSTER} AS cluster_id, {q.TAU_BIN.format(t="tau")} AS tau_bin, {q.GAP_BIN.format(g="(tau - score)")} AS gap_bin FROM dlt) c
LEFT JOIN cells USING (checkpoint, tau_bin, cluster_id, gap_bin)"""
)


def clustered(spark, d):
    from tierscore.operators.certify import checkpoint_features

    rows = checkpoint_features(long_prefix(spark, d))
    at = fx.atlas(spark)
    cluster = F.lit(None).cast("int")
    for c in at.checkpoints:
        own = L.nearest_cluster(c, F.col("gap"), F.col("delta_prev"), F.col("delta_64"))
        cluster = F.when(F.col("checkpoint") == c.checkpoint, own).otherwise(cluster)
    rows = rows.withColumn("cluster_id", cluster).withColumn("tau_bin", at.tau_bin(F.col("tau")))
    return rows.withColumn("gap_bin", B.bin_by_edges(F.col("gap"), fx.GAP_EDGES)), at


@query("atlas_cluster", "txn_id:l, checkpoint:l, cluster_id:l", "SELECT txn_id, checkpoint, cluster_id FROM (" + CLUSTER_SQL + ")")
def atlas_cluster(spark, d):
    return clustered(spark, d)[0]


@query("atlas_lookup", "txn_id:l, checkpoint:l, cluster_id:l, tau_bin:l, gap_bin:l, cell:l", CLUSTER_SQL)
def atlas_lookup(spark, d):
    rows, at = clustered(spark, d)
    return L.lookup_atlas(rows, at.cells)


RESCUE_IN = "op AS (SELECT o_orderkey AS txn_id, o_orderkey % 3 + 1 AS fold_id, (o_orderkey % 9 - 2) / 16e0 AS tau, (o_orderkey % 37 - 18) / 32e0 AS score FROM orders)"


@query("rescue_route", "txn_id:l, tau_bin:l, gap_bin:l, side:l, action:s, code:l",
       q.with_(RESCUE_IN, rescue_action_sql("op", "act")) + "SELECT txn_id, tb AS tau_bin, gb AS gap_bin, side, action, CASE action WHEN 'fallback' THEN 1 WHEN 'run_reject_rescue' THEN 2 ELSE 3 END AS code FROM act")
def rescue_route(spark, d):
    key = F.col("o_orderkey")
    rows = fx.table(spark, d, "orders").select(
        key.alias("txn_id"), (key % 3 + 1).cast("int").alias("fold_id"), ((key % 9 - 2) / F.lit(16.0)).cast("float").alias("tau"),
        ((key % 37 - 18) / F.lit(32.0)).cast("float").alias("prefix"), F.lit(8).alias("anchor"),
    )
    actions = after_stale(inline_table(spark, fx.RESCUE_ROW_SCHEMA, fx.RESCUE_ROWS), action=F.lit("stale"))
    defaults = after_stale(inline_table(spark, fx.RESCUE_DEFAULT_SCHEMA, fx.RESCUE_DEFAULTS), action=F.lit("stale"))
    out = L.lookup_rescue(rows, actions, defaults, fx.TAU_EDGES, fx.RESCUE_GAP_EDGES)
    return out.withColumn("code", L.rescue_code(F.col("action")))


@query("order_route", "route:l, route_tau_bin:l, n:l", f"SELECT 2 - {q.TAU_BIN.format(t='((o_orderkey % 9 - 2) / 16e0)')} AS route, {q.TAU_BIN.format(t='((o_orderkey % 9 - 2) / 16e0)')} AS route_tau_bin, count(*) AS n FROM orders GROUP BY 1, 2")
def order_route(spark, d):
    rows = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("txn_id")).withColumn("tau", fx.row_tau())
    routes = inline_table(spark, "tau_bin int, route int", [(i, 2 - i) for i in range(3)])
    return L.route_by_tau(rows, routes, fx.TAU_EDGES).groupBy("route", "route_tau_bin").agg(F.count("*").alias("n"))


def _policy_values() -> str:
    rows = []
    for i in range(48):
        if i % 5 != 4:
            step, rest = divmod(i, 16)
            ranking = "[" + ", ".join(str((i * 3 + k * 3) % 4) for k in range(2 + i % 3)) + "]"
            rows.append(f"({step}, {rest // 8}, {rest // 2 % 4}, {rest % 2}, {(i * 7) % 11}, {i}, {ranking})")
    return ", ".join(rows)


@query(
    "packet_choice", "id:l, packet:l",
    f"""WITH pol AS (SELECT * FROM (VALUES {_policy_values()}) v(step, tau_bin, gap_bin, delta_bin, row_count, ord, ranking)),
li AS (SELECT l_orderkey * 16 + l_linenumber AS id, l_linenumber % 4 AS step, l_suppkey % 3 AS tau_bin, l_partkey % 4 AS gap_bin, l_orderkey % 2 AS delta_bin,
         l_partkey % 5 AS u, count(*) AS n FROM lineitem GROUP BY ALL),
bt AS (SELECT step, tau_bin, arg_max(ranking, row_count * 1000 - ord) AS ranking FROM pol GROUP BY step, tau_bin),
bs AS (SELECT step, arg_max(ranking, row_count * 1000 - ord) AS ranking FROM pol GROUP BY step),
r AS (SELECT li.*, coalesce(pol.ranking, bt.ranking, bs.ranking) AS ranking FROM li LEFT JOIN pol USING (step, tau_bin, gap_bin, delta_bin)
      LEFT JOIN bt USING (step, tau_bin) LEFT JOIN bs USING (step))
SELECT id, coalesce([p for p in coalesce(ranking, []) if p <> u][1], [p for p in [0, 1, 2, 3] if p <> u][1]) AS packet FROM r""",
)
def packet_choice(spark, d):
    """Next packet for every line item: state by arithmetic, one packet already used."""
    c = F.col
    rows = fx.table(spark, d, "lineitem").select(
        (c("l_orderkey") * 16 + c("l_linenumber")).alias("id"), (c("l_linenumber") % 4).cast("int").alias("step"),
        (c("l_suppkey") % 3).cast("int").alias("tau_bin"), (c("l_partkey") % 4).cast("int").alias("gap_bin"),
        (c("l_orderkey") % 2).cast("int").alias("delta_bin"), (c("l_partkey") % 5).cast("int").alias("u"),
    ).distinct()
    policy = fx.packet_policy(spark)
    ranked = L.rank_packets(rows, replace(policy, rows=after_stale(policy.rows, ranking=F.array(F.lit(9)), row_count=F.lit(99))))
    packets = F.array(*[F.lit(i) for i in range(4)])
    return ranked.select("id", L.choose_packet(F.col("ranking"), F.array("u"), packets).alias("packet"))


SIDE_IDX = "(t.txn_id * 7 + 3) % (SELECT count(*) FROM txn)"


@query("sidecar_join", "txn_id:l, side_idx:l, f0:d", q.with_(q.TXN) + f"SELECT t.txn_id, {SIDE_IDX} AS side_idx, s.features[1] AS f0 FROM txn t LEFT JOIN txn s ON s.txn_id = {SIDE_IDX}")
def sidecar_join(spark, d):
    """Every order paired with the features of another one: the whole table is the side."""
    rows = fx.transactions(spark, d).select("txn_id", (F.col("txn_id") * 7 + 3).alias("row_idx"))
    side = fx.transactions(spark, d).select(F.col("txn_id").alias("side_idx"), "features")
    out = L.sidecar_features(rows, side, fx.table(spark, d, "orders").count())
    return out.select("txn_id", "side_idx", F.get("side_features", F.lit(0)).alias("f0"))


@query("missing_meta", "row_idx:l", "SELECT o_orderkey AS row_idx FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey < (SELECT count(*) FROM orders)")
def missing_meta(spark, d):
    """Order numbers below the row count that have no line item."""
    meta = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_idx"))
    return L.missing_meta(spark, meta, fx.table(spark, d, "orders").count())


@query(
    "atlas_grid", "tau_bin:l, cluster_id:l, gap_bin:l, count:l, cell:l",
    """SELECT tau_bin, cluster_id, gap_bin, n AS count, CASE WHEN n < 8 THEN 0 WHEN rate <= 0.3 THEN 1 WHEN rate >= 0.4 THEN 2 ELSE 0 END AS cell
FROM (SELECT l_linenumber % 3 AS tau_bin, l_suppkey % 4 AS cluster_id, l_partkey % 256 AS gap_bin, count(*) AS n,
             sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*) AS rate FROM lineitem GROUP BY 1, 2, 3)""",
)
def atlas_grid(spark, d):
    """Cells counted from the line items: reject rate and row count per cell, then the decision."""
    c = F.col
    cells = fx.table(spark, d, "lineitem").groupBy(
        (c("l_linenumber") % 3).alias("tau_bin"), (c("l_suppkey") % 4).alias("cluster_id"), (c("l_partkey") % 256).alias("gap_bin")
    ).agg(F.count("*").alias("count"), (F.count_if(c("l_returnflag") == "R") / F.count("*")).alias("rate"))
    return cells.withColumn("cell", L.cell_decision(c("count"), c("rate"), 8, 0.3, 0.4))


@query(
    "packet_defaults", "level:s, step:l, tau_bin:l, ranking:s",
    """WITH pol AS (SELECT l_linenumber % 3 AS step, l_suppkey % 4 AS tau_bin, l_partkey % 8 AS gap_bin, l_orderkey % 4 AS delta_bin, count(*) AS n FROM lineitem GROUP BY ALL),
o AS (SELECT *, ((step * 4 + tau_bin) * 8 + gap_bin) * 4 + delta_bin AS ord FROM pol),
r AS (SELECT *, concat_ws(',', ord % 5, (ord + 2) % 5, (ord + 4) % 5) AS ranking FROM o)
SELECT 'step_tau' AS level, step, tau_bin, arg_max(ranking, n * 1000 - ord) AS ranking FROM r GROUP BY step, tau_bin
UNION ALL SELECT 'step', step, -1, arg_max(ranking, n * 1000 - ord) FROM r GROUP BY step""",
)
def packet_defaults(spark, d):
    """Default rankings from policy rows whose counts come from the line items."""
    c = F.col
    pol = fx.table(spark, d, "lineitem").groupBy(
        (c("l_linenumber") % 3).cast("bigint").alias("step"), (c("l_suppkey") % 4).alias("tau_bin"), (c("l_partkey") % 8).alias("gap_bin"),
        (c("l_orderkey") % 4).alias("delta_bin"),
    ).agg(F.count("*").alias("row_count"))
    ord_ = ((c("step") * 4 + c("tau_bin")) * 8 + c("gap_bin")) * 4 + c("delta_bin")
    pol = pol.withColumn("ord", ord_).withColumn("ranking", F.array(c("ord") % 5, (c("ord") + 2) % 5, (c("ord") + 4) % 5))
    by_tau, by_step = L.policy_defaults(pol)
    both = by_tau.withColumn("level", F.lit("step_tau")).unionByName(
        by_step.withColumn("level", F.lit("step")).withColumn("tau_bin", F.lit(-1).cast("bigint"))
    )
    return both.withColumn("ranking", F.array_join(F.col("ranking").cast("array<string>"), ","))


@query("row_limit", "txn_id:l, row_idx:l", "SELECT * FROM (SELECT o_orderkey AS txn_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders) WHERE row_idx < 1000")
def row_limit(spark, d):
    """First 1000 rows in file order: a filter on the dense row index."""
    ids = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("txn_id"))
    return dense_index(ids, "txn_id", "row_idx").where("row_idx < 1000")


@query(
    "spaced_sample", "txn_id:l",
    """WITH a AS (SELECT o_orderkey AS txn_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders WHERE o_orderkey % 10 <> 0)
SELECT a.txn_id FROM a WHERE a.i IN (SELECT (s * a2.n) // least(256, a2.n) FROM (SELECT DISTINCT n FROM a) a2 CROSS JOIN (SELECT unnest(range(256)) AS s) WHERE s < least(256, a2.n))""",
)
def spaced_sample(spark, d):
    from tierscore.operators.sampling import spaced_sample as pick

    active = fx.route_meta(spark, d).where("active").select("txn_id")
    return pick(active, "txn_id", 256)


# --- model tables derived from the parts: one model per brand, one stump per part ------------

PART_NODES = """pn AS (
  SELECT p_brand AS model, p_partkey AS tree_id, n AS node_id, n > 0 AS is_leaf, CASE WHEN n = 0 THEN p_size % 8 END AS fidx,
         CASE WHEN n = 0 THEN CAST(p_retailprice AS FLOAT) END AS thr, CASE n WHEN 1 THEN (p_partkey % 41 - 20) / 64e0 WHEN 2 THEN (p_size % 23 - 9) / 64e0 END AS leaf
  FROM part CROSS JOIN (SELECT unnest(range(3)) AS n)),
ranked AS (SELECT p_brand AS model, p_partkey AS tree_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1 AS plan_pos FROM part)"""


def part_nodes(spark, d):
    """Node table with three nodes per part."""
    n, c = F.col("node_id"), F.col
    rows = fx.table(spark, d, "part").withColumn("node_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    root = n == 0
    leaf = F.when(n == 1, (c("p_partkey") % 41 - 20) / F.lit(64.0)).when(n == 2, (c("p_size") % 23 - 9) / F.lit(64.0))
    return rows.select(
        c("p_brand").alias("model"), c("p_partkey").cast("int").alias("tree_id"), "node_id",
        F.when(root, c("p_size") % 8).cast("int").alias("fidx"), F.when(root, c("p_retailprice")).cast("float").alias("thr"),
        F.when(root, 1).alias("left"), F.when(root, 2).alias("right"), F.when(root, 1 + c("p_partkey") % 2).cast("int").alias("missing"),
        leaf.cast("float").alias("leaf"), (~root).alias("is_leaf"),
    )


def part_order(spark, d):
    """Trees of a brand by falling part size: position = parts before it, counted per size."""
    from tierscore.operators.skew import chunked_running_sum

    parts = fx.table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("tree_id"), "p_size")
    place = parts.withColumn("_pos", (F.lit(1_000_000) - F.col("p_size")).cast("bigint") * F.lit(1 << 32) + F.col("tree_id"))
    ones = place.withColumn("_one", F.lit(1).cast("bigint"))
    out = chunked_running_sum(ones, ["model"], "_pos", {"plan_pos": "_one"}, inclusive=False)
    return out.select("model", F.col("tree_id").cast("int").alias("tree_id"), "plan_pos")


@query("tree_plan", "model:s, tree_id:l, plan_pos:l", q.with_(PART_NODES) + "SELECT * FROM ranked WHERE plan_pos < 60")
def tree_plan(spark, d):
    return T.tree_plan(part_nodes(spark, d), part_order(spark, d), 60)


@query(
    "suffix_bounds", "model:s, plan_pos:l, min_leaf:d, max_leaf:d, suffix_min:d, suffix_max:d",
    q.with_(PART_NODES, "bd AS (SELECT model, plan_pos, min(leaf) AS min_leaf, max(leaf) AS max_leaf FROM pn JOIN ranked USING (model, tree_id) GROUP BY 1, 2)")
    + """SELECT *, coalesce(sum(min_leaf) OVER w, 0) AS suffix_min, coalesce(sum(max_leaf) OVER w, 0) AS suffix_max FROM bd
WINDOW w AS (PARTITION BY model ORDER BY plan_pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
)
def suffix_bounds(spark, d):
    nodes = part_nodes(spark, d)
    return T.suffix_bounds(nodes, T.tree_plan(nodes, part_order(spark, d)), chunk=16)


@query("decision_labels", "decision:s, code:l, n:l", "SELECT decision, code, count(*) AS n FROM (SELECT CASE WHEN p THEN 'allow' WHEN r THEN 'deny' ELSE 'manual_review' END AS decision, CASE WHEN p THEN 0 WHEN r THEN 1 ELSE 2 END AS code FROM (SELECT o_totalprice > 200000 AS p, o_orderkey % 3 = 0 AS r FROM orders)) GROUP BY 1, 2")
def decision_labels(spark, d):
    rows = fx.table(spark, d, "orders")
    label = S.decision_label(F.col("o_totalprice") > 200000, F.col("o_orderkey") % 3 == 0)
    rows = rows.select(label.alias("decision")).withColumn("code", S.decision_code(F.col("decision")))
    return rows.groupBy("decision", "code").agg(F.count("*").alias("n"))

