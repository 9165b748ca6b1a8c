"""Registered queries of the readers and writers: Spark writes the files from the given tables
into the shared folder, the reader under test reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscore.operators import certify as X
from tierscore.operators import trees as T
from tierscore.plans import fixtures as fx
from tierscore.plans import sql as q
from tierscore.plans.lookup_queries import PART_NODES, part_nodes
from tierscore.plans.registry import REGISTRY, query
from tierscore.plans.request_queries import _window_sql, window_metrics
from tierscore.plans.scoring import CASCADE, P2, PREFIX_RUN, bundle, cascade_run, tier_two, txn
from tierscore.plans.stats_queries import infer_stats
from tierscore.session import scratch_path
from tierscore.sources import binary as SB
from tierscore.sources import files as SF
from tierscore.sources import sinks as SK


def ordered(df: DataFrame, key: str) -> DataFrame:
    """Range partitions in key order, rows sorted within: the file order is the key order."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


@query("src_dense_rows", "row_idx:l, position:l, value:d",
       "SELECT row_idx, position, embedding[position + 1] AS value FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_idx, embedding FROM embeddings) CROSS JOIN (SELECT unnest(range(64)) AS position)")
def src_dense_rows(spark, d):
    """Every element of every row, read back."""
    path = scratch_path(spark, "dense")
    SB.write_binary(ordered(fx.vectors(spark, d), "vec_id").select("features"), path, "dense")
    rows = SB.read_dense_rows(spark, path, fx.VEC_DIM, 200)
    return rows.select("row_idx", F.posexplode("features").alias("position", "value"))


@query("src_feature_table", "row_idx:l, txn_id:l, label:l, feature:l, value:d",
       q.with_(q.TXN) + "SELECT row_idx, txn_id, label, feature, features[feature + 1] AS value FROM (SELECT row_number() OVER (ORDER BY txn_id) - 1 AS row_idx, * FROM txn) CROSS JOIN (SELECT unnest(range(8)) AS feature)")
def src_feature_table(spark, d):
    """All features of every row; the file holds missing ones as NaN."""
    path = scratch_path(spark, "features")
    SB.write_binary(ordered(fx.transactions(spark, d).select("txn_id", "label", "features"), "txn_id"), path, "features")
    rows = SB.read_feature_table(spark, path, 5000)
    rows = rows.select("row_idx", "txn_id", "label", F.posexplode("features").alias("feature", "value"))
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query("src_row_meta", "txn_id:l, slot_id:l, tau_used:d, active:l, exact_positive:l",
       "SELECT o_orderkey AS txn_id, o_orderkey % 3 AS slot_id, CASE WHEN o_orderkey % 7 = 0 THEN 0.25 ELSE 0 END AS tau_used, o_orderkey % 10 <> 0 AS active, o_orderkey % 4 = 0 AS exact_positive FROM orders")
def src_row_meta(spark, d):
    meta = fx.route_meta(spark, d).select(
        "txn_id", "slot_id", F.coalesce("l2_tau_used", F.lit(0.0)).cast("float").alias("tau_used"), "active", (F.col("txn_id") % 4 == 0).alias("exact_positive")
    )
    path = scratch_path(spark, "meta")
    SB.write_binary(ordered(meta, "txn_id"), path, "dispatch_meta")
    return SB.read_row_meta(spark, path, "dispatch_meta")


@query("src_route_meta", "row_idx:l, transaction_id:l, fold_id:l, seg_prod_amtbin:l, l2_tau_used:d",
       "SELECT o_orderkey AS row_idx, o_orderkey + 1000000 AS transaction_id, o_orderkey % 3 + 1 AS fold_id, o_orderkey % 5 AS seg_prod_amtbin, CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 0.25 END AS l2_tau_used FROM orders WHERE o_orderkey % 11 <> 3")
def src_route_meta(spark, d):
    """TSV in which every 7th row is repeated later with another threshold and some lines are short."""
    meta = fx.route_meta(spark, d)
    line = lambda tau: F.concat_ws("\t", (F.col("txn_id") + 1000000).cast("string"), F.col("txn_id").cast("string"), F.col("fold_id").cast("string"), F.col("seg_prod_amtbin").cast("string"), F.lit(tau))
    short = F.concat_ws("\t", (F.col("txn_id") + 1000000).cast("string"), F.col("txn_id").cast("string"))
    lines = F.when(F.col("txn_id") % 11 == 3, F.array(short)).when(F.col("txn_id") % 7 == 0, F.array(line("0.25"), line("0.5"))).otherwise(F.array(line("0.25")))
    path = scratch_path(spark, "route-meta")
    text = meta.select(F.explode(lines).alias("TransactionID\trow_idx\tfold_id\tseg_prod_amtbin\tl2_tau_used"))
    text.write.option("header", True).option("quote", "").option("sep", "\u0001").option("escape", "").csv(path)
    return SF.read_route_meta_tsv(spark, path, 1 << 40)


@query("model_nodes", "model:s, nodes:l, leaves:l, thr_sum:d, leaf_sum:d, base:d",
       q.with_(PART_NODES) + "SELECT model, count(*) AS nodes, sum(CASE WHEN is_leaf THEN 1 ELSE 0 END) AS leaves, sum(CAST(thr AS DOUBLE)) AS thr_sum, sum(leaf) AS leaf_sum, (count(*) % 8) / 8e0 AS base FROM pn GROUP BY model")
def model_nodes(spark, d):
    """Node tables of all brands and their base scores, both written and read back."""
    path, docs = scratch_path(spark, "nodes"), scratch_path(spark, "models")
    part_nodes(spark, d).write.parquet(path)
    nodes = SF.read_tree_model(spark, path)
    sums = nodes.groupBy("model").agg(
        F.count("*").alias("nodes"), F.count_if("is_leaf").alias("leaves"),
        F.sum(F.col("thr").cast("double")).alias("thr_sum"), F.sum(F.col("leaf").cast("double")).alias("leaf_sum"),
    )
    score = F.concat(F.lit("["), (F.col("nodes") % 8 / 8.0).cast("string"), F.lit("]"))
    strict = F.to_json(F.struct(F.col("model").alias("name"), F.struct(F.struct(score.alias("base_score")).alias("learner_model_param")).alias("learner")))
    loose = F.to_json(F.struct(F.col("model").alias("name"), F.struct((F.col("nodes") % 8 / 8.0).alias("base_score")).alias("params")))
    sums.select(F.when(F.length("model") % 2 == 0, strict).otherwise(loose).alias("value")).write.text(docs)
    base = SF.read_model_base_scores(spark, docs).withColumnRenamed("base_score", "base")
    return sums.join(base, "model")


@query("policy_global_tau", "name:s, l1_threshold:d, gb_target:s, fold_id:l, tau:d, segmented:l, tau_field:s",
       """SELECT CAST(c_custkey AS VARCHAR) AS name, (c_custkey % 16) / 16e0 AS l1_threshold, '0.0005' AS gb_target, f AS fold_id, (c_custkey % 32 + f) / 64e0 AS tau,
  c_custkey % 2 = 0 AS segmented, 'tau_shrink' AS tau_field FROM customer CROSS JOIN (SELECT unnest([1, 2, 3]) AS f)""")  # fmt: skip
def policy_global_tau(spark, d):
    """One policy document per customer."""
    k = F.col("c_custkey")
    folds = F.map_from_arrays(F.array(*[F.lit(str(f)) for f in (1, 2, 3)]), F.array(*[(k % 32 + f) / F.lit(64.0) for f in (1, 2, 3)]))
    other = F.create_map(F.lit("9"), F.lit(9.0))
    doc = F.struct(
        k.cast("string").alias("name"), F.struct((k % 16 / F.lit(16.0)).alias("threshold")).alias("decision"),
        F.struct(F.create_map(F.lit("0.0005"), folds, F.lit("0.001"), other).alias("tau_global_by_fold")).alias("thresholds"),
        F.struct((k % 2 == 0).alias("enabled")).alias("segmented_threshold"),
    )
    path = scratch_path(spark, "policy")
    fx.table(spark, d, "customer").select(F.to_json(doc).alias("value")).write.text(path)
    return SF.read_policy(spark, path)


@query("segment_tau_table", "fold_id:l, seg_key:s, tau:d",
       "SELECT c_custkey % 3 + 1 AS fold_id, (c_custkey // 3) || '|' || CASE WHEN c_custkey % 4 = 0 THEN 'NA' WHEN c_custkey % 4 = 1 THEN '7' ELSE 'x' || c_nationkey END AS seg_key, (c_custkey % 64) / 64e0 AS tau FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 13 <> 0")
def segment_tau_table(spark, d):
    """One line per customer: keys to canonicalise, another target, unreadable and short lines."""
    k = F.col("c_custkey")
    second = F.when(k % 4 == 0, F.lit("  ")).when(k % 4 == 1, F.lit("7.0")).otherwise(F.concat(F.lit("x"), F.col("c_nationkey").cast("string")))
    key = F.concat((F.floor(k / 3)).cast("string"), F.lit(".0|"), second)
    tau = F.when(k % 13 == 0, F.lit("n/a")).otherwise((k % 64 / F.lit(64.0)).cast("string"))
    full = F.concat_ws("\t", (k % 3 + 1).cast("string"), F.when(k % 5 == 0, F.lit("0.001")).otherwise(F.lit("5e-4")), key, tau)
    path = scratch_path(spark, "seg-tau")
    rows = fx.table(spark, d, "customer").select(F.explode(F.array(full, F.lit("1\t0.0005"))).alias("fold\tgb_target\tseg_key\ttau_shrink"))
    rows.write.option("header", True).option("quote", "").option("sep", "\u0001").option("escape", "").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return SF.read_segment_tau(spark, path, 0.0005)


def _ramp(k, f, n: int = 256):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: f(k, b).cast("float"))


CAL_LEVELS = """SELECT NULL AS fold_id, NULL AS tau_bin, 0 AS lv UNION ALL SELECT 1, NULL, 1 UNION ALL SELECT 1, 0, 2"""


@query("calibration_bands", "variant:s, checkpoint:l, fold_id:l, tau_bin:l, gap_bin:l, gap_lo:d, ref_hi:d, rej_lo:d",
       f"""SELECT 'v' || s_suppkey AS variant, cp AS checkpoint, fold_id, tau_bin, b AS gap_bin, (b - 128) / 32e0 AS gap_lo,
  (s_suppkey % 8 + lv + b % 16) / 64e0 AS ref_hi, -(s_suppkey % 4 + lv + b % 8) / 64e0 AS rej_lo
FROM supplier CROSS JOIN (SELECT unnest([4, 8]) AS cp) CROSS JOIN ({CAL_LEVELS}) CROSS JOIN (SELECT unnest(range(256)) AS b)""")  # fmt: skip
def calibration_bands(spark, d):
    """One calibration document per supplier with two checkpoints and three levels."""
    k = F.col("s_suppkey")
    hi = lambda lv: _ramp(k, lambda k, b: (k % 8 + lv + b % 16) / F.lit(64.0)).alias("ref_hi")
    lo = lambda lv: _ramp(k, lambda k, b: -(k % 4 + lv + b % 8) / F.lit(64.0)).alias("rej_lo")
    edges = _ramp(k, lambda k, b: (b - 128) / F.lit(32.0), 257)

    def at(cp):
        return F.struct(
            F.lit(cp).alias("checkpoint"), edges.alias("gap_edges"), hi(0).alias("global_ref_hi"), lo(0).alias("global_rej_lo"),
            F.array(F.lit(-1.0), F.lit(0.25), F.lit(1.0)).alias("tau_edges"), F.array(F.struct(F.lit(1).alias("fold_id"), hi(1), lo(1))).alias("fold_tables"),
            F.array(F.struct(F.lit(1).alias("fold_id"), F.lit(0).alias("tau_bin"), hi(2), lo(2))).alias("tau_fold_tables"),
        )

    variant = F.struct(F.concat(F.lit("v"), k.cast("string")).alias("key"), F.lit(0.99).alias("ref_q"), F.lit(0.01).alias("rej_q"), F.array(at(4), at(8)).alias("tables"))
    doc = F.struct(F.lit("L2PrefixCalV2").alias("format"), F.array(F.lit(4), F.lit(8)).alias("checkpoints"), F.array(variant).alias("variants"))
    path = scratch_path(spark, "calibration")
    fx.table(spark, d, "supplier").select(F.to_json(doc).alias("value")).write.text(path)
    return SF.read_calibration(spark, path)


@query("atlas_cells", "variant:s, checkpoint:l, cluster_id:l, c0:d, cells:l, refer:l, reject:l, none:l",
       """WITH e AS (SELECT 'v' || s_suppkey AS variant, 4 AS checkpoint, cl AS cluster_id, (s_suppkey % 8 + cl) / 8e0 AS c0, b, (s_suppkey + cl * 3 + b) % 20 AS cnt, ((s_suppkey + b * 5) % 32) / 32e0 AS rate
FROM supplier CROSS JOIN (SELECT unnest(range(2)) AS cl) CROSS JOIN (SELECT unnest(range(256)) AS b)),
c AS (SELECT *, CASE WHEN cnt < 4 THEN 0 WHEN rate <= 0.125 THEN 1 WHEN rate >= 0.875 THEN 2 ELSE 0 END AS cell FROM e)
SELECT variant, checkpoint, cluster_id, c0, count(*) AS cells, count(*) FILTER (cell = 1) AS refer, count(*) FILTER (cell = 2) AS reject, count(*) FILTER (cell = 0) AS none FROM c GROUP BY 1, 2, 3, 4""")  # fmt: skip
def atlas_cells(spark, d):
    """One cluster document per supplier."""
    k = F.col("s_suppkey")
    cell = lambda cl: F.struct(
        F.lit(0).alias("tau_bin"), F.lit(cl).alias("cluster_id"), _ramp(k, lambda k, b: (k + b * 5) % 32 / F.lit(32.0)).alias("reject_rate"),
        F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: ((k + cl * 3 + b) % 20).cast("int")).alias("counts"),
    )
    centre = lambda cl: F.array(((k % 8 + cl) / F.lit(8.0)), F.lit(0.0), F.lit(0.5), F.lit(0.0))
    four = F.array(*[F.lit(1.0)] * 4)
    at = F.struct(F.lit(4).alias("checkpoint"), four.alias("feature_mean"), four.alias("feature_inv_std"), F.array(centre(0), centre(1)).alias("centroids"), F.array(cell(0), cell(1)).alias("cells"))
    doc = F.struct(
        F.lit("L2PrefixAtlasV1").alias("format"), F.concat(F.lit("v"), k.cast("string")).alias("variant_key"), F.array(F.lit(-1.0), F.lit(1.0)).alias("tau_edges"),
        F.lit(4).alias("min_cell_count"), F.lit(0.125).alias("safe_ref_max_reject_rate"), F.lit(0.875).alias("safe_rej_min_reject_rate"), F.array(at).alias("checkpoints"),
    )
    path = scratch_path(spark, "atlas")
    fx.table(spark, d, "supplier").select(F.to_json(doc).alias("value")).write.text(path)
    centroids, cells = SF.read_atlas(spark, path)
    counts = cells.groupBy("variant", "checkpoint", "cluster_id").agg(
        F.count("*").alias("cells"), F.count_if(F.col("cell") == 1).alias("refer"), F.count_if(F.col("cell") == 2).alias("reject"), F.count_if(F.col("cell") == 0).alias("none")
    )
    return centroids.join(counts, ["variant", "checkpoint", "cluster_id"])


@query("router_tables", "kind:s, name:s, a:l, b:l, text:s",
       """SELECT 'order' AS kind, 'r' || s_suppkey AS name, tb AS a, CAST((s_suppkey % 8 + tb) AS BIGINT) AS b, CASE tb WHEN 0 THEN 'low' ELSE 'tau_bin_1' END AS text FROM supplier CROSS JOIN (SELECT unnest([0, 1]) AS tb)
UNION ALL SELECT 'action', 'r' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE -1 END, s_suppkey % 5, CASE s_suppkey % 3 WHEN 0 THEN 'fallback' WHEN 1 THEN 'run_reject_rescue' ELSE 'run_refer_rescue' END FROM supplier
UNION ALL SELECT 'default', 'r' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE -1 END, -1, 'run_refer_rescue' FROM supplier
UNION ALL SELECT 'packet', CAST(s_suppkey AS VARCHAR), CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END, 3, s_suppkey || ',' || (s_suppkey + 1) || ',' || (s_suppkey + 2) FROM supplier
UNION ALL SELECT 'policy', 'f' || s_suppkey, s_suppkey % 3, i, (s_suppkey + i) % 7 || ',' || (s_suppkey + i + 3) % 7 FROM supplier CROSS JOIN (SELECT unnest([0, 1]) AS i)
UNION ALL SELECT 'expert', 'r' || s_suppkey, i + 1, NULL, 'seg:' || (s_suppkey % 9 + i) || CASE i WHEN 0 THEN ' tau' ELSE ' zero' END FROM supplier CROSS JOIN (SELECT unnest([0, 1]) AS i)""")  # fmt: skip
def router_tables(spark: SparkSession, d: str) -> DataFrame:
    """Order and rescue routers, packets, packet policies and expert manifests, one per supplier."""
    sup, k = fx.table(spark, d, "supplier"), F.col("s_suppkey")
    name = F.concat(F.lit("r"), k.cast("string")).alias("name")
    text = lambda c: c.cast("string")
    lit = lambda v: F.lit(v)

    def written(doc, what: str) -> str:
        path = scratch_path(spark, what)
        sup.select(F.to_json(doc).alias("value")).write.text(path)
        return path

    edges = F.array((k % 8).cast("float"), (k % 8 + 1).cast("float"), (k % 8 + 2).cast("float"))
    bundles = F.array(F.struct(lit(0).alias("tau_bin"), lit("m0").alias("bundle_manifest"), lit("low").alias("label")), F.struct(lit(1).alias("tau_bin"), lit("m1").alias("bundle_manifest"), lit(None).cast("string").alias("label")))
    order = SF.read_order_router(spark, written(F.struct(lit("L2PrefixOrderRouterV1").alias("format"), name, edges.alias("tau_edges"), bundles.alias("bundles")), "order-router"))
    out = [order.select(lit("order").alias("kind"), "name", F.col("tau_bin").alias("a"), F.col("tau_lo").cast("bigint").alias("b"), F.col("label").alias("text"))]

    action = F.when(k % 3 == 0, "fallback").when(k % 3 == 1, "run_reject_rescue").otherwise("run_refer_rescue")
    row = F.struct(lit(8).alias("anchor_checkpoint"), lit(0).alias("tau_bin"), lit(1).alias("fold_id"), lit(1).alias("shadow_side"), (k % 5).alias("gap_bin"), action.alias("action"))
    default = F.struct(lit(8).alias("anchor_checkpoint"), lit(0).alias("tau_bin"), lit(-1).alias("shadow_side"), lit("run_refer_rescue").alias("action"))
    version = F.when(k % 2 == 0, "L2AnchorRescueRouterV2").otherwise("L2AnchorRescueRouterV1").alias("format")
    actions, defaults = SF.read_rescue_router(spark, written(F.struct(version, name, F.array(row).alias("rows"), F.array(default).alias("defaults")), "rescue-router"))
    out.append(actions.select(lit("action").alias("kind"), "name", F.col("anchor").alias("a"), F.col("gap_bin").cast("bigint").alias("b"), F.col("action").alias("text")))
    out.append(defaults.select(lit("default").alias("kind"), "name", F.col("anchor").alias("a"), F.col("side").cast("bigint").alias("b"), F.col("action").alias("text")))

    path = scratch_path(spark, "packets")
    bank = F.when(k % 4 == 0, "scout").when(k % 4 == 1, "reject").when(k % 4 == 2, "refer").otherwise("other")
    trees = F.concat_ws(",", text(k), text(k + 1), text(k + 2))
    SK.write_tsv(sup.select(k.alias("packet_id"), bank.alias("packet_bank"), lit(3).alias("tree_count"), lit(1.5).alias("block_cost"), trees.alias("tree_pos_list")), path)
    packets = SF.read_packets(spark, path)
    out.append(packets.select(lit("packet").alias("kind"), text(F.col("packet_id")).alias("name"), F.col("bank_id").alias("a"), F.col("tree_count").cast("bigint").alias("b"), F.array_join(F.col("trees").cast("array<string>"), ",").alias("text")))

    rows = F.array(*[F.struct((k % 3).alias("step"), lit(0).alias("tau_bin"), lit(0).alias("gap_regime"), lit(i).alias("delta_regime"), lit(5).alias("row_count"), F.array((k + i) % 7, (k + i + 3) % 7).alias("ranking")) for i in (0, 1)])
    doc = F.struct(lit("L2PacketSchedulerPolicyV1").alias("format"), F.concat(lit("f"), text(k)).alias("packet_family"), lit(7).alias("n_packets"), rows.alias("policy_rows"))
    policy = SF.read_packet_policy(spark, written(doc, "packet-policy"))
    out.append(policy.select(lit("policy").alias("kind"), F.col("family").alias("name"), F.col("step").alias("a"), F.col("ord").cast("bigint").alias("b"), F.array_join(F.col("ranking").cast("array<string>"), ",").alias("text")))

    one = lambda i, mode: F.struct(text(k % 9 + i).alias("seg_key"), lit("m").alias("model_dir"), mode.alias("threshold_mode"))
    experts = SF.read_experts(spark, written(F.struct(name, F.array(one(0, lit("tau")), one(1, lit(None).cast("string"))).alias("selected_experts")), "experts"))
    out.append(experts.select(lit("expert").alias("kind"), "name", F.col("slot_id").alias("a"), lit(None).cast("bigint").alias("b"), F.concat_ws(" ", "label", "threshold_mode").alias("text")))
    full = out[0]
    for part in out[1:]:
        full = full.unionByName(part)
    return full


# --- writers: each layout is written, read back as text columns and compared ------------------


def _round_trip(df: DataFrame, layout: str, second_tier: bool = False) -> DataFrame:
    path = scratch_path(df.sparkSession, layout)
    SK.write_scored(df, path, layout, second_tier)
    back = df.sparkSession.read.option("sep", "\t").option("header", True).csv(path)
    rest = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in back.columns[2:]])
    return back.select(F.lit(layout).alias("layout"), F.col("TransactionID").cast("bigint").alias("txn_id"), F.col("isFraud").cast("int").alias("label"), rest.alias("line"))


def nine(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'NaN' ELSE printf('%.9f', CAST({x} AS DOUBLE)) END"


@query("scored_layouts", "layout:s, txn_id:l, label:l, line:s",
       q.with_(PREFIX_RUN, "tr AS (SELECT 1)", q.route("l1", "c1", "txn", "0.125", "r1"))
       + f"""SELECT 'infer' AS layout, txn.txn_id, label, concat_ws('|', {nine('r1.score')}, CASE WHEN pass = 1 THEN 'PASS' ELSE 'REFER' END, visited) AS line FROM txn JOIN r1 USING (txn_id)
UNION ALL SELECT 'qs', txn.txn_id, label, {nine('s1.score')} FROM txn JOIN s1 USING (txn_id)
UNION ALL SELECT 'qs-prefix', f.txn_id, label, concat_ws('|', {nine('prefix_score')}, prefix_trees_used, CASE WHEN shadow_reject = 1 THEN 'REJECT' ELSE 'REFER' END,
  CASE WHEN final_reject = 1 THEN 'REJECT' ELSE 'REFER' END, fallback_used, direct_checkpoint, fallback_entry_checkpoint, 0, 0, {nine('route_score')}, prefix_trees_used * 3, exact_visits)
FROM f JOIN txn USING (txn_id)""")  # fmt: skip
def scored_layouts(spark, d):
    m = fx.model(spark, "l1")
    rows = txn(spark, d).withColumn("r", T.score_route(F.col("features"), F.lit(fx.L1_THRESHOLD), m))
    infer = _round_trip(rows.select("txn_id", "label", "r.score", "r.pass", "r.visited"), "infer")
    plain = _round_trip(txn(spark, d).withColumn("score", T.score_exact(F.col("features"), m)), "qs")
    run = X.prefix_cascade(tier_two(spark, d), bundle(spark), F.col("active"))
    run = run.withColumn("router_choice", F.lit(0)).withColumn("router_tau_bin", F.lit(0)).withColumn("work_evals", F.col("prefix_trees_used") * 3)
    return infer.unionByName(plain).unionByName(_round_trip(run, "qs-prefix"))


@query("trace_rows", "txn_id:l, fold_id:l, checkpoint:l, score:d, evals:l, delta:d, resolved:l, exact:l",
       q.with_(P2) + """SELECT p.txn_id, p.fold_id, checkpoint, p.score, checkpoint * 3 AS evals, p.score - coalesce(lag(p.score) OVER (PARTITION BY p.txn_id ORDER BY slot), 0) AS delta,
  checkpoint AS resolved, CASE WHEN s.score >= p.tau THEN 1 ELSE 0 END AS exact
FROM p JOIN t2 USING (txn_id) JOIN (SELECT txn_id, sum(leaf) AS score FROM c2 GROUP BY txn_id) s USING (txn_id) WHERE t2.active""")  # fmt: skip
def trace_rows(spark, d):
    """JSON traces of active rows, written as text and parsed again."""
    m, cps = fx.model(spark, "l2"), list(fx.CHECKPOINTS)
    rows = tier_two(spark, d).withColumn("checkpoint_scores", T.prefix_scores(F.col("features"), m, cps))
    rows = rows.withColumn("checkpoint_work_evals", T.prefix_splits(F.col("features"), m, cps)).withColumn("score", T.score_exact(F.col("features"), m))
    before = F.concat(F.array(F.lit(0.0).cast("float")), F.slice("checkpoint_scores", 1, len(cps) - 1))
    rows = rows.withColumn("checkpoint_deltas", F.zip_with("checkpoint_scores", before, lambda a, b: a - b))
    rows = rows.withColumn("checkpoint_resolved_early", F.array(*[F.lit(c) for c in cps])).withColumn("final_reject", F.col("score") >= F.col("tau"))
    rows = rows.withColumn("prefix_score", F.get("checkpoint_scores", F.lit(2))).withColumn("prefix_trees_used", F.lit(12)).withColumn("fallback_used", F.lit(False))
    rows = rows.withColumn("router_choice", F.lit(0)).withColumn("router_tau_bin", F.lit(0))
    path = scratch_path(spark, "trace")
    SK.write_trace(rows, path, cps)
    schema = "TransactionID bigint, fold_id int, exact_final_label int, checkpoints array<int>, checkpoint_scores array<float>, checkpoint_work_evals array<int>, checkpoint_deltas array<float>, checkpoint_resolved_early array<int>"
    back = spark.read.schema(schema).json(path)
    z = F.arrays_zip("checkpoints", "checkpoint_scores", "checkpoint_work_evals", "checkpoint_deltas", "checkpoint_resolved_early")
    back = back.select(F.col("TransactionID").alias("txn_id"), "fold_id", F.col("exact_final_label").alias("exact"), F.explode(z).alias("z"))
    return back.select(
        "txn_id", "fold_id", "exact", F.col("z.checkpoints").alias("checkpoint"), F.col("z.checkpoint_scores").alias("score"),
        F.col("z.checkpoint_work_evals").alias("evals"), F.col("z.checkpoint_deltas").alias("delta"), F.col("z.checkpoint_resolved_early").alias("resolved"),
    )


@query("decision_dump", "row_idx:l, transaction_id:l, used_l2:l, decision:s, l2_score:d, tau_used:d, fold_id:l",
       q.with_(CASCADE) + "SELECT txn_id AS row_idx, txn_id AS transaction_id, used_l2, decision, l2_score, tau AS tau_used, fold_id FROM cas")
def decision_dump(spark, d):
    rows = cascade_run(spark, d).withColumn("row_idx", F.col("txn_id")).withColumn("tau_used", F.col("tau"))
    path = scratch_path(spark, "decisions")
    SK.write_decisions(rows, path)
    schema = "row_idx bigint, transaction_id bigint, used_l2 int, decision string, l2_score double, tau_used double, fold_id int"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def columns_of(name: str) -> str:
    """The column list of a registered query."""
    return ", ".join(f"{c}:{k}" for c, k in REGISTRY[name].columns)


@query("window_csv", columns_of("window_metrics"), _window_sql())
def window_csv(spark, d):
    """The window file with its 19 columns, read back."""
    path = scratch_path(spark, "windows")
    SK.write_windows(window_metrics(spark, d), path)
    back = spark.read.option("header", True).csv(path)
    if tuple(back.columns) != SK.WINDOW_COLUMNS:
        raise ValueError(f"window file has the columns {back.columns}")
    return back


@query("stats_json", columns_of("infer_stats"), REGISTRY["infer_stats"].sql)
def stats_json(spark, d):
    """Run statistics written as JSON and read back."""
    path, stats = scratch_path(spark, "stats"), infer_stats(spark, d)
    SK.write_stats(stats, path)
    return spark.read.schema(stats.schema).json(path)
