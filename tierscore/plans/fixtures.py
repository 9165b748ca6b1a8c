"""Inputs of the registered queries: feature vectors and metadata derived from the given tables,
and models, thresholds and bands given by arithmetic rules that SQL can repeat.

Leaves, thresholds and band limits are multiples of 1/64 or 1/128, so 32-bit sums are exact in
any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscore.operators.certify import Mlp
from tierscore.operators.lookups import Atlas, AtlasCheckpoint, Calibration, PacketPolicy, cell_decision
from tierscore.operators.skew import inline_table
from tierscore.operators.trees import ApproxPolicy, TreeModel
from tierscore.session import group_apart, scratch_path, spread

# Fixed values: (name, trees, depth, leaf offset in 1/64) of the rule-based models.
MODELS = {
    "l1": (8, 3, 2),
    "l2": (16, 3, -1),
    "seg_a": (6, 3, 0),
    "seg_b": (10, 2, 1),
    "vec_small": (32, 5, 0),
    "vec_large": (128, 6, 0),
}
# Low end and span of each transaction feature, and of the appended tier-one score.
FEATURE_LOW = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1024.0, -2.0)
FEATURE_SPAN = (524288.0, 12.0, 256.0, 0.125, 131072.0, 32.0, 4.0, 12288.0, 4.0)
VEC_DIM, VEC_LOW, VEC_SPAN = 64, -0.25, 0.5
TXN_FEATURES = tuple(f"f{i}" for i in range(8))
L2_FEATURES = (*TXN_FEATURES, "l1_score")

L1_THRESHOLD = 0.125
# Global thresholds by fold (fold 3 has none) and segment thresholds of fold 1.
GLOBAL_TAU = ((1, 0.25), (2, 0.375))
SEGMENT_TAU = ((1, "0", 0.125), (1, "1", 0.1875), (1, "2", 0.3125))
TAU_EDGES = (-1.0, 0.1875, 0.28125, 1.0)
CHECKPOINTS = (4, 8, 12)
L1_POLICY = ApproxPolicy((2, 4, 6), (None, -0.75, -0.5), (1.0, None, 0.75))
GAP_EDGES = tuple((i - 128) / 32.0 for i in range(257))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One row per order: id, label, priority and the eight features (NULL = missing).

    Line items are aggregated before the join and customers are joined by their unique key; both
    sides of each join keep one row per key, so neither has a hot key. ``orders``: these orders
    instead of the table's, for instance those of one trigger of a stream.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("txn_id"),
        "l_quantity",
        "l_discount",
        "l_extendedprice",
        (F.col("l_returnflag") == "R").alias("returned"),
    )
    li = (
        group_apart(lines, "txn_id")
        .groupBy("txn_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("l_quantity").alias("q"),
            F.max("l_discount").alias("d"),
            F.max("l_extendedprice").alias("e"),
            F.min("l_quantity").alias("mq"),
            F.count_if("returned").alias("r"),
        )
    )
    orders = (table(spark, sf_dir, "orders") if orders is None else orders).select(
        F.col("o_orderkey").alias("txn_id"), "o_custkey", "o_totalprice", "o_orderpriority"
    )
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    full = spread(orders, "txn_id").join(li, "txn_id", "left").join(cust, "o_custkey", "left")
    cols = ["o_totalprice", "n", "q", "d", "e", "mq", "r", "c_acctbal"]
    return full.select(
        "txn_id",
        F.when(F.col("r") > 0, 1).otherwise(0).cast("tinyint").alias("label"),
        F.col("o_orderpriority").alias("priority"),
        F.array(*[F.col(c).cast("float") for c in cols]).alias("features"),
    )


def with_route_meta(txn: DataFrame) -> DataFrame:
    """Routing metadata as arithmetic on the transaction id."""
    t = F.col("txn_id")
    return txn.select(
        "*",
        (t % 3 + 1).cast("int").alias("fold_id"),
        (t % 5).cast("bigint").alias("seg_prod_amtbin"),
        (t % 3).cast("int").alias("slot_id"),
        (t % 10 != 0).alias("active"),
        F.when(t % 7 == 0, F.lit(0.25)).cast("float").alias("l2_tau_used"),
    )


def route_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id"))
    return with_route_meta(ids)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<float>").alias("features"), "label"
    )
    return spread(rows, "vec_id")


def row_tau() -> Column:
    """A per-row threshold for runs without a policy, on the grid of 1/16."""
    return ((F.col("txn_id") % 9 - 2) / F.lit(16.0)).cast("float")


def model_nodes(spark: SparkSession, name: str) -> DataFrame:
    """Complete trees by rule: nodes in heap order, all fields arithmetic in (tree, node)."""
    trees, depth, bias = MODELS[name]
    per_tree, inner = 2 ** (depth + 1) - 1, 2**depth - 1
    t = F.floor(F.col("id") / per_tree).cast("int")
    n = (F.col("id") % per_tree).cast("int")
    is_leaf = n >= inner
    if name.startswith("vec"):
        fidx = F.pmod(t * 5 + n * 3 + t * n, F.lit(VEC_DIM))
        low, span = F.lit(VEC_LOW), F.lit(VEC_SPAN)
    else:
        width = 9 if name == "l2" else 8
        fidx = F.pmod(t * 5 + n * 3 + t * n, F.lit(width))
        low = F.get(F.array(*map(F.lit, FEATURE_LOW)), fidx)
        span = F.get(F.array(*map(F.lit, FEATURE_SPAN)), fidx)
    thr = low + span * (F.pmod(t * 7 + n * 11 + 3, F.lit(15)) + 1) / F.lit(16.0)
    leaf = (F.pmod(t * 37 + n * 23 + t * n * 5, F.lit(41)) - 20 + bias) / F.lit(64.0)
    left, right = n * 2 + 1, n * 2 + 2
    miss = F.when(F.pmod(t + n, F.lit(3)) == 0, left).otherwise(right)
    inner_only = lambda c: F.when(~is_leaf, c).cast("int")
    return spark.range(trees * per_tree).select(
        F.lit(name).alias("model"),
        t.alias("tree_id"),
        n.alias("node_id"),
        inner_only(fidx).alias("fidx"),
        F.when(~is_leaf, thr).cast("float").alias("thr"),
        inner_only(left).alias("left"),
        inner_only(right).alias("right"),
        inner_only(miss).alias("missing"),
        F.when(is_leaf, leaf).cast("float").alias("leaf"),
        is_leaf.alias("is_leaf"),
    )


_LOADED: dict[tuple, TreeModel] = {}


def leaf_work(nodes: DataFrame) -> DataFrame:
    """Work and early resolution of every leaf, by rule."""
    t, n = F.col("tree_id"), F.col("node_id")
    return nodes.withColumns({"evals": (t + n) % 3 + 1, "resolved": (t * 3 + n) % 2})


def model(
    spark: SparkSession, name: str, order: Sequence[int] | None = None, max_trees: int | None = None, work: bool = False
) -> TreeModel:
    """A rule-based model, loaded once per order; ``work``: with the work of its leaves."""
    key = (name, tuple(order) if order is not None else None, max_trees, work)
    if key not in _LOADED:
        dim = VEC_DIM if name.startswith("vec") else 9 if name == "l2" else 8
        nodes = model_nodes(spark, name)
        _LOADED[key] = TreeModel.load(leaf_work(nodes) if work else nodes, dim, order=order, max_trees=max_trees, name=name)
    return _LOADED[key]


def global_tau(spark: SparkSession) -> DataFrame:
    return inline_table(spark, "fold_id int, tau float", GLOBAL_TAU)


def segment_tau(spark: SparkSession) -> DataFrame:
    return inline_table(spark, "fold_id int, seg_key string, tau float", SEGMENT_TAU)


# Band levels as (fold, tau bin, offset): global, two folds, one (fold, tau bin).
BAND_LEVELS = ((None, None, 0), (1, None, 2), (2, None, 3), (1, 1, 1))


def calibration(spark: SparkSession, checkpoints: tuple[int, ...] = CHECKPOINTS) -> Calibration:
    """Bands by rule over 256 gap bins of width 1/32 around zero; prepared once per session."""
    key = (spark.sparkContext.applicationId, checkpoints)
    if key not in _CALIBRATIONS:
        _CALIBRATIONS[key] = _calibration(spark, checkpoints)
    return _CALIBRATIONS[key]


_CALIBRATIONS: dict[tuple, Calibration] = {}


def _calibration(spark: SparkSession, checkpoints: tuple[int, ...]) -> Calibration:
    levels = inline_table(spark, "fold_id int, tau_bin int, lv int", BAND_LEVELS)
    cps = inline_table(spark, "slot int, checkpoint int", list(enumerate(checkpoints)))
    slot, lv, b = F.col("slot"), F.col("lv"), F.col("gap_bin")
    bins = levels.withColumn("gap_bin", F.explode(F.sequence(F.lit(0), F.lit(255)))).withColumn("one", F.lit(1))
    rows = cps.withColumn("one", F.lit(1)).join(bins, "one")
    bands = rows.select(
        "checkpoint",
        "fold_id",
        "tau_bin",
        "gap_bin",
        ((8 - 2 * slot + lv + b % 8) / F.lit(16.0)).cast("float").alias("ref_hi"),
        (-(6 - 2 * slot + lv + b % 5) / F.lit(16.0)).cast("float").alias("rej_lo"),
    )
    return Calibration(checkpoints, (GAP_EDGES,) * len(checkpoints), TAU_EDGES, bands)


# Cluster geometry and cell limits.
ATLAS_MEAN, ATLAS_INV_STD = (0.25, 0.5, 0.0, 0.0), (1.0, 2.0, 1.0, 1.0)
ATLAS_CENTROIDS = ((0.5, 0.0, 0.25, 0.0), (-0.5, 0.25, -0.25, 0.0), (1.0, 1.0, 0.5, 0.0), (-1.0, 0.5, 0.0, 0.0))
ATLAS_MIN, ATLAS_SAFE_REF, ATLAS_SAFE_REJ = 4, 0.125, 0.875


def atlas_table(spark: SparkSession) -> DataFrame:
    """Counts and reject rates by rule per (checkpoint, tau bin, cluster, gap bin)."""
    per = 3 * 4 * 256
    i = F.col("id")
    cps = F.array(*[F.lit(c) for c in CHECKPOINTS])
    rows = spark.range(len(CHECKPOINTS) * per).select(
        F.get(cps, F.floor(i / per).cast("int")).alias("checkpoint"),
        F.floor(i % per / 1024).cast("int").alias("tau_bin"),
        F.floor(i % 1024 / 256).cast("int").alias("cluster_id"),
        (i % 256).cast("int").alias("gap_bin"),
    )
    tb, cl, b = F.col("tau_bin"), F.col("cluster_id"), F.col("gap_bin")
    rows = rows.withColumn("count", (tb * 7 + cl * 5 + b) % 20)
    return rows.withColumn("reject_rate", ((b * 3 + cl * 11 + tb) % 32 / F.lit(32.0)).cast("float"))


def atlas(spark: SparkSession) -> Atlas:
    cell = cell_decision(F.col("count"), F.col("reject_rate"), ATLAS_MIN, ATLAS_SAFE_REF, ATLAS_SAFE_REJ)
    at = tuple(AtlasCheckpoint(c, ATLAS_MEAN, ATLAS_INV_STD, ATLAS_CENTROIDS) for c in CHECKPOINTS)
    return Atlas(TAU_EDGES, at, atlas_table(spark).withColumn("cell", cell))


# A 2 x 2 network on 3 checkpoints, 3 folds, 3 tau bins and 8 numbers.
MLP_SHAPE = {
    "checkpoint_values": CHECKPOINTS,
    "fold_values": (1, 2, 3),
    "mean": (0.25, 0.25, 0.25, 0.5, 0.25, 0.25, 0.5, 0.25, 0.25, 0.0, 0.25, 0.5, 0.0, 0.0, 2.0, 0.0, 0.0),
    "inv_std": (1.0, 1.0, 1.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 1.0, 2.0, 1.0, 0.5, 1.0, 1.0),
    "w1": (
        (0.125, 0.25, 0.5, 0.25, -0.25, 0.125, 0.0, 0.125, 0.25, 1.0, -1.0, 0.25, 0.5, 0.0, 0.125, 0.5, 0.0),
        (0.25, -0.125, 0.0, 0.125, 0.25, -0.25, 0.25, 0.0, -0.125, -1.0, 1.0, 0.5, -0.25, 0.0, 0.0, 0.0, 0.25),
    ),
    "b1": (0.125, 0.25),
    "w2": ((1.0, -1.0), (-0.5, 1.0)),
    "b2": (0.125, 0.0),
    "w3": (2.0, -2.0),
    "b3": -0.125,
}
MLP_THRESHOLDS = {4: (0.05, 0.95), 8: (0.125, 0.875)}


def mlp() -> Mlp:
    return Mlp(tau_edges=TAU_EDGES, checkpoint_limit=8, thresholds=MLP_THRESHOLDS, **MLP_SHAPE)


# Tree orders as (factor, shift) of position = (tree * factor + shift) mod 16.
ORDERS = ((1, 0), (5, 3), (11, 6))


def order(index: int, trees: int = 16) -> list[int]:
    a, b = ORDERS[index]
    place = {(t * a + b) % trees: t for t in range(trees)}
    return [place[p] for p in range(trees)]


ANCHOR_CHECKPOINTS, RESCUE_CHECKPOINTS = (4, 8), (2, 4)
REJECT_ORDER = tuple(list(range(8, 16)) + list(range(8)))
REFER_ORDER = tuple(list(range(15, 7, -1)) + list(range(8)))
RESCUE_GAP_EDGES = (-4.0, -0.25, 0.0, 0.25, 4.0)
# Router rows (anchor, tau bin, fold, side, gap bin, action) and defaults.
RESCUE_ROWS = (
    (8, 0, 1, 1, 1, "run_reject_rescue"),
    (8, 0, 2, -1, 2, "run_refer_rescue"),
    (8, 1, 1, -1, 2, "run_reject_rescue"),
    (8, 2, 3, -1, 3, "fallback"),
    (-1, 2, 1, -1, 2, "run_refer_rescue"),
)
RESCUE_DEFAULTS = (
    (8, 0, -1, "run_refer_rescue"),
    (8, 0, 1, "run_reject_rescue"),
    (8, 2, 1, "run_refer_rescue"),
    (-1, 2, -1, "run_reject_rescue"),
)
RESCUE_ROW_SCHEMA = "anchor int, tau_bin int, fold_id int, side int, gap_bin int, action string"
RESCUE_DEFAULT_SCHEMA = "anchor int, tau_bin int, side int, action string"

PACKETS = tuple((p, tuple(range(p, 16, 4))) for p in range(4))
STEP_GAP_EDGES = ((-4.0, -0.25, 0.0, 0.25, 4.0),) * 3
STEP_DELTA_EDGES = ((-4.0, 0.0, 4.0),) * 3


def packet_policy(spark: SparkSession) -> PacketPolicy:
    """Rankings by rule; every fifth state is left out so that the defaults are used."""
    rows = []
    for step in range(3):
        for tau_bin in range(2):
            for gap_bin in range(4):
                for delta_bin in range(2):
                    i = ((step * 2 + tau_bin) * 4 + gap_bin) * 2 + delta_bin
                    if i % 5 != 4:
                        ranking = [(i * 3 + k * 3) % 4 for k in range(2 + i % 3)]
                        rows.append((step, tau_bin, gap_bin, delta_bin, (i * 7) % 11, i, ranking))
    schema = "step int, tau_bin int, gap_bin int, delta_bin int, row_count int, ord int, ranking array<int>"
    return PacketPolicy(3, TAU_EDGES, STEP_GAP_EDGES, STEP_DELTA_EDGES, inline_table(spark, schema, rows))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream with one event time beyond all events of the table."""
    path = scratch_path(spark, "beats")
    last = table(spark, sf_dir, "events").agg((F.max("ts") + F.expr("INTERVAL 40 DAYS")).alias("ts"))
    last.write.parquet(path)
    return spark.readStream.schema(last.schema).parquet(path)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_requests(table(spark, sf_dir, "events"))


def shape_requests(events: DataFrame) -> DataFrame:
    """Request log by arithmetic on the events; also applies to a stream of them."""
    e2e = F.round(F.col("value") * 1000).cast("bigint")
    kind = F.col("event_type")
    late = F.col("value") > 200
    s0 = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.round(F.col("value") * 10)).cast("bigint")
    stage = F.struct(
        s0.alias("parse"),
        (s0 % 50).alias("feature"),
        (s0 % 30).alias("router"),
        (s0 % 400).alias("l1"),
        (s0 % 900).alias("l2"),
        (s0 % 20).alias("serialize"),
    )
    decision = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "signup", 2).when(kind == "purchase", 3)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("t_sched"),
        "event_type",
        "user_id",
        "value",
        e2e.alias("e2e_us"),
        (e2e % 1000).alias("queue_delay_us"),
        (e2e % 77).alias("send_delay_us"),
        (e2e - e2e % 1000).alias("server_rtt_us"),
        late.alias("timeout"),
        F.when(late, 0)
        .when((kind == "error") & (F.col("value") > 50), 503)
        .when(kind == "error", 429)
        .otherwise(200)
        .alias("status_code"),
        decision.otherwise(255).alias("decision"),
        F.floor(F.col("event_id") / 128).cast("bigint").alias("batch_id"),
        (F.col("user_id") % 4 == 0).alias("used_l2"),
        (F.col("event_id") % 101 == 0).alias("dropped"),
        (F.col("event_id") % 211 == 0).alias("dropped_late"),
        (F.col("event_id") % 307 == 0).alias("drop_inflight"),
        stage.alias("stage"),
    )
