"""Cascades against brute force and against each other."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tierscore.functions import scalars as S
from tierscore.operators import cascade as C
from tierscore.operators import certify as X
from tierscore.operators import lookups as L
from tierscore.operators import trees as T
from tierscore.operators.skew import inline_table
from tierscore.plans import fixtures as fx
from tierscore.plans import scoring as Q
from tierscore.session import materialise


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    df = Q.tier_two(spark, sf_dir)
    return materialise(df, "tier-two")


def bins(edges, x):
    return max(min(sum(e <= x for e in edges) - 1, len(edges) - 2), 0)


def limits(slot, fold, tau, gap):
    """Band limits by the fixture's rule."""
    offset = {None: 0, 1: 2, 2: 3}[fold if fold in (1, 2) else None]
    if fold == 1 and bins(fx.TAU_EDGES, tau) == 1:
        offset = 1
    b = bins(fx.GAP_EDGES, gap)
    lo = b - 1 if b > 0 and abs(gap - fx.GAP_EDGES[b]) <= 1e-6 * max(abs(gap), 1) else b
    reach = range(lo, b + 1)
    return max((8 - 2 * slot + offset + i % 8) / 16 for i in reach), min(-(6 - 2 * slot + offset + i % 5) / 16 for i in reach)


def test_packets_by_brute_force(spark, rows):
    bundle, policy = Q.bundle(spark), fx.packet_policy(spark)
    table = {(r.step, r.tau_bin, r.gap_bin, r.delta_bin): (r.row_count, r.ord, list(r.ranking)) for r in policy.rows.collect()}

    def best(match):
        found = [v for k, v in table.items() if match(k)]
        return max(found, key=lambda v: (v[0], -v[1]))[2] if found else []

    data = rows.withColumn("lv", T.tree_leaves(F.col("features"), bundle.model))
    got = {r.txn_id: r for r in X.packet_cascade(rows, bundle, fx.PACKETS, policy, F.col("active")).collect()}
    members, seen = dict(fx.PACKETS), set()
    for r in data.where("active").collect():
        prefix, delta, used, decided = 0.0, 0.0, [], None
        for step in range(3):
            tb, gb = bins(fx.TAU_EDGES, r.tau), bins(fx.STEP_GAP_EDGES[step], r.tau - prefix)
            db = bins(fx.STEP_DELTA_EDGES[step], delta)
            exact = table.get((step, tb, gb, db))
            ranking = exact[2] if exact else best(lambda k: k[:2] == (step, tb)) or best(lambda k: k[0] == step)
            pick = next((p for p in ranking + [0, 1, 2, 3] if p not in used))
            used.append(pick)
            delta = sum(r.lv[t] for t in members[pick])
            prefix += delta
            hi, lo = limits(step, r.fold_id, r.tau, r.tau - prefix)
            if hi < r.tau - prefix:
                decided = (False, prefix + hi, fx.CHECKPOINTS[step])
            elif lo >= r.tau - prefix:
                decided = (True, prefix + lo, fx.CHECKPOINTS[step])
            if decided:
                break
        o = got[r.txn_id]
        assert (o.packets, o.prefix_score, o.prefix_trees_used) == (used, prefix, 4 * len(used))
        if decided:
            assert (o.final_reject, o.route_score, o.direct_checkpoint, o.exact_visits) == (*decided, 0)
        else:
            total = sum(r.lv)
            assert (o.final_reject, o.route_score, o.exact_visits) == (total >= r.tau, total, 16 - 4 * len(used))
        seen.add((o.fallback_used, o.final_reject))
    assert len(seen) == 4


@pytest.mark.parametrize("kind", ["table", "atlas", "mlp"])
def test_stages_do_not_change_the_result(spark, rows, kind):
    bundle = Q.bundle(spark, kind)
    one = X.prefix_cascade(rows, bundle, F.col("active")).select("txn_id", *X.PREFIX_COLUMNS)
    for trees in (1, 1000):
        many = X.staged_cascade(rows, bundle, F.col("active"), stage_trees=trees).select("txn_id", *X.PREFIX_COLUMNS)
        assert one.exceptAll(many).count() == 0
    assert one.where("direct_checkpoint = 4").count() > 0 and one.where("fallback_used").count() > 0


def test_open_bands_give_the_exact_decision(spark, rows):
    cal = fx.calibration(spark)
    wide = cal.bands.withColumn("ref_hi", F.lit(1e9).cast("float")).withColumn("rej_lo", F.lit(-1e9).cast("float"))
    bundle = X.Bundle(fx.model(spark, "l2"), L.Calibration(cal.checkpoints, cal.gap_edges, cal.tau_edges, wide))
    out = X.prefix_cascade(rows, bundle).withColumn("s", T.score_exact(F.col("features"), bundle.model))
    assert out.where("NOT fallback_used OR final_reject <> (s >= tau)").count() == 0


def test_shadow_only_leaves_open_rows_open(spark, rows):
    out = X.prefix_cascade(rows, Q.bundle(spark), shadow_only=True)
    assert out.where("fallback_used AND (final_reject OR exact_visits <> 0)").count() == 0


def test_delta_checkpoint_feeds_later_checkpoints(spark, sf_dir):
    """Checkpoint 64 inside and before a stage gives the same certifier inputs."""
    m = fx.model(spark, "vec_large")
    cal = fx.calibration(spark, (32, 64, 96, 128))
    shape = tuple(L.AtlasCheckpoint(c, (0.0,) * 4, (1.0,) * 4, ((0.0, 0.0, 0.0, -1.0), (0.0, 0.0, 0.0, 1.0))) for c in cal.checkpoints)
    cells = spark.range(256).select(
        F.explode(F.array(*[F.lit(c) for c in (96, 128)])).alias("checkpoint"), F.lit(0).alias("tau_bin"), F.lit(1).alias("cluster_id"),
        F.col("id").cast("int").alias("gap_bin"), F.lit(2).alias("cell"),
    )
    cells = cells.unionByName(cells.withColumn("tau_bin", F.lit(2))).unionByName(cells.withColumn("tau_bin", F.lit(1)))
    bundle = X.Bundle(m, cal, L.Atlas(fx.TAU_EDGES, shape, cells))
    vec = fx.vectors(spark, sf_dir).select(F.col("vec_id").alias("txn_id"), "features", F.lit(0.25).cast("float").alias("tau"), F.lit(9).alias("fold_id"))
    one = X.prefix_cascade(vec, bundle).select("txn_id", *X.PREFIX_COLUMNS)
    for trees in (1, 1000):
        many = X.staged_cascade(vec, bundle, F.lit(True), stage_trees=trees).select("txn_id", *X.PREFIX_COLUMNS)
        assert one.exceptAll(many).count() == 0
    assert one.where("direct_checkpoint > 64").count() > 0


def test_unknown_slot_and_bin_fail(spark, rows):
    experts = [(fx.model(spark, "l2"), "tau")]
    with pytest.raises(PySparkException, match="unknown dispatch slot"):
        X.dispatch_experts(rows, experts, F.col("active")).collect()
    with pytest.raises(ValueError, match="threshold mode"):
        X.dispatch_experts(rows, [(fx.model(spark, "l2"), "other")])
    routes = inline_table(spark, "tau_bin int, route int", [(0, 0)])
    with pytest.raises(PySparkException, match="no bundle for tau bin"):
        L.route_by_tau(rows, routes, fx.TAU_EDGES).collect()


def test_cascade_without_second_tier(spark, sf_dir):
    out = C.cascade(fx.transactions(spark, sf_dir), fx.model(spark, "l1"), fx.L1_THRESHOLD, None)
    assert {r.decision for r in out.select("decision").distinct().collect()} == {S.ALLOW, S.REVIEW}
    assert out.where("used_l2").count() == 0


def test_sidecar_needs_a_threshold(spark, sf_dir):
    rows = Q.txn(spark, sf_dir).withColumn("row_idx", F.col("txn_id")).drop("tau")
    side = fx.transactions(spark, sf_dir).where("txn_id < 5").select(F.col("txn_id").alias("side_idx"), "features")
    with pytest.raises(PySparkException, match="no side row 4 for row"):
        C.cascade_sidecar(
            rows, fx.model(spark, "l1"), fx.L1_THRESHOLD, fx.model(spark, "seg_b"), side.where("side_idx < 4"), 5, fixed_tau=0.25
        ).collect()
    with pytest.raises(PySparkException, match="no threshold for row"):
        C.cascade_sidecar(rows, fx.model(spark, "l1"), fx.L1_THRESHOLD, fx.model(spark, "seg_b"), side, 5).collect()
    fixed = C.cascade_sidecar(rows, fx.model(spark, "l1"), fx.L1_THRESHOLD, fx.model(spark, "seg_b"), side, 5, fixed_tau=0.25)
    assert fixed.where("decision = 'deny'").count() > 0


def test_gather_refuses_unknown_names():
    with pytest.raises(ValueError, match="neither"):
        C.gather_features(F.col("features"), F.lit(0.0), ["a"], ["b"])


def test_nan_never_passes(spark):
    nan = spark.sql("SELECT CAST('NaN' AS FLOAT) AS s")
    assert nan.select(S.at_least(F.col("s"), F.lit(0.0))).first()[0] is False


def test_tau_needs_a_global_value(spark):
    rows = spark.sql("SELECT 1 AS fold_id, '0' AS seg_key, CAST(NULL AS FLOAT) AS l2_tau_used")
    empty = spark.createDataFrame([], "fold_id int, tau float")
    with pytest.raises(ValueError, match="no fold-wide"):
        L.resolve_tau(rows, None, empty)


def test_metadata_join_names_the_offender(spark):
    left = spark.range(5).withColumnRenamed("id", "txn_id")
    with pytest.raises(PySparkException, match="txn_id 4 missing in metadata"):
        L.join_row_meta(left, left.where("txn_id < 4").withColumn("m", F.lit(1))).collect()
    with pytest.raises(PySparkException, match="txn_id 2 repeated in metadata"):
        L.join_row_meta(left, left.unionByName(left.where("txn_id = 2")).withColumn("m", F.lit(1))).collect()
    with pytest.raises(PySparkException, match="txn_id 3 repeated in features"):
        L.join_row_meta(left.unionByName(left.where("txn_id = 3")), left.withColumn("m", F.lit(1))).collect()
    with pytest.raises(ValueError, match="'repeated_meta': 1"):
        feats = spark.sql("SELECT 7L AS txn_id, array(1f) AS features")
        C.validate(feats, feats.select("txn_id").unionByName(feats.select("txn_id")), 1)
    with pytest.raises(ValueError, match="txn_id=7"):
        feats = spark.sql("SELECT 7L AS txn_id, array(1f) AS features")
        C.validate(feats, feats.select("txn_id"), 2)


def test_last_row_of_a_key_wins_without_multiplying(spark):
    rows = spark.sql("SELECT 1 AS fold_id, '0' AS seg_key, CAST(NULL AS FLOAT) AS l2_tau_used")
    fold = inline_table(spark, "fold_id int, tau float, ord int", [(1, 0.1, 1), (1, 0.5, 0), (1, 0.1, 1)])
    seg = inline_table(spark, "fold_id int, seg_key string, tau float", [(1, "0", 0.25), (1, "0", 0.75)])
    assert [r.tau for r in L.resolve_tau(rows, None, fold).collect()] == pytest.approx([0.1])
    assert [r.tau for r in L.resolve_tau(rows, seg, fold).collect()] == [0.75]
    routes = inline_table(spark, "tau_bin int, route int, ord int", [(0, 7, 2), (0, 9, 1), (1, 3, 0), (2, 4, 0)])
    assert [r.route for r in L.route_by_tau(rows.withColumn("tau", F.lit(-5.0)), routes, fx.TAU_EDGES).collect()] == [7]


def test_atlas_cells_of_large_numbers_stay_apart(spark):
    on = ["checkpoint", "tau_bin", "cluster_id", "gap_bin"]
    cells = inline_table(spark, "checkpoint int, tau_bin int, cluster_id int, gap_bin int, cell int",
                         [(4, 0, 1000, 3, 1), (5, 0, 0, 3, 2), (2200, 0, 5000, 255, 2), (4, 0, 1000, 3, 1)])
    atlas = L.Atlas((), (), cells)
    rows = L.attach_atlas(inline_table(spark, "tau double", [(0.5,)]), atlas)
    def at(*key):
        return F.try_element_at("atlas_cells", L.cell_key(*[F.lit(k) for k in key]))

    got = rows.select(at(4, 1000, 3).alias("a"), at(5, 0, 3).alias("b"), at(2200, 5000, 255).alias("c"), at(5, 0, 4).alias("d")).first()
    assert tuple(got) == (1, 2, 2, None)
    assert L.lookup_atlas(cells.select(*on).distinct(), cells).count() == 3
