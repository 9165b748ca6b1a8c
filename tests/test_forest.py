"""Slots of a forest against each model on its own, and the plans of the fused cascades."""

import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierscore.operators import certify as X
from tierscore.operators import lookups as L
from tierscore.operators import trees as T
from tierscore.operators.forest import Forest, bin_of
from tierscore.operators.skew import inline_table
from tierscore.plans import fixtures as fx
from tierscore.plans import scoring as Q
from tierscore.session import materialise


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return materialise(Q.tier_two(spark, sf_dir), "tier-two")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many_experts(spark, n):
    """``n`` different models: cut at different trees and shifted by their number."""
    cut = [fx.model(spark, "l2", max_trees=k) for k in (16, 9, 2, 1)]
    return [(replace(cut[i % 4], base=i / 64 - 2), "zero" if i % 5 == 0 else "tau") for i in range(n)]


def test_300_experts_equal_single_models(spark, rows):
    experts = many_experts(spark, 300)
    data = rows.withColumn("slot_id", (F.col("txn_id") % 300).cast("int"))
    got = {r["txn_id"]: r for r in X.dispatch_experts(data, experts, F.col("active")).collect()}
    leaves = data.withColumn("lv", T.tree_leaves(F.col("features"), fx.model(spark, "l2")))
    for r in leaves.collect():
        (model, mode), out = experts[r["slot_id"]], got[r["txn_id"]]
        if not r["active"]:
            assert (out["route_score"], out["reject"], out["visited_trees"]) == (None, False, 0)
            continue
        score, tau = np.float32(model.base), 0.0 if mode == "zero" else r["tau"]
        for pos in range(model.n_trees):
            score += np.float32(r["lv"][pos])
            low, high = score + model.suffix_min[pos + 1], score + model.suffix_max[pos + 1]
            if low >= tau or high < tau:
                break
        assert (out["route_score"], out["reject"], out["visited_trees"]) == (float(score), bool(low >= tau), pos + 1)


def test_plan_does_not_grow_with_the_slots(spark, rows):
    few = plan_of(X.dispatch_experts(rows, many_experts(spark, 2), F.col("active")))
    many = plan_of(X.dispatch_experts(rows, many_experts(spark, 300), F.col("active")))
    assert len(few.splitlines()) == len(many.splitlines()) and abs(len(many) - len(few)) < 1500
    assert many.count("ArrowEvalPython") == few.count("ArrowEvalPython") == 1


def test_multi_order_of_many_bundles_is_one_step(spark, rows):
    bundles = [Q.bundle(spark, order=i % 3) for i in range(30)]
    edges = tuple(np.linspace(-1, 1, 31).tolist())
    routes = inline_table(spark, "tau_bin int, route int", [(i, i) for i in range(30)])
    out = X.multi_order(rows, bundles, routes, edges, F.col("active"))
    assert plan_of(out).count("ArrowEvalPython") == 1
    for i in range(3):
        part = rows.join(out.where(F.col("route") % 3 == i).select("txn_id"), "txn_id")
        alone = X.staged_cascade(part, Q.bundle(spark, order=i), F.col("active")).select("txn_id", *X.PREFIX_COLUMNS)
        together = out.where(F.col("route") % 3 == i).select("txn_id", *X.PREFIX_COLUMNS)
        assert alone.exceptAll(together).count() == 0 and together.count() > 0


@pytest.mark.parametrize("kind", ["table", "atlas", "mlp"])
def test_fused_plan_has_one_arrow_step_and_no_bands(spark, rows, kind):
    plan = plan_of(X.prefix_cascade(rows, Q.bundle(spark, kind), F.col("active")))
    assert plan.count("ArrowEvalPython") == 1
    assert not re.search("Join|ref_hi|Exchange", plan)
    bands = plan_of(L.lookup_bands(rows.select("tau", "fold_id", F.lit(4).alias("checkpoint"), F.lit(0.0).alias("gap")), fx.calibration(spark)))
    assert "Join" not in bands and "array" not in bands


def test_bands_by_arrow_equal_the_join(spark, rows):
    cal = fx.calibration(spark)
    apart = L.Calibration(cal.checkpoints, cal.gap_edges, cal.tau_edges, cal.bands)
    apart.__dict__["small"] = False
    edges = F.array(*[F.lit(float(v)) for v in (*fx.GAP_EDGES[::8], -9.0, 9.0, 0.03125 - 1e-7, float("nan"))])
    data = rows.where("txn_id < 60").select("txn_id", "tau", "fold_id", F.explode(edges).alias("gap"))
    data = data.withColumn("checkpoint", F.explode(F.array(F.lit(4), F.lit(12))))
    one, two = L.lookup_bands(data, cal), L.lookup_bands(data, apart)
    assert one.columns == two.columns and one.count() > 500
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_large_tables_are_joined(spark, rows):
    cal = fx.calibration(spark)
    apart = L.Calibration(cal.checkpoints, cal.gap_edges, cal.tau_edges, cal.bands)
    apart.__dict__["small"] = False
    bundle = X.Bundle(fx.model(spark, "l2", fx.order(0)), apart)
    joined = X.prefix_cascade(rows, bundle, F.col("active"))
    assert "Join" in plan_of(joined)
    fused = X.prefix_cascade(rows, Q.bundle(spark), F.col("active"))
    assert joined.select("txn_id", *X.PREFIX_COLUMNS).exceptAll(fused.select("txn_id", *X.PREFIX_COLUMNS)).count() == 0


@pytest.mark.parametrize("kind", ["table", "atlas", "mlp"])
def test_outcomes_at_all_checkpoints_are_one_step(spark, rows, kind):
    bundle = Q.bundle(spark, kind)
    one = X.certify_long(rows, bundle)
    assert plan_of(one).count("ArrowEvalPython") == 1 and not re.search("Join|ref_hi", plan_of(one))
    cal = L.Calibration(bundle.calibration.checkpoints, bundle.calibration.gap_edges, bundle.calibration.tau_edges, bundle.calibration.bands)
    cal.__dict__["small"] = False
    joined = X.certify_long(rows, replace(bundle, calibration=cal))
    plan = plan_of(joined)
    # Nothing wide waits for Python: the joins of the bands are above all Arrow steps.
    assert plan.rindex("Join") < plan.index("ArrowEvalPython")
    assert joined.columns == one.columns and one.count() == 3 * rows.count()
    assert joined.drop("features").exceptAll(one.drop("features")).count() == 0
    assert {r["outcome"] for r in one.select("outcome").distinct().collect()} == {"open", "reject", "refer"}


def test_packets_are_one_step_and_equal_the_joins(spark, rows):
    bundle, policy = Q.bundle(spark), fx.packet_policy(spark)
    one = X.packet_cascade(rows, bundle, fx.PACKETS, policy, F.col("active"))
    assert plan_of(one).count("ArrowEvalPython") == 1 and not re.search("Join|ref_hi", plan_of(one))
    joined = X.joined_packets(rows, bundle, fx.PACKETS, policy, F.col("active"))
    assert joined.columns == one.columns and one.count() == rows.count()
    assert joined.drop("features").exceptAll(one.drop("features")).count() == 0
    uneven = ((3, (0, 7, 9)), (1, (15,)), (2, (1, 2, 3, 4)), (0, (5, 6, 8, 10, 11, 12, 13, 14)))
    out = [f(rows, bundle, uneven, policy, F.col("active")).drop("features") for f in (X.packet_cascade, X.joined_packets)]
    assert out[1].exceptAll(out[0]).count() == 0


def test_rescue_takes_two_steps(spark, sf_dir):
    plan = plan_of(Q.anchor_run(spark, sf_dir))
    # Tier-one score, anchor, and the rescue together with the leaves of what stays open.
    assert plan.count("ArrowEvalPython") == 3 and "certify_slots" in plan and "tree_leaf_values" in plan


def test_missing_vectors_and_thresholds(spark, rows):
    some = rows.where("txn_id < 200").withColumn("tau", F.when(F.col("txn_id") % 2 == 0, F.col("tau")))
    some = some.withColumn("features", F.when(F.col("txn_id") % 3 != 0, F.col("features"))).withColumn("fold_id", F.lit(None).cast("int"))
    bundle = Q.bundle(spark)
    one = X.prefix_cascade(some, bundle).select("txn_id", *X.PREFIX_COLUMNS).collect()
    for r in one:
        if r["txn_id"] % 3 == 0:
            assert r["route_score"] is None and not r["fallback_used"]
        elif r["txn_id"] % 2:
            assert r["fallback_used"] and not r["final_reject"]
    empty = X.prefix_cascade(rows.where("false"), bundle)
    assert empty.count() == 0


def test_forest_refuses_what_does_not_fit(spark, monkeypatch):
    with pytest.raises(ValueError, match="one width"):
        Forest([fx.model(spark, "l1"), fx.model(spark, "l2")])
    with pytest.raises(ValueError, match="at least one"):
        Forest([])
    import tierscore.operators.forest as forest

    monkeypatch.setattr(forest, "MAX_NODES", 10)
    with pytest.raises(ValueError, match="too large"):
        Forest([fx.model(spark, "l2")])


def test_bin_of():
    edges = np.array([0.0, 1.0, 2.0], np.float32)
    assert bin_of(edges, np.array([-1, 0, 0.5, 1, 2, 5, np.nan], np.float32)).tolist() == [0, 0, 0, 1, 1, 1, 0]
