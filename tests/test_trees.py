"""Scorers against a plain walk over random, uneven trees with missing values."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tierscore.operators import relational as R
from tierscore.operators import trees as T

DIM = 5


def grow(rng, model, tree, depth):
    """Random tree as node rows; some branches stop early."""
    rows = []

    def node(level):
        nid = len(rows)
        rows.append(None)
        if level == depth or (level > 0 and rng.random() < 0.25):
            rows[nid] = (model, tree, nid, None, None, None, None, None, rng.randint(-40, 40) / 64.0, True)
            return nid
        f, thr = rng.randrange(DIM), rng.randint(-8, 8) / 4.0
        left, right = node(level + 1), node(level + 1)
        rows[nid] = (model, tree, nid, f, thr, left, right, rng.choice((left, right)), None, False)
        return nid

    node(0)
    return rows


def walk(rows, x, missing="learned"):
    by_id = {r[2]: r for r in rows}
    node = by_id[0]
    while not node[9]:
        v = x[node[3]]
        if v is None or math.isnan(v):
            nxt = node[7] if missing == "learned" else node[6]
        else:
            nxt = node[5] if np.float32(v) < np.float32(node[4]) else node[6]
        node = by_id[nxt]
    return node[8]


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(7)
    trees = [grow(rng, "m", t, 4) for t in range(9)]
    nodes = spark.createDataFrame([r for t in trees for r in t], T.NODE_SCHEMA)
    values = [-2.0, -0.25, 0.0, 0.25, 0.5, 1.75, None, float("nan"), float("inf"), float("-inf")]
    data = [(i, [rng.choice(values) if rng.random() < 0.5 else rng.randint(-9, 9) / 4.0 for _ in range(DIM)]) for i in range(300)]
    data += [(300, [None] * DIM), (301, [float("nan")] * DIM), (302, None)]
    df = spark.createDataFrame(data, "txn_id bigint, features array<float>").repartition(3)
    return trees, nodes, data, df


def collect(df, col):
    return {r["txn_id"]: r[col] for r in df.collect()}


@pytest.mark.parametrize("missing", ["learned", "right"])
def test_exact_score_is_the_plain_walk(forest, missing):
    trees, nodes, data, df = forest
    order = [4, 2, 0, 8, 7, 6, 5, 3, 1]
    m = T.TreeModel.load(nodes, DIM, order=order, base=0.5, missing=missing)
    got = collect(df.withColumn("s", T.score_exact(F.col("features"), m)), "s")
    for i, x in data:
        want = None if x is None else 0.5 + sum(walk(trees[t], x, missing) for t in order)
        assert got[i] == want


def test_leaves_prefixes_and_splits(forest):
    trees, nodes, data, df = forest
    m = T.TreeModel.load(nodes, DIM)
    rows = df.withColumn("lv", T.tree_leaves(F.col("features"), m)).withColumn("p", T.prefix_scores(F.col("features"), m, [1, 4, 9]))
    rows = rows.withColumn("f", R.prefix_by_fold(F.col("lv"), [1, 4, 9])).withColumn("n", T.prefix_splits(F.col("features"), m, [9]))
    for r in rows.where("features IS NOT NULL").collect():
        x = dict(data)[r["txn_id"]]
        assert r["lv"] == [walk(t, x) for t in trees]
        assert r["p"] == r["f"] == [sum(r["lv"][:k]) for k in (1, 4, 9)]
        assert 0 < r["n"][0] <= 36


def test_prefix_continues_from_a_score(forest):
    _, nodes, _, df = forest
    m = T.TreeModel.load(nodes, DIM)
    rows = df.withColumn("a", T.prefix_scores(F.col("features"), m, [3, 9]))
    rows = rows.withColumn("b", T.prefix_scores(F.col("features"), m, [9], F.get("a", F.lit(0)), start=3))
    assert rows.where(F.get("a", F.lit(1)) != F.get("b", F.lit(0))).count() == 0


def test_early_exit_keeps_the_decision(forest):
    _, nodes, _, df = forest
    m = T.TreeModel.load(nodes, DIM)
    tau = (F.col("txn_id") % 9 - 4) / 16
    rows = df.where("features IS NOT NULL").withColumn("s", T.score_exact(F.col("features"), m)).withColumn("lv", T.tree_leaves(F.col("features"), m))
    for every in (1, 4):
        out = rows.withColumn("r", T.score_route(F.col("features"), tau, m, every=every))
        out = out.withColumn("q", R.route_by_fold(F.col("lv"), tau, m.suffix_min.tolist(), m.suffix_max.tolist(), every=every))
        assert out.where(F.col("r.pass") != (F.col("s") >= tau)).count() == 0
        same = (F.col("r.score") == F.col("q.score")) & (F.col("r.visited") == F.col("q.visited")) & (F.col("r.pass") == F.col("q.pass"))
        assert out.where(~same).count() == 0
        assert out.where("r.visited < 9").count() > 0


def test_guard_needs_a_wider_margin(forest):
    _, nodes, _, df = forest
    m = T.TreeModel.load(nodes, DIM)
    rows = df.where("features IS NOT NULL")
    visits = []
    for margin in (0.0, 0.25):
        r = rows.withColumn("r", T.score_route(F.col("features"), F.lit(0.1), m, eps=margin, guard=margin))
        visits.append(r.agg(F.sum("r.visited")).first()[0])
    assert visits[0] < visits[1]


def test_interval_contains_the_score(forest):
    _, nodes, _, df = forest
    m = T.TreeModel.load(nodes, DIM)
    rows = df.where("features IS NOT NULL").withColumn("s", T.score_exact(F.col("features"), m))
    some = rows.withColumn("iv", T.score_interval(F.col("features"), m, [1, 3]))
    assert some.where("iv.lower > s OR iv.upper < s").count() == 0
    full = rows.withColumn("iv", T.score_interval(F.col("features"), m))
    assert full.where("iv.lower <> s OR iv.upper <> s").count() == 0


def test_mask_scorer_agrees(forest):
    _, nodes, _, df = forest
    m = T.TreeModel.load(nodes, DIM)
    rows = df.where("features IS NOT NULL")
    arrow = rows.select("txn_id", T.score_exact(F.col("features"), m).alias("a"))
    assert R.score_by_masks(rows, nodes).join(arrow, "txn_id").where("a = score").count() == 302
    iv = rows.select("txn_id", T.score_interval(F.col("features"), m, [1, 3]).alias("iv"))
    both = R.interval_by_masks(rows, nodes, observed=[1, 3]).join(iv, "txn_id")
    assert both.where("lower = iv.lower AND upper = iv.upper").count() == 302


def test_mask_scorer_of_one_block_moves_no_rows(forest, monkeypatch):
    _, nodes, _, df = forest
    m = T.TreeModel.load(nodes, DIM)
    rows = df.where("features IS NOT NULL")
    one = R.score_by_masks(rows, nodes)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(R, "BLOCK_TREES", 2)
    blocks = R.score_by_masks(rows, nodes)
    arrow = rows.select("txn_id", T.score_exact(F.col("features"), m).alias("a"))
    assert blocks.join(arrow, "txn_id").where("a = score").count() == blocks.count() == one.count() == 302
    twice = R.score_by_masks(rows.unionAll(rows), nodes)
    assert twice.exceptAll(blocks).exceptAll(one).count() == 0 and twice.count() == 604


def test_interval_by_blocks_equals_one_block(forest, monkeypatch):
    _, nodes, _, df = forest
    rows = df.where("features IS NOT NULL")
    one = R.interval_by_masks(rows, nodes, observed=[1, 3])
    assert "HashAggregate" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "BLOCK_TREES", 2)
    blocks = R.interval_by_masks(rows, nodes, observed=[1, 3])
    iv = rows.select("txn_id", T.score_interval(F.col("features"), T.TreeModel.load(nodes, DIM), [1, 3]).alias("iv"))
    assert blocks.join(iv, "txn_id").where("lower = iv.lower AND upper = iv.upper").count() == one.count() == 302


def test_suffix_bounds_table_matches_the_model(spark, forest):
    _, nodes, _, _ = forest
    m = T.TreeModel.load(nodes, DIM)
    rows = T.suffix_bounds(nodes, chunk=4).orderBy("plan_pos").collect()
    assert [r["suffix_min"] for r in rows] == m.suffix_min[1:].tolist()
    assert [r["suffix_max"] for r in rows] == m.suffix_max[1:].tolist()


def test_bad_input_is_refused(spark, forest):
    _, nodes, _, df = forest
    m = T.TreeModel.load(nodes, DIM)
    with pytest.raises(ValueError, match="tree order"):
        T.TreeModel.load(nodes, DIM, order=[0, 1])
    with pytest.raises(ValueError, match="outside the vector"):
        T.TreeModel.load(nodes, 2)
    with pytest.raises(ValueError, match="checkpoints"):
        T.prefix_scores(F.col("features"), m, [3, 3])
    with pytest.raises(PySparkException, match="width 1"):
        spark.sql("SELECT array(1f) AS features").select(T.score_exact(F.col("features"), m)).collect()
    order = spark.createDataFrame([("m", 0, 0)], "model string, tree_id int, plan_pos int")
    with pytest.raises(PySparkException, match="tree order mismatch"):
        T.tree_plan(nodes, order).collect()


def test_single_leaf_tree_and_empty_input(spark):
    nodes = spark.createDataFrame([("m", 0, 0, None, None, None, None, None, 0.25, True)], T.NODE_SCHEMA)
    m = T.TreeModel.load(nodes, 1)
    one = spark.sql("SELECT array(1f) AS features")
    assert one.select(T.score_exact(F.col("features"), m)).first()[0] == 0.25
    assert one.where("false").select(T.score_exact(F.col("features"), m)).count() == 0
