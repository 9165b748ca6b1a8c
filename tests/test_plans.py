"""Plans of the scorers: filters reach the scan, and survivors are scored once."""

from pyspark.sql import functions as F

from tierscore.operators import cascade as C
from tierscore.operators import trees as T
from tierscore.plans import fixtures as fx


def final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_filters_on_other_columns_reach_the_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    name, vector = rows.columns[0], next(c for c, t in rows.dtypes if t.startswith("array"))
    scored = rows.withColumn("s", T.score_exact(F.col(vector).cast("array<float>"), fx.model(spark, "vec_small")))
    assert f"EqualTo({name},5)" in final_plan(scored.where(F.col(name) == 5))


def test_survivors_are_scored_once(spark, sf_dir):
    rows = C.tier_one(fx.transactions(spark, sf_dir), fx.model(spark, "l1"), fx.L1_THRESHOLD)
    plan = final_plan(C.l1_survivors(rows).select("txn_id", "l1.score"))
    assert plan.count("ArrowEvalPython [") == 1
    assert C.l1_survivors(rows).count() == rows.where("NOT l1.pass").count()


def test_summaries_walk_the_trees_once(spark, sf_dir):
    from tierscore.operators import stats as A
    from tierscore.plans.scoring import prefix_run

    for summary in (A.prefix_stats, A.prefix_summary):
        plan = summary(prefix_run(spark, sf_dir), 16)._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "counted-" in plan


def test_lines_of_many_splits_meet_before_they_are_grouped(spark, sf_dir, tmp_path):
    """No aggregate per file split, whose memory would follow the size of a split; the same rows as of one file."""
    for name in ("orders", "customer"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.repartition(64).write.option("parquet.block.size", 1 << 20).parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = fx.transactions(spark, str(tmp_path))
        plan = final_plan(rows).splitlines()
        found = sorted(map(str, rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    groups = next(i for i, line in enumerate(plan) if "partial_sum(l_quantity" in line)
    dealt = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(txn_id" in line and "REPARTITION_BY_COL" in line]
    assert dealt and groups < max(dealt) and not any("Exchange" in line for line in plan[groups + 1 : min(i for i in dealt if i > groups)])
    assert found == sorted(map(str, fx.transactions(spark, sf_dir).collect()))
