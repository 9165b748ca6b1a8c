"""The two-tier cascade: tier one passes or hands on, tier two denies or leaves to review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscore.functions.scalars import at_least, decision_label, segment_key
from tierscore.operators import lookups as L
from tierscore.operators.certify import Bundle, prefix_cascade
from tierscore.operators.trees import ApproxPolicy, TreeModel, rows_where, score_exact, score_route

# Feature names that stand for the tier-one score.
L1_SCORE_NAMES = ("l1_1_oof_score", "l1_oof_score", "l1_score", "l1_margin")


def gather_features(features: Column, l1_score: Column, l1_names: Sequence[str], l2_names: Sequence[str]) -> Column:
    """Tier-two vector: features picked by name, the tier-one score under any of its names."""
    at = {name: i for i, name in enumerate(l1_names)}
    cols = []
    for name in l2_names:
        if name in L1_SCORE_NAMES:
            cols.append(l1_score.cast("float"))
        elif name in at:
            cols.append(F.get(features, F.lit(at[name])))
        else:
            raise ValueError(f"feature {name!r} is neither a tier-one feature nor the tier-one score")
    return F.array(*cols)


def tier_one(df: DataFrame, model: TreeModel, threshold: float, policy: ApproxPolicy | None = None) -> DataFrame:
    """Adds ``l1``, a struct of score and pass: exact, or with calibrated exits under a policy."""
    if policy is not None:
        return df.withColumn("l1", score_route(F.col("features"), F.lit(threshold), model, policy=policy))
    rows = df.withColumn("_s", score_exact(F.col("features"), model))
    passed = at_least(F.col("_s"), F.lit(threshold).cast("float"))
    return rows.withColumn("l1", F.struct(F.col("_s").alias("score"), passed.alias("pass"))).drop("_s")


def l1_survivors(df: DataFrame) -> DataFrame:
    """Rows that tier one did not pass."""
    return rows_where(df, "l1", lambda l1: ~l1["pass"])


def cascade(
    df: DataFrame,
    l1: TreeModel,
    l1_threshold: float,
    l2: TreeModel | Bundle | None,
    l1_names: Sequence[str] = (),
    l2_names: Sequence[str] = (),
    global_tau: DataFrame | None = None,
    seg_tau: DataFrame | None = None,
    seg_cols: Sequence[str] = (),
    policy: ApproxPolicy | None = None,
    default_fold: int = 1,
) -> DataFrame:
    """Adds ``l1_score, l2_score, final_score, tau, fold_used, used_l2, l2_reject, decision``.

    One pass over the rows: tier two is computed in the same plan, and only the vectors of
    tier-one survivors are handed to it. A bundle runs tier two as a prefix cascade, a model as
    an exact early exit.
    """
    rows = tier_one(df, l1, l1_threshold, policy)
    if l2 is None:
        return rows.select(
            *df.columns,
            F.col("l1.score").alias("l1_score"),
            F.lit(None).cast("float").alias("l2_score"),
            F.col("l1.score").alias("final_score"),
            F.lit(False).alias("used_l2"),
            decision_label(F.col("l1.pass"), F.lit(None).cast("boolean")).alias("decision"),
        )
    second = gather_features(F.col("features"), F.col("l1.score"), l1_names, l2_names)
    rows = rows.withColumn("_l1_features", F.col("features")).withColumn("features", second)
    explicit = F.col("seg_prod_amtbin") if "seg_prod_amtbin" in df.columns else None
    parts = [F.get("features", F.lit(list(l2_names).index(c))) for c in seg_cols]
    if "l2_tau_used" not in df.columns:
        rows = rows.withColumn("l2_tau_used", F.lit(None).cast("float"))
    rows = rows.withColumn("seg_key", segment_key(parts, explicit))
    rows = L.resolve_tau(rows, seg_tau, global_tau, default_fold)
    rows = rows.withColumn("used_l2", ~F.col("l1.pass"))
    if isinstance(l2, Bundle):
        own = rows.withColumnRenamed("fold_id", "_fold").withColumn("fold_id", F.col("fold_used"))
        part = prefix_cascade(own, l2, F.col("used_l2"))
        rows = part.drop("fold_id").withColumnRenamed("_fold", "fold_id")
        l2_score, reject = F.col("route_score"), F.col("final_reject")
    else:
        routed = score_route(F.when(F.col("used_l2"), F.col("features")), F.col("tau"), l2)
        rows = rows.withColumn("_l2", routed)
        l2_score, reject = F.col("_l2.score"), F.col("_l2.pass")
    keep = [c for c in df.columns if c != "features"]
    return rows.select(
        *keep,
        F.col("_l1_features").alias("features"),
        F.col("l1.score").alias("l1_score"),
        l2_score.alias("l2_score"),
        F.coalesce(l2_score, F.col("l1.score")).alias("final_score"),
        "tau",
        "fold_used",
        "used_l2",
        F.coalesce(reject, F.lit(False)).alias("l2_reject"),
        decision_label(F.col("l1.pass"), reject).alias("decision"),
    )


def cascade_sidecar(
    df: DataFrame,
    l1: TreeModel,
    l1_threshold: float,
    l2: TreeModel,
    side: DataFrame,
    n_side: int,
    fixed_tau: float | None = None,
    policy: ApproxPolicy | None = None,
) -> DataFrame:
    """Cascade whose tier-two vectors come from a side table picked by ``row_idx % n_side``.

    The threshold is ``fixed_tau`` or the row's own; a survivor without one fails the job, and so does
    a survivor whose side row is missing.
    """
    if n_side < 1:
        raise ValueError(f"no side rows: {n_side}")
    rows = tier_one(df, l1, l1_threshold, policy)
    rows = rows.withColumn("used_l2", ~F.col("l1.pass"))
    if fixed_tau is None:
        own = F.col("l2_tau_used").cast("float")
        message = F.concat(F.lit("no threshold for row "), F.col("row_idx").cast("string"))
        tau = L.fail_when(F.col("used_l2") & own.isNull(), message, own, "float")
    else:
        tau = F.lit(float(fixed_tau)).cast("float")
    rows = L.sidecar_features(rows.withColumn("tau", tau), side, n_side)
    vector = F.col("side_features")
    message = F.concat(F.lit("no side row "), F.col("side_idx").cast("string"), F.lit(" for row "), F.col("row_idx").cast("string"))
    vector = L.fail_when(F.col("used_l2") & vector.isNull(), message, vector, dict(rows.dtypes)["side_features"])
    routed = score_route(F.when(F.col("used_l2"), vector), F.col("tau"), l2)
    rows = rows.withColumn("_l2", routed)
    return rows.select(
        *df.columns,
        "tau",
        "used_l2",
        F.col("l1.score").alias("l1_score"),
        F.col("_l2.score").alias("l2_score"),
        decision_label(F.col("l1.pass"), F.col("_l2.pass")).alias("decision"),
    )


def score_response(df: DataFrame, timings: Sequence[str] = ()) -> DataFrame:
    """Response rows: trace id, score, decision, both scores as reasons, and stage timings."""

    def reason(signal: str, value: Column) -> Column:
        return F.struct(
            F.lit(signal).alias("signal"),
            F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"),
            F.lit(0.0).alias("baseline_p95"),
            F.lit("info").alias("direction"),
        )

    stages = F.struct(*[F.col(c) for c in timings]) if timings else F.lit(None).cast("struct<l1: bigint>")
    return df.select(
        "txn_id",
        F.uuid().alias("trace_id"),
        F.col("final_score").cast("double").alias("score"),
        "decision",
        F.array(reason("l1_score", F.col("l1_score")), reason("l2_score", F.col("l2_score"))).alias("reason"),
        stages.alias("timings_us"),
    )


def mask_inactive(df: DataFrame, score: str = "score", decision: str = "pass", visited: str = "visited") -> DataFrame:
    """Inactive rows stay in the output with a NaN score, the negative decision and no trees."""
    on = F.coalesce(F.col("active"), F.lit(False))
    return (
        df.withColumn(score, F.when(on, F.col(score)).otherwise(F.lit(float("nan")).cast("float")))
        .withColumn(decision, F.when(on, F.col(decision)).otherwise(F.lit(False)))
        .withColumn(visited, F.when(on, F.col(visited)).otherwise(F.lit(0)))
    )


def validation_report(features: DataFrame, meta: DataFrame, dim: int, key: str = "txn_id") -> DataFrame:
    """Counts of every rule violation with the smallest offending key; one row, no collect."""
    wide = F.count_if(F.coalesce(F.size("features") != dim, F.lit(False))).alias("_w")
    left = features.groupBy(key).agg(F.count("*").alias("_f"), wide)
    both = left.join(meta.groupBy(key).agg(F.count("*").alias("_m")), key, "full").fillna(0, ["_f", "_w", "_m"])
    no_meta, no_features, wrong = F.col("_m") == 0, F.col("_f") == 0, F.col("_w") > 0
    twice, twice_meta = F.col("_f") > 1, F.col("_m") > 1
    total = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0))
    return both.agg(
        total(F.col("_f")).alias("feature_rows"),
        total(F.col("_m")).alias("meta_rows"),
        total(F.col("_f"), no_meta).alias("without_meta"),
        total(F.col("_m"), no_features).alias("without_features"),
        total(F.col("_w")).alias("wrong_width"),
        F.count_if(twice).alias("repeated_features"),
        F.count_if(twice_meta).alias("repeated_meta"),
        F.min(F.when(no_meta | no_features | wrong | twice | twice_meta, F.col(key))).alias("first_offender"),
    )


def validate(features: DataFrame, meta: DataFrame, dim: int, key: str = "txn_id") -> None:
    """Raises with the first offender when the report is not clean."""
    row = validation_report(features, meta, dim, key).first()
    faults = ("without_meta", "without_features", "wrong_width", "repeated_features", "repeated_meta")
    if any(row[f] for f in faults):
        raise ValueError(f"invalid input, first at {key}={row['first_offender']}: {row.asDict()}")
