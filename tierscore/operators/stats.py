"""Statistics of scoring runs: rates, visit percentiles and histograms, exits, mismatches.

Everything is a partial-plus-final aggregate or a window over counted bins; no statistic
gathers rows of a group in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscore.functions.scalars import OTHER_BUCKET, decision_bucket
from tierscore.operators.skew import order_statistics
from tierscore.session import materialise


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """0-based rank ``round((n - 1) q)``, halves up."""
    return lambda n: F.floor((n - 1) * F.lit(float(q)) + 0.5)


def reached_rank(q: float) -> Callable[[Column], Column]:
    """0-based rank of the first value with a cumulative count of at least ``q n``."""
    return lambda n: F.greatest(F.ceil(n * F.lit(float(q))) - 1, F.lit(0))


def visit_histogram(df: DataFrame, n_trees: int, keys: Sequence[str] = (), visited: str = "visited") -> DataFrame:
    """Dense histogram of visited trees: 0 for none, capped at ``n_trees``, empty bins included."""
    spark = df.sparkSession
    binned = F.least(F.greatest(F.col(visited), F.lit(0)), F.lit(n_trees)).cast("bigint")
    counts = df.groupBy(*keys, binned.alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.range(n_trees + 1).withColumnRenamed("id", "bin")
    if keys:
        bins = counts.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_trees))))
        bins = bins.withColumn("bin", F.col("bin").cast("bigint"))
    return bins.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def visit_percentiles(
    df: DataFrame,
    qs: Sequence[float] = (0.5, 0.9, 0.99),
    keys: Sequence[str] = (),
    visited: str = "visited",
    weight: str | None = None,
) -> DataFrame:
    ranks = {f"p{round(q * 100)}": nearest_rank(q) for q in qs}
    return order_statistics(df, keys, visited, ranks, weight=weight)


ROWS = "_rows"


def counted(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Rows per combination of small columns, in ``ROWS``, written once.

    Everything a summary needs comes from this one small table, so the trees are walked once however
    often it is read.
    """
    return materialise(df.groupBy(*by).agg(F.count("*").alias(ROWS)), "counted")


def _rows(when: Column | None = None, value: Column | None = None) -> Column:
    """Number of rows that meet a condition, or the sum of a value over them."""
    amount = F.col(ROWS) if value is None else F.col(ROWS) * value
    return F.coalesce(F.sum(amount if when is None else F.when(when, amount)), F.lit(0))


def _rate(count: Column, n: Column) -> Column:
    return count.cast("double") / F.greatest(n, F.lit(1)).cast("double")


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join aggregate rows by key; without keys both sides are a single row."""
    if keys:
        return left.join(right, list(keys), "left")
    one = "_one"
    return left.withColumn(one, F.lit(1)).join(right.withColumn(one, F.lit(1)), one, "left").drop(one)


def infer_stats(df: DataFrame, n_trees: int, keys: Sequence[str] = ()) -> DataFrame:
    """Run summary over ``pass, visited, exit_idx, active``.

    Rates are over all rows. Inactive rows count as zero visited trees in the average, as in
    the per-row output, and are left out of the percentiles.
    """
    early = F.coalesce(F.col("exit_idx") >= 0, F.lit(False)).alias("early")
    small = counted(df, [*keys, "active", "pass", "visited", early])
    on, n = F.col("active"), _rows()
    quick = on & F.col("early")
    stats = small.groupBy(*keys).agg(
        n.alias("n_rows"),
        _rate(_rows(on & F.col("pass")), n).alias("pass_rate"),
        _rate(_rows(on), n).alias("active_rate"),
        _rate(_rows(on, F.col("visited")), n).alias("avg_visited"),
        _rate(_rows(on & (F.col("visited") == n_trees)), n).alias("full_eval_rate"),
        _rate(_rows(quick), n).alias("approx_coverage"),
        _rate(_rows(quick & F.col("pass")), n).alias("approx_pass_rate"),
        _rate(_rows(quick & ~F.col("pass")), n).alias("approx_refer_rate"),
        _rate(n - _rows(quick), n).alias("approx_fallback_rate"),
    )
    return _attach(stats, visit_percentiles(small.where(on), keys=keys, weight=ROWS), keys)


def exit_counts(df: DataFrame, checkpoint: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per exit checkpoint."""
    return df.groupBy(*keys, checkpoint.alias("checkpoint")).agg(F.count("*").alias("n"))


def dispatch_stats(df: DataFrame) -> DataFrame:
    """Per expert slot and in total (``slot_id`` NULL), over active rows."""
    on = counted(df.where("active"), ["slot_id", "reject", "visited_trees"])
    base = on.rollup("slot_id").agg(
        _rows().alias("rows"),
        _rate(_rows(value=F.col("visited_trees")), _rows()).alias("avg_visited"),
        _rate(_rows(F.col("reject")), _rows()).alias("reject_rate"),
    )
    by_slot = visit_percentiles(on, keys=["slot_id"], visited="visited_trees", weight=ROWS)
    total = visit_percentiles(on, visited="visited_trees", weight=ROWS).withColumn("slot_id", F.lit(None).cast("int"))
    pct = by_slot.unionByName(total).withColumnRenamed("slot_id", "_slot")
    return base.join(pct, F.col("slot_id").eqNullSafe(F.col("_slot")), "left").drop("_slot")


def interval_result(df: DataFrame, shadow_only: bool = False) -> DataFrame:
    """Decision from an interval: sure reject, sure refer, else the exact struct ``exact``."""
    tau = F.col("tau").cast("float")
    reject, refer = F.col("lower") >= tau, F.col("upper") < tau
    sure = reject | refer
    exact = F.lit(None).cast("struct<score: float, pass: boolean, visited: int>") if shadow_only else F.col("exact")
    score = F.when(reject, F.col("lower")).when(refer, F.col("upper")).otherwise(F.coalesce(exact["score"], F.col("upper")))
    return df.select(
        "*",
        reject.alias("shadow_reject"),
        F.when(sure, reject).otherwise(F.coalesce(exact["pass"], F.lit(False))).alias("final_reject"),
        (~sure).alias("fallback_used"),
        score.alias("route_score"),
        F.when(sure, 0).otherwise(F.coalesce(exact["visited"], F.lit(0))).alias("exact_visits"),
    )


def interval_stats(df: DataFrame) -> DataFrame:
    """Rates of an interval run over active rows; exact visits over fallback rows."""
    on = counted(df.where("active"), ["shadow_reject", "final_reject", "fallback_used", "exact_visits"])
    fell, shadow = F.col("fallback_used"), F.col("shadow_reject")
    n, back = _rows(), _rows(fell)
    stats = on.agg(
        n.alias("active_rows"),
        _rate(_rows(shadow), n).alias("shadow_reject_rate"),
        _rate(_rows(F.col("final_reject")), n).alias("final_reject_rate"),
        _rate(_rows(shadow), n).alias("direct_reject_rate"),
        _rate(_rows(~fell & ~shadow), n).alias("direct_refer_rate"),
        _rate(back, n).alias("fallback_rate"),
        _rate(_rows(value=F.col("exact_visits")), back).alias("exact_avg_visits"),
    )
    p99 = visit_percentiles(on.where(fell), (0.99,), visited="exact_visits", weight=ROWS)
    return _attach(stats, p99.withColumnRenamed("p99", "exact_p99_visits"), ())


PREFIX_KEYS = ("active", "shadow_reject", "final_reject", "fallback_used", "prefix_trees_used", "exact_visits")
# Columns a run may have besides: its checkpoints, router, rescue and known answer.
MORE_KEYS = (
    "direct_checkpoint", "fallback_entry_checkpoint", "route", "route_tau_bin", "anchor_checkpoint", "rescue_checkpoint",
    "rescue_route", "exact_positive",
)


def _prefix_rates(small: DataFrame, n_trees: int) -> DataFrame:
    on = small.where("active")
    fell, shadow = F.col("fallback_used"), F.col("shadow_reject")
    n, back = _rows(), _rows(fell)
    total = small.agg(_rows().alias("n_rows"), _rate(_rows(F.col("active")), _rows()).alias("active_rate"))
    stats = on.agg(
        n.alias("active_rows"),
        _rate(_rows(shadow), n).alias("shadow_reject_rate"),
        _rate(_rows(F.col("final_reject")), n).alias("final_reject_rate"),
        _rate(_rows(~fell & shadow), n).alias("direct_reject_rate"),
        _rate(_rows(~fell & ~shadow), n).alias("direct_refer_rate"),
        _rate(_rows(~fell), n).alias("direct_decision_rate"),
        _rate(back, n).alias("fallback_rate"),
        _rate(_rows(value=F.col("prefix_trees_used")), n).alias("avg_prefix_trees"),
        _rate(_rows(value=F.col("exact_visits")), back).alias("exact_avg_visits"),
        F.sum(F.col(ROWS) * F.col("prefix_trees_used")).alias("prefix_trees"),
        F.lit(n_trees).alias("n_trees"),
    )
    p99 = visit_percentiles(on.where(fell), (0.99,), visited="exact_visits", weight=ROWS)
    stats = _attach(stats, p99.withColumnRenamed("p99", "exact_p99_visits"), ())
    return _attach(total, stats, ())


def prefix_stats(df: DataFrame, n_trees: int) -> DataFrame:
    """Rates of a prefix run over active rows."""
    return _prefix_rates(counted(df, PREFIX_KEYS), n_trees)


def _families(columns: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    """Counted families of a run as ``name: (condition, key)``, all over active rows."""
    c = F.col
    direct, entry = "direct_checkpoint", "fallback_entry_checkpoint"
    rescued = "anchor_checkpoint" in columns
    at = c("anchor_checkpoint") if rescued else c(direct)
    families = {
        "checkpoint_exits": (F.lit(True), F.when(at != 0, at).otherwise(c(entry))),
        "direct_rows": (at != 0, at),
        "fallback_entries": ((at == 0) & (c(entry) != 0), c(entry)),
        "exact_visit_hist": (c("fallback_used"), c("exact_visits")),
    }
    if "route" in columns:
        families |= {"router_choices": (F.lit(True), c("route")), "router_tau_bins": (F.lit(True), c("route_tau_bin"))}
    wrong = c("shadow_reject") != c("exact_positive") if "exact_positive" in columns else None
    if wrong is not None:
        families["mismatch_by_checkpoint"] = ((at != 0) & wrong, at)
    if rescued:
        late, stage = c("rescue_checkpoint") != 0, F.when(c("anchor_checkpoint") != 0, 0).otherwise(1)
        families["anchor_exits"] = (at != 0, at)
        families["rescue_routes"] = (at == 0, c("rescue_route"))
        families["rescue_exits"] = ((at == 0) & late, c("rescue_route"))
        families["tail_rows"] = ((at == 0) & ~late & c("fallback_used"), F.lit(0))
        if wrong is not None:
            families["mismatch_by_stage"] = (((at != 0) | late) & wrong, stage)
    return families


def prefix_summary(df: DataFrame, n_trees: int) -> DataFrame:
    """One row for a whole run: the rates of :func:`prefix_stats` and its counted families as maps.

    Families are maps of a key (checkpoint, visits, route, tau bin, rescue route, stage: 0 anchor,
    1 rescue) to active rows, without empty keys; those appear whose columns ``df`` has. All come from
    one counted table, whose rows are bounded by the combinations of the small columns.
    """
    keys = [*PREFIX_KEYS, *[k for k in MORE_KEYS if k in df.columns]]
    small = counted(df, keys)
    families = _families(keys)
    marks = [
        F.when(on & key.isNotNull(), F.struct(F.lit(name).alias("family"), key.cast("bigint").alias("key"))) for name, (on, key) in families.items()
    ]
    each = small.where("active").select(ROWS, F.explode(F.array_compact(F.array(*marks))).alias("m"))
    sums = each.groupBy("m.family", "m.key").agg(F.sum(ROWS).alias("n"))
    entry = F.struct("key", "n")
    empty = F.create_map().cast("map<bigint,bigint>")
    maps = [
        F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("family") == name, entry)))), empty).alias(name) for name in families
    ]
    return _attach(_prefix_rates(small, n_trees), sums.agg(*maps), ())


def exits_by_checkpoint(df: DataFrame, checkpoints: Sequence[int]) -> DataFrame:
    """Per checkpoint: rows decided there, rows that fell back from there, and their sum."""
    on = df.where("active")
    at = F.when(F.col("direct_checkpoint") != 0, F.col("direct_checkpoint")).otherwise(F.col("fallback_entry_checkpoint"))
    counts = on.groupBy(at.cast("int").alias("checkpoint")).agg(
        F.count_if(F.col("direct_checkpoint") != 0).alias("direct_rows"),
        F.count_if(F.col("direct_checkpoint") == 0).alias("fallback_entries"),
    )
    frame = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(int(c)) for c in checkpoints])).alias("checkpoint"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = frame.join(counts, "checkpoint", "left")
    return full.select(
        "checkpoint",
        (zero("direct_rows") + zero("fallback_entries")).alias("exits"),
        zero("direct_rows").alias("direct_rows"),
        zero("fallback_entries").alias("fallback_entries"),
    )


def router_counts(df: DataFrame) -> DataFrame:
    """Active rows per route and tau bin."""
    return df.where("active").groupBy("route", "route_tau_bin").agg(F.count("*").alias("n"))


def rescue_stats(df: DataFrame) -> DataFrame:
    """Rescue routes of active rows the anchor left open: rows, rescue exits, tail rows."""
    on = df.where("active AND anchor_checkpoint = 0")
    return on.groupBy("rescue_route").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("rescue_checkpoint") != 0).alias("rescue_exits"),
        F.count_if("fallback_used").alias("tail_rows"),
    )


def shadow_mismatch(df: DataFrame) -> DataFrame:
    """Directly decided rows whose shadow decision differs from the known answer, by checkpoint
    and stage. ``df``: ``stage, checkpoint, shadow_reject, exact_positive``."""
    return df.where("checkpoint <> 0").groupBy("stage", "checkpoint").agg(
        F.count("*").alias("direct_rows"),
        F.count_if(F.col("shadow_reject") != F.col("exact_positive")).alias("mismatches"),
    )


def decision_counts(df: DataFrame, keys: Sequence[str] = (), code: str = "code") -> DataFrame:
    """Rows per decision bucket and use of tier two."""
    bucket = decision_bucket(F.col(code))
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if("used_l2").alias("used_l2"),
        *[F.count_if(bucket == i).alias(f"bucket_{i}") for i in range(OTHER_BUCKET + 1)],
    )


def batch_ack(df: DataFrame, index: str = "row_idx", n: int = 128, code: str = "code") -> DataFrame:
    """Record, ok, tier-two and decision counts per batch of ``n`` consecutive rows."""
    batches = df.withColumn("batch", F.floor(F.col(index) / F.lit(n)).cast("bigint"))
    return decision_counts(batches, ["batch"], code).withColumn("ok", F.col("rows"))


def run_summary(df: DataFrame, keys: Sequence[str], rows: str = "rows", elapsed: str = "elapsed_us") -> DataFrame:
    """Throughput over the runs of each key: median ``sorted[n // 2]``, mean, best, worst.

    Rates are compared as whole rows per second times 1000, which keeps them integers.
    """
    milli = F.floor(F.col(rows) * F.lit(1_000_000_000).cast("decimal(20,0)") / F.col(elapsed)).cast("bigint")
    runs = df.withColumn("_rate", milli)
    plain = runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.sum("_rate").alias("_sum"),
        F.max("_rate").alias("best"),
        F.min("_rate").alias("worst"),
    )
    median = order_statistics(runs, keys, "_rate", {"median": lambda n: F.floor(n / 2)})
    joined = _attach(plain, median, keys)
    return joined.withColumn("mean", F.col("_sum").cast("double") / F.col("runs")).drop("_sum")
