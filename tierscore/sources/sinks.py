"""Result layouts: tab-separated score files, JSON traces, statistics, windows, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscore.functions.scalars import fixed9

# Decision labels of a layout as (positive, negative).
PASS_REFER, REJECT_REFER = ("PASS", "REFER"), ("REJECT", "REFER")

WINDOW_COLUMNS = (
    "t_ms", "attempted", "ok", "err", "timeout", "dropped", "drop_inflight_cap", "drop_conn_queue_full", "http_2xx",
    "http_429", "http_5xx", "queue_p99_us", "send_p99_us", "server_rtt_p99_us", "e2e_p99_us", "batch_e2e_p99_us",
    "stage_router_p99_us", "stage_l1_p99_us", "stage_l2_p99_us",
)


def _label(flag: str, names: tuple[str, str]) -> Column:
    return F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(names[0])).otherwise(F.lit(names[1]))


def _flag(name: str) -> Column:
    return F.col(name).cast("int")


def scored_layout(df: DataFrame, layout: str, second_tier: bool = False) -> DataFrame:
    """Columns of one score file; scores print with nine decimals, missing ones as NaN."""
    head = [F.col("txn_id").alias("TransactionID"), F.col("label").alias("isFraud")]
    if layout == "infer":
        tier, names = ("l2", REJECT_REFER) if second_tier else ("l1", PASS_REFER)
        body = [
            fixed9(F.col("score")).alias("route_score"), _label("pass", names).alias(f"{tier}_decision"),
            F.col("visited").alias("visited_trees"),
        ]
    elif layout == "dispatch":
        body = [fixed9(F.col("route_score")).alias("route_score"), _label("reject", REJECT_REFER).alias("l2_decision"), F.col("visited_trees")]
    elif layout == "qs":
        body = [fixed9(F.col("score")).alias("l2_score")]
    elif layout == "qs-fast":
        body = [
            fixed9(F.col("lower")).alias("lower_bound"), fixed9(F.col("upper")).alias("upper_bound"),
            _label("shadow_reject", REJECT_REFER).alias("shadow_decision"), _label("final_reject", REJECT_REFER).alias("l2_decision"),
            _flag("fallback_used").alias("fallback_used"), fixed9(F.col("route_score")).alias("route_score"),
            F.col("work_evals").alias("qs_block_evals"), F.col("exact_visits").alias("exact_visited_trees"),
        ]
    elif layout == "qs-prefix":
        body = [
            fixed9(F.col("prefix_score")).alias("prefix_score"), F.col("prefix_trees_used"),
            _label("shadow_reject", REJECT_REFER).alias("shadow_decision"), _label("final_reject", REJECT_REFER).alias("l2_decision"),
            _flag("fallback_used").alias("fallback_used"), F.col("direct_checkpoint"), F.col("fallback_entry_checkpoint"),
            F.col("router_choice"), F.col("router_tau_bin"), fixed9(F.col("route_score")).alias("route_score"),
            F.col("work_evals").alias("qs_block_evals"), F.col("exact_visits").alias("exact_visited_trees"),
        ]
    else:
        raise ValueError(f"unknown layout: {layout}")
    return df.select(*head, *body)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("nullValue", "").option("quote", "").csv(path)


def write_scored(df: DataFrame, path: str, layout: str, second_tier: bool = False) -> None:
    write_tsv(scored_layout(df, layout, second_tier), path)


def trace_json(df: DataFrame, checkpoints: list[int]) -> DataFrame:
    """One JSON document per active row, with an entry per checkpoint in each array."""
    doc = F.struct(
        F.col("txn_id").alias("TransactionID"), F.col("label").alias("isFraud"), "fold_id", F.col("tau").alias("tau_used"),
        F.col("final_reject").cast("int").alias("exact_final_label"), "prefix_score", "prefix_trees_used",
        F.col("fallback_used").cast("int").alias("fallback_used"), "router_choice", "router_tau_bin",
        F.array(*[F.lit(c) for c in checkpoints]).alias("checkpoints"), "checkpoint_scores", "checkpoint_work_evals",
        "checkpoint_deltas", "checkpoint_resolved_early",
    )
    return df.where("active").select(F.to_json(doc).alias("value"))


def write_trace(df: DataFrame, path: str, checkpoints: list[int]) -> None:
    trace_json(df, checkpoints).write.text(path)


def write_stats(df: DataFrame, path: str) -> None:
    """A statistics table as JSON; one small row per group."""
    df.write.json(path)


def write_windows(df: DataFrame, path: str) -> None:
    df.select(*WINDOW_COLUMNS).write.option("header", True).csv(path)


def decision_layout(df: DataFrame) -> DataFrame:
    """Decision dump: the second-tier score stays blank where tier two was not used."""
    return df.select(
        "row_idx", F.col("txn_id").alias("transaction_id"), F.col("used_l2").cast("int").alias("used_l2"), "decision",
        F.when(F.col("used_l2"), F.col("l2_score")).alias("l2_score"), F.coalesce(F.col("tau_used"), F.lit(0.0)).alias("tau_used"), "fold_id",
    )


def write_decisions(df: DataFrame, path: str) -> None:
    write_tsv(decision_layout(df), path)
