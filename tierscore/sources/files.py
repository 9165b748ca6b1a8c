"""Readers for the text inputs: metadata, models, policies, calibrations, clusters and routers.

Every reader returns a DataFrame in long form and accepts one file or a folder of them, with one
JSON document per line unless ``multi_line`` is set. Length and range rules of a format are
checked inside the query; a broken document fails the job with its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscore.functions.scalars import canonical_key_text
from tierscore.operators.lookups import (
    ANY_ANCHOR,
    FALLBACK,
    REFER_RESCUE,
    REJECT_RESCUE,
    fail_when,
)
from tierscore.operators.trees import NODE_SCHEMA

GB_TOLERANCE = 1e-12  # fixed value
DEFAULT_GB_TARGET = "0.0005"  # fixed value
GAP_EDGES, GAP_BINS = 257, 256  # fixed values


def read_tsv(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """Header-addressed TSV as strings plus ``_short`` (line lacks columns) and ``_line`` (order)."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        raise ValueError(f"empty table: {path}")
    header = first["value"].split("\t")
    lost = [c for c in needed if c not in header]
    if lost:
        raise ValueError(f"missing column {lost[0]!r} in {path}")
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    cells = F.split("value", "\t", -1)
    rows = lines.select(cells.alias("_c"), order.alias("_line"), "value")
    rows = rows.where((F.trim("value") != "") & (F.col("value") != F.lit(first["value"])))
    fields = [F.get("_c", F.lit(header.index(c))).alias(c) for c in needed]
    return rows.select(*fields, (F.size("_c") < len(header)).alias("_short"), "_line")


def read_route_meta_tsv(
    spark: SparkSession, path: str, expected_rows: int | None = None, on_extra: str = "fail"
) -> DataFrame:
    """Routing metadata; the last line of a row index wins, short lines are skipped.

    A row index outside ``[0, expected_rows)`` fails the job, or is dropped with
    ``on_extra="skip"``. Use ``lookups.missing_meta`` for indexes without a line.
    """
    needed = ["row_idx", "TransactionID", "fold_id", "seg_prod_amtbin", "l2_tau_used"]
    raw = read_tsv(spark, path, needed).where("NOT _short")

    def number(name: str, kind: str) -> Column:
        text = F.trim(F.col(name))
        value = text.try_cast(kind)
        message = F.concat(F.lit(f"bad {name}: "), text)
        return fail_when(text.isNotNull() & (text != "") & value.isNull(), message, value, kind)

    rows = raw.select(
        number("row_idx", "bigint").alias("row_idx"),
        number("TransactionID", "bigint").alias("transaction_id"),
        number("fold_id", "int").alias("fold_id"),
        number("seg_prod_amtbin", "bigint").alias("seg_prod_amtbin"),
        number("l2_tau_used", "float").alias("l2_tau_used"),
        "_line",
    )
    if expected_rows is not None:
        outside = (F.col("row_idx") < 0) | (F.col("row_idx") >= expected_rows)
        if on_extra == "skip":
            rows = rows.where(~outside)
        else:
            message = F.concat(F.lit("row_idx out of range: "), F.col("row_idx").cast("string"))
            rows = rows.withColumn("row_idx", fail_when(outside, message, F.col("row_idx"), "bigint"))
    fields = ["transaction_id", "fold_id", "seg_prod_amtbin", "l2_tau_used"]
    last = rows.groupBy("row_idx").agg(F.max_by(F.struct(*fields), "_line").alias("m"))
    return last.select("row_idx", "m.*")


def count_short_lines(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    return read_tsv(spark, path, needed).agg(F.count_if("_short").alias("short_lines"), F.count("*").alias("lines"))


def read_tree_model(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Node table, checked: a split needs a feature, a threshold and all three children."""
    nodes = spark.read.schema(NODE_SCHEMA).format(fmt).load(path)
    whole = F.col("is_leaf") | (
        F.col("fidx").isNotNull()
        & F.col("thr").isNotNull()
        & F.col("left").isNotNull()
        & F.col("right").isNotNull()
        & F.col("missing").isin(F.col("left"), F.col("right"))
    )
    message = F.concat_ws(" ", F.lit("broken split"), "model", F.col("tree_id").cast("string"), F.col("node_id").cast("string"))
    ok = fail_when(~F.coalesce(whole, F.lit(False)), message, F.col("is_leaf"), "boolean")
    return nodes.withColumn("is_leaf", ok)


def base_score(text: Column) -> Column:
    """Base score of a model document: the learner parameter, else the first such field.

    Accepts a number, a quoted number or one in brackets.
    """
    strict = F.get_json_object(text, "$.learner.learner_model_param.base_score")
    anywhere = F.regexp_extract(text, r'"base_score"\s*:\s*"?\s*(\[?[^,"}\]]+)', 1)
    raw = F.coalesce(strict, F.nullif(anywhere, F.lit("")))
    return F.trim(F.regexp_replace(F.trim(raw), r'^"?\[|\]"?$', "")).try_cast("float")


def read_model_base_scores(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path)
    return docs.select(F.get_json_object("value", "$.name").alias("model"), base_score(F.col("value")).alias("base_score"))


def read_feature_names(spark: SparkSession, path: str) -> list[str]:
    """Feature names of one model: a JSON array of strings (a few hundred at most)."""
    text = spark.read.text(path, wholetext=True)
    row = only_document(text.select(F.from_json("value", "array<string>").alias("names")), path)
    if not row["names"]:
        raise ValueError(f"empty feature names: {path}")
    return list(row["names"])


POLICY_SCHEMA = (
    "name string, decision struct<threshold: double>, "
    "thresholds struct<default_gb_target: string, tau_global_by_fold: map<string, map<string, double>>>, "
    "segmented_threshold struct<enabled: boolean, seg_cols: array<string>, tau_table_file: string, tau_field: string>"
)


def read_policy(spark: SparkSession, path: str, gb_target: str | None = None, multi_line: bool = False) -> DataFrame:
    """Fold-wide thresholds: ``name, l1_threshold, gb_target, fold_id, tau`` and segment settings.

    A policy without any fold value for its target fails the job.
    """
    docs = spark.read.schema(POLICY_SCHEMA).option("multiLine", multi_line).json(path)
    target = F.lit(gb_target) if gb_target else F.coalesce("thresholds.default_gb_target", F.lit(DEFAULT_GB_TARGET))
    docs = docs.withColumn("gb_target", target)
    folds = F.try_element_at(F.col("thresholds.tau_global_by_fold"), F.col("gb_target"))
    entries = F.filter(
        F.map_entries(folds), lambda e: e["key"].try_cast("int").isNotNull() & e["value"].isNotNull()
    )
    message = F.concat(F.lit("no fold-wide threshold in policy "), F.coalesce("name", F.lit("?")))
    none = F.coalesce(F.size(entries), F.lit(0)) == 0
    kind = "array<struct<key: string, value: double>>"
    docs = docs.withColumn("_e", F.explode(fail_when(none, message, entries, kind)))
    seg = F.col("segmented_threshold")
    return docs.select(
        "name",
        F.col("decision.threshold").cast("float").alias("l1_threshold"),
        "gb_target",
        F.col("_e.key").cast("int").alias("fold_id"),
        F.col("_e.value").cast("float").alias("tau"),
        F.coalesce(seg["enabled"], F.lit(False)).alias("segmented"),
        F.coalesce(seg["tau_field"], F.lit("tau_shrink")).alias("tau_field"),
    )


def read_segment_tau(spark: SparkSession, path: str, gb_target: float, tau_field: str = "tau_shrink") -> DataFrame:
    """Segment thresholds of one target: ``fold_id, seg_key, tau``; the last line of a key wins."""
    raw = read_tsv(spark, path, ["fold", "gb_target", "seg_key", tau_field]).where("NOT _short")
    rows = raw.select(
        F.trim("fold").try_cast("int").alias("fold_id"),
        F.trim("gb_target").try_cast("double").alias("gb"),
        canonical_key_text(F.coalesce("seg_key", F.lit(""))).alias("seg_key"),
        F.trim(tau_field).try_cast("float").alias("tau"),
        "_line",
    )
    rows = rows.where(F.abs(F.col("gb") - F.lit(gb_target)) <= GB_TOLERANCE)
    rows = rows.where("fold_id IS NOT NULL AND tau IS NOT NULL")
    return rows.groupBy("fold_id", "seg_key").agg(F.max_by("tau", "_line").alias("tau"))


_BAND = "ref_hi: array<float>, rej_lo: array<float>"
CALIBRATION_SCHEMA = (
    "format string, checkpoints array<int>, variants array<struct<key: string, ref_q: float, rej_q: float, "
    "tables: array<struct<checkpoint: int, gap_edges: array<float>, global_ref_hi: array<float>, "
    "global_rej_lo: array<float>, tau_edges: array<float>, "
    f"fold_tables: array<struct<fold_id: int, {_BAND}>>, "
    f"tau_fold_tables: array<struct<fold_id: int, tau_bin: int, {_BAND}>>>>>>"
)


def read_calibration(
    spark: SparkSession, path: str, variant: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Bands, one row per bin: ``variant, checkpoint, fold_id, tau_bin, gap_bin, gap_lo, ref_hi, rej_lo``.

    NULL fold marks the global level and NULL tau bin the fold level.
    """
    docs = spark.read.schema(CALIBRATION_SCHEMA).option("multiLine", multi_line).json(path)
    known = F.col("format").isin("L2PrefixCalV1", "L2PrefixCalV2")
    message = F.concat(F.lit("unsupported calibration format "), F.coalesce("format", F.lit("?")))
    docs = docs.withColumn("format", fail_when(~F.coalesce(known, F.lit(False)), message, F.col("format"), "string"))
    v = docs.select("format", F.size("checkpoints").alias("n_cp"), F.explode("variants").alias("v")).where("format IS NOT NULL")
    if variant is not None:
        v = v.where(F.col("v.key") == variant)
    count = fail_when(
        F.size("v.tables") != F.col("n_cp"), F.concat(F.lit("table count of variant "), F.col("v.key")), F.col("v.key"), "string"
    )
    t = v.select(count.alias("variant"), F.explode("v.tables").alias("t"))
    level = "array<struct<fold_id: int, tau_bin: int, ref_hi: array<float>, rej_lo: array<float>>>"
    null_int = F.lit(None).cast("int")
    top = F.array(F.struct(null_int.alias("fold_id"), null_int.alias("tau_bin"), F.col("t.global_ref_hi").alias("ref_hi"), F.col("t.global_rej_lo").alias("rej_lo")))
    mid = F.transform(
        "t.fold_tables", lambda f: F.struct(f["fold_id"].alias("fold_id"), null_int.alias("tau_bin"), f["ref_hi"].alias("ref_hi"), f["rej_lo"].alias("rej_lo"))
    )
    deep = F.transform(
        "t.tau_fold_tables", lambda f: F.struct(f["fold_id"].alias("fold_id"), f["tau_bin"].alias("tau_bin"), f["ref_hi"].alias("ref_hi"), f["rej_lo"].alias("rej_lo"))
    )
    folds = F.transform("t.fold_tables", lambda f: f["fold_id"])
    bins = F.greatest(F.size(F.coalesce("t.tau_edges", F.array().cast("array<float>"))) - 1, F.lit(0))
    stray = F.exists(
        F.coalesce("t.tau_fold_tables", F.array().cast(f"array<struct<fold_id: int, tau_bin: int, {_BAND}>>")),
        lambda f: ~F.array_contains(folds, f["fold_id"]) | (f["tau_bin"] >= bins),
    )
    levels = F.concat(top.cast(level), mid.cast(level), F.coalesce(deep, F.array().cast(level)).cast(level))
    rows = t.select(
        "variant", F.col("t.checkpoint").alias("checkpoint"), F.col("t.gap_edges").alias("edges"),
        stray.alias("stray"), F.explode(levels).alias("b"),
    )
    wrong = (
        (F.size("edges") != GAP_EDGES) | (F.size("b.ref_hi") != GAP_BINS) | (F.size("b.rej_lo") != GAP_BINS) | F.col("stray")
    )
    message = F.concat_ws(" ", F.lit("broken band table"), "variant", F.col("checkpoint").cast("string"))
    checked = fail_when(wrong, message, F.col("b.ref_hi"), "array<float>")
    return rows.select(
        "variant", "checkpoint", F.col("b.fold_id").alias("fold_id"), F.col("b.tau_bin").alias("tau_bin"), "edges",
        F.col("b.rej_lo").alias("_rej"), F.posexplode(checked).alias("gap_bin", "ref_hi"),
    ).select(
        "variant", "checkpoint", "fold_id", "tau_bin", "gap_bin", F.get("edges", "gap_bin").alias("gap_lo"),
        "ref_hi", F.get("_rej", "gap_bin").alias("rej_lo"),
    )


ATLAS_SCHEMA = (
    "format string, variant_key string, tau_edges array<float>, min_cell_count int, safe_ref_max_reject_rate float, "
    "safe_rej_min_reject_rate float, checkpoints array<struct<checkpoint: int, gap_edges: array<float>, "
    "feature_mean: array<float>, feature_inv_std: array<float>, centroids: array<array<float>>, "
    "cells: array<struct<tau_bin: int, cluster_id: int, reject_rate: array<float>, counts: array<int>>>>>"
)


def read_atlas(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Centroids (``variant, checkpoint, cluster_id, c0..c3``) and decided cells in long form."""
    docs = spark.read.schema(ATLAS_SCHEMA).option("multiLine", multi_line).json(path)
    fine = (F.col("format") == "L2PrefixAtlasV1") & (F.size("tau_edges") >= 2)
    message = F.concat(F.lit("unsupported atlas "), F.coalesce("variant_key", F.lit("?")))
    docs = docs.withColumn("variant_key", fail_when(~F.coalesce(fine, F.lit(False)), message, F.col("variant_key"), "string"))
    at = docs.select(
        F.col("variant_key").alias("variant"), (F.size("tau_edges") - 1).alias("tau_bins"), "min_cell_count",
        "safe_ref_max_reject_rate", "safe_rej_min_reject_rate", F.explode("checkpoints").alias("c"),
    )
    four = (F.size("c.feature_mean") == 4) & (F.size("c.feature_inv_std") == 4) & F.forall("c.centroids", lambda v: F.size(v) == 4)
    message = F.concat_ws(" ", F.lit("broken atlas checkpoint"), "variant", F.col("c.checkpoint").cast("string"))
    at = at.withColumn("checkpoint", fail_when(~four, message, F.col("c.checkpoint"), "int"))
    centroids = at.select("variant", "checkpoint", F.posexplode("c.centroids").alias("cluster_id", "v")).select(
        "variant", "checkpoint", "cluster_id", *[F.get("v", F.lit(i)).alias(f"c{i}") for i in range(4)]
    )
    cells = at.withColumn("e", F.explode("c.cells"))
    wrong = (
        (F.size("e.reject_rate") != GAP_BINS) | (F.size("e.counts") != GAP_BINS)
        | (F.col("e.tau_bin") >= F.col("tau_bins")) | (F.col("e.cluster_id") >= F.size("c.centroids"))
    )
    message = F.concat_ws(" ", F.lit("broken atlas cell"), "variant", F.col("checkpoint").cast("string"))
    counts = fail_when(wrong, message, F.col("e.counts"), "array<int>")
    cells = cells.select("*", F.posexplode(counts).alias("gap_bin", "count"))
    rate = F.get("e.reject_rate", "gap_bin")
    cells = cells.select(
        "variant", "checkpoint", F.col("e.tau_bin").alias("tau_bin"), F.col("e.cluster_id").alias("cluster_id"), "gap_bin",
        "count", rate.alias("reject_rate"), "min_cell_count", "safe_ref_max_reject_rate", "safe_rej_min_reject_rate",
    )
    decided = (
        F.when(F.col("count") < F.col("min_cell_count"), 0)
        .when(F.col("reject_rate") <= F.col("safe_ref_max_reject_rate"), 1)
        .when(F.col("reject_rate") >= F.col("safe_rej_min_reject_rate"), 2)
        .otherwise(0)
    )
    return centroids, cells.select("variant", "checkpoint", "tau_bin", "cluster_id", "gap_bin", "count", "reject_rate", decided.alias("cell"))


MLP_SCHEMA = (
    "format string, variant_key string, checkpoint_values array<int>, fold_values array<int>, tau_edges array<float>, "
    "checkpoint_limit int, mean array<float>, inv_std array<float>, w1 array<array<float>>, b1 array<float>, "
    "w2 array<array<float>>, b2 array<float>, w3 array<float>, b3 float, "
    "thresholds array<struct<checkpoint: int, tau_ref: float, tau_rej: float>>"
)


def only_document(docs: DataFrame, path: str):
    """The one document of a path; none or several fail."""
    found = docs.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} document: {path}")
    return found[0]


def read_mlp(spark: SparkSession, path: str, multi_line: bool = True):
    """The network of one file; its shapes are checked by the returned object."""
    from tierscore.operators.certify import Mlp

    row = only_document(spark.read.schema(MLP_SCHEMA).option("multiLine", multi_line).json(path), path)
    if row["format"] != "L2PrefixCalMlpV1":
        raise ValueError(f"unsupported certifier file: {path}")
    return Mlp(
        tuple(row["checkpoint_values"]), tuple(row["fold_values"]), tuple(row["tau_edges"]), row["checkpoint_limit"],
        tuple(row["mean"]), tuple(row["inv_std"]), tuple(map(tuple, row["w1"])), tuple(row["b1"]),
        tuple(map(tuple, row["w2"])), tuple(row["b2"]), tuple(row["w3"]), row["b3"],
        {t["checkpoint"]: (t["tau_ref"], t["tau_rej"]) for t in row["thresholds"]},
    )


ORDER_ROUTER_SCHEMA = "format string, name string, tau_edges array<float>, bundles array<struct<tau_bin: int, bundle_manifest: string, label: string>>"


def read_order_router(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Bundles by tau bin: ``name, tau_bin, tau_lo, tau_hi, bundle, label``."""
    docs = spark.read.schema(ORDER_ROUTER_SCHEMA).option("multiLine", multi_line).json(path)
    message = F.concat(F.lit("unsupported order router "), F.coalesce("format", F.lit("?")))
    bad = ~F.coalesce(F.col("format") == "L2PrefixOrderRouterV1", F.lit(False))
    rows = docs.select(fail_when(bad, message, F.coalesce("name", F.lit("")), "string").alias("name"), "tau_edges", F.explode("bundles").alias("b"))
    label = F.coalesce("b.label", F.concat(F.lit("tau_bin_"), F.col("b.tau_bin").cast("string")))
    return rows.select(
        "name", F.col("b.tau_bin").alias("tau_bin"), F.get("tau_edges", "b.tau_bin").alias("tau_lo"),
        F.get("tau_edges", F.col("b.tau_bin") + 1).alias("tau_hi"), F.col("b.bundle_manifest").alias("bundle"), label.alias("label"),
    )


RESCUE_ROUTER_SCHEMA = (
    "format string, name string, tau_edges array<float>, gap_edges array<float>, "
    "rows array<struct<anchor_checkpoint: int, tau_bin: int, fold_id: int, shadow_side: int, gap_bin: int, action: string, row_count: bigint>>, "
    "defaults array<struct<anchor_checkpoint: int, tau_bin: int, shadow_side: int, action: string>>"
)


def read_rescue_router(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Router rows and defaults; the first format version has no anchor and matches any."""
    docs = spark.read.schema(RESCUE_ROUTER_SCHEMA).option("multiLine", multi_line).json(path)
    known = F.col("format").isin("L2AnchorRescueRouterV1", "L2AnchorRescueRouterV2")
    message = F.concat(F.lit("unsupported rescue router "), F.coalesce("format", F.lit("?")))
    docs = docs.withColumn("format", fail_when(~F.coalesce(known, F.lit(False)), message, F.col("format"), "string"))
    v2 = F.col("format") == "L2AnchorRescueRouterV2"

    def shaped(rows: DataFrame, cols: list[str]) -> DataFrame:
        anchor = F.when(v2, F.coalesce("r.anchor_checkpoint", F.lit(0))).otherwise(ANY_ANCHOR)
        legal = F.col("r.action").isin(FALLBACK, REJECT_RESCUE, REFER_RESCUE)
        text = F.concat(F.lit("unsupported rescue action "), F.col("r.action"))
        action = fail_when(~legal, text, F.col("r.action"), "string")
        picked = [F.col(f"r.{c}").alias("side" if c == "shadow_side" else c) for c in cols]
        return rows.select("name", anchor.cast("int").alias("anchor"), *picked, action.alias("action"))

    actions = shaped(docs.select("format", "name", F.explode("rows").alias("r")), ["tau_bin", "fold_id", "shadow_side", "gap_bin"])
    defaults = shaped(docs.select("format", "name", F.explode("defaults").alias("r")), ["tau_bin", "shadow_side"])
    return actions, defaults


# Packet bank names.
PACKET_BANKS = {"scout": 2, "reject": 1, "refer": 0}


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet summary TSV: ``packet_id, bank_id, tree_count, block_cost, trees``."""
    raw = read_tsv(spark, path, ["packet_id", "packet_bank", "tree_count", "block_cost", "tree_pos_list"])
    bank = F.lit(-1)
    for name, value in PACKET_BANKS.items():
        bank = F.when(F.col("packet_bank") == name, F.lit(value)).otherwise(bank)
    trees = F.filter(F.split(F.coalesce("tree_pos_list", F.lit("")), ","), lambda t: t != "")
    return raw.where(F.trim("packet_id") != "").select(
        F.col("packet_id").cast("int").alias("packet_id"), bank.alias("bank_id"), F.col("tree_count").cast("int").alias("tree_count"),
        F.col("block_cost").cast("float").alias("block_cost"), trees.cast("array<int>").alias("trees"),
    )


PACKET_POLICY_SCHEMA = (
    "format string, packet_family string, packet_size int, n_packets int, max_steps int, tau_edges array<float>, "
    "gap_edges_by_step array<array<float>>, delta_edges_by_step array<array<float>>, "
    "policy_rows array<struct<step: int, tau_bin: int, gap_regime: int, delta_regime: int, row_count: bigint, ranking: array<int>>>"
)


def read_packet_policy(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Policy rows: ``family, step, tau_bin, gap_bin, delta_bin, row_count, ord, ranking``."""
    docs = spark.read.schema(PACKET_POLICY_SCHEMA).option("multiLine", multi_line).json(path)
    bad = ~F.coalesce(F.col("format") == "L2PacketSchedulerPolicyV1", F.lit(False))
    message = F.concat(F.lit("unsupported packet policy "), F.coalesce("format", F.lit("?")))
    rows = docs.select(
        fail_when(bad, message, F.col("packet_family"), "string").alias("family"), "n_packets", F.posexplode("policy_rows").alias("ord", "r")
    )
    outside = F.exists("r.ranking", lambda p: p >= F.col("n_packets"))
    text = F.concat(F.lit("packet outside the scheduler of "), "family")
    ranking = fail_when(outside, text, F.col("r.ranking"), "array<int>")
    return rows.select(
        "family", F.col("r.step").alias("step"), F.col("r.tau_bin").alias("tau_bin"), F.col("r.gap_regime").alias("gap_bin"),
        F.col("r.delta_regime").alias("delta_bin"), F.col("r.row_count").alias("row_count"), "ord", ranking.alias("ranking"),
    )


EXPERT_SCHEMA = "name string, selected_experts array<struct<seg_key: string, model_dir: string, threshold_mode: string>>"


def read_experts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Expert slots: slot 0 is the global model, slot i+1 the i-th expert of the manifest."""
    docs = spark.read.schema(EXPERT_SCHEMA).option("multiLine", multi_line).json(path)
    rows = docs.select("name", F.posexplode("selected_experts").alias("i", "e"))
    mode = F.coalesce("e.threshold_mode", F.lit("zero"))
    text = F.concat(F.lit("unsupported threshold mode "), mode)
    return rows.select(
        "name", (F.col("i") + 1).alias("slot_id"), F.concat(F.lit("seg:"), F.col("e.seg_key")).alias("label"),
        fail_when(~mode.isin("tau", "zero"), text, mode, "string").alias("threshold_mode"),
    )


APPROX_SCHEMA = (
    "checkpoints array<int>, tau_ref array<float>, tau_pass array<float>, tau_reject array<float>, "
    "used_checkpoints array<int>, used_tau_ref array<float>, used_tau_pass array<float>, used_tau_reject array<float>, k_hot int"
)


def read_approx_policy(spark: SparkSession, path: str, multi_line: bool = True):
    """Early-exit policy; the compacted ``used_*`` lists win, and reject limits over pass limits."""
    from tierscore.operators.trees import ApproxPolicy

    row = only_document(spark.read.schema(APPROX_SCHEMA).option("multiLine", multi_line).json(path), path)
    used = "used_" if any(row[c] for c in ("used_checkpoints", "used_tau_ref", "used_tau_pass", "used_tau_reject")) else ""
    pos = row[f"{used}tau_reject"] or row[f"{used}tau_pass"] or []
    return ApproxPolicy(tuple(row[f"{used}checkpoints"] or ()), tuple(row[f"{used}tau_ref"] or ()), tuple(pos), row["k_hot"] or 0)
