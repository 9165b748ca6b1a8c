"""Threshold, band, cluster, router and metadata lookups as joins on small side tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierscore.functions.bins import bin_by_edges, count_in_long, every_stride, float_array, guard_bins, let
from tierscore.operators.forest import Bands, Clusters
from tierscore.operators.forest import band_limits as band_limits_of
from tierscore.operators.skew import is_small, last_per_key, lookup_join, salted_join
from tierscore.session import materialise

# Router actions.
FALLBACK, REJECT_RESCUE, REFER_RESCUE = "fallback", "run_reject_rescue", "run_refer_rescue"
# Numeric code of each router action.
RESCUE_CODES = {FALLBACK: 1, REJECT_RESCUE: 2, REFER_RESCUE: 3}
ANY_ANCHOR = -1
OTHER_FOLD = -(1 << 31)
MAX_FOLDS = 10_000


def fail_when(bad: Column, message: Column, value: Column, kind: str) -> Column:
    """``value``, or a job failure naming the offender."""
    return F.when(bad, F.raise_error(message).cast(kind)).otherwise(value)


def join_row_meta(features: DataFrame, meta: DataFrame, key: str = "txn_id") -> DataFrame:
    """1:1 join with strict key equality: a key missing or repeated on either side fails the job."""
    same = Window.partitionBy(key)
    left = features.withColumn("_f", F.count("*").over(same))
    right = meta.withColumn("_m", F.count("*").over(same))
    both = left.join(right, key, "full")
    fault = (
        F.when(F.col("_f").isNull(), "missing in features")
        .when(F.col("_m").isNull(), "missing in metadata")
        .when(F.col("_f") > 1, "repeated in features")
        .when(F.col("_m") > 1, "repeated in metadata")
    )
    message = F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")), F.lit(" "), fault)
    kind = dict(both.dtypes)[key]
    return both.withColumn(key, fail_when(fault.isNotNull(), message, F.col(key), kind)).drop("_f", "_m")


def resolve_tau(
    df: DataFrame,
    seg_tau: DataFrame | None,
    global_tau: DataFrame,
    default_fold: int = 1,
    key: str = "seg_key",
) -> DataFrame:
    """Adds ``fold_used`` and ``tau``: explicit row value, else segment, else fold-wide value.

    A fold without a fold-wide value is replaced by the smallest fold that has one. Of repeated keys
    of a threshold table the last counts (see ``last_per_key``).
    """
    global_tau = last_per_key(global_tau, ["fold_id"], ["tau"])
    first = global_tau.orderBy("fold_id").first()
    if first is None:
        raise ValueError("no fold-wide threshold available")
    fold = F.coalesce(F.col("fold_id"), F.lit(default_fold))
    rows = df.withColumn("_fold", fold)
    side = global_tau.select(F.col("fold_id").alias("_fold"), F.col("tau").cast("float").alias("_g"))
    rows = lookup_join(rows, side, ["_fold"])
    known = F.col("_g").isNotNull()
    rows = rows.withColumn("fold_used", F.when(known, F.col("_fold")).otherwise(F.lit(first["fold_id"])).cast("int"))
    rows = rows.withColumn("_g", F.coalesce("_g", F.lit(float(first["tau"])).cast("float")))
    seg = F.lit(None).cast("float")
    if seg_tau is not None:
        side = last_per_key(seg_tau, ["fold_id", "seg_key"], ["tau"]).select(
            F.col("fold_id").alias("fold_used"), F.col("seg_key").alias(key), F.col("tau").cast("float").alias("_s")
        )
        rows = lookup_join(rows, side, ["fold_used", key])
        seg = F.col("_s")
    tau = F.coalesce(F.col("l2_tau_used").cast("float"), seg, F.col("_g"))
    return rows.withColumn("tau", tau).drop("_fold", "_g", "_s")


# --- calibration bands --------------------------------------------------------------------


@dataclass(frozen=True, eq=False)
class Calibration:
    """Bands per checkpoint. ``bands`` is long: ``checkpoint, fold_id, tau_bin, gap_bin, ref_hi,
    rej_lo`` with NULL fold for the global level and NULL tau bin for the fold level."""

    checkpoints: tuple[int, ...]
    gap_edges: tuple[tuple[float, ...], ...]
    tau_edges: tuple[float, ...]
    bands: DataFrame

    def tau_bin(self, tau: Column) -> Column:
        return bin_by_edges(tau, self.tau_edges) if len(self.tau_edges) >= 2 else F.lit(0)

    @cached_property
    def small(self) -> bool:
        """Whether the band table is small enough to send to every task (checked once)."""
        return is_small(self.bands)

    @cached_property
    def folds(self) -> tuple[int, ...]:
        """Folds with tables of their own; all others share the global bands."""
        found = self.bands.where("fold_id IS NOT NULL").select("fold_id").distinct().limit(MAX_FOLDS + 1).collect()
        if len(found) > MAX_FOLDS:
            raise ValueError(f"more than {MAX_FOLDS} calibrated folds")
        return tuple(sorted(r["fold_id"] for r in found))

    @cached_property
    def routes(self) -> DataFrame:
        """The resolved bands, written once so that later stages only read them."""
        return materialise(bands_by_route(self), "bands")

    @cached_property
    def tables(self) -> Bands:
        """The bands as arrays, for tables that are small enough to send to every task."""
        cells = last_per_key(self.bands, ["checkpoint", "fold_id", "tau_bin", "gap_bin"], ["ref_hi", "rej_lo"])
        cells = cells.orderBy("checkpoint", "fold_id", "tau_bin", "gap_bin").toArrow()
        rows, keys = {}, zip(*(cells[c].to_pylist() for c in ("checkpoint", "fold_id", "tau_bin")), strict=True)
        for i, key in enumerate(keys):
            rows.setdefault(key, []).append(i)
        limits = [cells[c].fill_null(float("nan")).to_numpy().astype("float32") for c in ("ref_hi", "rej_lo")]
        found = [(*key, *(v[at] for v in limits)) for key, at in rows.items()]
        return Bands(self.checkpoints, self.gap_edges, self.tau_edges, self.folds, found)

    def join(self, left: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
        """Left join to a table packed from the bands, which has fewer rows than they have."""
        return left.join(F.broadcast(side), list(on), "left") if self.small else salted_join(left, side, on)


BAND_TYPE = "struct<edges: array<float>, coarse: array<float>, ref_hi: array<float>, rej_lo: array<float>>"


def pack_bands(cal: Calibration) -> DataFrame:
    """One row per (checkpoint, fold, tau bin): ``band`` with the edges and both limits as arrays."""
    cell = F.struct("gap_bin", "ref_hi", "rej_lo")
    cells = last_per_key(cal.bands, ["checkpoint", "fold_id", "tau_bin", "gap_bin"], ["ref_hi", "rej_lo"])
    packed = cells.groupBy("checkpoint", "fold_id", "tau_bin").agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    edges = F.lit(None).cast("array<float>")
    for cp, values in zip(cal.checkpoints, cal.gap_edges):
        edges = F.when(F.col("checkpoint") == cp, float_array(values)).otherwise(edges)
    packed = packed.withColumn("_e", edges)
    band = F.struct(
        F.col("_e").alias("edges"),
        every_stride(F.col("_e")).alias("coarse"),
        F.transform("_c", lambda c: c["ref_hi"].cast("float")).alias("ref_hi"),
        F.transform("_c", lambda c: c["rej_lo"].cast("float")).alias("rej_lo"),
    )
    return packed.select("checkpoint", "fold_id", "tau_bin", band.cast(BAND_TYPE).alias("band"))


def band_bin(band: Column, gap: Column) -> Column:
    """Gap bin among the 257 edges of a packed band; 0 for a missing gap."""
    raw = F.coalesce(count_in_long(band["edges"], band["coarse"], F.when(~F.isnan(gap), gap)), F.lit(0)) - 1
    return F.greatest(F.least(raw, F.size(band["edges"]) - 2), F.lit(0))


def band_limits(band: Column, gap: Column) -> Column:
    """Struct of ``gap_bin, ref_hi, rej_lo``: limits over the bins that rounding could reach."""

    def limits(s: Column, b: Column) -> Column:
        lo, hi = guard_bins(s["g"], s["b"]["edges"], b)
        span = F.struct((lo + 1).alias("start"), (hi - lo + 1).alias("n"))
        return let(
            span,
            lambda p: F.struct(
                b.alias("gap_bin"),
                F.array_max(F.slice(s["b"]["ref_hi"], p["start"], p["n"])).alias("ref_hi"),
                F.array_min(F.slice(s["b"]["rej_lo"], p["start"], p["n"])).alias("rej_lo"),
            ),
        )

    both = F.struct(gap.cast("float").alias("g"), band.alias("b"))
    return let(both, lambda s: let(band_bin(s["b"], s["g"]), lambda b: limits(s, b)))


def lookup_bands(df: DataFrame, cal: Calibration) -> DataFrame:
    """Adds ``ref_hi`` and ``rej_lo`` to rows of ``checkpoint, fold_id, tau, gap``.

    The most specific table that exists wins: (fold, tau bin), else fold, else global. Over the
    guard bins the larger ``ref_hi`` and the smaller ``rej_lo`` count.
    """
    if cal.small:
        found = band_limits_of(F.col("checkpoint"), F.col("fold_id"), F.col("tau"), F.col("gap"), cal.tables)
        return df.withColumn("_f", found).select(*df.columns, "_f.*")
    slot = F.array_position(F.array(*[F.lit(int(c)) for c in cal.checkpoints]), F.col("checkpoint").cast("int")) - 1
    rows = attach_bands(df.withColumn("tau_bin", cal.tau_bin(F.col("tau"))), cal, "_limits")
    found = band_limits(F.get("_limits", slot.cast("int")), F.col("gap"))
    return rows.select(*df.columns, "tau_bin", found.alias("_f")).select(*df.columns, "tau_bin", "_f.*")


def bands_by_route(cal: Calibration) -> DataFrame:
    """Bands resolved per (fold, tau bin) for all checkpoints at once.

    One small row per route: ``fold_id, tau_bin, limits`` where ``limits`` holds, in checkpoint
    order, the arrays that :func:`lookup_bands` would choose. Fold ``OTHER_FOLD`` serves folds
    without a table. A cascade thus needs one lookup per row instead of one per checkpoint.
    """
    packed = pack_bands(cal)
    slot = F.array_position(F.array(*[F.lit(int(c)) for c in cal.checkpoints]), F.col("checkpoint").cast("int"))
    packed = packed.withColumn("slot", slot).where("slot > 0")
    every_bin = F.sequence(F.lit(0), F.lit(max(len(cal.tau_edges) - 1, 1) - 1))
    folds = F.array(*[F.lit(int(f)) for f in (*cal.folds, OTHER_FOLD)])
    # Every table offers itself to the routes it covers; the most specific offer wins.
    level = F.when(F.col("tau_bin").isNotNull(), 2).when(F.col("fold_id").isNotNull(), 1).otherwise(0)
    offers = packed.select(
        "slot",
        "band",
        level.alias("level"),
        F.explode(F.when(F.col("fold_id").isNull(), folds).otherwise(F.array("fold_id"))).alias("fold_id"),
        "tau_bin",
    )
    bins = F.when(F.col("tau_bin").isNull(), every_bin).otherwise(F.array("tau_bin"))
    offers = offers.withColumn("tau_bin", F.explode(bins))
    best = offers.groupBy("fold_id", "tau_bin", "slot").agg(F.max_by("band", "level").alias("band"))
    cells = F.array_sort(F.collect_list(F.struct("slot", "band")))
    out = best.groupBy("fold_id", "tau_bin").agg(cells.alias("c"))
    return out.select("fold_id", "tau_bin", F.transform("c", lambda c: c["band"]).alias("limits"))


def attach_bands(df: DataFrame, cal: Calibration, out: str = "limits") -> DataFrame:
    """Adds the resolved bands of each row's (fold, tau) as one array column."""
    side = cal.routes.select(F.col("fold_id").alias("_cal_fold"), F.col("tau_bin").alias("_cal_bin"), F.col("limits").alias(out))
    fold = F.col("fold_id").cast("int")
    own = F.when(fold.isin(list(cal.folds)), fold).otherwise(OTHER_FOLD) if cal.folds else F.lit(OTHER_FOLD)
    rows = df.withColumn("_cal_fold", own).withColumn("_cal_bin", cal.tau_bin(F.col("tau")))
    return cal.join(rows, side, ["_cal_fold", "_cal_bin"]).drop("_cal_fold", "_cal_bin")


# --- clusters -----------------------------------------------------------------------------


@dataclass(frozen=True)
class AtlasCheckpoint:
    checkpoint: int
    mean: tuple[float, ...]
    inv_std: tuple[float, ...]
    centroids: tuple[tuple[float, ...], ...]
    gap_edges: tuple[float, ...] = ()


@dataclass(frozen=True, eq=False)
class Atlas:
    """Cluster geometry per checkpoint (a handful of numbers) and the decision cells as a table
    ``checkpoint, tau_bin, cluster_id, gap_bin, cell`` with cell 1 = refer, 2 = reject, 0 = none."""

    tau_edges: tuple[float, ...]
    checkpoints: tuple[AtlasCheckpoint, ...]
    cells: DataFrame

    def tau_bin(self, tau: Column) -> Column:
        return bin_by_edges(tau, self.tau_edges) if len(self.tau_edges) >= 2 else F.lit(0)

    @cached_property
    def deciding(self) -> DataFrame:
        cells = last_per_key(self.cells, ["checkpoint", "tau_bin", "cluster_id", "gap_bin"], ["cell"])
        return cells.where("cell > 0")

    @cached_property
    def small(self) -> bool:
        """Whether the deciding cells are few enough to send to every task (checked once)."""
        return is_small(self.deciding)

    def tables(self, checkpoints: Sequence[int]) -> Clusters:
        by_cp = {a.checkpoint: a for a in self.checkpoints}
        shapes = [(a.mean, a.inv_std, a.centroids, a.gap_edges) for a in (by_cp[c] for c in checkpoints)]
        rows = self.deciding.select("checkpoint", "tau_bin", "cluster_id", "gap_bin", "cell").collect()
        return Clusters(checkpoints, self.tau_edges, shapes, [tuple(r) for r in rows])


def nearest_cluster(at: AtlasCheckpoint, gap: Column, delta_prev: Column, delta_64: Column) -> Column:
    """Cluster whose centroid is nearest to the four standardised inputs; first one on a tie.

    The squared distance is compared through ``2 c.x - c.c``, which differs from it by a term
    that is the same for every centroid.
    """
    f = lambda v: F.lit(float(v)).cast("float")
    raw = [gap, F.abs(gap), delta_prev, delta_64]
    z = [(v.cast("float") - f(m)) * f(s) for v, m, s in zip(raw, at.mean, at.inv_std)]
    if not at.centroids:
        return F.lit(None).cast("int")

    def scores(v: Column) -> Column:
        out = []
        for c in at.centroids:
            total = F.get(v, F.lit(0)) * f(2.0 * c[0])
            for i in (1, 2, 3):
                total = total + F.get(v, F.lit(i)) * f(2.0 * c[i])
            out.append(total + f(-sum(x * x for x in c)))
        return F.array(*out)

    best = let(let(F.array(*z), scores), lambda a: F.array_position(a, F.array_max(a)))
    return (best - 1).cast("int")


def cell_decision(count: Column, reject_rate: Column, min_count: int, safe_ref: float, safe_rej: float) -> Column:
    """1 = refer, 2 = reject, 0 = not safe: too few rows or a rate between both limits."""
    return (
        F.when(count < min_count, 0)
        .when(reject_rate <= safe_ref, 1)
        .when(reject_rate >= safe_rej, 2)
        .otherwise(0)
        .cast("int")
    )


def lookup_atlas(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``cell`` to rows of ``checkpoint, tau_bin, cluster_id, gap_bin``; 0 where none exists."""
    on = ["checkpoint", "tau_bin", "cluster_id", "gap_bin"]
    return lookup_join(df, last_per_key(cells, on, ["cell"]), on).withColumn("cell", F.coalesce("cell", F.lit(0)))


def cell_key(checkpoint: Column, cluster: Column, gap_bin: Column) -> Column:
    """Key of a cell; a struct, so numbers of any size stay apart."""
    parts = {"checkpoint": checkpoint, "cluster_id": cluster, "gap_bin": gap_bin}
    return F.struct(*[c.cast("bigint").alias(n) for n, c in parts.items()])


def attach_atlas(df: DataFrame, atlas: Atlas, out: str = "atlas_cells") -> DataFrame:
    """Adds the cells of each row's tau bin as a map ``(checkpoint, cluster, gap bin) -> cell``.

    Only deciding cells are kept. The map is bounded by checkpoints x clusters x 256.
    """
    key = cell_key(F.col("checkpoint"), F.col("cluster_id"), F.col("gap_bin"))
    entry = F.struct(key.alias("k"), F.col("cell").cast("int").alias("v"))
    cells = last_per_key(atlas.cells, ["checkpoint", "tau_bin", "cluster_id", "gap_bin"], ["cell"])
    side = cells.where("cell > 0").groupBy(F.col("tau_bin").alias("_ab")).agg(
        F.map_from_entries(F.collect_list(entry)).alias(out)
    )
    rows = df.withColumn("_ab", atlas.tau_bin(F.col("tau")))
    return lookup_join(rows, side, ["_ab"]).drop("_ab")


SHAPE_TYPE = "array<struct<mean: array<float>, scale: array<float>, w: array<array<float>>, edges: array<float>>>"


def atlas_shapes(atlas: Atlas, checkpoints: Sequence[int]) -> Column:
    """The cluster geometry as one constant array in checkpoint order.

    ``w`` holds ``2 c`` and ``-c.c`` of each centroid.
    """
    by_cp = {a.checkpoint: a for a in atlas.checkpoints}
    shapes = []
    for cp in checkpoints:
        at = by_cp[cp]
        w = [[2.0 * v for v in c] + [-sum(v * v for v in c)] for c in at.centroids]
        shapes.append({"mean": at.mean, "scale": at.inv_std, "w": w, "edges": at.gap_edges})
    return F.from_json(F.lit(json.dumps(shapes)), SHAPE_TYPE)


def atlas_cell_key(shapes: Column, s: Column, shared_bin: Column) -> Column:
    """Cell key at a checkpoint: nearest centroid (first on a tie) and gap bin.

    ``s`` is a struct of ``slot, checkpoint, gap, dp, d64``; ``shared_bin`` is used where the
    checkpoint has no gap edges of its own.
    """
    at = lambda arr, i: F.get(arr, F.lit(i))

    def cluster(g: Column) -> Column:
        raw = F.array(s["gap"], F.abs(s["gap"]), s["dp"], s["d64"])
        centred = F.zip_with(raw, g["mean"], lambda x, m: (x - m).cast("float"))
        z = F.zip_with(centred, g["scale"], lambda x, v: (x * v).cast("float"))
        score = lambda v, w: at(v, 0) * at(w, 0) + at(v, 1) * at(w, 1) + at(v, 2) * at(w, 2) + at(v, 3) * at(w, 3) + at(w, 4)
        totals = let(z, lambda v: F.transform(g["w"], lambda w: score(v, w)))
        return let(totals, lambda t: F.array_position(t, F.array_max(t)) - 1)

    def key(g: Column) -> Column:
        own = F.when(F.size(g["edges"]) >= 2, bin_by_edges(s["gap"], g["edges"])).otherwise(shared_bin)
        return cell_key(s["checkpoint"], cluster(g), F.least(own, F.lit(255)))

    return let(F.get(shapes, s["slot"]), key)


# --- routers ------------------------------------------------------------------------------


def shadow_side(prefix: Column, tau: Column) -> Column:
    return F.when(prefix >= tau, 1).otherwise(-1)


def lookup_rescue(
    df: DataFrame, actions: DataFrame, defaults: DataFrame, tau_edges: Sequence[float], gap_edges: Sequence[float]
) -> DataFrame:
    """Adds ``action`` to rows of ``anchor, tau, fold_id, prefix``.

    Exact (anchor, tau bin, fold, side, gap bin) first, then the default of (anchor, tau bin,
    side), then fallback. Router rows of anchor ``ANY_ANCHOR`` match every anchor.
    """
    gap = (F.col("tau") - F.col("prefix")).cast("float")
    rows = (
        df.withColumn("tau_bin", bin_by_edges(F.col("tau"), tau_edges) if len(tau_edges) >= 2 else F.lit(0))
        .withColumn("gap_bin", bin_by_edges(gap, gap_edges))
        .withColumn("side", shadow_side(F.col("prefix"), F.col("tau")))
    )
    found = []
    for table, on in ((actions, ["tau_bin", "fold_id", "side", "gap_bin"]), (defaults, ["tau_bin", "side"])):
        for keyed in (True, False):
            name = f"_a{len(found)}"
            pick = table.where((F.col("anchor") != ANY_ANCHOR) if keyed else (F.col("anchor") == ANY_ANCHOR))
            cols = ["anchor", *on] if keyed else on
            side = last_per_key(pick, cols, ["action"]).withColumnRenamed("action", name)
            rows = lookup_join(rows, side, cols)
            found.append(name)
    return rows.withColumn("action", F.coalesce(*found, F.lit(FALLBACK))).drop(*found)


def rescue_code(action: Column) -> Column:
    out = F.lit(RESCUE_CODES[FALLBACK])
    for name, code in RESCUE_CODES.items():
        out = F.when(action == name, F.lit(code)).otherwise(out)
    return out


def route_by_tau(df: DataFrame, routes: DataFrame, tau_edges: Sequence[float]) -> DataFrame:
    """Adds ``route_tau_bin`` and ``route`` (the bundle of the bin); an unassigned bin fails."""
    rows = df.withColumn("route_tau_bin", bin_by_edges(F.col("tau"), tau_edges) if len(tau_edges) >= 2 else F.lit(0))
    side = last_per_key(routes, ["tau_bin"], ["route"])
    side = side.select(F.col("tau_bin").alias("route_tau_bin"), F.col("route").alias("_route"))
    rows = lookup_join(rows, side, ["route_tau_bin"])
    message = F.concat(F.lit("no bundle for tau bin "), F.col("route_tau_bin").cast("string"))
    return rows.withColumn("route", fail_when(F.col("_route").isNull(), message, F.col("_route"), "int")).drop("_route")


@dataclass(frozen=True, eq=False)
class PacketPolicy:
    """``rows`` is ``step, tau_bin, gap_bin, delta_bin, row_count, ord, ranking``."""

    max_steps: int
    tau_edges: tuple[float, ...]
    gap_edges: tuple[tuple[float, ...], ...]
    delta_edges: tuple[tuple[float, ...], ...]
    rows: DataFrame

    @cached_property
    def small(self) -> bool:
        """Whether the rankings are few enough to send to every task (checked once)."""
        return is_small(self.rows)

    @cached_property
    def rankings(self) -> list[dict[tuple, list]]:
        """Per step the rankings by ``(tau bin, gap bin, delta bin)``, ``(tau bin,)`` and ``()``."""
        exact = ["step", "tau_bin", "gap_bin", "delta_bin"]
        states = last_per_key(self.rows, exact, ["row_count", "ord", "ranking"])
        by_tau, by_step = policy_defaults(states)
        found: list[dict[tuple, list]] = [{} for _ in range(self.max_steps)]
        for table, on in ((states, exact), (by_tau, exact[:2]), (by_step, exact[:1])):
            for r in table.where(F.col("ranking").isNotNull()).select(*on, "ranking").collect():
                if r["step"] is not None and 0 <= r["step"] < self.max_steps and None not in r[:-1]:
                    found[r["step"]][tuple(r[1:-1])] = list(r["ranking"])
        return found


def policy_defaults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranking with the largest row count per (step, tau bin) and per step; first on a tie."""
    best = F.max_by("ranking", F.struct(F.col("row_count"), -F.col("ord"))).alias("ranking")
    return rows.groupBy("step", "tau_bin").agg(best), rows.groupBy("step").agg(best)


def rank_packets(df: DataFrame, policy: PacketPolicy) -> DataFrame:
    """Adds ``ranking`` to rows of ``step, tau_bin, gap_bin, delta_bin``; NULL if the step is unknown."""
    exact = ["step", "tau_bin", "gap_bin", "delta_bin"]
    states = last_per_key(policy.rows, exact, ["row_count", "ord", "ranking"])
    by_tau, by_step = policy_defaults(states)
    levels = ((states, exact), (by_tau, ["step", "tau_bin"]), (by_step, ["step"]))
    rows = df
    for i, (table, on) in enumerate(levels):
        rows = lookup_join(rows, last_per_key(table, on, ["ranking"]).withColumnRenamed("ranking", f"_k{i}"), on)
    return rows.withColumn("ranking", F.coalesce("_k0", "_k1", "_k2")).drop("_k0", "_k1", "_k2")


def choose_packet(ranking: Column, used: Column, all_packets: Column) -> Column:
    """First packet of the ranking not used yet, else the first unused packet by id."""
    free = lambda p: ~F.array_contains(used, p)
    ranked = F.get(F.filter(F.coalesce(ranking, F.array().cast("array<int>")), free), F.lit(0))
    return F.coalesce(ranked, F.get(F.filter(all_packets, free), F.lit(0)))


def sidecar_features(
    df: DataFrame, side: DataFrame, n_side: int, index: str = "row_idx", out: str = "side_features"
) -> DataFrame:
    """Features of the side row ``index % n_side``; ``side`` holds ``side_idx, features``.

    Every side row serves the same share of rows, so the join key has no hot value. A row without a
    side row gets NULL.
    """
    rows = df.withColumn("side_idx", F.pmod(F.col(index), F.lit(n_side)))
    cols = side.select(F.col("side_idx").cast("bigint").alias("side_idx"), F.col("features").alias(out), *[c for c in ("ord",) if c in side.columns])
    cols = last_per_key(cols, ["side_idx"], [out])
    return lookup_join(rows.withColumn("side_idx", F.col("side_idx").cast("bigint")), cols, ["side_idx"])


def missing_meta(spark: SparkSession, meta: DataFrame, n_rows: int, index: str = "row_idx") -> DataFrame:
    """Row indexes in ``[0, n_rows)`` without metadata."""
    return spark.range(n_rows).withColumnRenamed("id", index).join(meta.select(index), index, "left_anti")
