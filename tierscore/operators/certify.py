"""Calibrated certifiers and the prefix cascades that use them.

All of it is row-local. Where bands and cells are of a checked size, one Arrow step walks the trees,
looks up bands and decides, rows leaving it as they are decided (``forest``). Larger tables are joined
stage by stage: prefix scores from one Arrow UDF per stage, decisions as column expressions, and an
exact fallback that only sees the vectors of rows that no checkpoint decided.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscore.functions.bins import bin_by_edges, float_array, let
from tierscore.functions.scalars import at_least
from tierscore.operators import lookups as L
from tierscore.operators.forest import Forest, Packets, Slots, forest_cascade, forest_certify, forest_outcomes, forest_packets, forest_route
from tierscore.operators.trees import TreeModel, prefix_scores, prefix_splits, score_route, tree_leaves

NUDGE = 1e-6  # fixed value: how far a certified score lies from the threshold
TREES_PER_UNIT = 2048.0  # fixed value: scale of the tree count among the certifier inputs
DELTA_CHECKPOINT = 64  # fixed value: checkpoint whose score is the long-range reference
STAGE_TREES = 64


def _f(v: float) -> Column:
    return F.lit(float(v)).cast("float")


def checkpoint_features(df: DataFrame, key: str = "txn_id", initial: float = 0.0) -> DataFrame:
    """Long form ``key, checkpoint, score, tau`` -> gap, |gap| and both deltas.

    A window holds the few checkpoints of one row.
    """
    w = Window.partitionBy(key).orderBy("checkpoint")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    at_64 = F.max(F.when(F.col("checkpoint") == DELTA_CHECKPOINT, F.col("score"))).over(earlier)
    gap = F.col("tau").cast("float") - F.col("score").cast("float")
    return df.select(
        "*",
        gap.alias("gap"),
        F.abs(gap).alias("abs_gap"),
        (F.col("score") - F.coalesce(F.lag("score").over(w), _f(initial))).alias("delta_prev"),
        F.coalesce(F.col("score") - at_64, _f(0.0)).alias("delta_64"),
    )


@dataclass(frozen=True, eq=False)
class Mlp:
    """Two hidden layers and a logit; at most a few thousand numbers, shipped as literals."""

    checkpoint_values: tuple[int, ...]
    fold_values: tuple[int, ...]
    tau_edges: tuple[float, ...]
    checkpoint_limit: int
    mean: tuple[float, ...]
    inv_std: tuple[float, ...]
    w1: tuple[tuple[float, ...], ...]
    b1: tuple[float, ...]
    w2: tuple[tuple[float, ...], ...]
    b2: tuple[float, ...]
    w3: tuple[float, ...]
    b3: float
    thresholds: dict[int, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        n = self.n_inputs
        if len(self.mean) != n or len(self.inv_std) != n:
            raise ValueError(f"certifier expects {n} normalisation values")
        if any(len(r) != n for r in self.w1) or len(self.w1) != len(self.b1):
            raise ValueError("first layer has the wrong shape")
        if any(len(r) != len(self.b1) for r in self.w2) or len(self.w2) != len(self.b2):
            raise ValueError("second layer has the wrong shape")
        if len(self.w3) != len(self.b2):
            raise ValueError("output layer has the wrong shape")

    @property
    def n_inputs(self) -> int:
        return len(self.checkpoint_values) + len(self.fold_values) + self.tau_bins + 8

    @property
    def tau_bins(self) -> int:
        return max(len(self.tau_edges) - 1, 1)


def certifier_vector(mlp: Mlp, s: Column) -> Column:
    """One-hot checkpoint, fold and tau bin, then eight numbers; standardised.

    ``s`` is a struct of ``checkpoint, fold, tau, prefix, gap, dp, d64, evals, resolved``; the last two are
    the work and the early resolved trees of the row so far, per tree.
    """

    def one_hot(values: Sequence[int], x: Column) -> Column:
        return F.transform(float_array(values), lambda v: F.when(v == x, _f(1.0)).otherwise(_f(0.0)))

    tau_bin = bin_by_edges(s["tau"], mlp.tau_edges) if len(mlp.tau_edges) >= 2 else F.lit(0)
    numbers = F.array(
        s["prefix"], s["gap"], F.abs(s["gap"]), s["dp"], s["d64"], s["evals"],
        (s["checkpoint"] / F.lit(TREES_PER_UNIT)).cast("float"), s["resolved"],
    )
    raw = F.concat(
        one_hot(mlp.checkpoint_values, s["checkpoint"]),
        one_hot(mlp.fold_values, s["fold"]),
        let(tau_bin, lambda b: one_hot(range(mlp.tau_bins), b)),
        numbers,
    )
    centred = F.zip_with(raw, float_array(mlp.mean), lambda x, m: (x - m).cast("float"))
    return F.zip_with(centred, float_array(mlp.inv_std), lambda x, v: (x * v).cast("float"))


def mlp_probability(mlp: Mlp, inputs: Column) -> Column:
    """Reject probability from a standardised input vector."""

    def layer(weights: Sequence[Sequence[float]], bias: Sequence[float], x: Column) -> Column:
        return F.array(*[F.greatest(dot(w, b, x), _f(0.0)) for w, b in zip(weights, bias)])

    def dot(weights: Sequence[float], bias: float, x: Column) -> Column:
        terms = F.zip_with(float_array(weights), x, lambda w, v: (w * v).cast("float"))
        return F.aggregate(terms, _f(bias), lambda a, t: (a + t).cast("float"))

    first = let(inputs, lambda x: layer(mlp.w1, mlp.b1, x))
    second = let(first, lambda h: layer(mlp.w2, mlp.b2, h))
    logit = let(second, lambda h: dot(mlp.w3, mlp.b3, h))
    return (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit.cast("double")))).cast("float")


@dataclass(frozen=True, eq=False)
class Bundle:
    """A model in its tree order with its calibration and, optionally, a second certifier."""

    model: TreeModel
    calibration: L.Calibration
    atlas: L.Atlas | None = None
    mlp: Mlp | None = None

    @property
    def small(self) -> bool:
        """Whether bands and cells are of a checked size that may be sent to every task."""
        return self.calibration.small and (self.atlas is None or self.atlas.small)


CONSTANTS = (("nudge", NUDGE), ("trees_per_unit", TREES_PER_UNIT), ("delta_checkpoint", DELTA_CHECKPOINT))


@lru_cache(maxsize=32)
def _slots(parts: tuple) -> Slots:
    checkpoints = parts[0][1].checkpoints
    clusters = [None if atlas is None else atlas.tables(checkpoints) for _, _, atlas, _ in parts]
    bands = [cal.tables for _, cal, _, _ in parts]
    return Slots(Forest([p[0] for p in parts]), checkpoints, bands, clusters, [p[3] for p in parts], dict(CONSTANTS))


def slots_of(bundles: Sequence[Bundle]) -> Slots:
    """The bundles as slots of one forest; they share a list of checkpoints."""
    if len({b.calibration.checkpoints for b in bundles}) != 1:
        raise ValueError("the bundles of a forest need the same checkpoints")
    return _slots(tuple((b.model, b.calibration, b.atlas, b.mlp) for b in bundles))


CERT_TYPE = "struct<reject: boolean, route_score: float, checkpoint: int, prefix: float>"


def certify_scan(
    bundle: Bundle, begin: int, end: int, tau: Column, fold: Column, scores: Column, before: Column, at_64: Column | None,
    limits: Column, cells: Column | None = None, work: tuple[Column, Column] | None = None, first_delta: Column | None = None,
) -> Column:
    """Decisions at the checkpoints ``begin..end-1`` as an array of ``CERT_TYPE``, NULL where open.

    ``scores`` are the prefix scores of these checkpoints and ``before`` the score ahead of them.
    Bands come first: refer when even ``prefix + ref_hi`` stays below tau, reject when
    ``prefix + rej_lo`` reaches it. The cluster cells or the network only see what is left. One
    lambda serves all checkpoints, so the plan does not grow with their number.
    """
    cps = bundle.calibration.checkpoints
    atlas, mlp = bundle.atlas, bundle.mlp
    all_cps = F.array(*[F.lit(int(c)) for c in cps])
    has_64 = DELTA_CHECKPOINT in cps
    slot_64 = cps.index(DELTA_CHECKPOINT) if has_64 else -1
    shapes = L.atlas_shapes(atlas, cps) if atlas is not None else None

    def inputs(i: Column) -> Column:
        score = F.get(scores, i)
        step = F.when(i == 0, before).otherwise(F.get(scores, i - 1))
        delta_64 = _f(0.0)
        if has_64:
            base = at_64 if slot_64 < begin and at_64 is not None else F.get(scores, F.lit(slot_64 - begin))
            delta_64 = F.when(i + begin > slot_64, score - base).otherwise(_f(0.0))
        checkpoint = F.get(all_cps, i + begin)
        share = lambda k: _f(0.0) if work is None else (F.get(work[k], i + begin) / checkpoint).cast("float")
        return F.struct(
            (i + begin).alias("slot"),
            checkpoint.alias("checkpoint"),
            tau.cast("float").alias("tau"),
            fold.alias("fold"),
            score.alias("prefix"),
            (tau.cast("float") - score).alias("gap"),
            ((score - step) if first_delta is None else first_delta).alias("dp"),
            delta_64.alias("d64"),
            share(0).alias("evals"),
            share(1).alias("resolved"),
        )

    def cert(s: Column, reject: bool, score: Column) -> Column:
        return F.struct(
            F.lit(reject).alias("reject"),
            score.cast("float").alias("route_score"),
            s["checkpoint"].alias("checkpoint"),
            s["prefix"].alias("prefix"),
        ).cast(CERT_TYPE)

    def decide(s: Column, b: Column) -> Column:
        below, above = s["tau"] - _f(NUDGE), s["tau"] + _f(NUDGE)
        out = F.when(b["ref_hi"] < s["gap"], cert(s, False, s["prefix"] + b["ref_hi"]))
        out = out.when(b["rej_lo"] >= s["gap"], cert(s, True, s["prefix"] + b["rej_lo"]))
        if atlas is not None and cells is not None:
            key = L.atlas_cell_key(shapes, s, b["gap_bin"])
            sure = lambda c: F.when(c == 1, cert(s, False, below)).when(c == 2, cert(s, True, above))
            return out.otherwise(let(F.try_element_at(cells, key), sure))
        if mlp is not None and mlp.thresholds:
            lows = F.create_map(*[x for c, (lo, _) in mlp.thresholds.items() for x in (F.lit(c), _f(lo))])
            highs = F.create_map(*[x for c, (_, hi) in mlp.thresholds.items() for x in (F.lit(c), _f(hi))])
            may = s["checkpoint"] <= mlp.checkpoint_limit
            sure = lambda p: F.when(
                may & (p <= F.try_element_at(lows, s["checkpoint"])), cert(s, False, below)
            ).when(may & (p >= F.try_element_at(highs, s["checkpoint"])), cert(s, True, above))
            return out.otherwise(let(mlp_probability(mlp, certifier_vector(mlp, s)), sure))
        return out

    def at(i: Column) -> Column:
        return let(
            inputs(i),
            lambda s: F.when(
                s["prefix"].isNotNull() & ~F.isnan(s["gap"]),
                let(L.band_limits(F.get(limits, s["slot"]), s["gap"]), lambda b: decide(s, b)),
            ),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(end - begin - 1)), at)


def first_of(certs: Column) -> Column:
    """The first certifying checkpoint, NULL if there is none."""
    return F.get(F.filter(certs, lambda c: c.isNotNull()), F.lit(0))


def stage_slices(checkpoints: Sequence[int], min_trees: int = STAGE_TREES) -> list[tuple[int, int]]:
    """Checkpoint ranges scored by one UDF call each: at least ``min_trees`` trees per call."""
    cuts, begin, done = [], 0, 0
    for i, cp in enumerate(checkpoints):
        if cp - done >= min_trees or i == len(checkpoints) - 1:
            cuts.append((begin, i + 1))
            begin, done = i + 1, cp
    return cuts


def prefix_certify(
    df: DataFrame, bundle: Bundle, run: Column, out: str, initial: Column | None = None, stage_trees: int = STAGE_TREES
) -> DataFrame:
    """Adds ``<out>_cert`` (first certifying checkpoint), ``<out>_scores`` and ``<out>_last``.

    ``df`` has ``features, tau, fold_id``; rows where ``run`` is false are not scored. A stage is
    only shipped the vectors that earlier stages left open.
    """
    cal, model = bundle.calibration, bundle.model
    limits, cells = f"_{out}_limits", f"_{out}_cells"
    rows = df.withColumn(f"_{out}_open", run)
    start = _f(model.base) if initial is None else initial.cast("float")
    rows = rows.withColumn(f"_{out}_first", start)
    if bundle.mlp is not None:
        own = F.when(F.col(f"_{out}_open"), F.col("features"))
        for k in (0, 1):
            rows = rows.withColumn(f"_{out}_work{k}", prefix_splits(own, model, cal.checkpoints, pinned=True, resolved=k == 1))
    slot_64 = cal.checkpoints.index(DELTA_CHECKPOINT) if DELTA_CHECKPOINT in cal.checkpoints else -1
    at_64, done, last, stages, certs = None, 0, F.col(f"_{out}_first"), [], []
    for begin, end in stage_slices(cal.checkpoints, stage_trees):
        stage, found = f"_{out}_s{begin}", f"_{out}_c{begin}"
        wanted = F.when(F.col(f"_{out}_open"), F.col("features"))
        rows = rows.withColumn(stage, prefix_scores(wanted, model, cal.checkpoints[begin:end], last, start=done, pinned=True))
        # The wide band arrays join after the UDF, so they never pass through Python.
        rows = L.attach_bands(rows, cal, limits)
        if bundle.atlas is not None:
            rows = L.attach_atlas(rows, bundle.atlas, cells)
        scan = certify_scan(
            bundle, begin, end, F.col("tau"), F.col("fold_id"), F.col(stage), last, at_64, F.col(limits),
            F.col(cells) if bundle.atlas is not None else None,
            (F.col(f"_{out}_work0"), F.col(f"_{out}_work1")) if bundle.mlp is not None else None,
        )
        rows = rows.withColumn(found, first_of(scan)).drop(limits, cells)
        rows = rows.withColumn(f"_{out}_open", F.col(f"_{out}_open") & F.col(found).isNull())
        if begin <= slot_64 < end:
            at_64 = F.get(F.col(stage), F.lit(slot_64 - begin))
        last = F.get(F.col(stage), F.lit(end - begin - 1))
        done = cal.checkpoints[end - 1]
        stages.append(F.coalesce(F.col(stage), F.array().cast("array<float>")))
        certs.append(F.col(found))
    rows = rows.withColumn(f"{out}_cert", F.coalesce(*certs))
    rows = rows.withColumn(f"{out}_scores", F.concat(*stages)).withColumn(f"{out}_last", last)
    return rows.select(*df.columns, f"{out}_cert", f"{out}_scores", f"{out}_last")


PREFIX_COLUMNS = (
    "prefix_score",
    "prefix_trees_used",
    "shadow_reject",
    "final_reject",
    "fallback_used",
    "direct_checkpoint",
    "fallback_entry_checkpoint",
    "route_score",
    "exact_visits",
)


def prefix_cascade(
    df: DataFrame, bundle: Bundle, active: Column | None = None, shadow_only: bool = False,
    stage_trees: int = STAGE_TREES,
) -> DataFrame:
    """First certifying checkpoint decides; open rows go on exactly from the last checkpoint.

    One Arrow step does it all where the tables of the bundle may be sent to every task; larger
    calibrations are joined stage by stage.
    """
    run = F.lit(True) if active is None else active
    if bundle.small:
        return _forest_cascade(df, [bundle], F.lit(0), run, shadow_only)
    return staged_cascade(df, bundle, run, shadow_only, stage_trees)


def _forest_cascade(df: DataFrame, bundles: Sequence[Bundle], slot: Column, run: Column, shadow_only: bool = False) -> DataFrame:
    done = forest_cascade(F.when(run, F.col("features")), F.col("tau"), F.col("fold_id"), slot, slots_of(bundles), shadow_only)
    rows = df.withColumn("_done", done)
    return rows.select(*df.columns, *_filled(F.col("_done")))


def _filled(done: Column) -> list[Column]:
    """Result columns with the values of a row that was not run."""
    empty = {"prefix_score": None, "route_score": None, "shadow_reject": False, "final_reject": False, "fallback_used": False}
    return [
        (done[c] if empty.get(c, 0) is None else F.coalesce(done[c], F.lit(empty.get(c, 0)))).alias(c) for c in PREFIX_COLUMNS
    ]


def staged_cascade(df: DataFrame, bundle: Bundle, run: Column, shadow_only: bool = False, stage_trees: int = STAGE_TREES) -> DataFrame:
    """The prefix cascade by joins: every stage gets the bands of its rows next to them."""
    rows = prefix_certify(df.withColumn("_run", run), bundle, F.col("_run"), "p", stage_trees=stage_trees)
    end = bundle.calibration.checkpoints[-1]
    rows = rows.withColumn("_open", F.col("_run") & F.col("p_cert").isNull())
    if shadow_only:
        rows = rows.withColumn("_exact", F.lit(None).cast("struct<score: float, pass: boolean, visited: int>"))
    else:
        left = F.when(F.col("_open"), F.col("features"))
        rows = rows.withColumn("_exact", score_route(left, F.col("tau"), bundle.model, start=end, initial=F.col("p_last"), pinned=True))
    return _prefix_result(rows, df.columns, end)


def _prefix_result(rows: DataFrame, keep: Sequence[str], end: int) -> DataFrame:
    cert, exact, on, open_ = F.col("p_cert"), F.col("_exact"), F.col("_run"), F.col("_open")
    return rows.select(
        *keep,
        F.when(on, F.coalesce(cert["prefix"], F.col("p_last"))).alias("prefix_score"),
        F.when(on, F.coalesce(cert["checkpoint"], F.lit(end))).otherwise(0).alias("prefix_trees_used"),
        F.coalesce(cert["reject"], F.lit(False)).alias("shadow_reject"),
        F.coalesce(cert["reject"], exact["pass"], F.lit(False)).alias("final_reject"),
        open_.alias("fallback_used"),
        F.coalesce(cert["checkpoint"], F.lit(0)).alias("direct_checkpoint"),
        F.when(open_, F.lit(end)).otherwise(0).alias("fallback_entry_checkpoint"),
        F.when(on, F.coalesce(cert["route_score"], exact["score"], F.col("p_last"))).alias("route_score"),
        F.when(open_, F.coalesce(exact["visited"], F.lit(0))).otherwise(0).alias("exact_visits"),
    )


def multi_order(
    df: DataFrame, bundles: Sequence[Bundle], routes: DataFrame, tau_edges: Sequence[float], active: Column | None = None
) -> DataFrame:
    """The prefix cascade with the tree order assigned to each row's tau bin.

    The bundles are slots of one forest, so the plan does not grow with their number.
    """
    run = F.lit(True) if active is None else active
    rows = L.route_by_tau(df, routes, tau_edges).withColumn("_on", run)
    base = [c for c in rows.columns if c != "_on"]
    if all(b.small for b in bundles):
        return _forest_cascade(rows, bundles, F.col("route"), F.col("_on")).drop("_on")
    for i, bundle in enumerate(bundles):
        mine = F.col("_on") & (F.col("route") == i)
        part = staged_cascade(rows, bundle, mine)
        rows = part.select(*rows.columns, F.when(mine, F.struct(*PREFIX_COLUMNS)).alias(f"_b{i}"))
    chosen = F.coalesce(*[F.col(f"_b{i}") for i in range(len(bundles))])
    return rows.select(*base, chosen.alias("_b")).select(*base, *_filled(F.col("_b")))


def certified(
    df: DataFrame, bundles: Sequence[Bundle], slot: Column, run: Column, out: str, initial: Column | None = None,
    beside: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds ``<out>_cert`` and ``<out>_last`` of the slot of each row that runs, starting from ``initial``.

    ``beside``: other UDF columns of ``df``, evaluated by the same Python workers.
    """
    beside = beside or {}
    if all(b.small for b in bundles) and len({b.calibration.checkpoints for b in bundles}) == 1:
        both = forest_certify(F.when(run, F.col("features")), F.col("tau"), F.col("fold_id"), slot, slots_of(bundles), initial)
        rows = df.withColumns({"_both": both, **beside})
        return rows.select(*df.columns, *beside, F.col("_both.cert").alias(f"{out}_cert"), F.col("_both.last").alias(f"{out}_last"))
    rows, parts = df.withColumns({"_slot": slot, "_mine": run, **beside}), []
    for i, bundle in enumerate(bundles):
        mine = F.col("_mine") & (F.col("_slot") == i)
        rows = prefix_certify(rows, bundle, mine, f"_s{i}", initial).drop(f"_s{i}_scores")
        parts.append(F.when(mine, F.struct(F.col(f"_s{i}_cert").alias("cert"), F.col(f"_s{i}_last").alias("last"))))
    rows = rows.withColumn("_both", F.coalesce(*parts))
    return rows.select(*df.columns, *beside, F.col("_both.cert").alias(f"{out}_cert"), F.col("_both.last").alias(f"{out}_last"))


def anchor_rescue(
    df: DataFrame, anchor: Bundle, reject: Bundle, refer: Bundle, actions: DataFrame, defaults: DataFrame,
    tau_edges: Sequence[float], gap_edges: Sequence[float], active: Column | None = None,
) -> DataFrame:
    """Anchor cascade; open rows are sent to a rescue order that starts from the anchor's score.

    A rescue answer on the wrong side is dropped. What stays open is finished over the trees
    that neither stage has executed.
    """
    run = F.lit(True) if active is None else active
    end = anchor.calibration.checkpoints[-1]
    rows = certified(df.withColumn("_run", run), [anchor], F.lit(0), F.col("_run"), "a")
    rows = rows.withColumn("anchor", F.lit(end)).withColumn("prefix", F.col("a_last"))
    rows = L.lookup_rescue(rows, actions, defaults, tau_edges, gap_edges)
    open_ = F.col("_run") & F.col("a_cert").isNull()
    rows = rows.select(*df.columns, "_run", "a_cert", "a_last", F.when(open_, F.col("action")).alias("action"))
    plan = {t: i for i, t in enumerate(anchor.model.tree_ids)}
    names, bundles = (L.REJECT_RESCUE, L.REFER_RESCUE), (reject, refer)
    mine = F.coalesce(F.col("action").isin(*names), F.lit(False))
    slot = F.when(F.col("action") == names[1], 1).otherwise(0)
    # The leaves of all rows the anchor left open, in the rescue's step: a step of their own would be one Python worker more per task.
    vectors = F.when(F.col("_run") & F.col("a_cert").isNull(), F.col("features"))
    leaves = tree_leaves(vectors, anchor.model, pinned=True)
    rows = certified(rows, bundles, slot, mine, "_r", F.col("a_last"), {"_leaves": leaves})
    orders = F.array(*[F.array(*[F.lit(plan[t]) for t in b.model.tree_ids]) for b in bundles])
    lasts = F.array(*[F.lit(b.calibration.checkpoints[-1]) for b in bundles])
    stop = F.coalesce(F.col("_r_cert.checkpoint"), F.get(lasts, slot))
    rows = rows.select(
        *df.columns, "_run", "a_cert", "a_last", "action", "_leaves", F.col("_r_cert").alias("_r"),
        F.when(mine, F.slice(F.get(orders, slot), F.lit(1), stop)).alias("_used"),
        F.when(mine, F.coalesce(F.col("_r_cert.prefix"), F.col("_r_last"))).alias("_end"),
    )
    wrong = (F.col("action") == L.REJECT_RESCUE) != F.col("_r.reject")
    rows = rows.withColumn("_r_ok", F.when(~wrong, F.col("_r")))
    rows = rows.withColumn("_cert", F.coalesce("a_cert", "_r_ok"))
    rows = rows.withColumn("_open", F.col("_run") & F.col("_cert").isNull())
    everything = F.sequence(F.lit(0), F.lit(anchor.model.n_trees - 1))
    executed = F.concat(F.sequence(F.lit(0), F.lit(end - 1)), F.coalesce("_used", F.array().cast("array<int>")))
    remaining = F.array_except(everything, executed)
    rest = F.aggregate(remaining, _f(0.0), lambda a, p: (a + F.get(F.col("_leaves"), p)).cast("float"))
    prefix = F.coalesce(F.col("a_cert.prefix"), F.col("_end"), F.col("a_last"))
    tail = F.coalesce(F.col("_end"), F.col("a_last")) + rest
    on, still = F.col("_run"), F.col("_open")
    final = F.coalesce(F.col("_cert.reject"), F.when(still, at_least(tail, F.col("tau").cast("float"))), F.lit(False))
    code = F.when(F.col("action").isNotNull(), L.rescue_code(F.col("action"))).otherwise(0)
    last = F.when(F.col("action") == L.REJECT_RESCUE, reject.calibration.checkpoints[-1]).when(
        F.col("action") == L.REFER_RESCUE, refer.calibration.checkpoints[-1]
    ).otherwise(end)
    trees = F.when(F.col("a_cert").isNotNull(), F.col("a_cert.checkpoint")).otherwise(
        F.lit(end) + F.coalesce(F.size("_used"), F.lit(0))
    )
    return rows.select(
        *df.columns,
        F.when(on, prefix).alias("prefix_score"),
        F.when(on, trees).otherwise(0).cast("int").alias("prefix_trees_used"),
        F.coalesce(F.col("_cert.reject"), F.lit(False)).alias("shadow_reject"),
        final.alias("final_reject"),
        still.alias("fallback_used"),
        F.coalesce(F.col("a_cert.checkpoint"), F.lit(0)).alias("anchor_checkpoint"),
        F.coalesce(F.col("_r_ok.checkpoint"), F.lit(0)).alias("rescue_checkpoint"),
        code.alias("rescue_route"),
        F.when(still, last).otherwise(0).cast("int").alias("fallback_entry_checkpoint"),
        F.when(on, F.coalesce(F.col("_cert.route_score"), tail)).alias("route_score"),
        F.when(still, F.size(remaining)).otherwise(0).alias("exact_visits"),
    )


def packet_cascade(
    df: DataFrame, bundle: Bundle, packets: Sequence[tuple[int, Sequence[int]]], policy: L.PacketPolicy,
    active: Column | None = None,
) -> DataFrame:
    """Up to ``max_steps`` packets of trees per row, each chosen by the state reached so far.

    Step, thresholds and the last packet's score pick a ranking, the first unused packet of it is
    added, and the bands of the step may decide. Rows still open add the packets they have not used.
    One Arrow step where rankings and bands may be sent to every task; else a bounded loop of lookups.
    """
    cal = bundle.calibration
    if len(cal.checkpoints) != policy.max_steps:
        raise ValueError(f"{len(cal.checkpoints)} band tables for {policy.max_steps} packet steps")
    run = F.lit(True) if active is None else active
    if bundle.small and policy.small and _known_packets(bundle, packets, policy):
        parts = Slots(Forest([bundle.model]), cal.checkpoints, [cal.tables], [None], [None], dict(CONSTANTS))
        steps = Packets(parts, packets, policy.tau_edges, policy.gap_edges, policy.delta_edges, policy.rankings)
        rows = df.withColumn("_done", forest_packets(F.when(run, F.col("features")), F.col("tau"), F.col("fold_id"), steps))
        done = F.col("_done")
        return rows.select(*df.columns, *_filled(done), F.coalesce(done["packets"], F.array().cast("array<int>")).alias("packets"))
    return joined_packets(df, bundle, packets, policy, run)


def _known_packets(bundle: Bundle, packets: Sequence[tuple[int, Sequence[int]]], policy: L.PacketPolicy) -> bool:
    """Whether rankings name known packets only, packets known trees, and every step has a packet left."""
    ids, trees = {p for p, _ in packets}, {t for _, members in packets for t in members}
    named = {p for known in policy.rankings for r in known.values() for p in r if p is not None}
    return named <= ids and policy.max_steps <= len(ids) == len(packets) and trees <= set(range(bundle.model.n_trees))


def joined_packets(
    df: DataFrame, bundle: Bundle, packets: Sequence[tuple[int, Sequence[int]]], policy: L.PacketPolicy, run: Column
) -> DataFrame:
    """The packet cascade by joins: every step looks up its rankings."""
    cal = bundle.calibration
    rows = df.withColumn("_run", run)
    rows = rows.withColumn("_leaves", tree_leaves(F.when(F.col("_run"), F.col("features")), bundle.model, pinned=True))
    # After the UDF: rows that wait for Python would be buffered with their bands.
    rows = L.attach_bands(rows, cal, "_limits")
    ids = F.array(*[F.lit(int(p)) for p, _ in packets])
    members = F.create_map(
        *[c for p, trees in packets for c in (F.lit(int(p)), F.array(*[F.lit(int(t)) for t in trees]))]
    )

    def packet_score(packet: Column) -> Column:
        trees = F.try_element_at(members, packet)
        return F.aggregate(trees, _f(0.0), lambda a, p: (a + F.get(F.col("_leaves"), p)).cast("float"))

    tau_bin = bin_by_edges(F.col("tau"), policy.tau_edges) if len(policy.tau_edges) >= 2 else F.lit(0)
    rows = (
        rows.withColumn("tau_bin", tau_bin)
        .withColumn("_used", F.array().cast("array<int>"))
        .withColumn("_prefix", _f(bundle.model.base))
        .withColumn("_delta", _f(0.0))
        .withColumn("_cert", F.lit(None).cast(CERT_TYPE))
    )
    for step in range(policy.max_steps):
        gap = F.col("tau").cast("float") - F.col("_prefix")
        rows = (
            rows.withColumn("step", F.lit(step))
            .withColumn("gap_bin", bin_by_edges(gap, policy.gap_edges[step]))
            .withColumn("delta_bin", bin_by_edges(F.col("_delta"), policy.delta_edges[step]))
        )
        rows = L.rank_packets(rows, policy)
        go = F.col("_go")
        rows = rows.withColumn("_go", F.col("_run") & F.col("_cert").isNull())
        rows = rows.withColumn("_pick", F.when(go, L.choose_packet(F.col("ranking"), F.col("_used"), ids)))
        rows = rows.withColumn("_gain", F.when(go, packet_score(F.col("_pick"))))
        rows = rows.withColumn("_next", F.when(go, F.col("_prefix") + F.col("_gain")))
        here = certify_scan(
            Bundle(bundle.model, cal), step, step + 1, F.col("tau"), F.col("fold_id"), F.array("_next"), F.col("_prefix"), None,
            F.col("_limits"), first_delta=F.col("_gain"),
        )
        here = F.get(here, F.lit(0))
        rows = (
            rows.withColumn("_cert", F.coalesce(F.col("_cert"), here))
            .withColumn("_used", F.when(go, F.concat("_used", F.array("_pick"))).otherwise(F.col("_used")))
            .withColumn("_prefix", F.coalesce("_next", "_prefix"))
            .withColumn("_delta", F.coalesce("_gain", "_delta"))
            .drop("step", "gap_bin", "delta_bin", "ranking", "_go", "_pick", "_gain", "_next")
        )
    rest = F.array_except(ids, F.col("_used"))
    tail = F.aggregate(rest, F.col("_prefix"), lambda a, p: (a + packet_score(p)).cast("float"))
    count = F.aggregate(rest, F.lit(0), lambda a, p: a + F.size(F.try_element_at(members, p)))
    trees = F.aggregate(F.col("_used"), F.lit(0), lambda a, p: a + F.size(F.try_element_at(members, p)))
    on, open_ = F.col("_run"), F.col("_run") & F.col("_cert").isNull()
    end = cal.checkpoints[-1]
    return rows.select(
        *df.columns,
        F.when(on, F.col("_prefix")).alias("prefix_score"),
        F.when(on, trees).otherwise(0).alias("prefix_trees_used"),
        F.coalesce(F.col("_cert.reject"), F.lit(False)).alias("shadow_reject"),
        F.coalesce(F.col("_cert.reject"), F.when(open_, at_least(tail, F.col("tau").cast("float"))), F.lit(False)).alias("final_reject"),
        open_.alias("fallback_used"),
        F.coalesce(F.col("_cert.checkpoint"), F.lit(0)).alias("direct_checkpoint"),
        F.when(open_, F.lit(end)).otherwise(0).alias("fallback_entry_checkpoint"),
        F.when(on, F.coalesce(F.col("_cert.route_score"), tail)).alias("route_score"),
        F.when(open_, count).otherwise(0).alias("exact_visits"),
        F.col("_used").alias("packets"),
    )


def dispatch_experts(
    df: DataFrame, experts: Sequence[tuple[TreeModel, str]], active: Column | None = None
) -> DataFrame:
    """Score each row with the model of its ``slot_id``: slot 0 global, slot i+1 the i-th expert.

    The threshold mode of a slot is ``tau`` (the row's value) or ``zero``. An unknown slot of an
    active row fails the job.
    """
    run = F.lit(True) if active is None else active
    known = F.col("slot_id").between(0, len(experts) - 1)
    message = F.concat(F.lit("unknown dispatch slot "), F.col("slot_id").cast("string"))
    rows = df.withColumn("_run", L.fail_when(run & ~F.coalesce(known, F.lit(False)), message, run, "boolean"))
    modes = [mode for _, mode in experts]
    if unknown := set(modes) - {"tau", "zero"}:
        raise ValueError(f"unsupported threshold mode: {min(unknown)}")
    # Slots in a short list; the others keep the threshold of the row.
    zero = F.array(*[F.lit(i) for i, mode in enumerate(modes) if mode == "zero"]).cast("array<int>")
    limit = F.when(F.array_contains(zero, F.col("slot_id").cast("int")), F.lit(0.0)).otherwise(F.col("tau"))
    routed = forest_route(F.when(F.col("_run"), F.col("features")), limit, F.col("slot_id"), _experts(tuple(m for m, _ in experts)))
    best = F.col("_routed")
    return rows.withColumn("_routed", routed).select(
        *df.columns,
        best["score"].alias("route_score"),
        F.coalesce(best["pass"], F.lit(False)).alias("reject"),
        F.coalesce(best["visited"], F.lit(0)).alias("visited_trees"),
    )


@lru_cache(maxsize=32)
def _experts(models: tuple[TreeModel, ...]) -> Forest:
    return Forest(models)


def certify_long(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Certifier outcome at every checkpoint in long form, for analysis: one row per checkpoint.

    One Arrow step where the tables of the bundle may be sent to every task; larger ones are joined.
    """
    long = _outcomes(df, bundle) if bundle.small else _joined_outcomes(df, bundle)
    rows = long.select(*df.columns, F.explode("_all").alias("_x"))
    return rows.select(
        *df.columns,
        F.col("_x.checkpoint").alias("checkpoint"),
        F.col("_x.score").alias("score"),
        F.when(F.col("_x.reject").isNull(), F.lit("open"))
        .when(F.col("_x.reject"), F.lit("reject"))
        .otherwise(F.lit("refer"))
        .alias("outcome"),
        F.col("_x.route_score").alias("route_score"),
    )


def _outcomes(df: DataFrame, bundle: Bundle) -> DataFrame:
    return df.withColumn("_all", forest_outcomes(F.col("features"), F.col("tau"), F.col("fold_id"), slots_of([bundle])))


def _joined_outcomes(df: DataFrame, bundle: Bundle) -> DataFrame:
    cps = bundle.calibration.checkpoints
    rows = df.withColumn("_s", prefix_scores(F.col("features"), bundle.model, cps, pinned=True))
    if bundle.mlp is not None:
        for k in (0, 1):
            rows = rows.withColumn(f"_work{k}", prefix_splits(F.col("features"), bundle.model, cps, pinned=True, resolved=k == 1))
    # The wide bands and cells join after the UDFs: they would be buffered with every row that waits for Python.
    rows = L.attach_bands(rows, bundle.calibration, "_limits")
    if bundle.atlas is not None:
        rows = L.attach_atlas(rows, bundle.atlas, "_cells")
    scan = certify_scan(
        bundle, 0, len(cps), F.col("tau"), F.col("fold_id"), F.col("_s"), _f(bundle.model.base), None, F.col("_limits"),
        F.col("_cells") if bundle.atlas is not None else None,
        (F.col("_work0"), F.col("_work1")) if bundle.mlp is not None else None,
    )
    marks = F.array(*[F.lit(int(c)) for c in cps])
    zipped = F.arrays_zip(marks.alias("checkpoint"), F.col("_s").alias("score"), scan.alias("cert"))
    flat = lambda z: F.struct(z["checkpoint"], z["score"], z["cert"]["reject"].alias("reject"), z["cert"]["route_score"].alias("route_score"))
    return rows.select(*df.columns, zipped.alias("_z")).select(*df.columns, F.transform("_z", flat).alias("_all"))
