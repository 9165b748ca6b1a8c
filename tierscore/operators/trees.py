"""Tree ensembles: the node table, its bounds and plan, and the Arrow scorers.

A model is a node table, one row per node. The scorers are Arrow UDFs: Spark splits and ships
the rows, a task walks one Arrow batch of feature vectors at a time, and only the feature
column crosses into Python. Rows whose vector is NULL are skipped, so a later stage can be
limited to undecided rows without a second scan or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscore.operators.skew import chunked_running_sum
from tierscore.session import materialise

NODE_SCHEMA = (
    "model string, tree_id int, node_id int, fidx int, thr float, left int, right int, "
    "missing int, leaf float, is_leaf boolean"
)
MAX_NODES = 4_000_000
TILE_ROWS = 4096


@dataclass(frozen=True, eq=False)
class TreeModel:
    """Node arrays in plan order, small enough to ship with a task.

    Nodes of a tree lie together, root first, and the right child follows the left one; all node
    numbers are relative to the tree. A leaf is its own child and has a NaN threshold. ``work`` has two
    numbers per leaf: what a row has cost that ends there, and whether its tree then counts as resolved
    early. The node table may bring them (``evals``, ``resolved``); else they are the splits above the
    leaf and 1 for every tree with a split.
    """

    name: str
    dim: int
    base: float
    offset: np.ndarray
    depth: np.ndarray
    fidx: np.ndarray
    thr: np.ndarray
    child: np.ndarray
    missing_step: np.ndarray
    leaf: np.ndarray
    tree_ids: tuple[int, ...]
    suffix_min: np.ndarray
    suffix_max: np.ndarray
    work: np.ndarray

    @property
    def n_trees(self) -> int:
        return len(self.tree_ids)

    def tree(self, pos: int) -> tuple[np.ndarray, ...]:
        at = slice(self.offset[pos], self.offset[pos + 1])
        return self.fidx[at], self.thr[at], self.child[at], self.missing_step[at], self.leaf[at]

    @classmethod
    def load(
        cls,
        nodes: DataFrame,
        dim: int,
        order: Sequence[int] | None = None,
        max_trees: int | None = None,
        base: float = 0.0,
        missing: str = "learned",
        name: str = "model",
    ) -> TreeModel:
        """Read a checked-size node table of one model; larger ones go to the relational scorer."""
        fields = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        own_work = {"evals", "resolved"} <= set(nodes.columns)
        t = nodes.select(*fields[1:], *(("evals", "resolved") if own_work else ())).limit(MAX_NODES + 1).orderBy("tree_id", "node_id").toArrow()
        if t.num_rows > MAX_NODES:
            raise ValueError("model too large to ship with a task: use operators.relational")
        if t.num_rows == 0:
            raise ValueError("model has no nodes")
        is_leaf = t["is_leaf"].to_numpy()
        tree = t["tree_id"].to_numpy().astype(np.int64)
        ids = np.unique(tree).tolist()
        plan = ids if order is None else [int(i) for i in order]
        if sorted(plan) != ids:
            raise ValueError(f"tree order does not match the model: {len(plan)} versus {len(ids)} trees")
        plan = plan[: len(plan) if max_trees is None else max_trees]
        keys = (tree << 32) + t["node_id"].to_numpy()

        def rows_of(column: str) -> np.ndarray:
            want = (tree << 32) + t[column].fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            if (~is_leaf & (keys[at] != want)).any():
                raise ValueError(f"{column} child of a node is not in the table")
            return at

        left, right, miss = rows_of("left"), rows_of("right"), rows_of("missing")
        if (~is_leaf & (miss != left) & (miss != right)).any():
            raise ValueError("the missing child of a node is neither of its children")
        fidx = np.where(is_leaf, 0, t["fidx"].fill_null(0).to_numpy()).astype(np.intp)
        if fidx.min() < 0 or fidx.max() >= dim:
            raise ValueError(f"split feature outside the vector of width {dim}")

        # Level by level from the roots: children of one split stay side by side.
        level = np.searchsorted(tree, np.array(plan, dtype=np.int64))
        owner, depth = np.arange(len(plan)), np.zeros(len(plan), np.int32)
        found, owners = [level], [owner]
        while True:
            inner = ~is_leaf[level]
            if not inner.any():
                break
            owner = np.repeat(owner[inner], 2)
            level = np.stack([left[level[inner]], right[level[inner]]], axis=1).ravel()
            depth[np.unique(owner)] += 1
            found.append(level)
            owners.append(owner)
        rows, owner = np.concatenate(found), np.concatenate(owners)
        by_tree = np.argsort(owner, kind="stable")
        rows, owner = rows[by_tree], owner[by_tree]
        offset = np.searchsorted(owner, np.arange(len(plan) + 1))
        place = np.zeros(len(keys), np.intp)
        place[rows] = np.arange(len(rows)) - offset[owner]
        leafy = is_leaf[rows]
        here = np.arange(len(rows)) - offset[owner]
        leaf = np.where(leafy, t["leaf"].fill_null(0).to_numpy()[rows], 0).astype(np.float32)
        least = np.minimum.reduceat(np.where(leafy, leaf, np.float32(np.inf)), offset[:-1])
        most = np.maximum.reduceat(np.where(leafy, leaf, np.float32(-np.inf)), offset[:-1])
        step = (miss != left)[rows] if missing == "learned" else np.ones(len(rows), bool)
        child = np.where(leafy, here, place[left[rows]]).astype(np.intp)
        if own_work:
            work = np.stack([np.where(leafy, t[c].fill_null(0).to_numpy()[rows], 0) for c in ("evals", "resolved")]).astype(np.int64)
        else:
            work = np.stack([_levels(child, offset), (depth > 0)[owner].astype(np.int64)])
        return cls(
            name=name,
            dim=dim,
            base=float(np.float32(base)),
            offset=offset,
            depth=depth,
            fidx=fidx[rows],
            thr=np.where(leafy, np.nan, t["thr"].fill_null(0).to_numpy()[rows]).astype(np.float32),
            child=child,
            missing_step=step & ~leafy,
            leaf=leaf,
            tree_ids=tuple(plan),
            suffix_min=_suffix(least),
            suffix_max=_suffix(most),
            work=work,
        )


def _levels(child: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Splits above each node; nodes of a tree lie level by level, children after their parent."""
    start = np.repeat(offset[:-1], np.diff(offset))
    level = np.zeros(len(child), np.int64)
    row = np.arange(len(child))
    at = np.flatnonzero(child + start != row)
    front = offset[:-1][child[offset[:-1]] != 0]
    while len(front):
        kids = np.concatenate([child[front] + start[front], child[front] + start[front] + 1])
        level[kids] = np.concatenate([level[front], level[front]]) + 1
        front = kids[np.isin(kids, at)]
    return level


def _suffix(values: np.ndarray) -> np.ndarray:
    back = np.add.accumulate(values[::-1], dtype=np.float32)[::-1]
    return np.append(back, np.float32(0))


def _vectors(batch: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-null vectors of a batch as a (row, feature) matrix, and their row numbers."""
    rows = np.flatnonzero(~np.asarray(batch.is_null()))
    widths = np.asarray(batch.value_lengths().fill_null(dim))
    wrong = np.flatnonzero(widths != dim)
    if len(wrong):
        raise ValueError(f"vector of width {widths[wrong[0]]} where the model needs {dim}")
    flat = batch.flatten()
    if flat.null_count:
        flat = flat.fill_null(float("nan"))
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return x.reshape(-1, dim), rows


def _tiles(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, bool]]:
    """Row ranges that fit the CPU cache, each as a (feature, row) matrix with its NaN flag."""
    for at in range(0, len(x), TILE_ROWS):
        part = np.ascontiguousarray(x[at : at + TILE_ROWS].T)
        yield slice(at, at + part.shape[1]), part, bool(np.isnan(part).any())


def _tree_leaf(m: TreeModel, pos: int, x: np.ndarray, has_nan: bool) -> np.ndarray:
    """Leaf value of one tree for every column of ``x``."""
    fidx, thr, child, missing_step, leaf = m.tree(pos)
    n = x.shape[1]
    flat, col, start = x.ravel(), np.arange(n), fidx * n
    node = np.zeros(n, dtype=np.intp)
    for _ in range(m.depth[pos]):
        v = flat.take(start.take(node) + col)
        step = v >= thr.take(node)
        if has_nan:
            step |= np.isnan(v) & missing_step.take(node)
        node = child.take(node) + step
    return leaf.take(node)


def _spread(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    out = np.zeros(n, dtype=values.dtype)
    out[rows] = values
    mask = np.ones(n, dtype=bool)
    mask[rows] = False
    return pa.array(out, mask=mask)


def _spread_struct(fields: dict[str, np.ndarray], rows: np.ndarray, n: int) -> pa.Array:
    absent = np.ones(n, dtype=bool)
    absent[rows] = False
    arrays = [_spread(v, rows, n) for v in fields.values()]
    return pa.StructArray.from_arrays(arrays, names=list(fields), mask=pa.array(absent))


def _spread_lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    lengths = np.zeros(n + 1, dtype=np.int64)
    lengths[rows + 1] = values.shape[1]
    present = np.zeros(n, dtype=bool)
    present[rows] = True
    offsets = pa.array(np.cumsum(lengths).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()), mask=pa.array(~present))


def batch_udf(returns: str, pinned: bool = False):
    """An Arrow UDF over batches of vectors.

    It is deterministic, so filters on other columns reach the scan and rows they drop are not scored.
    A filter on the score itself would be moved below the column and walk the trees twice: keep such
    rows with :func:`rows_where`. ``pinned``: evaluated exactly where it is written; the stages of a
    cascade need that, as their conditions must not be copied into array functions.
    """
    return lambda fn: F.arrow_udf(fn, returns).asNondeterministic() if pinned else F.arrow_udf(fn, returns)


def rows_where(df: DataFrame, column: str, keep: Callable[[Column], Column]) -> DataFrame:
    """Rows whose computed ``column`` meets ``keep``, with the column computed once."""
    return df.withColumn(column, F.explode(F.filter(F.array(F.col(column)), keep)))


def score_exact(features: Column, model: TreeModel) -> Column:
    """Base plus the leaf of every tree, added as 32-bit floats in plan order."""

    @batch_udf("float")
    def tree_score(batch: pa.Array) -> pa.Array:
        x, rows = _vectors(batch, model.dim)
        acc = np.full(len(x), model.base, dtype=np.float32)
        for at, tile, has_nan in _tiles(x):
            for pos in range(model.n_trees):
                acc[at] += _tree_leaf(model, pos, tile, has_nan)
        return _spread(acc, rows, len(batch))

    return tree_score(features)


def tree_leaves(features: Column, model: TreeModel, pinned: bool = False) -> Column:
    """The leaf value of every tree in plan order, as an array."""

    @batch_udf("array<float>", pinned)
    def tree_leaf_values(batch: pa.Array) -> pa.Array:
        x, rows = _vectors(batch, model.dim)
        out = np.empty((len(x), model.n_trees), dtype=np.float32)
        for at, tile, has_nan in _tiles(x):
            for pos in range(model.n_trees):
                out[at, pos] = _tree_leaf(model, pos, tile, has_nan)
        return _spread_lists(out, rows, len(batch))

    return tree_leaf_values(features)


def prefix_scores(
    features: Column,
    model: TreeModel,
    checkpoints: Sequence[int],
    initial: Column | None = None,
    start: int = 0,
    pinned: bool = False,
) -> Column:
    """Running score after each checkpoint number of trees, starting from base or ``initial``.

    With ``start`` the first trees count as done and ``initial`` holds their score.
    """
    cps = check_checkpoints(checkpoints, model.n_trees)
    if cps[0] <= start and start:
        raise ValueError(f"checkpoint {cps[0]} is not beyond the {start} trees already done")

    @batch_udf("array<float>", pinned)
    def tree_prefix(batch: pa.Array, first: pa.Array) -> pa.Array:
        x, rows = _vectors(batch, model.dim)
        begin = np.asarray(first.to_numpy(zero_copy_only=False), dtype=np.float32)[rows]
        out = np.empty((len(x), len(cps)), dtype=np.float32)
        for at, tile, has_nan in _tiles(x):
            acc = begin[at].copy()
            for i, (done, cp) in enumerate(zip([start, *cps], cps)):
                for pos in range(done, cp):
                    acc += _tree_leaf(model, pos, tile, has_nan)
                out[at, i] = acc
        return _spread_lists(out, rows, len(batch))

    begin_score = F.lit(model.base).cast("float") if initial is None else initial.cast("float")
    return tree_prefix(features, begin_score)


def prefix_splits(
    features: Column, model: TreeModel, checkpoints: Sequence[int], pinned: bool = False, resolved: bool = False
) -> Column:
    """The work a row has cost up to each checkpoint, or the trees that were resolved early until then."""
    cps = check_checkpoints(checkpoints, model.n_trees)
    counted = replace(model, leaf=model.work[1 if resolved else 0].astype(np.float32))

    @batch_udf("array<int>", pinned)
    def tree_splits(batch: pa.Array) -> pa.Array:
        x, rows = _vectors(batch, counted.dim)
        out = np.empty((len(x), len(cps)), dtype=np.int32)
        for at, tile, has_nan in _tiles(x):
            acc = np.zeros(tile.shape[1], np.int32)
            for i, (done, cp) in enumerate(zip([0, *cps], cps)):
                for pos in range(done, cp):
                    acc += _tree_leaf(counted, pos, tile, has_nan).astype(np.int32)
                out[at, i] = acc
        return _spread_lists(out, rows, len(batch))

    return tree_splits(features)


def check_checkpoints(checkpoints: Sequence[int], n_trees: int) -> list[int]:
    cps = [int(c) for c in checkpoints]
    if not cps:
        raise ValueError("checkpoints must not be empty")
    if any(b <= a for a, b in zip([0, *cps], cps)) or cps[-1] > n_trees:
        raise ValueError(f"checkpoints must increase strictly within 1..{n_trees}: {cps}")
    return cps


@dataclass(frozen=True)
class ApproxPolicy:
    """Calibrated early exits: at ``checkpoints[i]`` refer at or below ``tau_ref[i]``, pass at or
    above ``tau_pos[i]``, both relative to the row threshold; None leaves that side open."""

    checkpoints: tuple[int, ...]
    tau_ref: tuple[float | None, ...]
    tau_pos: tuple[float | None, ...]
    k_hot: int = 0

    def __post_init__(self) -> None:
        if not len(self.checkpoints) == len(self.tau_ref) == len(self.tau_pos):
            raise ValueError("approximate policy lists differ in length")

    @property
    def hot_trees(self) -> int:
        return self.k_hot or max(self.checkpoints, default=0)


ROUTE_TYPE = "struct<score: float, pass: boolean, visited: int, exit_idx: int>"


def score_route(
    features: Column,
    threshold: Column,
    model: TreeModel,
    eps: float = 0.0,
    guard: float = 0.0,
    every: int = 1,
    policy: ApproxPolicy | None = None,
    start: int = 0,
    initial: Column | None = None,
    pinned: bool = False,
) -> Column:
    """Score until the decision is certain; a struct of score, pass, visited trees, exit index.

    Trees are walked in blocks; a row leaves the batch once its remaining trees cannot change
    the decision. With a policy, the calibrated checkpoints act on the first hot trees and the
    exact bounds on the rest. ``exit_idx`` is -1 unless a calibrated checkpoint decided.
    """
    f32 = np.float32
    margin = f32(eps), f32(guard)
    hot = min(policy.hot_trees, model.n_trees) if policy else 0
    at = {c: i for i, c in enumerate(policy.checkpoints)} if policy else {}
    open_ref = [None if v is None else f32(v) for v in policy.tau_ref] if policy else []
    open_pos = [None if v is None else f32(v) for v in policy.tau_pos] if policy else []

    @batch_udf(ROUTE_TYPE, pinned)
    def tree_route(batch: pa.Array, limit: pa.Array, first: pa.Array) -> pa.Array:
        x, rows = _vectors(batch, model.dim)
        n = len(x)
        thr_all = np.asarray(limit.to_numpy(zero_copy_only=False), dtype=f32)[rows]
        begin_all = np.asarray(first.to_numpy(zero_copy_only=False), dtype=f32)[rows]
        score, passed = np.zeros(n, f32), np.zeros(n, bool)
        visited, exit_idx = np.full(n, max(model.n_trees, start), np.int32), np.full(n, -1, np.int32)
        for at_rows, tile, has_nan in _tiles(x):
            live = np.arange(at_rows.start, at_rows.stop)
            thr, acc = thr_all[at_rows], begin_all[at_rows].copy()
            here = np.ones(len(live), bool)
            for pos in range(start, model.n_trees):
                acc += _tree_leaf(model, pos, tile, has_nan)
                end, idx = pos + 1, -1
                yes = no = None
                if end <= hot:
                    idx = at.get(end, -1)
                    if idx >= 0:
                        over = acc - thr
                        no = np.zeros(len(live), bool) if open_ref[idx] is None else over <= open_ref[idx]
                        yes = ~no if open_pos[idx] is not None else np.zeros(len(live), bool)
                        if open_pos[idx] is not None:
                            yes &= over >= open_pos[idx]
                elif end % every == 0 or end == model.n_trees:
                    wide = acc.astype(np.float64)
                    yes = wide + float(model.suffix_min[end]) >= ((thr + margin[0]) + margin[1]).astype(np.float64)
                    no = wide + float(model.suffix_max[end]) < ((thr - margin[0]) - margin[1]).astype(np.float64)
                if yes is None:
                    continue
                out = (yes | no) & here
                if out.any():
                    gone = live[out]
                    score[gone], passed[gone], visited[gone], exit_idx[gone] = acc[out], yes[out], end, idx
                    here &= ~out
                    left = int(here.sum())
                    if not left:
                        break
                    # Decided rows walk along until half of the tile has left.
                    if 2 * left <= len(here):
                        live, acc, thr, tile = live[here], acc[here], thr[here], np.ascontiguousarray(tile[:, here])
                        here = np.ones(left, bool)
            rest = live[here]
            score[rest], passed[rest] = acc[here], (acc >= thr)[here]
        fields = {"score": score, "pass": passed, "visited": visited, "exit_idx": exit_idx}
        return _spread_struct(fields, rows, len(batch))

    begin = F.lit(model.base).cast("float") if initial is None else initial.cast("float")
    return tree_route(features, threshold.cast("float"), begin)


def score_interval(features: Column, model: TreeModel, observed: Sequence[int] | None = None) -> Column:
    """Lowest and highest score still possible when only the ``observed`` features are known.

    Folded from the leaves up: a split on a known feature keeps one child, any other keeps the
    smaller and the larger of both. With every feature known both ends equal the exact score.
    """
    known = np.ones(model.dim, bool)
    if observed is not None:
        known[:] = False
        known[list(observed)] = True

    @batch_udf("struct<lower: float, upper: float>")
    def tree_interval(batch: pa.Array) -> pa.Array:
        x, rows = _vectors(batch, model.dim)
        lower = np.full(len(x), model.base, dtype=np.float32)
        upper = lower.copy()
        for at, tile, _ in _tiles(x):
            for pos in range(model.n_trees):
                lo, hi = _tree_ends(model, pos, tile, known)
                lower[at] += lo
                upper[at] += hi
        return _spread_struct({"lower": lower, "upper": upper}, rows, len(batch))

    return tree_interval(features)


def _tree_ends(
    m: TreeModel, pos: int, x: np.ndarray, known: np.ndarray, node: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest leaf reachable from ``node`` for every column of ``x``."""
    fidx, thr, child, missing_step, leaf = m.tree(pos)
    if child[node] == node:
        both = np.full(x.shape[1], leaf[node], dtype=np.float32)
        return both, both
    l_lo, l_hi = _tree_ends(m, pos, x, known, child[node])
    r_lo, r_hi = _tree_ends(m, pos, x, known, child[node] + 1)
    if not known[fidx[node]]:
        return np.minimum(l_lo, r_lo), np.maximum(l_hi, r_hi)
    v = x[fidx[node]]
    step = v >= thr[node]
    if missing_step[node]:
        step |= np.isnan(v)
    return np.where(step, r_lo, l_lo), np.where(step, r_hi, l_hi)


# --- model tables as relations ------------------------------------------------------------


def tree_plan(
    nodes: DataFrame, order: DataFrame | None = None, max_trees: int | None = None
) -> DataFrame:
    """One row per planned tree: ``model, tree_id, plan_pos`` (0-based), cut to ``max_trees``.

    ``order`` gives ``model, tree_id, plan_pos``; without it the tree id is the position. A tree
    without a position, or a position without a tree, raises.
    """
    trees = nodes.groupBy("model", "tree_id").agg(F.count("*").alias("n_nodes")).drop("n_nodes")
    if order is None:
        plan = trees.withColumn("plan_pos", F.col("tree_id").cast("bigint"))
    else:
        both = trees.withColumn("_t", F.lit(True)).join(
            order.select("model", "tree_id", F.col("plan_pos").cast("bigint").alias("plan_pos")),
            ["model", "tree_id"],
            "full",
        )
        fits = F.col("_t").isNotNull() & F.col("plan_pos").isNotNull()
        message = F.concat(F.lit("tree order mismatch at tree "), F.col("tree_id").cast("string"))
        checked = F.when(fits, F.col("plan_pos")).otherwise(F.raise_error(message).cast("bigint"))
        plan = both.select("model", "tree_id", checked.alias("plan_pos"))
    return plan if max_trees is None else plan.where(F.col("plan_pos") < max_trees)


def tree_bounds(nodes: DataFrame) -> DataFrame:
    """Smallest and largest leaf of each tree."""
    leaves = nodes.where("is_leaf").withColumn("leaf", F.col("leaf").cast("double"))
    return leaves.groupBy("model", "tree_id").agg(
        F.min("leaf").alias("min_leaf"), F.max("leaf").alias("max_leaf")
    )


def suffix_bounds(nodes: DataFrame, plan: DataFrame | None = None, chunk: int = 4096) -> DataFrame:
    """Per plan position the least and most that the trees *after* it can still add.

    Row ``plan_pos = p`` holds the bounds once p+1 trees are done; 0 after the last tree.
    """
    plan = tree_plan(nodes) if plan is None else plan
    bounds = plan.join(tree_bounds(nodes), ["model", "tree_id"], "inner")
    sums = {"suffix_min": "min_leaf", "suffix_max": "max_leaf"}
    return chunked_running_sum(bounds, ["model"], "plan_pos", sums, chunk, reverse=True, inclusive=False)


def split_masks(nodes: DataFrame, max_leaves: int = 63) -> tuple[DataFrame, DataFrame]:
    """Node table -> (splits with the leaf sets either outcome keeps, leaves with their bit).

    Leaves of a tree are numbered by node id. The sets are carried up from the leaves, one join
    and one written table per level. Trees of more than ``max_leaves`` leaves raise.
    """
    leaf_rank = Window.partitionBy("model", "tree_id").orderBy("node_id")
    leaves = nodes.where("is_leaf").select(
        "model", "tree_id", "node_id", "leaf", (F.row_number().over(leaf_rank) - 1).alias("bit")
    )
    fits = F.when(F.col("bit") < max_leaves, F.col("bit")).otherwise(
        F.raise_error(F.lit(f"tree with more than {max_leaves} leaves")).cast("int")
    )
    leaves = leaves.withColumn("bit", fits).withColumn("mask", F.expr("shiftleft(1L, bit)"))
    splits = nodes.where("NOT is_leaf")
    edges = splits.select("model", "tree_id", F.col("node_id").alias("parent"), F.explode(F.array("left", "right")).alias("node_id"))
    leaves = materialise(leaves, "leaves")
    below = leaves.select("model", "tree_id", "node_id", "mask")
    under = below
    while True:  # one round per level of the deepest tree
        up = edges.join(below, ["model", "tree_id", "node_id"]).groupBy("model", "tree_id", "parent").agg(
            F.bit_or("mask").alias("mask")
        )
        below = materialise(up.withColumnRenamed("parent", "node_id"), "masks")
        if below.isEmpty():
            break
        under = under.unionByName(below)
    under = under.groupBy("model", "tree_id", "node_id").agg(F.bit_or("mask").alias("mask"))
    full = leaves.groupBy("model", "tree_id").agg(F.bit_or("mask").alias("full_mask"))
    for side in ("left", "right", "missing"):
        child = under.select("model", "tree_id", F.col("node_id").alias(side), F.col("mask").alias(f"{side}_mask"))
        splits = splits.join(child, ["model", "tree_id", side])
    out = splits.join(full, ["model", "tree_id"]).select(
        "model",
        "tree_id",
        "fidx",
        "thr",
        (F.bitwise_not("right_mask").bitwiseAND(F.col("full_mask"))).alias("if_left"),
        (F.bitwise_not("left_mask").bitwiseAND(F.col("full_mask"))).alias("if_right"),
        (F.col("missing") == F.col("left")).alias("missing_left"),
    )
    return materialise(out, "splits"), leaves

