"""Several models as one forest: node arrays end to end, one walk for the rows of all slots.

A slot is a model with, for cascades, its calibration and second certifier. An Arrow UDF receives the
vector of a row and its slot number; a tile of rows walks its trees position by position, whatever
slots they belong to, so neither the plan nor the number of Python stages grows with the slots. Rows
leave their tile once they are decided; the tile is copied when half of it has left.

Model, bands and cells are sent to the executors once, in one broadcast. Only tables of checked size
are: nodes up to ``MAX_NODES``, band and cell tables up to ``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tierscore.functions.bins import FLOAT_EPS, GUARD_FLOOR
from tierscore.operators.trees import MAX_NODES, TILE_ROWS, TreeModel, _spread_struct, _vectors, batch_udf

F32 = np.float32
_SENT: weakref.WeakKeyDictionary[Any, tuple[str, Sent]] = weakref.WeakKeyDictionary()


class Sent:
    """A broadcast object that carries its code along; read once per task."""

    def __init__(self, broadcast):
        self.broadcast, self._value = broadcast, None

    def __getstate__(self):
        return {"broadcast": self.broadcast, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self.broadcast.value)
        return self._value


def shared(value: Any) -> Sent:
    """``value`` as a broadcast, sent once per session and object."""
    sc = SparkSession.active().sparkContext
    known = _SENT.get(value)
    if known is None or known[0] != sc.applicationId:
        known = (sc.applicationId, Sent(sc.broadcast(cloudpickle.dumps(value))))
        _SENT[value] = known
    return known[1]


class Forest:
    """Node arrays of all slots end to end; tree ``first_tree[slot] + pos`` is the slot's tree at ``pos``."""

    def __init__(self, models: Sequence[TreeModel]):
        if not models:
            raise ValueError("a forest needs at least one model")
        if len({m.dim for m in models}) != 1:
            raise ValueError("the models of a forest need vectors of one width")
        if sum(len(m.fidx) for m in models) > MAX_NODES:
            raise ValueError("forest too large to ship with a task: score its models in groups")
        self.dim = models[0].dim
        self.n_trees = np.array([m.n_trees for m in models])
        self.first_tree = np.cumsum([0, *self.n_trees[:-1]])
        self.base = np.array([m.base for m in models], F32)
        nodes = np.cumsum([0, *(len(m.fidx) for m in models)])
        self.root = np.concatenate([m.offset[:-1] + at for m, at in zip(models, nodes, strict=False)])
        self.depth = np.concatenate([m.depth for m in models])
        self.fidx = np.concatenate([m.fidx for m in models])
        self.thr = np.concatenate([m.thr for m in models])
        self.missing_step = np.concatenate([m.missing_step for m in models])
        self.leaf = np.concatenate([m.leaf for m in models])
        # Children are numbered within their tree: move them to the place of the tree.
        starts = [np.repeat(m.offset[:-1], np.diff(m.offset)) + at for m, at in zip(models, nodes, strict=False)]
        self.child = np.concatenate([m.child for m in models]) + np.concatenate(starts)
        self.work = np.stack([np.concatenate([m.work[k] for m in models]) for k in (0, 1)])
        # Bounds of what is left after each tree, one entry more than trees per slot.
        self.first_bound = self.first_tree + np.arange(len(models))
        self.suffix_min = np.concatenate([m.suffix_min for m in models]).astype(np.float64)
        self.suffix_max = np.concatenate([m.suffix_max for m in models]).astype(np.float64)


class Tile:
    """Rows on their way through the trees: vectors feature by feature, scores, and who is still open."""

    def __init__(self, forest: Forest, x: np.ndarray, rows: np.ndarray, slot: np.ndarray, **columns: np.ndarray):
        self.forest = forest
        self.x = np.ascontiguousarray(x.T)
        self.has_nan = bool(np.isnan(self.x).any())
        self.rows, self.slot = rows, slot
        self.columns = columns
        self.open = np.ones(len(rows), bool)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def leaves(self, pos: int) -> np.ndarray:
        """Node of the leaf each row reaches in the tree at ``pos`` of its slot."""
        f, n = self.forest, len(self.rows)
        tree = f.first_tree.take(self.slot) + pos
        node, flat, col = f.root.take(tree), self.x.ravel(), np.arange(n)
        for _ in range(int(f.depth.take(tree).max(initial=0))):
            v = flat.take(f.fidx.take(node) * n + col)
            step = v >= f.thr.take(node)
            if self.has_nan:
                step |= np.isnan(v) & f.missing_step.take(node)
            node = f.child.take(node) + step
        return node

    def add(self, pos: int, work: bool = False) -> None:
        node = self.leaves(pos)
        self.columns["score"] += self.forest.leaf.take(node)
        if work:
            self.columns["evals"] += self.forest.work[0].take(node)
            self.columns["resolved"] += self.forest.work[1].take(node)

    def leave(self, gone: np.ndarray) -> None:
        """Close rows; the tile shrinks once at most half of it is open."""
        self.open &= ~gone
        left = int(self.open.sum())
        if left and 2 * left <= len(self.open):
            keep = np.flatnonzero(self.open)
            self.x = np.ascontiguousarray(self.x[:, keep])
            self.rows, self.slot = self.rows[keep], self.slot[keep]
            self.columns = {k: v[keep] for k, v in self.columns.items()}
            self.open = np.ones(len(keep), bool)

    @property
    def done(self) -> bool:
        return not self.open.any()


def finish(tile: Tile, start: int, put) -> None:
    """Walk on from tree ``start`` until the rest of the trees cannot change a row's decision.

    ``put(rows, score, passed, visited)`` receives rows as they are decided.
    """
    f = tile.forest

    def close(out: np.ndarray, passed: np.ndarray, end) -> None:
        out &= tile.open
        if out.any():
            put(tile.rows[out], tile["score"][out], passed[out], end if np.isscalar(end) else end[out])
            tile.leave(out)

    for pos in range(start, int(f.n_trees.take(tile.slot[tile.open]).max(initial=0))):
        last = f.n_trees.take(tile.slot)
        close(last <= pos, tile["score"] >= tile["tau"], np.maximum(last, start))
        if tile.done:
            return
        # Rows that are done walk a tree of their own once more; nobody looks at them.
        safe = np.minimum(pos, f.n_trees.take(tile.slot) - 1)
        tile.add(pos if (safe == pos).all() else safe)
        at = f.first_bound.take(tile.slot) + np.minimum(pos + 1, f.n_trees.take(tile.slot))
        wide, tau = tile["score"].astype(np.float64), tile["tau"].astype(np.float64)
        yes = wide + f.suffix_min.take(at) >= tau
        close(yes | (wide + f.suffix_max.take(at) < tau), yes, pos + 1)
        if tile.done:
            return
    if not tile.done:
        close(tile.open.copy(), tile["score"] >= tile["tau"], np.maximum(f.n_trees.take(tile.slot), start))


def tiles(forest: Forest, x: np.ndarray, slot: np.ndarray, **columns: np.ndarray) -> Iterator[Tile]:
    """Tiles of rows sorted by slot, so that a tile mostly stays within the nodes of a few slots."""
    order = np.argsort(slot, kind="stable") if len(slot) and (slot != slot[0]).any() else np.arange(len(slot))
    for at in range(0, len(order), TILE_ROWS):
        rows = order[at : at + TILE_ROWS]
        yield Tile(forest, x[rows], rows, slot[rows], **{k: v[rows].copy() for k, v in columns.items()})


def _numbers(column: pa.Array, kind, null) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(kind, copy=False)


ROUTED = "struct<score: float, pass: boolean, visited: int>"


def forest_route(features: Column, threshold: Column, slot: Column, forest: Forest) -> Column:
    """Exact early exit of every row in the model of its slot; NULL for a NULL vector."""
    sent = shared(forest)

    @batch_udf(ROUTED, pinned=True)
    def route_slots(batch: pa.Array, limit: pa.Array, slots: pa.Array) -> pa.Array:
        f = sent.value
        x, rows = _vectors(batch, f.dim)
        tau, which = _numbers(limit, F32, np.nan)[rows], _numbers(slots, np.int64, 0)[rows]
        out = {"score": np.zeros(len(x), F32), "pass": np.zeros(len(x), bool), "visited": np.zeros(len(x), np.int32)}

        def put(at, score, passed, visited):
            out["score"][at], out["pass"][at], out["visited"][at] = score, passed, visited

        for tile in tiles(f, x, which, tau=tau, score=f.base.take(which)):
            finish(tile, 0, put)
        return _spread_struct(out, rows, len(batch))

    return route_slots(features, threshold.cast("float"), slot.cast("int"))


# --- certifiers -----------------------------------------------------------------------------


def bin_of(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of the half-open bin, clamped to the first and last; 0 for a missing value."""
    raw = np.where(np.isnan(x), 0, np.searchsorted(edges, x, side="right")) - 1
    return np.clip(raw, 0, max(len(edges) - 2, 0))


class Bands:
    """Resolved bands of a calibration: limits per (fold, tau bin) route, checkpoint and gap bin.

    ``rows``: ``(checkpoint, fold or None, tau bin or None, ref_hi, rej_lo)``, the limits being arrays over
    the gap bins. A route without any table has limits that decide nothing.
    """

    def __init__(self, checkpoints, gap_edges, tau_edges, folds, rows):
        self.checkpoints = tuple(checkpoints)
        self.edges = [np.array(e, F32) for e in gap_edges]
        self.tau_edges = np.array(tau_edges, F32)
        self.folds = np.array(folds, np.int64)
        self.bins = max(len(tau_edges) - 1, 1)
        known = {(cp, fold, tb): (hi, lo) for cp, fold, tb, hi, lo in rows}
        width = {cp: len(e) - 1 for cp, e in zip(self.checkpoints, self.edges, strict=True)}
        if wrong := [k for k, (hi, _) in known.items() if len(hi) != width.get(k[0], len(hi))]:
            raise ValueError(f"bands of {wrong[0]} do not fit the gap edges of their checkpoint")
        shape = (len(folds) + 1, self.bins)
        self.ref_hi, self.rej_lo = [], []
        for cp, edges in zip(self.checkpoints, self.edges, strict=True):
            hi = np.full((*shape, len(edges) - 1), np.inf, F32)
            lo = np.full((*shape, len(edges) - 1), -np.inf, F32)
            for i, fold in enumerate([*folds, None]):
                for tb in range(self.bins):
                    # The most specific table of the route.
                    tried = ((cp, fold, tb), (cp, None, tb), (cp, fold, None), (cp, None, None))
                    own = next((known[k] for k in tried if k in known), None)
                    if own is not None:
                        hi[i, tb], lo[i, tb] = own
            self.ref_hi.append(hi.reshape(-1, hi.shape[-1]))
            self.rej_lo.append(lo.reshape(-1, lo.shape[-1]))

    def tau_bin(self, tau: np.ndarray) -> np.ndarray:
        return bin_of(self.tau_edges, tau) if len(self.tau_edges) >= 2 else np.zeros(len(tau), np.int64)

    def route(self, fold: np.ndarray, tau: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.folds, fold)
        if len(self.folds):
            at = np.where(self.folds.take(np.minimum(at, len(self.folds) - 1)) == fold, at, len(self.folds))
        return at * self.bins + self.tau_bin(tau)

    def limits(self, slot: int, route: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``gap_bin, ref_hi, rej_lo``: limits over the bins that rounding of the gap could reach."""
        edges, hi, lo = self.edges[slot], self.ref_hi[slot], self.rej_lo[slot]
        b = bin_of(edges, gap)
        tol = np.maximum(F32(GUARD_FLOOR), F32(8.0 * FLOAT_EPS) * np.maximum(np.abs(gap), F32(1.0)))
        below = np.where((b > 0) & (np.abs(gap - edges.take(b)) <= tol), b - 1, b)
        above = np.where((b + 2 < len(edges)) & (np.abs(edges.take(np.minimum(b + 1, len(edges) - 1)) - gap) <= tol), b + 1, b)
        top = np.maximum(np.maximum(hi[route, b], hi[route, below]), hi[route, above])
        low = np.minimum(np.minimum(lo[route, b], lo[route, below]), lo[route, above])
        return b, top, low


class Clusters:
    """Cluster cells of an atlas: nearest centroid on four standardised inputs, then a dense cell table."""

    def __init__(self, checkpoints, tau_edges, shapes, cells):
        """``shapes``: per checkpoint ``(mean, inv_std, centroids, gap edges)``; ``cells``: rows with a cell > 0."""
        self.tau_edges = np.array(tau_edges, F32)
        self.mean = [np.array(s[0], F32) for s in shapes]
        self.scale = [np.array(s[1], F32) for s in shapes]
        self.weight = [np.array([[2.0 * v for v in c] for c in s[2]], F32).reshape(-1, 4) for s in shapes]
        self.bias = [np.array([-sum(v * v for v in c) for c in s[2]], F32) for s in shapes]
        self.edges = [np.array(s[3], F32) for s in shapes]
        self.cells = [np.zeros((max(len(tau_edges) - 1, 1), max(len(s[2]), 1), 256), np.int8) for s in shapes]
        at = {cp: i for i, cp in enumerate(checkpoints)}
        for cp, tb, cluster, gap_bin, cell in cells:
            table = self.cells[at[cp]] if cp in at else None
            if table is not None and 0 <= tb < table.shape[0] and 0 <= cluster < table.shape[1] and 0 <= gap_bin < 256:
                table[tb, cluster, gap_bin] = cell

    def cell(self, slot: int, tau: np.ndarray, gap: np.ndarray, dp: np.ndarray, d64: np.ndarray, shared_bin: np.ndarray) -> np.ndarray:
        z = [(v - m) * s for v, m, s in zip((gap, np.abs(gap), dp, d64), self.mean[slot], self.scale[slot], strict=True)]
        if not len(self.bias[slot]):
            return np.zeros(len(gap), np.int8)
        w, totals = self.weight[slot], np.empty((len(self.bias[slot]), len(gap)), F32)
        for i, bias in enumerate(self.bias[slot]):
            totals[i] = z[0] * w[i, 0] + z[1] * w[i, 1] + z[2] * w[i, 2] + z[3] * w[i, 3] + bias
        own = bin_of(self.edges[slot], gap) if len(self.edges[slot]) >= 2 else shared_bin
        tb = bin_of(self.tau_edges, tau) if len(self.tau_edges) >= 2 else np.zeros(len(tau), np.int64)
        return self.cells[slot][tb, totals.argmax(axis=0), np.minimum(own, 255)]


def reject_probability(mlp, checkpoint: int, fold: np.ndarray, tau: np.ndarray, numbers: Sequence[np.ndarray]) -> np.ndarray:
    """The network of ``certify.Mlp`` on one checkpoint's rows, added up as 32-bit floats in input order."""
    edges = np.array(mlp.tau_edges, F32)
    tau_bin = bin_of(edges, tau) if len(edges) >= 2 else np.zeros(len(tau), np.int64)
    raw = [np.full(len(tau), F32(c == checkpoint)) for c in mlp.checkpoint_values]
    raw += [(fold == f).astype(F32) for f in mlp.fold_values]
    raw += [(tau_bin == i).astype(F32) for i in range(mlp.tau_bins)]
    x = [(v.astype(F32) - F32(m)) * F32(s) for v, m, s in zip([*raw, *numbers], mlp.mean, mlp.inv_std, strict=True)]

    def dot(weights, bias, values):
        acc = np.full(len(tau), F32(bias))
        for w, v in zip(weights, values, strict=True):
            acc = acc + F32(w) * v
        return acc

    def layer(weights, bias, values):
        return [np.maximum(dot(w, b, values), F32(0)) for w, b in zip(weights, bias, strict=True)]

    logit = dot(mlp.w3, mlp.b3, layer(mlp.w2, mlp.b2, layer(mlp.w1, mlp.b1, x)))
    with np.errstate(over="ignore"):
        return (1.0 / (1.0 + np.exp(-logit.astype(np.float64)))).astype(F32)


class Slots:
    """What a cascade sends to the executors: a forest whose slots share one list of checkpoints.

    ``bands``, ``clusters`` and ``networks`` hold one entry per slot; the last two may be None.
    """

    def __init__(self, forest: Forest, checkpoints, bands, clusters, networks, constants: dict[str, float]):
        self.forest, self.checkpoints = forest, tuple(checkpoints)
        self.bands, self.clusters, self.networks = bands, clusters, networks
        self.nudge, self.per_unit = F32(constants["nudge"]), constants["trees_per_unit"]
        self.delta_checkpoint = constants["delta_checkpoint"]

    def decide(self, tile: Tile, i: int, dp: np.ndarray, d64: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``known, reject, route score`` of the open rows of a tile at checkpoint ``i``."""
        n = len(tile.rows)
        known, reject, route = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, F32)
        for slot in np.unique(tile.slot[tile.open]).tolist():
            at = np.flatnonzero(tile.open & (tile.slot == slot))
            at = at[~np.isnan(tile["tau"][at] - tile["score"][at])]
            tau, score = tile["tau"][at], tile["score"][at]
            gap = tau - score
            b, hi, lo = self.bands[slot].limits(i, tile["route"][at], gap)
            refer = hi < gap
            rejects = ~refer & (lo >= gap)
            sure, value = refer | rejects, np.where(refer, score + hi, score + lo)
            rest = np.flatnonzero(~sure)
            if len(rest):
                verdict = self._second(slot, i, tile, at[rest], gap[rest], dp, d64, b[rest])
                sure[rest], rejects[rest] = verdict > 0, verdict == 2
                value[rest] = np.where(verdict == 2, tau[rest] + self.nudge, tau[rest] - self.nudge)
            known[at], reject[at], route[at] = sure, rejects, value
        return known, reject, route

    def _second(self, slot, i, tile, at, gap, dp, d64, shared_bin) -> np.ndarray:
        """0 open, 1 refer, 2 reject: cluster cells, or the network where its checkpoint has limits."""
        clusters, mlp, cp = self.clusters[slot], self.networks[slot], self.checkpoints[i]
        tau = tile["tau"][at]
        if clusters is not None:
            return clusters.cell(i, tau, gap, dp[at], d64[at], shared_bin)
        verdict = np.zeros(len(at), np.int8)
        if mlp is not None and cp <= mlp.checkpoint_limit and cp in mlp.thresholds:
            share = lambda c: (tile[c][at] / cp).astype(F32)
            trees = np.full(len(at), F32(cp / self.per_unit))
            numbers = [tile["score"][at], gap, np.abs(gap), dp[at], d64[at], share("evals"), trees, share("resolved")]
            p, (low, high) = reject_probability(mlp, cp, tile["fold"][at], tau, numbers), mlp.thresholds[cp]
            verdict[p >= F32(high)] = 2
            verdict[p <= F32(low)] = 1
        return verdict

    def walk(self, tile: Tile) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Walk from checkpoint to checkpoint: ``checkpoint, known, reject, route score`` of the tile's rows at each."""
        count_work = any(m is not None for m in self.networks)
        done = 0
        for i, cp in enumerate(self.checkpoints):
            for pos in range(done, cp):
                tile.add(pos, count_work)
            done = cp
            dp = tile["score"] - tile["before"]
            d64 = tile["score"] - tile["at_64"] if cp > self.delta_checkpoint else np.zeros(len(tile.rows), F32)
            d64 = np.where(np.isnan(tile["at_64"]), F32(0), d64)
            known, reject, route = self.decide(tile, i, dp, d64)
            tile.columns["before"] = tile["score"].copy()
            if cp == self.delta_checkpoint:
                tile.columns["at_64"] = tile["score"].copy()
            yield cp, known, reject, route

    def run(self, tile: Tile, put) -> None:
        """Walk to every checkpoint; ``put(rows, checkpoint, score, reject, route)`` for rows that one decides."""
        for cp, known, reject, route in self.walk(tile):
            known &= tile.open
            if known.any():
                put(tile.rows[known], cp, tile["score"][known], reject[known], route[known])
                tile.leave(known)
            if tile.done:
                return

    def tiles(self, x, tau, fold, slot, first) -> Iterator[Tile]:
        n = len(x)
        route = np.zeros(n, np.int64)
        for s in np.unique(slot).tolist():
            at = slot == s
            route[at] = self.bands[s].route(fold[at], tau[at])
        zero = np.zeros(n, np.int64)
        columns = {"tau": tau, "fold": fold, "route": route, "score": first, "before": first}
        columns |= {"at_64": np.full(n, F32(np.nan)), "evals": zero, "resolved": zero}
        return tiles(self.forest, x, slot, **columns)


NO_FOLD = -(1 << 31)
CERTIFIED = "struct<reject: boolean, route_score: float, checkpoint: int, prefix: float>"
CASCADED = (
    "struct<prefix_score: float, prefix_trees_used: int, shadow_reject: boolean, final_reject: boolean, fallback_used: boolean, "
    "direct_checkpoint: int, fallback_entry_checkpoint: int, route_score: float, exact_visits: int>"
)


def _inputs(s: Slots, batch, limit, folds, slots, first):
    x, rows = _vectors(batch, s.forest.dim)
    slot = _numbers(slots, np.int64, 0)[rows]
    begin = _numbers(first, F32, np.nan)[rows]
    return x, rows, _numbers(limit, F32, np.nan)[rows], _numbers(folds, np.int64, NO_FOLD)[rows], slot, begin


def forest_cascade(features: Column, tau: Column, fold: Column, slot: Column, slots: Slots, shadow_only: bool = False) -> Column:
    """Prefix, bands and exact rest in one step: the struct CASCADED, NULL for a NULL vector."""
    sent = shared(slots)
    names = [part.split(":")[0].strip() for part in CASCADED[7:-1].split(",")]
    kinds = (F32, np.int32, bool, bool, bool, np.int32, np.int32, F32, np.int32)

    @batch_udf(CASCADED, pinned=True)
    def cascade_slots(batch: pa.Array, limit: pa.Array, folds: pa.Array, which: pa.Array) -> pa.Array:
        s = sent.value
        base = pa.array(s.forest.base.take(_numbers(which, np.int64, 0)))
        x, rows, tau_, fold_, slot_, first = _inputs(s, batch, limit, folds, which, base)
        out = {n: np.zeros(len(x), k) for n, k in zip(names, kinds, strict=True)}

        def direct(at, cp, score, reject, route):
            out["prefix_score"][at], out["prefix_trees_used"][at], out["direct_checkpoint"][at] = score, cp, cp
            out["shadow_reject"][at] = out["final_reject"][at] = reject
            out["route_score"][at] = route

        def exact(at, score, passed, visited):
            out["final_reject"][at], out["route_score"][at], out["exact_visits"][at] = passed, score, visited

        end = s.checkpoints[-1]
        for tile in s.tiles(x, tau_, fold_, slot_, first):
            s.run(tile, direct)
            if tile.done:
                continue
            at = tile.rows[tile.open]
            out["prefix_score"][at] = out["route_score"][at] = tile["score"][tile.open]
            out["prefix_trees_used"][at] = out["fallback_entry_checkpoint"][at] = end
            out["fallback_used"][at] = True
            if not shadow_only:
                finish(tile, end, exact)
        return _spread_struct(out, rows, len(batch))

    return cascade_slots(features, tau.cast("float"), fold.cast("int"), slot.cast("int"))


def forest_certify(features: Column, tau: Column, fold: Column, slot: Column, slots: Slots, initial: Column | None = None) -> Column:
    """``cert`` (CERTIFIED of the first deciding checkpoint, else NULL) and ``last``, the last score reached."""
    sent, from_base = shared(slots), initial is None

    @batch_udf(f"struct<cert: {CERTIFIED}, last: float>", pinned=True)
    def certify_slots(batch: pa.Array, limit: pa.Array, folds: pa.Array, which: pa.Array, first: pa.Array) -> pa.Array:
        s = sent.value
        x, rows, tau_, fold_, slot_, begin = _inputs(s, batch, limit, folds, which, first)
        begin = s.forest.base.take(slot_) if from_base else begin
        n = len(x)
        cert = {"reject": np.zeros(n, bool), "route_score": np.zeros(n, F32), "checkpoint": np.zeros(n, np.int32), "prefix": np.zeros(n, F32)}
        last = np.zeros(n, F32)

        def put(at, cp, score, reject, route):
            cert["reject"][at], cert["route_score"][at], cert["checkpoint"][at], cert["prefix"][at] = reject, route, cp, score
            last[at] = score

        for tile in s.tiles(x, tau_, fold_, slot_, begin):
            s.run(tile, put)
            if not tile.done:
                last[tile.rows[tile.open]] = tile["score"][tile.open]
        sure = rows[cert["checkpoint"] > 0]
        certs = _spread_struct({k: v[cert["checkpoint"] > 0] for k, v in cert.items()}, sure, len(batch))
        absent = np.ones(len(batch), bool)
        absent[rows] = False
        ends = np.zeros(len(batch), F32)
        ends[rows] = last
        return pa.StructArray.from_arrays([certs, pa.array(ends, mask=absent)], names=["cert", "last"], mask=pa.array(absent))

    begin_score = F.lit(None).cast("float") if initial is None else initial.cast("float")
    return certify_slots(features, tau.cast("float"), fold.cast("int"), slot.cast("int"), begin_score)


OUTCOMES = "array<struct<checkpoint: int, score: float, reject: boolean, route_score: float>>"


def forest_outcomes(features: Column, tau: Column, fold: Column, slots: Slots) -> Column:
    """OUTCOMES of a row at every checkpoint, decided or not (NULL ``reject``); NULL for a NULL vector."""
    sent = shared(slots)

    @batch_udf(OUTCOMES, pinned=True)
    def outcomes_of(batch: pa.Array, limit: pa.Array, folds: pa.Array) -> pa.Array:
        s = sent.value
        first = pa.array(np.full(len(batch), s.forest.base[0], F32))
        x, rows, tau_, fold_, slot_, begin = _inputs(s, batch, limit, folds, pa.array(np.zeros(len(batch), np.int64)), first)
        shape = (len(x), len(s.checkpoints))
        score, sure, reject, route = np.empty(shape, F32), np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, F32)
        for tile in s.tiles(x, tau_, fold_, slot_, begin):
            for i, (_, known, rejected, value) in enumerate(s.walk(tile)):
                score[tile.rows, i], sure[tile.rows, i] = tile["score"], known
                reject[tile.rows, i], route[tile.rows, i] = rejected, value
        lengths = np.zeros(len(batch) + 1, np.int64)
        lengths[rows + 1] = len(s.checkpoints)
        absent = np.ones(len(batch), bool)
        absent[rows] = False
        marks, open_ = np.tile(np.array(s.checkpoints, np.int32), len(x)), ~sure.ravel()
        fields = [pa.array(marks), pa.array(score.ravel()), pa.array(reject.ravel(), mask=open_), pa.array(route.ravel(), mask=open_)]
        values = pa.StructArray.from_arrays(fields, names=["checkpoint", "score", "reject", "route_score"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), values, mask=pa.array(absent))

    return outcomes_of(features, tau.cast("float"), fold.cast("int"))


LIMITS = "struct<tau_bin: int, gap_bin: int, ref_hi: float, rej_lo: float>"


def band_limits(checkpoint: Column, fold: Column, tau: Column, gap: Column, bands: Bands) -> Column:
    """The struct LIMITS of rows in long form; NULL limits where the checkpoint or its table is unknown."""
    sent = shared(bands)

    @batch_udf(LIMITS, pinned=True)
    def limits_of(cps: pa.Array, folds: pa.Array, taus: pa.Array, gaps: pa.Array) -> pa.Array:
        b = sent.value
        cp, fold_ = _numbers(cps, np.int64, -1), _numbers(folds, np.int64, NO_FOLD)
        tau_, gap_ = _numbers(taus, F32, np.nan), _numbers(gaps, F32, np.nan)
        out = {"tau_bin": b.tau_bin(tau_).astype(np.int32), "gap_bin": np.zeros(len(cp), np.int32)}
        hi, lo = np.full(len(cp), np.inf, F32), np.full(len(cp), -np.inf, F32)
        route = b.route(fold_, tau_)
        for i, c in enumerate(b.checkpoints):
            at = np.flatnonzero(cp == c)
            out["gap_bin"][at], hi[at], lo[at] = b.limits(i, route[at], gap_[at])
        none = np.isinf(hi) & np.isinf(lo)
        columns = [pa.array(out["tau_bin"]), pa.array(out["gap_bin"]), pa.array(hi, mask=none), pa.array(lo, mask=none)]
        return pa.StructArray.from_arrays(columns, names=["tau_bin", "gap_bin", "ref_hi", "rej_lo"])

    return limits_of(checkpoint.cast("int"), fold.cast("int"), tau.cast("float"), gap.cast("float"))


# --- packets --------------------------------------------------------------------------------


class Packets:
    """Packets of trees and the rankings that order them, resolved to one lookup per state.

    ``rankings``: per step the rankings of the keys ``(tau bin, gap bin, delta bin)``, ``(tau bin,)`` and ``()``.
    A ranking is completed by the packets it leaves out, in order of ``packets``.
    """

    def __init__(self, slots: Slots, packets: Sequence[tuple[int, Sequence[int]]], tau_edges, gap_edges, delta_edges, rankings):
        self.slots = slots
        self.ids, self.trees = np.array([p for p, _ in packets], np.int32), [list(t) for _, t in packets]
        self.sizes = np.array([len(t) for t in self.trees], np.int32)
        place = {p: i for i, (p, _) in enumerate(packets)}
        self.tau_edges, self.gap_edges, self.delta_edges = (np.array(tau_edges, F32), *([np.array(e, F32) for e in many] for many in (gap_edges, delta_edges)))
        self.keys, self.orders = [], []
        for step, known in enumerate(rankings):
            full = {k: list(dict.fromkeys([*(place[p] for p in r if p is not None), *range(len(packets))])) for k, r in known.items()}
            bins = [max(len(e) - 1, 1) for e in (self.tau_edges, self.gap_edges[step], self.delta_edges[step])]
            own = [k for k in full if len(k) == 3 and all(0 <= v < b for v, b in zip(k, bins, strict=True))]
            own.sort()
            self.keys.append(np.array([self._key(step, *k) for k in own], np.int64))
            # Exact states first, then the default of each tau bin.
            last = full.get((), list(range(len(packets))))
            self.orders.append(np.array([full[k] for k in own] + [full.get((tb,), last) for tb in range(bins[0])], np.int32))

    def _key(self, step: int, tau_bin, gap_bin, delta_bin):
        gaps, deltas = max(len(self.gap_edges[step]) - 1, 1), max(len(self.delta_edges[step]) - 1, 1)
        return (tau_bin * gaps + gap_bin) * deltas + delta_bin

    def order(self, step: int, tau: np.ndarray, gap: np.ndarray, delta: np.ndarray) -> np.ndarray:
        """Packets of each row in the order of its state."""
        tb = bin_of(self.tau_edges, tau) if len(self.tau_edges) >= 2 else np.zeros(len(tau), np.int64)
        key = self._key(step, tb, bin_of(self.gap_edges[step], gap), bin_of(self.delta_edges[step], delta))
        keys = self.keys[step]
        at = np.searchsorted(keys, key)
        known = at < len(keys)
        known[known] = keys[at[known]] == key[known]
        return self.orders[step][np.where(known, at, len(keys) + tb)]

    def gains(self, x: np.ndarray, picked: np.ndarray) -> np.ndarray:
        """Score of the packet each row has picked; only its trees are walked."""
        forest, out = self.slots.forest, np.zeros(len(x), F32)
        for p in np.unique(picked).tolist():
            rows = np.flatnonzero(picked == p)
            tile = Tile(forest, x[rows], rows, np.zeros(len(rows), np.int64))
            for pos in self.trees[p]:
                out[rows] += forest.leaf.take(tile.leaves(pos))
        return out


PACKED = CASCADED[:-1] + ", packets: array<int>>"


def forest_packets(features: Column, tau: Column, fold: Column, packets: Packets) -> Column:
    """The packet cascade of a row in one step: the struct PACKED, NULL for a NULL vector."""
    sent = shared(packets)
    names = [part.split(":")[0].strip() for part in CASCADED[7:-1].split(",")]
    kinds = (F32, np.int32, bool, bool, bool, np.int32, np.int32, F32, np.int32)

    @batch_udf(PACKED, pinned=True)
    def run_packets(batch: pa.Array, limit: pa.Array, folds: pa.Array) -> pa.Array:
        p = sent.value
        s, bands = p.slots, p.slots.bands[0]
        x, rows = _vectors(batch, s.forest.dim)
        tau_, fold_ = _numbers(limit, F32, np.nan)[rows], _numbers(folds, np.int64, NO_FOLD)[rows]
        n, steps = len(x), len(s.checkpoints)
        out = {name: np.zeros(n, kind) for name, kind in zip(names, kinds, strict=True)}
        taken, picks = np.zeros((n, len(p.ids)), bool), np.full((n, steps), -1, np.int32)
        for lo in range(0, n, TILE_ROWS):
            open_ = np.arange(lo, min(lo + TILE_ROWS, n))
            prefix, delta = np.full(n, s.forest.base[0], F32)[open_], np.zeros(len(open_), F32)
            for step, cp in enumerate(s.checkpoints):
                limit_, vectors = tau_[open_], x[open_]
                order = p.order(step, limit_, limit_ - prefix, delta)
                pick = np.take_along_axis(order, np.take_along_axis(taken[open_], order, 1).argmin(axis=1)[:, None], 1)[:, 0]
                taken[open_, pick], picks[open_, step] = True, pick
                delta = p.gains(vectors, pick)
                prefix = prefix + delta
                gap = limit_ - prefix
                _, hi, low = bands.limits(step, bands.route(fold_[open_], limit_), gap)
                refer = hi < gap
                reject = ~refer & (low >= gap)
                out["prefix_score"][open_] = prefix
                for sure, value in ((refer, prefix + hi), (reject, prefix + low)):
                    out["route_score"][open_[sure]], out["direct_checkpoint"][open_[sure]] = value[sure], cp
                out["shadow_reject"][open_] = out["final_reject"][open_] = reject
                left = ~(refer | reject)
                open_, prefix, delta = open_[left], prefix[left], delta[left]
            tail = prefix.copy()
            for k in range(len(p.ids)):
                rest = np.flatnonzero(~taken[open_, k])
                tail[rest] += p.gains(x[open_[rest]], np.full(len(rest), k))
            out["fallback_used"][open_], out["fallback_entry_checkpoint"][open_] = True, s.checkpoints[-1]
            out["route_score"][open_], out["final_reject"][open_] = tail, tail >= tau_[open_]
            out["exact_visits"][open_] = (~taken[open_]) @ p.sizes
        out["prefix_trees_used"] = (taken @ p.sizes).astype(np.int32)
        lengths = np.zeros(len(batch) + 1, np.int64)
        lengths[rows + 1] = (picks >= 0).sum(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(p.ids[picks[picks >= 0]]))
        scalars = _spread_struct(out, rows, len(batch))
        absent = np.ones(len(batch), bool)
        absent[rows] = False
        return pa.StructArray.from_arrays([*(scalars.field(k) for k in names), lists], names=[*names, "packets"], mask=pa.array(absent))

    return run_packets(features, tau.cast("float"), fold.cast("int"))
