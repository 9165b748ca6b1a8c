"""SQL building blocks for the checks: the fixtures and the scoring steps as common table
expressions that run on the same Parquet tables."""

from __future__ import annotations

from tierscore.plans import fixtures as fx

TXN = """li AS (
  SELECT l_orderkey AS txn_id, count(*) AS n, sum(l_quantity) AS q, max(l_discount) AS d, max(l_extendedprice) AS e,
         min(l_quantity) AS mq, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r
  FROM lineitem GROUP BY l_orderkey),
txn AS (
  SELECT o_orderkey AS txn_id, CASE WHEN li.r > 0 THEN 1 ELSE 0 END AS label, o_orderpriority AS priority,
         [CAST(o_totalprice AS FLOAT), CAST(n AS FLOAT), CAST(q AS FLOAT), CAST(d AS FLOAT), CAST(e AS FLOAT),
          CAST(mq AS FLOAT), CAST(r AS FLOAT), CAST(c_acctbal AS FLOAT)] AS features,
         o_orderkey % 3 + 1 AS fold_id, o_orderkey % 5 AS seg_prod_amtbin, o_orderkey % 3 AS slot_id,
         o_orderkey % 10 <> 0 AS active,
         CASE WHEN o_orderkey % 7 = 0 THEN 0.25e0 END AS l2_tau_used,
         (o_orderkey % 9 - 2) / 16e0 AS tau
  FROM orders LEFT JOIN li ON o_orderkey = li.txn_id LEFT JOIN customer ON o_custkey = c_custkey)"""

VEC = "vec AS (SELECT vec_id AS txn_id, embedding AS features, label FROM embeddings)"


def nodes(name: str) -> str:
    """Node table of a rule-based model: ``t, n, is_leaf, fidx, thr, lc, rc, mc, leaf``."""
    trees, depth, bias = fx.MODELS[name]
    per_tree, inner = 2 ** (depth + 1) - 1, 2**depth - 1
    if name.startswith("vec"):
        width, low, span = fx.VEC_DIM, f"{fx.VEC_LOW}e0", f"{fx.VEC_SPAN}e0"
    else:
        width = 9 if name == "l2" else 8
        pick = lambda vals: "[" + ", ".join(f"{v}e0" for v in vals) + f"][(t * 5 + n * 3 + t * n) % {width} + 1]"
        low, span = pick(fx.FEATURE_LOW), pick(fx.FEATURE_SPAN)
    return f"""nodes_{name} AS (
  SELECT t, n, n >= {inner} AS is_leaf, (t * 5 + n * 3 + t * n) % {width} AS fidx,
         CAST({low} + {span} * ((t * 7 + n * 11 + 3) % 15 + 1) / 16e0 AS FLOAT) AS thr,
         2 * n + 1 AS lc, 2 * n + 2 AS rc, CASE WHEN (t + n) % 3 = 0 THEN 2 * n + 1 ELSE 2 * n + 2 END AS mc,
         ((t * 37 + n * 23 + t * n * 5) % 41 - 20 + {bias}) / 64e0 AS leaf
  FROM (SELECT unnest(range({trees})) AS t) CROSS JOIN (SELECT unnest(range({per_tree})) AS n))"""


def leaves(name: str, source: str, out: str, pos: str = "t") -> str:
    """Leaf reached per row and tree: ``out(txn_id, t, pos, leaf)``, one join per level.

    Vectors are cut to the needed value at each level; ``pos`` is the plan position of tree t.
    """
    _, depth, _ = fx.MODELS[name]
    step = f"{out}_0 AS (SELECT s.txn_id, m.t, 0 AS n FROM {source} s CROSS JOIN (SELECT DISTINCT t FROM nodes_{name}) m)"
    parts = [step]
    for k in range(depth):
        parts.append(
            f"""{out}_{k + 1} AS (
  SELECT w.txn_id, w.t,
         CASE WHEN s.features[m.fidx + 1] IS NULL OR isnan(s.features[m.fidx + 1]) THEN m.mc
              WHEN s.features[m.fidx + 1] < m.thr THEN m.lc ELSE m.rc END AS n
  FROM {out}_{k} w JOIN nodes_{name} m ON m.t = w.t AND m.n = w.n JOIN {source} s ON s.txn_id = w.txn_id)"""
        )
    parts.append(
        f"""{out} AS (
  SELECT w.txn_id, w.t, w.n, w.pos, m.leaf
  FROM (SELECT *, {pos} AS pos FROM {out}_{depth}) w JOIN nodes_{name} m ON m.t = w.t AND m.n = w.n)"""
    )
    return ",\n".join(parts)


def scores(leaf_table: str, out: str) -> str:
    return f"{out} AS (SELECT txn_id, sum(leaf) AS score FROM {leaf_table} GROUP BY txn_id)"


def suffix(name: str, out: str, pos: str = "t") -> str:
    """Bounds of what the trees after each position can still add: ``out(pos, smin, smax)``."""
    frame = "OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"""{out} AS (
  SELECT pos, coalesce(sum(lo) {frame}, 0) AS smin, coalesce(sum(hi) {frame}, 0) AS smax
  FROM (SELECT {pos} AS pos, min(leaf) AS lo, max(leaf) AS hi FROM nodes_{name} WHERE is_leaf GROUP BY t))"""


def route(
    name: str, leaf_table: str, rows: str, tau: str, out: str, pos: str = "t", start: int = 0, first: str = "0",
    policy: fx.ApproxPolicy | None = None, every: int = 1,
) -> str:
    """Early exit per row: ``out(txn_id, score, pass, visited, exit_idx)``.

    ``rows`` supplies the threshold expression ``tau`` and the start score ``first``.
    """
    trees = fx.MODELS[name][0]
    hot = policy.hot_trees if policy else 0
    approx = "NULL"
    idx = "-1"
    if policy:
        tests, places = [], []
        for i, (cp, ref, pos_) in enumerate(zip(policy.checkpoints, policy.tau_ref, policy.tau_pos)):
            if ref is not None:
                tests.append(f"WHEN m = {cp} AND score - tau <= {ref} THEN 0")
            if pos_ is not None:
                tests.append(f"WHEN m = {cp} AND score - tau >= {pos_} THEN 1")
            places.append(f"WHEN m = {cp} THEN {i}")
        approx = "CASE " + " ".join(tests) + " END"
        idx = f"CASE WHEN m > {hot} THEN -1 " + " ".join(places) + " END"
    check = f"(m % {every} = 0 OR m = {trees})"
    return f"""{suffix(name, out + "_sfx", pos)},
{out}_run AS (
  SELECT l.txn_id, l.pos + 1 AS m, r.tau, r.f + sum(l.leaf) OVER (PARTITION BY l.txn_id ORDER BY l.pos) AS score, x.smin, x.smax
  FROM {leaf_table} l JOIN (SELECT txn_id, {tau} AS tau, {first} AS f FROM {rows}) r ON r.txn_id = l.txn_id
  JOIN {out}_sfx x ON x.pos = l.pos WHERE l.pos >= {start}),
{out}_dec AS (
  SELECT txn_id, m, score, CASE WHEN m <= {hot} THEN {approx}
         WHEN {check} AND score + smin >= tau THEN 1 WHEN {check} AND score + smax < tau THEN 0 END AS pass, {idx} AS idx
  FROM {out}_run),
{out} AS (
  SELECT txn_id, arg_min(score, m) AS score, arg_min(pass, m) AS pass, min(m) AS visited, arg_min(idx, m) AS exit_idx
  FROM {out}_dec WHERE pass IS NOT NULL GROUP BY txn_id)"""


def prefix(leaf_table: str, checkpoints: tuple[int, ...], out: str) -> str:
    """Running score at each checkpoint: ``out(txn_id, slot, checkpoint, score)``."""
    values = ", ".join(f"({i}, {c})" for i, c in enumerate(checkpoints))
    return f"""{out} AS (
  SELECT l.txn_id, c.slot, c.checkpoint, sum(l.leaf) AS score
  FROM {leaf_table} l JOIN (VALUES {values}) c(slot, checkpoint) ON l.pos < c.checkpoint
  GROUP BY l.txn_id, c.slot, c.checkpoint)"""


def leaf_work(leaf_table: str, checkpoints: tuple[int, ...]) -> str:
    """Work and early resolved trees per tree up to each checkpoint: ``wk(txn_id, checkpoint, evals, resolved)``."""
    values = ", ".join(f"({c})" for c in checkpoints)
    return f"""wk AS (
  SELECT l.txn_id, c.checkpoint, sum((t + n) % 3 + 1) / c.checkpoint AS evals, sum((t * 3 + n) % 2) / c.checkpoint AS resolved
  FROM {leaf_table} l JOIN (VALUES {values}) c(checkpoint) ON l.pos < c.checkpoint GROUP BY l.txn_id, c.checkpoint)"""


def list_of(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}" for v in values) + "]::DOUBLE[]"


GAP_BIN = "greatest(least(CAST(floor({g} * 32) AS BIGINT) + 128, 255), 0)"
TAU_BIN = "(CASE WHEN {t} < 0.1875 THEN 0 WHEN {t} < 0.28125 THEN 1 ELSE 2 END)"


def bands(checkpoints: tuple[int, ...] = fx.CHECKPOINTS) -> str:
    """The rule-based band table: ``slot, checkpoint, fold_id, tau_bin, b, ref_hi, rej_lo``."""
    cps = ", ".join(f"({i}, {c})" for i, c in enumerate(checkpoints))
    levels = ", ".join(f"({'NULL' if f is None else f}, {'NULL' if t is None else t}, {lv})" for f, t, lv in fx.BAND_LEVELS)
    return f"""bands AS (
  SELECT slot, checkpoint, fold_id, tau_bin, b, (8 - 2 * slot + lv + b % 8) / 16e0 AS ref_hi, -(6 - 2 * slot + lv + b % 5) / 16e0 AS rej_lo
  FROM (VALUES {cps}) c(slot, checkpoint) CROSS JOIN (VALUES {levels}) l(fold_id, tau_bin, lv)
  CROSS JOIN (SELECT unnest(range(256)) AS b))"""


def band_limits(rows: str, out: str) -> str:
    """Limits over the guard bins for rows ``txn_id, slot, checkpoint, fold_id, tau, score``."""
    gap = GAP_BIN.format(g="gap")
    return f"""{out}_g AS (
  SELECT *, {gap} AS gap_bin, {TAU_BIN.format(t="tau")} AS tau_bin FROM (SELECT *, tau - score AS gap FROM {rows})),
{out}_h AS (
  SELECT *, CASE WHEN gap_bin > 0 AND abs(gap - (gap_bin - 128) / 32e0) <= greatest(1e-6, 8 * 2e0 ** -23 * greatest(abs(gap), 1)) THEN gap_bin - 1 ELSE gap_bin END AS g_lo,
         CASE WHEN gap_bin + 1 < 256 AND abs((gap_bin - 127) / 32e0 - gap) <= greatest(1e-6, 8 * 2e0 ** -23 * greatest(abs(gap), 1)) THEN gap_bin + 1 ELSE gap_bin END AS g_hi
  FROM {out}_g),
{out}_lv AS (
  SELECT h.txn_id, h.checkpoint, max(CASE WHEN b.tau_bin IS NOT NULL THEN 3 WHEN b.fold_id IS NOT NULL THEN 2 ELSE 1 END) AS lv
  FROM {out}_h h JOIN (SELECT DISTINCT checkpoint, fold_id, tau_bin FROM bands) b
    ON b.checkpoint = h.checkpoint AND (b.fold_id IS NULL OR b.fold_id = h.fold_id) AND (b.tau_bin IS NULL OR b.tau_bin = h.tau_bin)
  GROUP BY h.txn_id, h.checkpoint),
{out} AS (
  SELECT h.txn_id, h.slot, h.checkpoint, h.fold_id, h.tau, h.score, h.gap, h.gap_bin, h.tau_bin, max(b.ref_hi) AS ref_hi, min(b.rej_lo) AS rej_lo
  FROM {out}_h h JOIN {out}_lv v ON v.txn_id = h.txn_id AND v.checkpoint = h.checkpoint
  JOIN bands b ON b.checkpoint = h.checkpoint AND b.b BETWEEN h.g_lo AND h.g_hi
    AND (CASE v.lv WHEN 1 THEN b.fold_id IS NULL WHEN 2 THEN b.fold_id = h.fold_id AND b.tau_bin IS NULL
         ELSE b.fold_id = h.fold_id AND b.tau_bin = h.tau_bin END)
  GROUP BY ALL)"""


def atlas_cells() -> str:
    cps = ", ".join(f"({c})" for c in fx.CHECKPOINTS)
    return f"""cells AS (
  SELECT checkpoint, tb AS tau_bin, cl AS cluster_id, b AS gap_bin,
         CASE WHEN cnt < {fx.ATLAS_MIN} THEN 0 WHEN rate <= {fx.ATLAS_SAFE_REF} THEN 1 WHEN rate >= {fx.ATLAS_SAFE_REJ} THEN 2 ELSE 0 END AS cell
  FROM (SELECT checkpoint, tb, cl, b, (tb * 7 + cl * 5 + b) % 20 AS cnt, ((b * 3 + cl * 11 + tb) % 32) / 32e0 AS rate
        FROM (VALUES {cps}) c(checkpoint) CROSS JOIN (SELECT unnest(range(3)) AS tb) CROSS JOIN (SELECT unnest(range(4)) AS cl)
        CROSS JOIN (SELECT unnest(range(256)) AS b)))"""


def cluster_expr(gap: str, dp: str, d64: str) -> str:
    z = [f"(({v}) - {m}) * {s}" for v, m, s in zip((gap, f"abs({gap})", dp, d64), fx.ATLAS_MEAN, fx.ATLAS_INV_STD)]
    totals = []
    for c in fx.ATLAS_CENTROIDS:
        totals.append(" + ".join(f"({zi}) * {2 * ci}" for zi, ci in zip(z, c)) + f" - {sum(v * v for v in c)}")
    arr = "[" + ", ".join(totals) + "]"
    return f"(list_position({arr}, list_max({arr})) - 1)"


def certified(rows: str, out: str, kind: str = "table", initial: str = "0") -> str:
    """Outcome per checkpoint: ``out(txn_id, slot, checkpoint, score, tau, outcome, route_score)``.

    ``outcome`` is 1 reject, 0 refer, NULL open. ``rows`` as for :func:`band_limits`.
    """
    extra, score = "", ""
    if kind == "atlas":
        extra = f"""LEFT JOIN cells a ON a.checkpoint = x.checkpoint AND a.tau_bin = x.tau_bin AND a.gap_bin = x.gap_bin
    AND a.cluster_id = {cluster_expr("x.gap", "x.dp", "0")}"""
        score = "WHEN a.cell = 1 THEN 0 WHEN a.cell = 2 THEN 1"
    elif kind == "mlp":
        extra = "JOIN wk ON wk.txn_id = x.txn_id AND wk.checkpoint = x.checkpoint"
        p = mlp_expr()
        cases = []
        for cp, (ref, rej) in fx.MLP_THRESHOLDS.items():
            cases.append(f"WHEN x.checkpoint = {cp} AND {p} <= {ref} THEN 0 WHEN x.checkpoint = {cp} AND {p} >= {rej} THEN 1")
        score = " ".join(cases)
    return f"""{band_limits(rows, out + "_b")},
{out}_d AS (SELECT *, score - coalesce(lag(score) OVER (PARTITION BY txn_id ORDER BY slot), {initial}) AS dp FROM {out}_b),
{out}_o AS (
  SELECT x.*, CASE WHEN ref_hi < gap THEN 0 WHEN rej_lo >= gap THEN 1 {score} END AS outcome,
         ref_hi < gap OR rej_lo >= gap AS by_band
  FROM {out}_d x {extra}),
{out} AS (
  SELECT txn_id, slot, checkpoint, score, tau, outcome,
         CASE WHEN outcome IS NULL THEN NULL WHEN by_band AND outcome = 0 THEN score + ref_hi WHEN by_band THEN score + rej_lo
              WHEN outcome = 0 THEN CAST(CAST(tau AS FLOAT) - CAST(1e-6 AS FLOAT) AS DOUBLE)
              ELSE CAST(CAST(tau AS FLOAT) + CAST(1e-6 AS FLOAT) AS DOUBLE) END AS route_score
  FROM {out}_o)"""


def mlp_expr() -> str:
    """Reject probability at a row of ``x(checkpoint, fold_id, tau, tau_bin, score, gap, dp)`` and ``wk(evals, resolved)``."""
    m = fx.MLP_SHAPE
    hot = [f"CASE WHEN x.checkpoint = {c} THEN 1 ELSE 0 END" for c in m["checkpoint_values"]]
    hot += [f"CASE WHEN x.fold_id = {f} THEN 1 ELSE 0 END" for f in m["fold_values"]]
    hot += [f"CASE WHEN x.tau_bin = {i} THEN 1 ELSE 0 END" for i in range(3)]
    nums = ["x.score", "x.gap", "abs(x.gap)", "x.dp", "0", "wk.evals", "x.checkpoint / 2048e0", "wk.resolved"]
    z = [f"(({v}) - {mu}) * {s}" for v, mu, s in zip(hot + nums, m["mean"], m["inv_std"])]

    def dot(w, b, xs):
        return f"({b} + " + " + ".join(f"{wi} * ({xi})" for wi, xi in zip(w, xs) if wi) + ")"

    h1 = [f"greatest({dot(w, b, z)}, 0)" for w, b in zip(m["w1"], m["b1"])]
    h2 = [f"greatest({dot(w, b, h1)}, 0)" for w, b in zip(m["w2"], m["b2"])]
    return f"1 / (1 + exp(-{dot(m['w3'], m['b3'], h2)}))"


def first_cert(table: str, out: str) -> str:
    """First certifying checkpoint per row."""
    return f"""{out} AS (
  SELECT txn_id, min(checkpoint) AS checkpoint, arg_min(outcome, slot) AS outcome, arg_min(route_score, slot) AS route_score,
         arg_min(score, slot) AS score FROM {table} WHERE outcome IS NOT NULL GROUP BY txn_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


REQUESTS = """log AS (
  SELECT event_id, ts AS t_sched, event_type, user_id, value,
         CAST(round(value * 1000) AS BIGINT) AS e2e_us, CAST(round(value * 1000) AS BIGINT) % 1000 AS queue_delay_us,
         CAST(round(value * 1000) AS BIGINT) % 77 AS send_delay_us,
         CAST(round(value * 1000) AS BIGINT) - CAST(round(value * 1000) AS BIGINT) % 1000 AS server_rtt_us,
         value > 200 AS timeout,
         CASE WHEN value > 200 THEN 0 WHEN event_type = 'error' AND value > 50 THEN 503 WHEN event_type = 'error' THEN 429 ELSE 200 END AS status_code,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 255 END AS decision,
         event_id // 128 AS batch_id, user_id % 4 = 0 AS used_l2, event_id % 101 = 0 AS dropped,
         event_id % 211 = 0 AS dropped_late, event_id % 307 = 0 AS drop_inflight,
         CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(round(value * 10) AS BIGINT) END AS s0
  FROM events)"""

# A recorded latency: exact below 2048, above it the upper end of a bin that doubles in width.
RECORDED = "(CASE WHEN {v} <= 60000000 THEN greatest({v}, 1) - greatest({v}, 1) % {w} + {w} - 1 END)"


def recorded(v: str) -> str:
    width = f"CAST(2 ** greatest(length(ltrim(bin(greatest({v}, 1)), '0')) - 11, 0) AS BIGINT)"
    return RECORDED.format(v=v, w=width)


OUTCOMES = """sum(CASE WHEN NOT timeout AND status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS ok,
 sum(CASE WHEN NOT timeout AND status_code NOT BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS err,
 sum(CASE WHEN timeout THEN 1 ELSE 0 END) AS timeout,
 sum(CASE WHEN NOT timeout AND status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS http_2xx,
 sum(CASE WHEN NOT timeout AND status_code = 429 THEN 1 ELSE 0 END) AS http_429,
 sum(CASE WHEN NOT timeout AND status_code >= 500 THEN 1 ELSE 0 END) AS http_5xx"""


def buckets(code: str, rows: str = "1") -> str:
    parts = [f"sum(CASE WHEN {code} = {i} THEN {rows} ELSE 0 END) AS bucket_{i}" for i in range(4)]
    return ", ".join([*parts, f"sum(CASE WHEN {code} NOT BETWEEN 0 AND 3 THEN {rows} ELSE 0 END) AS bucket_4"])
