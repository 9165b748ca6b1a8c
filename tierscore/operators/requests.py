"""Analytics over request logs: outcomes, latency quantiles, windows, load verdicts, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscore.functions.bins import let
from tierscore.functions.scalars import OTHER_BUCKET, decision_bucket
from tierscore.operators.skew import bounded_order_statistics, top_n_per_group
from tierscore.operators.stats import reached_rank

# Recorded latency range in microseconds and exact low range of the 3-digit bins.
LATENCY_FLOOR_US, LATENCY_CEILING_US, EXACT_BITS = 1, 60_000_000, 11
STAGES = ("parse", "feature", "router", "l1", "l2", "serialize")
LATENCIES = ("queue_delay_us", "send_delay_us", "server_rtt_us", "e2e_us")
# Limits of the load verdict.
TARGET_SHARE, QUEUE_LIMIT_US, QUEUE_PERIODS = 0.98, 5000, 10


def recorded_latency(us: Column) -> Column:
    """The value a latency histogram of three significant digits reports for ``us``.

    Below 2048 values are exact; above, bins double in width per power of two and report their
    upper end. NULL beyond one minute. At most about 18,000 distinct values result.
    """
    v = F.greatest(us.cast("bigint"), F.lit(LATENCY_FLOOR_US).cast("bigint"))
    width = F.when(v < 1 << EXACT_BITS, 1)
    for bits in range(EXACT_BITS + 1, LATENCY_CEILING_US.bit_length() + 1):
        width = width.when(v < 1 << bits, 1 << (bits - EXACT_BITS))
    width = width.cast("bigint")
    return F.when(us <= LATENCY_CEILING_US, v - F.pmod(v, width) + width - 1)


def recorded_only(log: DataFrame, warmup_end: Column, ts: str = "t_sched") -> DataFrame:
    """Drops requests scheduled before the warm-up ends."""
    return log.where(F.col(ts) >= warmup_end)


def is_2xx() -> Column:
    return ~F.col("timeout") & F.col("status_code").between(200, 299)


def outcome_columns(among: Column | None = None) -> list[Column]:
    """Outcome counts of the rows, or of those ``among`` them that meet a condition."""
    code, base = F.col("status_code"), F.lit(True) if among is None else among
    ok, failed = base & is_2xx(), base & ~F.col("timeout") & ~F.col("status_code").between(200, 299)
    return [
        F.count_if(ok).alias("ok"),
        F.count_if(failed).alias("err"),
        F.count_if(base & F.col("timeout")).alias("timeout"),
        F.count_if(ok).alias("http_2xx"),
        F.count_if(failed & (code == 429)).alias("http_429"),
        F.count_if(failed & (code >= 500)).alias("http_5xx"),
    ]


def outcome_counts(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Timeouts, successes and errors, tier-two use and decision buckets of sent requests."""
    bucket = decision_bucket(F.col("decision"))
    return log.groupBy(*keys).agg(
        *outcome_columns(),
        F.count_if("used_l2").alias("used_l2"),
        *[F.count_if(bucket == i).alias(f"bucket_{i}") for i in range(OTHER_BUCKET + 1)],
    )


def metric_rows(log: DataFrame, keys: Sequence[str], metrics: Sequence[str] = LATENCIES) -> DataFrame:
    """Long form ``keys, metric, us, over_range``: recorded latencies, NULL and marked beyond the range."""

    def pair(m: str) -> Column:
        us = F.col(m)
        over = F.coalesce(us > LATENCY_CEILING_US, F.lit(False))
        return F.struct(F.lit(m).alias("metric"), recorded_latency(us).alias("us"), over.alias("over_range"))

    rows = log.select(*keys, F.explode(F.array(*[pair(m) for m in metrics])).alias("m"))
    return rows.select(*keys, "m.metric", "m.us", "m.over_range").where("us IS NOT NULL OR over_range")


def stage_rows(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stage timings in long form, only of requests with some stage above zero."""
    any_stage = F.lit(False)
    for s in STAGES:
        any_stage = any_stage | (F.col(f"stage.{s}") > 0)
    flat = log.where(any_stage).select(*keys, *[F.col(f"stage.{s}").alias(s) for s in STAGES])
    return metric_rows(flat, keys, STAGES)


def latency_quantiles(rows: DataFrame, keys: Sequence[str] = (), qs: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles per metric from long-form rows: first value whose cumulative count reaches q n.

    ``over_range`` counts the latencies beyond the recorded range, which the quantiles leave out.
    """
    ranks = {f"p{round(q * 100)}": reached_rank(q) for q in qs}
    return bounded_order_statistics(rows, [*keys, "metric"], "us", ranks, {"over_range": "over_range"})


def counter_totals(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Named counters summed: ``keys, name, total``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("v")) for c in names])
    rows = df.select(*keys, F.explode(pairs).alias("c"))
    return rows.groupBy(*keys, F.col("c.name").alias("name")).agg(F.sum("c.v").alias("total"))


def load_summary(
    log: DataFrame, duration_s: float, target_rps: float, batch_records: int = 128, keys: Sequence[str] = ()
) -> DataFrame:
    """Attempted, offered and successful rates against the target.

    Attempted counts sent requests; offered adds those dropped at a full queue.
    """
    sent = ~F.col("dropped")
    counts = log.groupBy(*keys).agg(
        F.count_if(sent).alias("attempted"),
        F.count_if(F.col("dropped")).alias("drop_conn_queue_full"),
        F.count_if(F.col("dropped_late")).alias("dropped_after_attempt"),
        F.count_if(F.col("drop_inflight")).alias("drop_inflight_cap"),
        F.count_if(sent & is_2xx()).alias("ok"),
        F.count_if(sent & F.col("timeout")).alias("timeout"),
        F.count_if(sent & ~F.col("timeout") & (F.col("status_code") == 429)).alias("http_429"),
        F.count_if(sent & ~F.col("timeout") & (F.col("status_code") >= 500)).alias("http_5xx"),
    )
    seconds, target = F.lit(max(float(duration_s), 1.0)), F.lit(float(target_rps))
    rows = counts.withColumn("offered", F.col("attempted") + F.col("drop_conn_queue_full"))
    rows = rows.withColumn("attempted_rps", F.col("attempted") / seconds).withColumn("ok_rps", F.col("ok") / seconds)
    short = F.greatest(target - F.col("attempted_rps"), F.lit(0.0))
    share = F.when(F.col("offered") == 0, F.lit(0.0)).otherwise(F.col("drop_conn_queue_full") / F.col("offered"))
    return rows.select(
        "*",
        (F.col("offered") / seconds).alias("offered_rps"),
        share.alias("not_sent_share"),
        short.alias("under_target_rps"),
        F.when(target == 0, F.lit(0.0)).otherwise(short / target).alias("under_target_share"),
        (F.col("attempted_rps") / F.lit(float(max(batch_records, 1)))).alias("attempted_batch_rps"),
        (F.col("ok_rps") / F.lit(float(max(batch_records, 1)))).alias("ok_batch_rps"),
    )


def verdict(summary: DataFrame, target_rps: float, batch_mode: str = "off", latency_mode: bool = True) -> DataFrame:
    """Adds ``verdict``, ``client_reasons`` and ``server_reasons`` to a summary with ``queue_p99``.

    The client limits the run if it dropped requests, stayed below 98 % of the target or queued
    too long; else the server does if there were timeouts, 429 or 5xx replies.
    """

    def counted(name: str) -> Column:
        return F.when(F.col(name) > 0, F.format_string(name + "=%d", F.col(name)))

    under = F.col("attempted_rps") < F.lit(target_rps * TARGET_SHARE)
    if batch_mode == "http1":
        gap = F.greatest(F.lit(float(target_rps)) - F.col("attempted_rps"), F.lit(0.0))
        slow = F.format_string("under_target_rows=%.1f offered_rows=%.1f", gap.cast("double"), F.col("offered_rps").cast("double"))
        drops = [counted("dropped_after_attempt")]
    else:
        slow = F.format_string("attempted_rps=%.1f (<98%% target)", F.col("attempted_rps").cast("double"))
        drops = [counted("drop_conn_queue_full")]
    client = [counted("drop_inflight_cap"), F.when(under, slow), *drops]
    if batch_mode == "off":
        period = max(int(max(1_000_000.0 / max(target_rps, 1), 1.0)), 1)
        late = (F.col("queue_p99") >= QUEUE_LIMIT_US) | (F.col("queue_p99") >= period * QUEUE_PERIODS)
        name = "queue_delay_p99" if latency_mode else "batch_e2e_p99"
        client.append(F.when(late, F.format_string(name + "=%dus", F.col("queue_p99"))))
    server = [counted("timeout"), counted("http_429"), counted("http_5xx")]
    present = lambda cols: F.filter(F.array(*cols), lambda r: r.isNotNull())
    rows = summary.withColumn("client_reasons", present(client)).withColumn("server_reasons", present(server))
    word = (
        F.when(F.size("client_reasons") > 0, F.lit("ClientLimited"))
        .when(F.size("server_reasons") > 0, F.lit("ServerLimited"))
        .otherwise(F.lit("Pass"))
    )
    return rows.withColumn("verdict", word)


def batch_completion(replies: DataFrame, seals: DataFrame) -> DataFrame:
    """Batches that are sealed and fully answered, with their counts and latency.

    ``replies``: ``batch_id, issued_at, done_at, rows, ok_rows, status_code, timeout, used_l2,
    decision`` per reply; ``seals``: ``batch_id, expected``. Rows of a 2xx reply beyond its ok
    rows are ``lost``. A timed-out reply counts all its rows as timeout and in bucket 4.
    """
    rows, late, good = F.col("rows"), F.col("timeout"), is_2xx()
    failed = ~late & ~good
    total = lambda cond, amount: F.sum(F.when(cond, amount).otherwise(0))
    bucket = F.when(late, F.lit(OTHER_BUCKET)).otherwise(decision_bucket(F.col("decision")))
    done = replies.groupBy("batch_id").agg(
        F.count("*").alias("replies"),
        F.max("done_at").alias("closed_at"),
        (F.unix_micros(F.max("done_at")) - F.unix_micros(F.min("issued_at"))).alias("latency_us"),
        total(good, F.col("ok_rows")).alias("ok"),
        total(good, rows - F.col("ok_rows")).alias("lost"),
        total(failed, rows).alias("err"),
        total(late, rows).alias("timeout"),
        total(failed & (F.col("status_code") == 429), rows).alias("http_429"),
        total(failed & (F.col("status_code") >= 500), rows).alias("http_5xx"),
        total(~late, F.col("used_l2").cast("int") * rows).alias("used_l2"),
        *[total(bucket == i, rows).alias(f"bucket_{i}") for i in range(OTHER_BUCKET + 1)],
    )
    return done.join(seals, "batch_id").where(F.col("replies") == F.col("expected")).drop("expected")


# --- outcomes and latencies as one histogram: (metric, bin) -> count, merged by adding up ------

OUTCOME, OVER_RANGE = "outcome", -1
OK, OTHER_ERROR, TOO_MANY, SERVER_ERROR, TIMEOUT = range(1, 6)


def outcome_code() -> Column:
    """Drops, outcome, tier-two use and decision bucket of a request as one small number."""
    failed = ~F.col("timeout") & ~F.col("status_code").between(200, 299)
    kind = (
        F.when(is_2xx(), OK)
        .when(F.col("timeout"), TIMEOUT)
        .when(failed & (F.col("status_code") == 429), TOO_MANY)
        .when(failed & (F.col("status_code") >= 500), SERVER_ERROR)
        .when(failed, OTHER_ERROR)
        .otherwise(0)
    )
    flag = lambda c, v: F.when(F.col(c), v).otherwise(0)
    code = flag("dropped", 1) + flag("drop_inflight", 2) + flag("used_l2", 4) + kind * 8
    return (code + decision_bucket(F.col("decision")) * 64).cast("bigint")


def measure(name: str, us: Column) -> Column:
    """One latency as ``metric, bin``; bin ``OVER_RANGE`` beyond the recorded range, NULL for none."""
    seen = F.coalesce(recorded_latency(us), F.lit(OVER_RANGE)).cast("bigint")
    return F.when(us.isNotNull(), F.struct(F.lit(name).alias("metric"), seen.alias("bin")))


def measures(log: DataFrame, keep: Sequence[str] = (), stages: Sequence[str] = STAGES) -> DataFrame:
    """``keep, metric, bin``: the outcome of every request and the latencies of those that were sent.

    Stage timings count only where some stage is above zero; rows without ``dropped`` (heartbeats of a
    stream) measure nothing.
    """
    staged = F.lit(False)
    for s in STAGES:
        staged = staged | (F.col(f"stage.{s}") > 0)
    sent = ~F.col("dropped")
    outcome = F.when(F.col("dropped").isNotNull(), F.struct(F.lit(OUTCOME).alias("metric"), outcome_code().alias("bin")))
    times = [F.when(sent, measure(m, F.col(m))) for m in LATENCIES]
    times += [F.when(sent & staged, measure(s, F.col(f"stage.{s}"))) for s in stages]
    rows = log.select(*keep, F.explode(F.array_compact(F.array(outcome, *times))).alias("m"))
    return rows.select(*keep, "m.metric", "m.bin")


ENTRY = ("metric", "bin", "n")


def total(entries: Column, wanted) -> Column:
    """Sum of the counts of the entries that are ``wanted``."""
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + F.when(wanted(e), e["n"]).otherwise(0))


def outcome_totals(entries: Column) -> dict[str, Column]:
    """Attempts, drops, outcomes, tier-two use and decision buckets from ``metric, bin, n`` entries."""
    bit = lambda e, b: F.floor(e["bin"] / b) % 2 == 1
    kind = lambda e: F.floor(e["bin"] / 8) % 8
    among = lambda wanted: total(entries, lambda e: (e["metric"] == OUTCOME) & wanted(e))
    sent = lambda *kinds: among(lambda e: ~bit(e, 1) & kind(e).isin(*kinds))
    return {
        "attempted": among(lambda e: ~bit(e, 1)),
        "dropped": among(lambda e: bit(e, 1) | bit(e, 2)),
        "drop_inflight_cap": among(lambda e: bit(e, 2)),
        "drop_conn_queue_full": among(lambda e: bit(e, 1)),
        "ok": sent(OK),
        "err": sent(OTHER_ERROR, TOO_MANY, SERVER_ERROR),
        "timeout": sent(TIMEOUT),
        "http_2xx": sent(OK),
        "http_429": sent(TOO_MANY),
        "http_5xx": sent(SERVER_ERROR),
        "used_l2": among(lambda e: ~bit(e, 1) & bit(e, 4)),
        **{f"bucket_{b}": among(lambda e, b=b: ~bit(e, 1) & (F.floor(e["bin"] / 64) == b)) for b in range(OTHER_BUCKET + 1)},
    }


def entry_quantiles(entries: Column, metric: str, qs: Sequence[float]) -> Column:
    """Values of one metric whose cumulative count first reaches ``q n``; NULL without measurements."""
    own = F.filter(entries, lambda e: (e["metric"] == metric) & (e["bin"] != OVER_RANGE))
    own = F.array_sort(F.transform(own, lambda e: F.struct(e["bin"].alias("bin"), e["n"].alias("n"))))

    def of(bins: Column) -> Column:
        n = F.aggregate(bins, F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"])

        def found(count: Column) -> Column:
            ranks = [reached_rank(q)(count) for q in qs]
            none = F.lit(None).cast("bigint")
            start = F.struct(F.lit(0).cast("bigint").alias("seen"), *[none.alias(f"q{i}") for i in range(len(qs))])

            def step(acc: Column, e: Column) -> Column:
                seen = acc["seen"] + e["n"]
                hit = [F.coalesce(acc[f"q{i}"], F.when(seen > r, e["bin"])).alias(f"q{i}") for i, r in enumerate(ranks)]
                return F.struct(seen.alias("seen"), *hit)

            return F.aggregate(bins, start, step)

        return let(n, found)

    return let(own, of)


# Window column of each p99 latency, ``batch`` being whole batches.
WINDOW_P99 = {
    "queue_delay_us": "queue_p99_us", "send_delay_us": "send_p99_us", "server_rtt_us": "server_rtt_p99_us",
    "e2e_us": "e2e_p99_us", "batch": "batch_e2e_p99_us", "router": "stage_router_p99_us", "l1": "stage_l1_p99_us",
    "l2": "stage_l2_p99_us",
}
WINDOW_STAGES = [m for m in WINDOW_P99 if m in STAGES]
WINDOW_TOTALS = ("attempted", "dropped", "drop_inflight_cap", "drop_conn_queue_full", "ok", "err", "timeout", "http_2xx", "http_429", "http_5xx")


def over_range(entries: Column) -> Column:
    return total(entries, lambda e: e["bin"] == OVER_RANGE)


def window_rows(counted: DataFrame, w: str) -> DataFrame:
    """One row per window from ``w, entries``: totals, p99 latencies (0 for none) and ``over_range``."""
    entries = F.col("entries")
    totals = outcome_totals(entries)
    p99 = [F.coalesce(entry_quantiles(entries, m, (0.99,))["q0"], F.lit(0)).alias(c) for m, c in WINDOW_P99.items()]
    return counted.select(
        F.floor(F.unix_millis(F.col(w))).cast("bigint").alias("t_ms"),
        *[totals[c].alias(c) for c in WINDOW_TOTALS],
        *p99,
        over_range(entries).alias("over_range"),
    )


def window_metrics(log: DataFrame, batches: DataFrame, window: str, ts: str = "t_sched") -> DataFrame:
    """Per tumbling window: attempts, outcomes, drops and p99 latencies (windows with events).

    One pass over the log counts outcomes and recorded latencies alike; a window then has at most some
    18,000 counts per metric. ``over_range`` counts the measurements beyond the recorded latencies.
    """
    start = lambda col: F.window(F.col(col), window)["start"]
    rows = measures(log.withColumn("w", start(ts)), ["w"], WINDOW_STAGES)
    done = batches.select(start("closed_at").alias("w"), measure("batch", F.col("latency_us")).alias("m"))
    rows = rows.unionByName(done.where("m is not null").select("w", "m.metric", "m.bin"))
    counts = rows.groupBy("w", "metric", "bin").agg(F.count("*").alias("n"))
    full = window_rows(counts.groupBy("w").agg(F.collect_list(F.struct(*ENTRY)).alias("entries")), "w")
    # A window that only holds the end of a batch has no events.
    return full.where("attempted + dropped > 0")


def rate_budget(log: DataFrame, per_second: int, ts: str = "t_sched", key: str = "event_id") -> DataFrame:
    """First ``per_second`` triggers of every second; 0 means no limit."""
    rows = log.withColumn("second", F.floor(F.unix_micros(F.col(ts)) / 1_000_000).cast("bigint"))
    if per_second == 0:
        return rows
    return top_n_per_group(rows, ["second"], [F.col(ts), F.col(key)], per_second)


def activity_windows(
    log: DataFrame, key: str, value: str, windows: Sequence[int] = (60, 300), ts: str = "t_sched"
) -> DataFrame:
    """Per key and active second: events and value sum of the trailing windows, that second included.

    Events are first combined per (key, second). Each combined row is then copied to the time
    slots its windows reach, so a slot holds all it needs and a busy key is split over slots.
    """
    span = max(windows)
    secs = log.groupBy(key, F.floor(F.unix_micros(F.col(ts)) / 1_000_000).cast("bigint").alias("second")).agg(
        F.count("*").alias("n"), F.sum(value).alias("v")
    )
    slot = F.floor(F.col("second") / F.lit(span)).cast("bigint")
    copies = secs.withColumn("own", slot).withColumn("slot", F.explode(F.array(slot, slot + 1)))
    out = copies
    for w in windows:
        frame = Window.partitionBy(key, "slot").orderBy("second").rangeBetween(-(w - 1), 0)
        out = out.withColumn(f"n_{w}s", F.sum("n").over(frame)).withColumn(f"v_{w}s", F.sum("v").over(frame))
    cols = [c for w in windows for c in (f"n_{w}s", f"v_{w}s")]
    return out.where("slot = own").select(key, "second", *cols)

