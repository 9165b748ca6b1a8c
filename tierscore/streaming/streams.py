"""Streams: windowed metrics, running totals, batch closing, rate budgets (scoring: ``policies``).

Event time and watermarks come from Spark. Rows later than the watermark are dropped by the
engine; :func:`late_rows` reads how many from the query progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tierscore.functions.scalars import OTHER_BUCKET, decision_bucket
from tierscore.operators.requests import (
    ENTRY,
    LATENCIES,
    STAGES,
    WINDOW_STAGES,
    entry_quantiles,
    measure,
    measures,
    outcome_totals,
    over_range,
    window_rows,
)
from tierscore.operators.skew import SALTS
from tierscore.session import scratch_path


def read_file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Stream one file pattern of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def with_heartbeats(sdf: DataFrame, beats: DataFrame, ts: str) -> DataFrame:
    """The stream and rows that carry nothing but an event time.

    Heartbeats move the watermark on when requests stop, so the last windows and batches close too. They
    belong in front of ``withWatermark``; no operator here counts them.
    """
    return sdf.unionByName(beats.select(ts), allowMissingColumns=True)


def stream_windows(sdf: DataFrame, replies: DataFrame | None, window: str, watermark: str, deadline_ms: int, ts: str = "t_sched") -> DataFrame:
    """The rows of ``window_metrics`` per tumbling window, in append mode.

    State is one count per (window, metric, bin), so percentiles are exact and merge by adding; a
    window that the watermark has passed is emitted once and its counts are freed. ``replies`` (see
    :func:`stream_batch_completion`) adds the latency of batches in the window in which they close.
    """
    at = F.col(ts).alias("at")
    rows = measures(sdf.withWatermark(ts, watermark).withColumn("at", at), ["at"], WINDOW_STAGES)
    if replies is not None:
        done = stream_batch_completion(replies, watermark, deadline_ms, chained=True)
        done = done.select(F.col("closed_at").alias("at"), measure("batch", F.col("latency_us")).alias("m"))
        rows = rows.unionByName(done.select("at", "m.metric", "m.bin"))
    counts = rows.groupBy(F.window("at", window).alias("w"), "metric", "bin").agg(F.count("*").alias("n"))
    # The window of a window is the window itself; it makes the second aggregate follow the watermark.
    whole = counts.groupBy(F.window("w", window).alias("w")).agg(F.collect_list(F.struct(*ENTRY)).alias("entries"))
    full = window_rows(whole.select(F.col("w.start").alias("w"), "entries"), "w")
    return full.where("attempted + dropped > 0")


COUNTER_KEYS = ["metric", "bin"]


def stream_totals(sdf: DataFrame) -> DataFrame:
    """Running counts ``metric, bin, n`` over the whole stream, for update mode.

    Many small counters instead of one row: tasks share them, and a trigger hands on only those that
    changed. :func:`totals_row` merges them.
    """
    return measures(sdf).groupBy(*COUNTER_KEYS).agg(F.count("*").alias("n"))


def totals_row(counters: DataFrame) -> DataFrame:
    """One row of totals: outcomes, drops, tier-two use, decisions, p50, p95 and p99 of all latencies.

    The counters of a metric are bounded by the recorded latencies, so their list is too.
    """
    entries = F.col("entries")
    whole = counters.agg(F.collect_list(F.struct(*ENTRY)).alias("entries"))
    quantiles = {m: entry_quantiles(entries, m, (0.5, 0.95, 0.99)) for m in (*LATENCIES, *STAGES)}
    found = whole.select(
        *[c.alias(n) for n, c in outcome_totals(entries).items()],
        *[c.alias(f"_{m}") for m, c in quantiles.items()],
        over_range(entries).alias("over_range"),
    )
    ranked = [F.col(f"_{m}.q{i}").alias(f"{m}_p{p}") for m in quantiles for i, p in enumerate((50, 95, 99))]
    return found.select(*outcome_totals(entries), *ranked, "over_range")


def stream_decision_counts(sdf: DataFrame, window: str, watermark: str, ts: str = "t_sched") -> DataFrame:
    """Decision buckets and tier-two use per window."""
    bucket = decision_bucket(F.col("decision"))
    out = sdf.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w")).agg(
        F.count("*").alias("rows"),
        F.count_if("used_l2").alias("used_l2"),
        *[F.count_if(bucket == i).alias(f"bucket_{i}") for i in range(OTHER_BUCKET + 1)],
    )
    return out.withColumn("t_ms", F.unix_millis("w.start")).drop("w")


NO_BATCH = -1  # key of heartbeats
REPLY_DEFAULTS = {
    "batch_id": NO_BATCH, "rows": 0, "ok_rows": 0, "status_code": 0, "timeout": False, "used_l2": False, "decision": OTHER_BUCKET,
    "expected": 0, "issued_us": 0, "done_us": 0,
}
BUCKETS = tuple(f"bucket_{b}" for b in range(OTHER_BUCKET + 1))
BATCH_COUNTS = ("replies", "rows", "ok", "lost", "err", "timeout", "http_429", "http_5xx", "used_l2", *BUCKETS)
BATCH_OUTPUT = (
    "batch_id bigint, " + ", ".join(f"{c} bigint" for c in BATCH_COUNTS) + ", latency_us bigint, closed string, closed_at timestamp"
)


class BatchCloser(StatefulProcessor):
    """Open batches as state: counts per batch, closed once, when fully answered or at a deadline.

    The deadline counts from the earliest known issue time; a reply that tells of an earlier one moves
    the timer. A closed batch leaves a marker until ``linger_ms`` of event time have passed, so that
    later replies neither reopen it nor emit it again. State is a few numbers, whatever the batch size.
    """

    FIELDS = (*BATCH_COUNTS, "expected", "issued", "done", "timer", "closed")

    def __init__(self, deadline_ms: int, linger_ms: int, only_complete: bool):
        self.deadline_ms, self.linger_ms, self.only_complete = deadline_ms, linger_ms, only_complete

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", ", ".join(f"{f} bigint" for f in self.FIELDS))

    def _load(self) -> dict[str, int]:
        if self.state.exists():
            return dict(zip(self.FIELDS, self.state.get(), strict=True))
        return dict.fromkeys(self.FIELDS, 0)

    def _keep(self, s: dict[str, int], timer: int) -> None:
        """Store the state with its only timer set to ``timer``."""
        if timer != s["timer"]:
            if s["timer"]:
                self.handle.deleteTimer(s["timer"])
            self.handle.registerTimer(timer)
        self.state.update(tuple((s | {"timer": timer})[f] for f in self.FIELDS))

    @staticmethod
    def _add(s: dict[str, int], pdf: pd.DataFrame) -> None:
        late = pdf["timeout"].astype(bool)
        good = ~late & pdf["status_code"].between(200, 299)
        failed = ~late & ~good
        of = lambda rows, among: int(rows[among].sum())
        bucket = pdf["decision"].where(pdf["decision"].between(0, OTHER_BUCKET - 1) & ~late, OTHER_BUCKET)
        s["replies"] += len(pdf)
        s["rows"] += int(pdf["rows"].sum())
        s["ok"] += of(pdf["ok_rows"], good)
        s["lost"] += of(pdf["rows"] - pdf["ok_rows"], good)
        s["timeout"] += of(pdf["rows"], late)
        s["err"] += of(pdf["rows"], failed)
        s["http_429"] += of(pdf["rows"], failed & (pdf["status_code"] == 429))
        s["http_5xx"] += of(pdf["rows"], failed & (pdf["status_code"] >= 500))
        s["used_l2"] += of(pdf["rows"], ~late & pdf["used_l2"].astype(bool))
        for b, name in enumerate(BUCKETS):
            s[name] += of(pdf["rows"], bucket == b)
        s["expected"] = max(s["expected"], int(pdf["expected"].max()))
        issued = int(pdf["issued_us"].min())
        s["issued"] = min(s["issued"], issued) if s["issued"] else issued
        s["done"] = max(s["done"], int(pdf["done_us"].max()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, seen = self._load(), False
        if s["timer"] and not s["closed"] and timerValues.getCurrentWatermarkInMs() >= s["timer"]:
            # Rows come before timers: the deadline was over when these arrived.
            yield from self._expire(key, s, s["timer"])
        for pdf in rows:
            # Heartbeats have no batch; replies to a closed batch are only waited out.
            if key[0] == NO_BATCH or s["closed"]:
                continue
            self._add(s, pdf)
            seen = True
        if not seen:
            return
        if s["expected"] and s["replies"] >= s["expected"]:
            s["closed"] = 1
            self._keep(s, s["done"] // 1000 + self.linger_ms)
            yield self._row(key, s, "complete", s["done"])
        else:
            self._keep(s, s["issued"] // 1000 + self.deadline_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        s, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if s["closed"]:
            if now >= s["timer"]:
                self.state.clear()
            return
        yield from self._expire(key, s | {"timer": 0}, now)

    def _expire(self, key, s: dict[str, int], now: int) -> Iterator[pd.DataFrame]:
        s["closed"] = 1
        self._keep(s, now + self.linger_ms)
        if not self.only_complete:
            yield self._row(key, s, "deadline", now * 1000)

    def _row(self, key, s: dict, closed: str, at_us: int) -> pd.DataFrame:
        out = {"batch_id": [key[0]], **{f: [s[f]] for f in BATCH_COUNTS}, "latency_us": [s["done"] - s["issued"]]}
        return pd.DataFrame(out | {"closed": [closed], "closed_at": pd.to_datetime([at_us], unit="us", utc=True)})

    def close(self) -> None:
        pass


def stream_batch_completion(
    sdf: DataFrame, watermark: str, deadline_ms: int, linger_ms: int | None = None, ts: str = "done_at", chained: bool = False
) -> DataFrame:
    """Closes batches of replies: ``batch_id``, BATCH_COUNTS, ``latency_us, closed, closed_at``.

    Columns: ``batch_id, done_at, rows, ok_rows, status_code, timeout, used_l2, decision, expected,
    issued_us, done_us``. Needs the RocksDB state store. ``closed`` is ``complete`` at the last reply or
    ``deadline`` that long after the issue. ``chained``: only complete batches, with ``closed_at`` as
    the event time of further operators.
    """
    closer = BatchCloser(deadline_ms, deadline_ms if linger_ms is None else linger_ms, chained)
    more = {"eventTimeColumnName": "closed_at"} if chained else {}
    # Groups with missing keys or values change the types of those that share their Arrow batch.
    full = {c: F.coalesce(F.col(c), F.lit(v).cast(dict(sdf.dtypes)[c])) for c, v in REPLY_DEFAULTS.items()}
    rows = sdf.withColumns(full).withWatermark(ts, watermark).groupBy("batch_id")
    return rows.transformWithStateInPandas(closer, outputStructType=BATCH_OUTPUT, outputMode="append", timeMode="EventTime", **more)


BUDGET_OUTPUT = "second bigint, slice int, event_id bigint, t_us bigint, t_sched timestamp"


class SecondBudget(StatefulProcessor):
    """Admits the first ``limit`` triggers of a group; the state is one counter.

    Of each trigger's rows only the earliest ``limit`` are held while its chunks pass by.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.used.exists()
        used = self.used.get()[0] if had else 0
        left = self.limit - used
        first = None
        for pdf in rows:
            if left > 0:
                both = pdf if first is None else pd.concat([first, pdf])
                first = both.sort_values(["t_us", "event_id"]).head(left)
        self.used.update((used + (0 if first is None else len(first)),))
        if not had:
            self.handle.registerTimer((int(key[0]) + 1) * 1000)
        if first is not None:
            yield first[["second", "slice", "event_id", "t_us", "t_sched"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_budget(sdf: DataFrame, per_second: int, watermark: str, ts: str = "t_sched") -> DataFrame:
    """First triggers of each second in arrival order; ``per_second = 0`` admits all.

    A busy second is first cut down in slices, each to at most ``per_second`` rows, so that the
    task deciding the second only sees the few rows the slices let through.
    """
    rows = sdf.withColumn("t_us", F.unix_micros(F.col(ts)))
    rows = rows.withColumn("second", F.floor(F.col("t_us") / 1_000_000).cast("bigint"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int"))
    rows = rows.select("second", "slice", "event_id", "t_us", F.col(ts).alias("t_sched"))
    if per_second == 0:
        return rows.drop("slice", "t_sched")
    rows = rows.withWatermark("t_sched", watermark)
    for keys in (["second", "slice"], ["second"]):
        rows = rows.groupBy(*keys).transformWithStateInPandas(
            SecondBudget(per_second),
            outputStructType=BUDGET_OUTPUT,
            outputMode="append",
            timeMode="EventTime",
            eventTimeColumnName="t_sched",
        )
    return rows.select("second", "event_id", "t_us")


def run_to_table(sdf: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all available input and return what it wrote to the shared folder.

    Append output lands in a file sink. Complete output replaces one folder per trigger, so only
    the last one is read back.
    """
    spark = sdf.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = sdf.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
        query.awaitTermination()
        return spark.read.schema(sdf.schema).parquet(out)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id:08d}")
        last["id"] = batch_id

    last = {"id": -1}
    writer.outputMode(mode).foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{out}/{last['id']:08d}")


def run_updates(sdf: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an update-mode stream over all available input; the newest row of every key.

    Each trigger appends one folder named after its id, so a trigger that is run again replaces what
    it wrote before and nothing else; earlier folders are never rewritten.
    """
    spark = sdf.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    updates(sdf, out, state).awaitTermination()
    return newest(spark, out, keys, sdf.schema)


def updates(sdf: DataFrame, out: str, state: str) -> StreamingQuery:
    """Start an update-mode stream whose sink is keyed by trigger."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = sdf.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    return writer.outputMode("update").foreachBatch(put).start()


def newest(spark: SparkSession, out: str, keys: list[str], schema) -> DataFrame:
    """The row of the latest trigger of every key."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(out)
    values = [f.name for f in schema.fields if f.name not in keys]
    last = F.max_by(F.struct(*values), "batch").alias("_v")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as later than the watermark, summed over the recorded progress."""
    total = 0
    for p in query.recentProgress:
        for op in p["stateOperators"]:
            total += int(op.get("numRowsDroppedByWatermark", 0))
    return total


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
