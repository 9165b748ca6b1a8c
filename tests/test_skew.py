"""Helpers against plain Python, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tierscore.operators import requests as R
from tierscore.operators import stats as A
from tierscore.operators.sampling import spaced_sample
from tierscore.operators.skew import (
    bounded_order_statistics,
    chunked_running_sum,
    dense_index,
    lookup_join,
    order_statistics,
    salted_join,
    top_n_per_group,
)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    return [(i * 3, "hot" if rng.random() < 0.34 else f"k{rng.randrange(9)}", rng.randrange(500)) for i in range(3000)]


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "id bigint, k string, v bigint").repartition(5)


def groups(data):
    out = {}
    for i, k, v in data:
        out.setdefault(k, []).append((i, v))
    return out


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_sum(df, data, reverse, inclusive):
    got = {r.id: r.s for r in chunked_running_sum(df, ["k"], "id", {"s": "v"}, 100, reverse, inclusive).collect()}
    for rows in groups(data).values():
        total = 0
        for i, v in sorted(rows, reverse=reverse):
            assert got[i] == total + (v if inclusive else 0)
            total += v


def test_dense_index(df, data):
    got = sorted((r.id, r.i) for r in dense_index(df, "id", "i").collect())
    assert [i for _, i in got] == list(range(len(data)))


@pytest.mark.parametrize("fn", [order_statistics, bounded_order_statistics])
def test_order_statistics(df, data, fn):
    out = fn(df, ["k"], "v", {"lo": A.nearest_rank(0.0), "mid": A.nearest_rank(0.5), "top": A.reached_rank(0.99)})
    for r in out.collect():
        vals = sorted(v for _, v in groups(data)[r.k])
        n = len(vals)
        assert r.lo == vals[0] and r.mid == vals[int((n - 1) * 0.5 + 0.5)] and r.top == vals[max(-(-n * 99 // 100) - 1, 0)]


def test_narrow_bins_change_nothing(df):
    ranks = {"p": A.nearest_rank(0.9)}
    wide = order_statistics(df, ["k"], "v", ranks)
    assert wide.exceptAll(order_statistics(df, ["k"], "v", ranks, width=7)).count() == 0


def test_percentile_definitions_differ(spark):
    four = spark.range(1, 5)
    assert order_statistics(four, [], "id", {"p": A.nearest_rank(0.5)}).first().p == 3
    assert order_statistics(four, [], "id", {"p": A.reached_rank(0.5)}).first().p == 2


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_salted_join_is_a_join(spark, df, how):
    side = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, w int")
    want = df.join(side, "k", how)
    assert salted_join(df, side, ["k"], how).exceptAll(want).count() == 0
    assert lookup_join(df, side, ["k"], how, max_rows=1).count() == want.count()


def test_large_side_is_not_broadcast(spark, df):
    side = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, w int")
    plan = lookup_join(df, side, ["k"], max_rows=1)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plan.lower()
    assert "broadcast" in lookup_join(df, side, ["k"])._jdf.queryExecution().logical().toString().lower()


def test_top_n(df, data):
    got = {}
    for r in top_n_per_group(df, ["k"], [F.col("v"), F.col("id")], 4).collect():
        got.setdefault(r.k, []).append((r.v, r.id))
    for k, rows in groups(data).items():
        assert sorted(got[k]) == sorted((v, i) for i, v in rows)[:4]


@pytest.mark.parametrize("n", [7, 256, 5000])
def test_spaced_sample(df, data, n):
    ids = [i for i, _, _ in data]
    take = min(n, len(ids))
    want = {ids[s * len(ids) // take] for s in range(take)}
    assert {r.id for r in spaced_sample(df.select("id"), "id", n).collect()} == want


def test_rate_budget_and_activity(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), rng.randrange(900_000_000)) for i in range(2000)]
    log = spark.createDataFrame(rows, "event_id bigint, u int, us bigint").withColumn("t_sched", F.timestamp_micros("us"))
    got = {r.event_id for r in R.rate_budget(log, 2).collect()}
    by_second = {}
    for i, _, us in rows:
        by_second.setdefault(us // 1_000_000, []).append((us, i))
    assert got == {i for v in by_second.values() for _, i in sorted(v)[:2]}
    assert R.rate_budget(log, 0).count() == 2000
    for r in R.activity_windows(log, "u", "event_id").collect():
        near = [i for i, u, us in rows if u == r.u and r.second - 59 <= us // 1_000_000 <= r.second]
        assert (r.n_60s, r.v_60s) == (len(near), sum(near))


def test_recorded_latency(spark):
    vals = [0, 1, 2047, 2048, 2049, 4095, 4096, 4099, 1_000_000, 60_000_000, 60_000_001]
    rows = spark.createDataFrame([(v,) for v in vals], "v bigint").select("v", R.recorded_latency(F.col("v")).alias("r"))
    for r in rows.collect():
        v = max(r.v, 1)
        width = 1 << max(v.bit_length() - 11, 0)
        assert r.r == (None if r.v > 60_000_000 else v - v % width + width - 1)


def test_verdicts(spark):
    base = "SELECT 100L AS attempted, 0L AS drop_conn_queue_full, 0L AS dropped_after_attempt, 0L AS drop_inflight_cap, {t} AS timeout, 0L AS http_429, 0L AS http_5xx, {a} AS attempted_rps, 100.0 AS offered_rps, {q} AS queue_p99"
    one = lambda t, a, q: R.verdict(spark.sql(base.format(t=t, a=a, q=q)), 100.0).first()
    assert one("0L", "100.0", "10L").verdict == "Pass"
    assert one("3L", "100.0", "10L").verdict == "ServerLimited"
    r = one("3L", "97.9", "6000L")
    assert r.verdict == "ClientLimited" and r.client_reasons == ["attempted_rps=97.9 (<98% target)", "queue_delay_p99=6000us"]
