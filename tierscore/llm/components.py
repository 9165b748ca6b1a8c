"""Connected components of a link table by alternating large and small stars.

Tasks first contract the links they hold, in blocks of bounded size; a table that is no larger than one
block is done with that. Else every round points nodes at the smallest neighbour they know; the rounds
needed grow with the logarithm of the longest chain. Null links and links of a node to itself say nothing,
repeated ones no more than one.
Links stay in tables: a hub is one key of a join whose side has one row per node, and minima are taken
before rows move.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscore.session import materialise


def _contract(block: int, loops: bool):
    """Links of a block to links that point each node, with ``loops`` the smallest too, at the smallest of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def flush() -> pa.RecordBatch:
            rows = [(x, root(x)) for x in list(parent)]
            rows = [r for r in rows if loops or r[0] != r[1]]
            parent.clear()
            names = ["node", "component"] if loops else ["a", "b"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=names)

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > block:
                yield flush()
        yield flush()

    return run


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    pointed = links.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return pointed.unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, block: int = 200_000) -> DataFrame:
    """``node, component`` of every node of ``a, b`` links; the component is its smallest node."""
    down = links.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b"))
    down = down.where("a > b")
    if links.count() <= block // 2:  # with at most ``block`` nodes: one task, nothing to merge
        return down.coalesce(1).mapInArrow(_contract(block, True), "node bigint, component bigint")
    current = materialise(down.mapInArrow(_contract(block, False), "a bigint, b bigint").distinct(), "links")
    before = None
    while True:
        sign = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            break
        before = sign
        current = materialise(_small_star(_large_star(current)), "links")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
