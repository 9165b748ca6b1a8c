"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows of one group go to one shard, and the shards get nearly the same number of bytes. Every hash
bucket of groups starts from partial partitions (one group against empty sets) and repeatedly
combines the two of largest spread in opposite order; the one partition that is left per bucket is an
item of the next level, where buckets are combined the same way until one is left. A task sees one
bucket, a level passes on ``shards`` sums per bucket, and the driver sees nothing but bucket counts.

Null texts count as empty. Equal texts are one group, told apart by their SHA-256. Null and repeated
ids keep their rows, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscore.llm.common import whole_text
from tierscore.session import materialise

HEAVY_SHARE = 1000


def differencing(parts: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combines partitions given by their sums, all of one width.

    Returns the sums of the result and, for every input partition and subset, the subset of the
    result it ended in.
    """
    width = len(parts[0])
    heap, kids = [], []
    for i, sums in enumerate(parts):
        order = sorted(range(width), key=lambda k: -sums[k])
        ordered = [sums[k] for k in order]
        kids.append(order)
        heap.append((ordered[-1] - ordered[0], i, ordered))
    heapq.heapify(heap)
    merged: list[tuple[int, int, list[tuple[int, int]]]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        pairs = sorted(((x[k] + y[width - 1 - k], k) for k in range(width)), reverse=True)
        floor = pairs[-1][0]
        merged.append((a, b, [(k, width - 1 - k) for _, k in pairs]))
        # Only differences matter for the next choice; the true sums are added up at the end.
        heapq.heappush(heap, (floor - pairs[0][0], len(parts) + len(merged) - 1, [s - floor for s, _ in pairs]))
    final: dict[int, list[int]] = {heap[0][1]: list(range(width))}
    for at in range(len(merged) - 1, -1, -1):
        a, b, pairs = merged[at]
        to = final.pop(len(parts) + at)
        left, right = [0] * width, [0] * width
        for place, (i, j) in enumerate(pairs):
            left[i] = right[j] = to[place]
        final[a], final[b] = left, right
    ends, totals = [], [0] * width
    for i, sums in enumerate(parts):
        end = [0] * width
        for place, k in enumerate(kids[i]):
            end[k] = final[i][place]
        for k in range(width):
            totals[end[k]] += sums[k]
        ends.append(end)
    return totals, ends


def _pack_bucket(shards: int):
    """All groups of a bucket, as partitions of one group each, to their subset of the bucket."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "grp"], ascending=[False, True])
        parts = [[n] + [0] * (shards - 1) for n in rows["bytes"].tolist()]
        _, ends = differencing(parts)
        return pd.DataFrame({"bucket": rows["bucket"], "grp": rows["grp"], "bytes": rows["bytes"], "sub": [e[0] for e in ends]})

    return run


def _pack_level(shards: int):
    """All buckets under one parent to the parent's subsets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "sub"])
        names = rows["bucket"].drop_duplicates().tolist()
        sums = dict(zip(zip(rows["bucket"], rows["sub"], strict=True), rows["bytes"].tolist(), strict=True))
        totals, ends = differencing([[sums.get((b, k), 0) for k in range(shards)] for b in names])
        out = [(b, k, end[k]) for b, end in zip(names, ends, strict=True) for k in range(shards)]
        frame = pd.DataFrame(out, columns=["bucket", "sub", "to"])
        frame["parent"] = rows["parent"].iloc[0]
        frame["bytes"] = [sums.get((b, k), 0) for b, k, _ in out]
        return frame

    return run


def assign_groups(groups: DataFrame, shards: int, per_bucket: int = 4096, fan_in: int = 64) -> DataFrame:
    """``grp, bytes`` to ``grp, shard``. ``per_bucket``: groups a task combines, on average."""
    count = max(1, -(-groups.count() // per_bucket))
    keyed = groups.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(count)))
    packed = materialise(
        keyed.groupBy("bucket").applyInPandas(_pack_bucket(shards), "bucket bigint, grp string, bytes bigint, sub bigint"), "shards"
    )
    owner = packed.select("grp", "bucket", "sub")
    level = packed.groupBy("bucket", "sub").agg(F.sum("bytes").alias("bytes"))
    while count > 1:
        count = -(-count // fan_in)
        level = level.withColumn("parent", F.floor(F.col("bucket") / fan_in).cast("bigint"))
        moved = materialise(
            level.groupBy("parent").applyInPandas(
                _pack_level(shards), "bucket bigint, sub bigint, to bigint, parent bigint, bytes bigint"
            ),
            "shards",
        )
        owner = owner.join(moved.select("bucket", "sub", "to", "parent"), ["bucket", "sub"]).select(
            "grp", F.col("parent").alias("bucket"), F.col("to").alias("sub")
        )
        level = moved.groupBy(F.col("parent").alias("bucket"), F.col("to").alias("sub")).agg(F.sum("bytes").alias("bytes"))
    return owner.select("grp", F.col("sub").cast("int").alias("shard"))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, grp`` of every row; the texts are not needed afterwards."""
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("grp"),
    )


def with_groups(rows: DataFrame, side: DataFrame, total: int) -> DataFrame:
    """Joins ``side`` (``grp, rows, ...``) to ``rows``; groups that hold a large share are broadcast.

    At most HEAVY_SHARE groups can hold a HEAVY_SHARE-th of all rows each, so that side is small
    whatever the data; the join that shuffles only sees groups below that share.
    """
    heavy = side.where(F.col("rows") * HEAVY_SHARE >= total)
    light = side.where(F.col("rows") * HEAVY_SHARE < total)
    marked = rows.join(F.broadcast(heavy.select("grp", F.col("shard").alias("own"))), "grp", "left")
    first = marked.where("own is not null").withColumnRenamed("own", "shard")
    rest = marked.where("own is null").drop("own").join(light.select("grp", "shard"), "grp")
    return first.unionByName(rest)


def slots(rows: DataFrame, total: int, per_block: int = 20_000) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 within each shard.

    Blocks of a shard are hash classes of its rows; only their counts are summed up in order.
    """
    blocks = max(1, total // per_block)
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)))
    counts = keyed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")
    numbered = keyed.withColumn("rank", F.row_number().over(inner))
    return numbered.join(base, ["shard", "block"]).withColumn("slot", F.col("base") + F.col("rank") - 1).drop("base", "rank", "block")


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of every document; equal texts share a shard, bytes are nearly equal."""
    rows = materialise(measure(docs), "shards")
    total = rows.count()
    groups = materialise(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shards")
    side = groups.join(assign_groups(groups.select("grp", "bytes"), shards), "grp").select("grp", "rows", "shard")
    placed = materialise(with_groups(rows, side, total), "shards")
    return slots(placed, total).drop("grp")
