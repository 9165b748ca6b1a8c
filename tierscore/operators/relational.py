"""Second implementation of the scorers, in joins and array expressions only.

``score_by_masks`` never ships more than MAX_BLOCKS blocks of trees and nothing through the driver, so it
also serves models beyond the size limit of the Arrow scorers. ``route_by_fold`` and ``prefix_by_fold`` work row by row on
the array of leaf values and define what the Arrow scorers must return.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscore.functions.bins import let
from tierscore.operators.skew import is_small
from tierscore.operators.trees import split_masks
from tierscore.session import materialise

MAX_BLOCKS = 200  # that are sent to every task, about 50 MB; more meet the rows partition by partition
BLOCK_TREES = 64  # trees of one model that a row meets at once


def tree_blocks(nodes: DataFrame) -> DataFrame:
    """``model, block, trees``: up to BLOCK_TREES trees in a row, each with its splits and leaves as leaf sets.

    Missing splits are an empty list: all leaves of such a tree stay possible.
    """
    splits, leaves = split_masks(nodes)
    met = splits.groupBy("model", "tree_id").agg(
        F.collect_list(F.struct("fidx", F.col("thr"), "missing_left", "if_left", "if_right")).alias("splits")
    )
    ends = leaves.groupBy("model", "tree_id").agg(F.collect_list(F.struct("mask", F.col("leaf").cast("double").alias("leaf"))).alias("leaves"))
    trees = ends.join(met, ["model", "tree_id"], "left")
    place = F.dense_rank().over(Window.partitionBy("model").orderBy("tree_id")) - 1
    trees = trees.withColumn("block", F.floor(place / BLOCK_TREES).cast("int"))
    tree = F.struct("tree_id", F.coalesce("splits", F.array().cast(dict(met.dtypes)["splits"])).alias("splits"), "leaves")
    return materialise(trees.groupBy("model", "block").agg(F.array_sort(F.collect_list(tree)).alias("trees")), "trees")


def interval_by_masks(
    df: DataFrame, nodes: DataFrame, id_col: str = "txn_id", observed: Sequence[int] | None = None
) -> DataFrame:
    """Lower and upper score per row and model from the candidate leaf sets.

    A row meets the trees of a model block by block: in each tree the known features intersect the leaf
    sets that their splits keep, and the least and largest leaf that is left count. Models of one block
    need no shuffle; of larger ones the two sums of each block are added up.
    """
    blocks = tree_blocks(nodes)
    known = lambda i: F.lit(True) if observed is None else i.isin([int(v) for v in observed])

    def keeps(s: Column) -> Column:
        x = F.get(F.col("features"), s["fidx"])
        left = F.when(x.isNull() | F.isnan(x), s["missing_left"]).otherwise(x < s["thr"])
        inside = known(s["fidx"]) & (s["fidx"] < F.size("features"))
        return F.when(inside, F.when(left, s["if_left"]).otherwise(s["if_right"])).otherwise(F.lit(-1).cast("bigint"))

    def ends(t: Column) -> Column:
        mask = F.aggregate(t["splits"], F.lit(-1).cast("bigint"), lambda m, s: m.bitwiseAND(keeps(s)))
        left = let(mask, lambda m: F.transform(F.filter(t["leaves"], lambda v: v["mask"].bitwiseAND(m) != 0), lambda v: v["leaf"]))
        return let(left, lambda v: F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")))

    rows = df.where(F.col("features").isNotNull()).select(id_col, "features")
    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    add = lambda a, e: F.struct((a["lo"] + e["lo"]).alias("lo"), (a["hi"] + e["hi"]).alias("hi"))
    few = is_small(blocks, MAX_BLOCKS)
    met = rows.crossJoin(F.broadcast(blocks) if few else blocks)
    part = met.withColumn("e", F.aggregate(F.transform("trees", ends), zero, add))
    if blocks.where("block > 0").isEmpty():
        return part.select(id_col, "model", F.col("e.lo").alias("lower"), F.col("e.hi").alias("upper"))
    # Equal rows are added up together and told apart again: a row gives a row, however many blocks there are.
    total = part.groupBy(id_col, "features", "model").agg(
        F.sum("e.lo").alias("lo"), F.sum("e.hi").alias("hi"), F.count_if(F.col("block") == 0).cast("int").alias("n")
    )
    total = total.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    return total.select(id_col, "model", (F.col("lo") / F.col("n")).alias("lower"), (F.col("hi") / F.col("n")).alias("upper"))


def score_by_masks(df: DataFrame, nodes: DataFrame, id_col: str = "txn_id") -> DataFrame:
    """Exact score per row and model: with every feature known one leaf per tree is left."""
    ends = interval_by_masks(df, nodes, id_col)
    return ends.select(id_col, "model", F.col("lower").cast("float").alias("score"))


def prefix_by_fold(leaves: Column, checkpoints: Sequence[int], base: float = 0.0) -> Column:
    """Running float score at each checkpoint from the array of leaf values."""
    start = F.lit(base).cast("float")
    return F.array(
        *[F.aggregate(F.slice(leaves, 1, int(c)), start, lambda a, v: a + v) for c in checkpoints]
    )


def route_by_fold(
    leaves: Column,
    threshold: Column,
    suffix_min: Sequence[float],
    suffix_max: Sequence[float],
    eps: float = 0.0,
    guard: float = 0.0,
    every: int = 1,
    base: float = 0.0,
) -> Column:
    """The bound-based early exit as one fold over the leaf values: score, pass, visited."""
    n = len(suffix_min) - 1
    thr = threshold.cast("float")
    cut_hi = (thr + F.lit(eps).cast("float") + F.lit(guard).cast("float")).cast("double")
    cut_lo = (thr - F.lit(eps).cast("float") - F.lit(guard).cast("float")).cast("double")
    lo = F.array(*[F.lit(float(v)) for v in suffix_min])
    hi = F.array(*[F.lit(float(v)) for v in suffix_max])
    state = F.struct(
        F.lit(base).cast("float").alias("score"),
        F.lit(None).cast("boolean").alias("pass"),
        F.lit(0).alias("visited"),
    )

    def step(s: Column, leaf: Column) -> Column:
        end = s["visited"] + 1
        score = s["score"] + leaf
        check = (F.pmod(end, F.lit(every)) == 0) | (end == n)
        sure = (
            F.when(check & (score.cast("double") + F.get(lo, end) >= cut_hi), F.lit(True))
            .when(check & (score.cast("double") + F.get(hi, end) < cut_lo), F.lit(False))
        )
        moved = F.struct(score.alias("score"), sure.alias("pass"), end.alias("visited"))
        return F.when(s["pass"].isNull(), moved).otherwise(s)

    def close(s: Column) -> Column:
        return F.struct(
            s["score"].alias("score"),
            F.coalesce(s["pass"], s["score"] >= thr).alias("pass"),
            s["visited"].alias("visited"),
        )

    return F.aggregate(leaves, state, step, close)
