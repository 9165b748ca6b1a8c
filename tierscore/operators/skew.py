"""Joins and ordered computations that hold up when one key carries a third of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 16
CHUNK = 1 << 20


def inline_table(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """A small literal table that stays inside the JVM (no pickled rows)."""
    if not rows:
        return spark.createDataFrame([], schema)
    columns = [part.strip().split(None, 1) for part in schema.split(",")]

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(literal(x) for x in v) + ")"
        if isinstance(v, float):
            return f"{v!r}D"
        return str(v)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in columns)
    casts = [f"CAST({name} AS {kind}) AS {name}" for name, kind in columns]
    return spark.sql(f"SELECT {', '.join(casts)} FROM VALUES {values} AS t({names})")


def is_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``side`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return side.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    left: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join to a lookup table: broadcast if its checked size allows, else a salted shuffle join.

    The salted form spreads each key of ``left`` over ``SALTS`` tasks and copies ``side`` that
    many times, so a hot key never meets one task.
    """
    if is_small(side, max_rows):
        return left.join(F.broadcast(side), list(on), how)
    return salted_join(left, side, on, how)


def last_per_key(side: DataFrame, on: Sequence[str], values: Sequence[str], order: str = "ord") -> DataFrame:
    """One row per key of a side table: the last one wins.

    Rows have no order of their own: the last is the one with the largest ``order`` where the table
    has that column, and of equal ones (or without it) the one with the largest values. Rows of a key
    are combined before they move, so a key with many rows meets no single task.
    """
    rank = [F.col(order)] if order in side.columns else []
    best = F.max(F.struct(*[r.alias("_order") for r in rank], *values)).alias("_last")
    return side.groupBy(*on).agg(best).select(*on, *[F.col(f"_last.{v}").alias(v) for v in values])


def salted_join(
    left: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    if how not in ("left", "inner", "left_anti", "left_semi"):
        raise ValueError(f"salted_join keeps the left side only: {how}")
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *_hashable(left)), F.lit(salts))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("_salt", spread.cast("int"))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[Column]:
    """Flat columns of a row: they and the partition give equal rows the same slice on a retry."""
    flat = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct")]
    return [F.col(f"`{c}`") for c in flat]


def chunked_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    sums: dict[str, str],
    chunk: int = CHUNK,
    reverse: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums along an integer ``position`` without one task holding a whole group.

    A group is cut into position ranges of ``chunk``; the totals of the ranges give each range
    its offset, and only rows of one range are windowed together. ``sums`` maps output to input
    column. Positions are distinct within a group, so a range has at most ``chunk`` rows.
    """
    keyed = df.withColumn("_chunk", F.floor(F.col(position) / F.lit(chunk)).cast("bigint"))
    order = F.col("_chunk").desc() if reverse else F.col("_chunk")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    offsets = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
    )
    pos = F.col(position).desc() if reverse else F.col(position)
    end = Window.currentRow if inclusive else -1
    within = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, end)
    joined = keyed.join(offsets, [*keys, "_chunk"], "inner")
    for out, src in sums.items():
        running = F.coalesce(F.sum(src).over(within), F.lit(0)) + F.col(f"_o_{out}")
        joined = joined.withColumn(out, running)
    return joined.drop("_chunk", *[f"_o_{o}" for o in sums])


def dense_index(df: DataFrame, order_id: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """0-based dense row index in order of a distinct integer id, counted range by range."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return chunked_running_sum(ones, keys, order_id, {out: "_one"}, inclusive=False).drop("_one")


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    width: int = CHUNK,
    weight: str | None = None,
) -> DataFrame:
    """Exact values at given 0-based ranks per group, for an integer-valued column.

    Equal values are counted first (combined before the shuffle). Bins of ``width`` values are
    summed, the bin holding a rank is found from those sums, and only the distinct values of
    that bin are ordered, so no task sees more than ``width`` values of one group. ``weight`` is the
    number of rows that a row stands for.
    """
    times = F.sum(weight) if weight else F.count("*")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(times.alias("_n"))
    counted = counted.withColumn("_bin", F.floor(F.col("_v") / F.lit(width)).cast("bigint"))
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    bins = bins.withColumn("_total", F.sum("_bn").over(whole))
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("name"), fn(F.col("_total")).cast("bigint").alias("rank"))
                for name, fn in ranks.items()
            ]
        )
    )
    hit = bins.withColumn("_w", wanted).where(
        (F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_bn"))
    )
    targets = hit.groupBy(*keys, "_bin", "_before").agg(F.collect_list("_w").alias("_wanted"))
    inside = counted.join(targets, [*keys, "_bin"], "inner")
    w = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_lo", F.col("_before") + F.coalesce(F.sum("_n").over(w), F.lit(0)))

    def pick(name: str) -> Column:
        def holds(t: Column) -> Column:
            at = (t["rank"] >= F.col("_lo")) & (t["rank"] < F.col("_lo") + F.col("_n"))
            return (t["name"] == name) & at

        return F.max(F.when(F.exists("_wanted", holds), F.col("_v"))).alias(name)

    return inside.groupBy(*keys).agg(*[pick(name) for name in ranks])


def bounded_order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    counts: dict[str, str] | None = None,
) -> DataFrame:
    """Like :func:`order_statistics` for a column with a fixed, small set of possible values.

    After counting equal values a group has at most that many rows, so one window suffices. Rows with
    a NULL value have no rank; ``counts`` maps outputs to boolean columns counted over all rows.
    """
    extra = {out: F.count_if(F.col(c)).alias(f"_c_{out}") for out, c in (counts or {}).items()}
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(value).alias("_n"), *extra.values())
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select(
        "*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lo"), F.sum("_n").over(whole).alias("_total")
    )

    def pick(name: str, fn: Callable[[Column], Column]) -> Column:
        rank = fn(F.col("_total")).cast("bigint")
        here = (rank >= F.col("_lo")) & (rank < F.col("_lo") + F.col("_n"))
        return F.max(F.when(here, F.col("_v"))).alias(name)

    totals = [F.sum(f"_c_{out}").alias(out) for out in extra]
    found = placed.groupBy(*keys).agg(*[pick(name, fn) for name, fn in ranks.items()], *totals)
    return found if extra else found.where(F.coalesce(*[F.col(n) for n in ranks]).isNotNull())


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; a hot group is cut down per slice before it is merged."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS))
    sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
    merged = Window.partitionBy(*keys).orderBy(*order)
    part = df.withColumn("_slice", salt).withColumn("_r", F.row_number().over(sliced))
    part = part.where(F.col("_r") <= n).withColumn("_r", F.row_number().over(merged))
    return part.where(F.col("_r") <= n).drop("_slice", "_r")
