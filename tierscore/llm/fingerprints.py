"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

A sketch is ``kept`` (sorted hashes) and ``bound``: it holds every shingle hash of its text below the
bound. The bound is ``1 / scale`` of the hash range; a text with fewer than ``least`` hashes there
keeps its ``least`` smallest, and its bound rises to the first one left out, so short texts have a
fingerprint too. Two sketches are compared below the smaller bound, which estimates likeness and
containment even between very unequal texts, and the union of sketches below that bound is the
sketch of the united texts.

Everything here is built-in column functions. The next document of each row is found in ranges of
ids: a row that starts a range is also sent to the end of the range before it, so no task orders more
than one range.

Null texts count as empty; texts without words have the empty sketch, which equals itself and nothing
else; null ids come first; rows with the same id are ordered by text; a single row follows itself; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscore.llm.common import whole_text

LOWEST, HIGHEST = -(2**63), 2**63 - 1
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def add_sketch(df: DataFrame, text: str, name: str, shingle: int = 5, scale: int = 16, least: int = 32) -> DataFrame:
    """Adds ``<name>_kept`` and ``<name>_bound`` of a text column, in steps that are each computed once."""
    words, hashes, low, full = (f"__{name}_{s}" for s in ("words", "hashes", "low", "full"))
    bound = LOWEST + 2**64 // scale
    empty = F.array().cast("array<bigint>")

    def shingle_hash(at: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(words), at + k) for k in range(shingle)])

    last = F.greatest(F.lit(0), F.size(words) - shingle)
    df = df.withColumn(words, F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r")), SPACE))
    df = df.withColumn(
        hashes,
        F.when(F.element_at(words, 1) == "", empty).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(0), last), shingle_hash))
        ),
    )
    df = df.withColumn(low, F.filter(hashes, lambda h: h < bound))
    df = df.withColumn(full, F.when(F.size(low) < least, F.sort_array(hashes)).otherwise(F.sort_array(low)))
    enough = F.size(low) >= least
    kept = F.when(enough, F.col(full)).otherwise(F.slice(full, 1, least))
    limit = F.when(enough, F.lit(bound)).otherwise(F.coalesce(F.get(full, F.lit(least)), F.lit(HIGHEST)))
    return df.withColumns({f"{name}_kept": kept, f"{name}_bound": limit}).drop(words, hashes, low, full)


def _below(kept: Column, bound: Column) -> Column:
    return F.filter(kept, lambda h: h < bound)


def _shared(a: str, b: str) -> tuple[Column, Column, Column]:
    bound = F.least(F.col(f"{a}_bound"), F.col(f"{b}_bound"))
    x, y = _below(F.col(f"{a}_kept"), bound), _below(F.col(f"{b}_kept"), bound)
    return x, y, F.size(F.array_intersect(x, y))


def likeness(a: str, b: str) -> Column:
    """Estimated shared part of the union of two sketches; 1 for two empty ones."""
    x, y, both = _shared(a, b)
    union = F.size(x) + F.size(y) - both
    same = F.col(f"{a}_kept") == F.col(f"{b}_kept")
    return F.when(same, F.lit(1.0)).when(union > 0, both / union).otherwise(F.lit(0.0))


def containment(a: str, b: str) -> Column:
    """Estimated part of ``a`` that ``b`` holds; 1 if ``a`` is empty, null if nothing of it can be compared."""
    x, _, both = _shared(a, b)
    return F.when(F.size(F.col(f"{a}_kept")) == 0, F.lit(1.0)).when(F.size(x) > 0, both / F.size(x))


def merged(a: str, b: str) -> tuple[Column, Column]:
    """``kept`` and ``bound`` of the union of two texts' shingles."""
    bound = F.least(F.col(f"{a}_bound"), F.col(f"{b}_bound"))
    kept = F.array_union(_below(F.col(f"{a}_kept"), bound), _below(F.col(f"{b}_kept"), bound))
    return F.sort_array(kept), bound


def as_string(name: str) -> Column:
    """The bound and the hashes in hexadecimal."""
    digits = F.transform(F.col(f"{name}_kept"), lambda h: F.lpad(F.hex(h), 16, "0"))
    return F.concat_ws(":", F.lpad(F.hex(F.col(f"{name}_bound")), 16, "0"), F.concat_ws("", digits))


def _id_ranges(ids: DataFrame, rows_per_range: int, max_ranges: int) -> list[int]:
    """Ascending range borders from a quantile sketch; at most ``max_ranges`` numbers reach the driver."""
    ranges = int(min(max_ranges, max(1, ids.count() // rows_per_range)))
    if ranges == 1:
        return []
    shares = F.split(F.lit(",".join(repr(k / ranges) for k in range(1, ranges))), ",").cast("array<double>")
    found = ids.agg(F.percentile_approx("place", shares, F.lit(20 * ranges))).first()[0]
    return sorted(set(found or []))


def _range_of(place: Column, borders: list[int], width: int = 128) -> Column:
    """Number of borders at or below ``place``, looked up in two short steps."""
    if not borders:
        return F.lit(0)
    groups = [borders[k : k + width] for k in range(0, len(borders), width)]

    def numbers(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    heads = numbers([g[0] for g in groups])
    group = F.size(F.filter(heads, lambda b: b <= place))
    lists = F.transform(
        F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";"), lambda g: F.split(g, ",").cast("array<bigint>")
    )
    inner = F.size(F.filter(F.get(lists, group - 1), lambda b: b <= place))
    return F.when(group > 0, (group - 1) * width + inner).otherwise(F.lit(0))


def with_next(docs: DataFrame, columns: list[str], rows_per_range: int = 1000, max_ranges: int = 16_384) -> DataFrame:
    """Adds ``next_<column>`` from the row with the next ``doc_id``; after the last comes the first."""
    df = docs.withColumn("place", F.coalesce("doc_id", F.lit(LOWEST)))
    borders = _id_ranges(docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("place")), rows_per_range, max_ranges)
    df = df.withColumn("range", _range_of(F.col("place"), borders))
    ids = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("place"))
    firsts = ids.withColumn("range", _range_of(F.col("place"), borders)).groupBy("range").agg(F.min("place").alias("place"))
    order = Window.orderBy("range")
    # One row per range: bounded by ``max_ranges``, so a single task and a broadcast hold them.
    back = firsts.select(
        F.col("place"),
        F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("range_before"),
    )
    df = df.join(F.broadcast(back), "place", "left")
    own = F.array(F.struct(F.lit(False).alias("guest"), F.col("range").alias("in_range")))
    both = F.array_append(own, F.struct(F.lit(True).alias("guest"), F.col("range_before").alias("in_range")))
    df = df.withColumn("seat", F.explode(F.when(F.col("range_before").isNull(), own).otherwise(both)))
    line = Window.partitionBy("seat.in_range").orderBy("seat.guest", "place", "text")
    df = df.withColumns({f"next_{c}": F.lead(c).over(line) for c in columns})
    return df.where("not seat.guest").drop("place", "range", "range_before", "seat")


def edit(docs: DataFrame) -> DataFrame:
    """Adds ``edited``: the last quarter of the text replaced by as much of the next text's start."""
    n, quarter = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    tail = F.substring(F.col("next_text"), F.lit(1), quarter)
    return docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), tail))


def fingerprint(docs: DataFrame, **options) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and what they say of each other."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    rows = with_next(add_sketch(rows, "text", "own", **options), ["text", "own_kept", "own_bound"])
    rows = add_sketch(edit(rows), "edited", "edited", **options)
    return rows.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("own").alias("fingerprint"),
        as_string("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )
