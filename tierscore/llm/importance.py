"""Target-distribution importance resampling with hashed word n-grams.

Documents are weighed by how much likelier their features are under a target collection than under
the corpus itself, and a share of them is drawn without replacement by Gumbel-perturbed weights.

* A 256-byte table lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a
  space; ``bytes.split`` then yields the words of a UTF-8 text.
* Features are all runs of 1 to ``longest`` words. The checksum of a longer one goes on from the
  checksum of the shorter one (``crc32(" " + next, seed)``), so no feature string is built.
* Tasks count buckets in counters and hand on one row per bucket; Spark adds them up. ``buckets``
  bounds the two count tables, which are the only things that reach the driver and go back to tasks.
* Ranks are counted over ranges of scores: the ranges' sizes give each its offset, no task orders all.

Null texts have no features. Rows with a null id are weighed with the id text "" in their draw and
come last among equals; repeated rows count as often as they stand; ties go to the smaller id; an
empty target or corpus counts zero features; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscore.llm.common import batch_of, whole_text
from tierscore.session import materialise

FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Seeds(dict):
    """Checksums to go on from after a word and a space; forgets everything beyond ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        seed = self[word] = zlib.crc32(b" ", zlib.crc32(word))
        return seed


def feature_hashes(words: list[bytes], seeds: Seeds, longest: int) -> Iterator[Iterable[int]]:
    """Checksums of all runs of 1, 2, ... ``longest`` words."""
    current = list(map(zlib.crc32, words))
    yield current
    for length in range(2, longest + 1):
        if length == 2:
            starts = map(seeds.__getitem__, words)
        else:
            starts = (zlib.crc32(b" ", c) for c in current)
        current = list(map(zlib.crc32, words[length - 1 :], starts))
        yield current


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How often each bucket is hit by the features of all texts; ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        folded = np.zeros(buckets, dtype=np.int64)
        seeds = Seeds()

        def fold() -> None:
            hashes = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
            np.add.at(folded, hashes % buckets, np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
            counts.clear()

        for batch in batches:
            for text in batch.column(0):
                for hashes in feature_hashes(words_of(text.as_py()), seeds, longest):
                    counts.update(hashes)
                if len(counts) > 300_000:
                    fold()
        fold()
        hit = np.flatnonzero(folded)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(folded[hit])], names=["bucket", "hits"])

    rows = texts.select(whole_text().alias("text"))
    parts = rows.mapInArrow(run, "bucket bigint, hits bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, hits in parts.groupBy("bucket").agg(F.sum("hits")).collect():
        out[bucket] = hits
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the two smoothed shares of each bucket, rounded down."""
    buckets, size, goal = len(corpus), int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    # The sums are formed as doubles, like every other step.
    ratios = [float(t + 1) * float(size + buckets) / (float(s + 1) * float(goal + buckets)) for s, t in pairs]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the mean gain of a document's features, rounded down."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds()
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                total = number = 0
                for hashes in feature_hashes(words, seeds, longest):
                    at = np.fromiter(hashes, dtype=np.int64, count=len(hashes))
                    total += int(gains[at % buckets].sum())
                    number += len(at)
                n_words.append(len(words))
                n_features.append(number)
                weights.append(total // number if number else 0)
            yield batch_of(WEIGHED, doc_id=batch.column(0), n_words=n_words, n_features=n_features, weight=weights)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def perturbed(seed: int):
    """Thousandths of a Gumbel draw that the seed and the id decide, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    uniform = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform))).cast("bigint")


def with_ranks(rows: DataFrame, order: list, ranges: int | None = None) -> DataFrame:
    """Adds ``rank`` (1, 2, ...) in the given order, range by range."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    # One row per range.
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = dealt.withColumn("__own", within).join(F.broadcast(offsets), "__part")
    return ranked.withColumn("rank", (F.col("__own") + F.col("__before")).cast("bigint")).drop("__part", "__own", "__before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    buckets: int = 10_000,
    longest: int = 2,
    least_words: int = 20,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` of the drawn ones.

    ``percent`` of the documents with at least ``least_words`` words are drawn, the highest scores first.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = weigh(docs, gains, longest).withColumn("score", F.col("weight") + perturbed(seed))
    scored = materialise(scored, "weighed")
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    ranked = with_ranks(enough, [F.desc("score"), F.asc_nulls_last("doc_id")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)
