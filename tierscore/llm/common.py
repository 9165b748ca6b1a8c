"""Helpers shared by the corpus operators: tables, hashing of words, Arrow batches in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of byte words, remembered; forgets everything beyond ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def ascii_words(text: str) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    with np.errstate(over="ignore"):
        acc = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
        for k in range(width):
            acc = acc * MIX + hashes[k : len(hashes) - width + 1 + k]
        if width < size:
            acc = acc + np.uint64(width)
    return np.unique(mix(acc))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a run of equal keys; input sorted by ``keys``.

    Only the run at the end is carried over, so memory is bounded by the longest run.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(t.num_rows, dtype=bool)
        for k in keys:
            c = t.column(k).to_numpy(zero_copy_only=False)
            same &= c == c[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
        count = t.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, with the row count appended."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()]
    by_name = dict(zip(columns, arrays, strict=True))
    return pa.RecordBatch.from_arrays([by_name[n] for n in schema.names], schema=schema)
