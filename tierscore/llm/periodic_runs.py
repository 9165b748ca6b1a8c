"""Periodic runs of words: maximal stretches that repeat with a smallest period, and texts without them.

A run has smallest period ``q``, at least ``max(least, 2 q)`` words, and no neighbouring word extends
it. Periods are solved by octaves ``[P, 2P)``, each with overlapping tiles of its own scale:

1. Every tile stands around a boundary, ``reach`` words to its left and ``2P + reach`` to its right.
   Boundaries lie so close that every run has one after which a window of ``3P/4`` words comes back one
   period later; hashes of windows say which tiles can hold a run of the octave at all. Short octaves
   are searched at every place instead.
2. Those tiles are solved on their own: a Z-function to the right and one over the reversed tile tell
   for every period how far the words around the boundary agree with the words one period later.
   Stretches with a smaller period are left out by the same numbers.
3. The stretches found are fragments, cut where their tile ends. They are shuffled by document and
   period, and fragments that share at least one period of words are stitched to runs.

Tiles are views inside the task that reads a document: shipping them would copy every word for every
octave. Only fragments are shuffled, and the texts of documents that have any.

Words are split at ASCII white space. Null texts have no words; documents without runs have an empty
list and collapse to their words; repeated rows and null ids give one result per row; an empty table
gives no rows; extra columns are ignored. Hashes only choose tiles, words are compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscore.llm.common import MIX, mix, runs, whole_text
from tierscore.session import materialise

FOUND = "row bigint, doc_id bigint, n_words bigint, fragments array<struct<period:bigint,start:bigint,stop:bigint>>, text string, collapsed string"
FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
DONE = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,period:bigint,length:bigint>>, collapsed string"


def _agree(s: np.ndarray, a: int, b: int) -> int:
    """How many items from ``a`` and from ``b > a`` on are equal, compared in growing pieces."""
    k, n, step = 0, len(s) - b, 16
    while k < n:
        size = min(step, n - k)
        differ = s[a + k : a + k + size] != s[b + k : b + k + size]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k, step = k + size, 2 * step
    return k


def z_function(s: np.ndarray, skipped: tuple[int, int] = (0, 0)) -> np.ndarray:
    """For every place how many items from there on equal the first ones; 0 at place 0.

    Only places that hold the first item are walked; all others have 0. Places in the range ``skipped``
    are not asked for; what a later one may look up must lie before it.
    """
    n = len(s)
    z = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(s[1:] == s[:1]) + 1
    left = right = 0
    for i in at[(at < skipped[0]) | (at >= skipped[1])].tolist():
        known = min(int(z[i - left]), right - i) if i < right else 0
        if i + known >= right:
            if i + known < n:
                known += _agree(s, known, i + known)
            left, right = i, i + known
        z[i] = known
    return z


@lru_cache(maxsize=32)
def _part_periods(octave: int) -> np.ndarray:
    """Row ``q - octave``: ``q`` divided by each of its primes, filled up with 0."""
    top = 2 * octave
    parts = np.zeros((octave, 8), dtype=np.int64)
    used = np.zeros(octave, dtype=np.int64)
    composite = np.zeros(top + 1, dtype=bool)
    for r in range(2, top):
        if composite[r]:
            continue
        composite[r * r :: r] = True
        q = np.arange(-(-octave // r) * r, top, r)
        parts[q - octave, used[q - octave]] = q // r
        used[q - octave] += 1
    return parts[:, : max(1, int(used.max()))]


BASE = 0x9E3779B97F4A7C15 | 1
FINE = 16  # octaves below are searched at every place, the others at boundaries
SHORTEST_REACH = 256  # so that a long run of a short period needs few tiles


class Windows:
    """Sums of hashed words times powers of BASE: equal stretches of any length are told by one product."""

    powers = np.ones(1, dtype=np.uint64)
    inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        if len(Windows.powers) <= self.n:
            size = 1 << (self.n + 1).bit_length()
            for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(Windows, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + MIX) * Windows.powers[: self.n], out=self.sums[1:])

    def of(self, size: int) -> np.ndarray:
        """One number per stretch of ``size`` words; equal stretches have equal numbers."""
        return (self.sums[size:] - self.sums[:-size]) * Windows.inverse[: self.n - size + 1]


def _fine_returns(windows: Windows, octave: int, least: int) -> tuple[list, list, np.ndarray, int]:
    """As ``_returns`` for a short octave: exactly where a stretch agrees long enough, every ``octave`` words."""
    sizes = np.maximum(least - np.arange(octave, 2 * octave), np.arange(octave, 2 * octave))
    places, periods = [], []
    for q, size in enumerate(sizes.tolist(), octave):
        if windows.n < q + size:
            continue
        own = windows.of(size)
        at = np.flatnonzero(own[: len(own) - q] == own[q:])
        if len(at):
            first = np.append(True, np.diff(at) > 1)
            at = at[(at - at[first][np.cumsum(first) - 1]) % octave == 0]
            places.append(at)
            periods.append(np.full(len(at), q))
    return places, periods, sizes, octave


def _returns(windows: Windows, octave: int, least: int) -> tuple[list, list, np.ndarray, int]:
    """``places, periods``: where words come back ``octave`` to ``2 octave - 1`` words later.

    Then the number of words that agree, per period of the octave, and the distance of the boundaries: a
    run agrees with its next period for ``octave`` words at least, so it holds the window of a boundary.
    """
    if octave < FINE or octave < least:
        return _fine_returns(windows, octave, least)
    size, step = 3 * octave // 4, octave // 4
    rows = (windows.n - octave - size) // step + 1
    places, periods = [], []
    if rows > 0:
        own = windows.of(size)
        later = own[octave : octave + (rows - 1) * step + octave]
        later = np.append(later, np.zeros((rows - 1) * step + octave - len(later), dtype=np.uint64))
        item = later.itemsize
        ahead = np.lib.stride_tricks.as_strided(later, (rows, octave), (step * item, item), writeable=False)
        part = max(1, 4_000_000 // octave)
        for at in range(0, rows, part):
            here = own[at * step : (min(rows, at + part) - 1) * step + 1 : step]
            row, q = np.nonzero(ahead[at : at + part] == here[:, None])
            if len(row):
                places.append((at + row) * step)
                periods.append(octave + q)
    return places, periods, np.full(octave, size), step


def solve_tile(words: np.ndarray, at: int, octave: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``period, start, stop`` of the stretches around place ``at`` of a tile, for periods of the octave.

    Last, how far the words from ``at`` on agree with those one period later, for each of its periods.
    """
    width = 2 * octave
    after = z_function(words[at:], (width, len(words)))
    head = words[:at][::-1]
    before = z_function(np.concatenate([head, [-1], words[::-1]]), (at, at + 2 + len(words) - at - width))
    known = min(width, len(words) - at)
    ahead, behind = np.zeros((2, width), dtype=np.int64)
    ahead[:known] = after[:known]
    behind[1:known] = before[at + 1 + len(words) - at - np.arange(1, known)]
    q, left, right = np.arange(octave, width), behind[octave:], ahead[octave:]
    long_enough = np.flatnonzero((left + right >= np.maximum(least - q, q)) & (q < known))
    q, left, agreed, parts = q[long_enough], left[long_enough], right[long_enough], _part_periods(octave)[long_enough]
    # A stretch of two periods that also repeats with a part of its period has a smaller one.
    need = 2 * q[:, None] - parts - left[:, None]
    smaller = (parts > 0) & (behind[parts] >= left[:, None]) & (ahead[parts] >= need)
    whole = ~smaller.any(axis=1)
    q, left, agreed = q[whole], left[whole], agreed[whole]
    return q, at - left, at + agreed + q, right


def _joined(pieces: list[tuple[int, int, int]]) -> np.ndarray:
    """Columns ``period, start, stop`` of the stretches that the pieces of one document add up to."""
    out: list[list[int]] = []
    for period, start, stop in sorted(pieces):
        if out and out[-1][0] == period and start <= out[-1][2] - period:
            out[-1][2] = max(stop, out[-1][2])
        else:
            out.append([period, start, stop])
    return np.array(out, dtype=np.int64).reshape(-1, 3).T


def _inside_smaller(places: np.ndarray, periods: np.ndarray, known: list[tuple[int, int, int]]) -> np.ndarray:
    """Which returns only repeat a part of their period: two periods around them lie in such a stretch."""
    out = np.zeros(len(places), dtype=bool)
    shortest = 2 * int(periods.min())
    for d, start, stop in _joined(known).T.tolist():
        if stop - start >= shortest:
            fits = (periods % d == 0) & (2 * periods <= stop - start)
            out |= fits & (places >= start) & (places + periods <= stop)
    return out


def fragments(words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(period, start, stop)`` of the tiles of all octaves of a document."""
    n, found, octave = len(words), [], 1
    windows = Windows(words)
    while max(least, 2 * octave) <= n:
        places, periods, sizes, step = _returns(windows, octave, least)
        if places:
            places, periods = np.concatenate(places), np.concatenate(periods)
            left = ~_inside_smaller(places, periods, found)
            places, periods = places[left], periods[left]
            order = np.argsort(places, kind="stable")
            found += _solve_octave(words, places[order], periods[order] - octave, sizes, step, octave, least)
        octave *= 2
    return found


def _solve_octave(words, places, periods, sizes, step, octave, least) -> list[tuple[int, int, int]]:
    """Pieces of one octave; a boundary whose windows lie in what earlier tiles have seen needs no tile."""
    n, reach, found = len(words), max(least, 2 * octave, SHORTEST_REACH) + octave, []
    seen = np.full(octave, -1, dtype=np.int64)
    bounds = runs(places)
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        b, q = int(places[x]), periods[x:y]
        if (seen[q] >= b + sizes[q]).all():
            continue
        low, high = max(0, b - reach), min(n, b + 2 * octave + reach)
        period, start, stop, agreed = solve_tile(words[low:high], b - low, octave, least)
        # What the tile's end cuts off is left to the last boundary whose window is still inside.
        cut = (b + agreed + np.arange(octave, 2 * octave) == high) & (high < n)
        seen = np.maximum(seen, b + agreed - np.where(cut, step, 0))
        found += zip(period.tolist(), (start + low).tolist(), (stop + low).tolist(), strict=True)
    return found


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Every word as the place where it first stands."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, count()), dtype=np.int64, count=len(words))


def collapse(words: list[bytes], dropped: list[tuple[int, int]]) -> bytes:
    """The words outside the ``(from, to)`` stretches, joined by one space."""
    keep = np.ones(len(words), dtype=bool)
    for low, high in dropped:
        keep[low:high] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]) if dropped else b" ".join(words)


def as_text(collapsed: bytes) -> str:
    return collapsed.decode("utf-8", "surrogatepass")


def find_fragments(docs: DataFrame, least: int, render: Callable[[bytes], str]) -> DataFrame:
    """FOUND rows: documents with fragments keep their text, the others are collapsed at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        rows = count()
        for batch in batches:
            out = {name: [] for name in ("row", "doc_id", "n_words", "fragments", "text", "collapsed")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                words = words_of(text)
                got = fragments(numbered(words), least) if len(words) >= least else []
                for name, value in zip(out, (base + next(rows), doc_id, len(words), got), strict=False):
                    out[name].append(value)
                out["text"].append(text if got else None)
                out["collapsed"].append(None if got else render(collapse(words, [])))
            flat = [f for got in out["fragments"] for f in got]
            parts = [pa.array([f[i] for f in flat], pa.int64()) for i in range(3)]
            ends = np.cumsum([0, *map(len, out["fragments"])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(FRAGMENT)))
            columns = [pa.array(out[n], pa.int64()) for n in ("row", "doc_id", "n_words")]
            columns += [lists, *(pa.array(out[n], pa.string()) for n in ("text", "collapsed"))]
            yield pa.RecordBatch.from_arrays(columns, names=list(out))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, FOUND)


def stitch(pieces: DataFrame) -> DataFrame:
    """``row, period, start, length``: fragments of one row and period that share a period of words are one run."""
    line = Window.partitionBy("row", "period").orderBy("start", "stop")
    reached = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > reached - F.col("period"), F.lit(True))
    marked = pieces.distinct().withColumn("begins", begins)
    numbered_ = marked.withColumn("part", F.count_if("begins").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered_.groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.select("row", "period", "start", (F.col("stop") - F.col("start")).alias("length"))


def _collapsed(render: Callable[[bytes], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
                cut = [(r["start"] + r["period"], r["start"] + r["length"]) for r in runs]
                out.append(render(collapse(words_of(text.as_py()), cut)))
            columns = [batch.column(n) for n in ("doc_id", "n_words", "runs")] + [pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 12, render: Callable[[bytes], str] = as_text) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row; ``runs`` by start, then period.

    ``collapsed``: the words that no run contains after its first period, joined by one space, as
    ``render`` gives them: as text, or as a digest where the text itself is not wanted.
    """
    found = materialise(find_fragments(docs, least, render), "fragments")
    pieces = found.select("row", F.inline("fragments"))
    run = F.struct("start", "period", "length")
    of_row = stitch(pieces).groupBy("row").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    repeated = found.where("text is not null").select("row", "doc_id", "n_words", "text").join(of_row, "row")
    repeated = repeated.select("doc_id", "n_words", "runs", "text").mapInArrow(_collapsed(render), DONE)
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    clean = found.where("text is null").select("doc_id", "n_words", none.alias("runs"), "collapsed")
    return clean.unionByName(repeated)
