"""Best-fit packing of tokenised documents into sequences of bounded length.

Every scan task packs its own pieces by best fit (largest first). Bins that are nearly full leave at
once; all others rise to the nodes of a tree, where whole bins are the items of further best-fit rounds
(or their pieces, where that needs fewer bins). A level has as many nodes as its bins need to stay within
``node_bins`` and ``node_pieces`` each; bins are dealt by hash, so every node gets a sample of all fills, and
what one scan task could not complete meets its complements from the others. A level that is one node is
the root; levels of several nodes follow each other, dealt anew, until they stop saving bins.

Null texts count as empty, null and repeated ids keep their rows, an empty table gives no rows and
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscore.llm.common import runs, whole_groups, whole_text
from tierscore.llm.tokens import Codec, vocabulary
from tierscore.session import materialise

MEMBER = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, offset bigint"
BINS = f"node bigint, bin bigint, fill bigint, full boolean, members array<struct<{MEMBER.replace(' ', ':').replace(',:', ',')}>>"


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item, largest items first, each into the fullest bin that still takes it."""
    free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_mask, made = 0, 0
    place = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        need = sizes[i]
        fitting = open_mask >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            b = free_bins[free].pop()
            if not free_bins[free]:
                open_mask ^= 1 << free
        else:
            free, b = capacity, made
            made += 1
        place[i] = b
        left = free - need
        free_bins[left].append(b)
        open_mask |= 1 << left
    return place


def pack_rows(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Bins of ``(length, payload)`` rows."""
    place = best_fit([p[0] for p in pieces], capacity)
    bins: list[list[tuple]] = [[] for _ in range(max(place, default=-1) + 1)]
    for p, b in zip(pieces, place, strict=True):
        bins[b].append(p)
    return bins


def cut_pieces(doc_id, ids: np.ndarray, end_id: int, capacity: int) -> Iterator[tuple]:
    """``(length, (doc_id, piece, start, length, crc))``; only the first piece of a cut text is short."""
    data = ids.tobytes() + np.array([end_id], dtype="<u4").tobytes()
    total = len(data) // 4
    first = total if total <= capacity else (total % capacity or capacity)
    start = 0
    for piece in range(1 + (total - first) // capacity):
        length = first if not piece else capacity
        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
        yield length, (doc_id, piece, start, length, crc)
        start += length


def _flat_bin(node: int, name: int, parts: list[tuple[int, list[tuple]]], capacity: int, slack: int) -> tuple:
    """One row of BINS: the members of ``parts`` laid end to end."""
    members, fill = [], 0
    for length, inner in parts:
        members += [(*m[:5], m[5] + fill) for m in inner]
        fill += length
    return node, name, fill, fill > capacity - slack, members


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in MEMBER.split(", ")]
    for at in range(0, len(rows), 2_000):
        part = rows[at : at + 2_000]
        flat = [m for r in part for m in r[4]]
        ends = np.cumsum([0, *(len(r[4]) for r in part)])
        columns = [pa.array([m[i] for m in flat], type=k) for i, k in enumerate(kinds)]
        members = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.StructArray.from_arrays(columns, names))
        simple = [pa.array([r[i] for r in part]) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*simple, members], names=["node", "bin", "fill", "full", "members"])


def _leaf(files: tuple[str, str], end_id: int, capacity: int, slack: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, node, made = Codec(files), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = []
            for parts in pack_rows(held, capacity):
                rows.append(_flat_bin(node, node << 36 | made, [(n, [(*m, 0)]) for n, m in parts], capacity, slack))
                made += 1
            held.clear()
            yield from _batches(rows)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.extend(cut_pieces(doc_id, codec.ids(text.as_py()), end_id, capacity))
                if len(held) >= block:
                    yield from emit()
        yield from emit()

    return run


def _merge(capacity: int, slack: int):
    """One level of the tree: rows of a node, best-fit as whole bins, or piece by piece if that needs fewer."""

    def node_rows(node: int, bins: list[dict]) -> list[tuple]:
        members = [[tuple(m.values()) for m in b["members"]] for b in bins]
        whole = pack_rows([(b["fill"], m) for b, m in zip(bins, members, strict=True)], capacity)
        loose = pack_rows([(m[3], [(*m[:5], 0)]) for inner in members for m in inner], capacity)
        best = loose if len(loose) < len(whole) else whole
        return [_flat_bin(node, b["bin"], parts, capacity, slack) for b, parts in zip(bins, best, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node"], 1):
            bounds = runs(t.column("node").to_numpy())
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                bins = t.slice(lo, hi - lo).to_pylist()
                yield from _batches(node_rows(bins[0]["node"], bins))

    return run


def pack(
    docs: DataFrame,
    files: tuple[str, str] | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    slack: int = 8,
    block: int = 65_536,
    node_bins: int = 4_096,
    node_pieces: int = 200_000,
    least_gain: float = 0.001,
) -> DataFrame:
    """Pieces of all documents with their sequence and place: MEMBER columns and ``sequence_id``.

    ``slack``: a bin with less room than this is full. ``block``: pieces a task packs at a time.
    ``least_gain``: share of its bins that a level must save for another one to follow.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    bins = materialise(rows.mapInArrow(_leaf(files or vocabulary(), end_id, capacity, slack, block), BINS), "bins")
    done, level = [], 0
    while True:
        done.append(bins.where("full"))
        open_bins = bins.where("not full")
        count, tokens, pieces = open_bins.agg(F.count("*"), F.sum("fill"), F.sum(F.size("members"))).first()
        # Nothing to save where the bins are as few as their tokens need.
        if count <= -(-(tokens or 0) // capacity):
            break
        nodes = max(1, -(-count // node_bins), -(-pieces // node_pieces))
        dealt = open_bins.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(nodes)))
        dealt = dealt.repartition(nodes, "node").sortWithinPartitions("node", "bin")
        bins = materialise(dealt.mapInArrow(_merge(capacity, slack), BINS), "bins")
        left, level = bins.count(), level + 1
        if nodes == 1 or count - left < least_gain * count:
            done.append(bins.where("full"))
            open_bins = bins.where("not full")
            break
    every = open_bins
    for d in done:
        every = every.unionByName(d)
    return every.select(F.col("bin").alias("sequence_id"), F.inline("members"))
