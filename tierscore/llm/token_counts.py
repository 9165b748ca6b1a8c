"""Token counts of documents in flat files of token ids without an index.

A file is nothing but little-endian ids of two or four bytes; an end-of-document id closes each
document. Readers
take fixed byte ranges (blocks), search each for the end id with one vectorised comparison, and keep
the positions found. A prefix scan over the small block summaries (number of ends, last end) gives
every block the number of documents before it and the end before its first one, which stitches the
documents that cross block borders. No task needs more than one block.

``write_flat`` writes such files from token arrays: one per task, under a name of its own, so a task
that runs again leaves an unreferenced file and never a doubled one; its result names the files that
count. Special tokens inside a text are plain characters, so only ends have the end id. Null texts
count as empty (one end id); tokens after the last end id are reported as an open
document; an empty file or table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierscore.llm.common import whole_text
from tierscore.llm.tokens import Codec, vocabulary
from tierscore.session import materialise, scratch_path
from tierscore.sources.binary import open_fs

WRITTEN = "path string, ordinal bigint, doc_id bigint"
ENDS = "path string, block bigint, tokens bigint, ends array<bigint>"


def write_flat(
    docs: DataFrame, folder: str, end_id: int = 50256, files: tuple[str, str] | None = None, width: int = 2
) -> DataFrame:
    """Writes the ids of every document and ``end_id`` to flat files below ``folder``: WRITTEN rows.

    ``width``: bytes of an id; two are enough for vocabularies below 65,536.
    """
    vocab, kind = files or vocabulary(), f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = open_fs(folder)
        codec, name, out, ordinal = Codec(vocab), f"{uuid.uuid4().hex}.ids", None, 0
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(inner, recursive=True)
                out = fs.open_output_stream(f"{inner}/{name}")
            for text in batch.column(1):
                ids = codec.plain_ids(text.as_py())
                if (ids == end_id).any():
                    raise ValueError(f"a text holds the end id {end_id}")
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                out.write(ids.astype(kind).tobytes() + end)
            n = batch.num_rows
            order = pa.array(np.arange(ordinal, ordinal + n, dtype=np.int64))
            ordinal += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"] * n), order, batch.column(0)], names=["path", "ordinal", "doc_id"]
            )
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return materialise(rows.mapInArrow(run, WRITTEN), "flat")


def find_ends(paths: DataFrame, end_id: int, block_tokens: int, width: int = 2) -> DataFrame:
    """ENDS rows of every block of the files in ``path``: places of the end ids from the file's start."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = open_fs(path)
                tokens = fs.get_file_info(inner).size // width
                count = -(-tokens // block_tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * count, pa.string()), pa.array(range(count), pa.int64())], names=["path", "block"]
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = open_fs(path)
                start = block * block_tokens
                with fs.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(width * block_tokens, width * start), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + start
                bounds = pa.array([0, len(ends)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]),
                        pa.array([block], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.ListArray.from_arrays(bounds, pa.array(ends, pa.int64())),
                    ],
                    names=["path", "block", "tokens", "ends"],
                )

    blocks = paths.select("path").distinct().mapInArrow(sizes, "path string, block bigint")
    return blocks.repartition("path", "block").mapInArrow(scan, ENDS)


def prefix_scan(blocks: DataFrame, group: int = 4096) -> DataFrame:
    """Adds ``docs_before`` and ``end_before`` (-1: none) to ``path, block, n, last``.

    Two levels: within groups of ``group`` blocks, and over the groups, so the longest file gives no
    task more than ``group`` rows plus one per group.
    """
    keyed = blocks.withColumn("grp", F.floor(F.col("block") / group))
    upto = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy("path", "grp").orderBy("block").rowsBetween(*upto)
    outer = Window.partitionBy("path").orderBy("grp").rowsBetween(*upto)
    groups = keyed.groupBy("path", "grp").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select(
        "path",
        "grp",
        F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("docs_group"),
        F.coalesce(F.max("last").over(outer), F.lit(-1)).alias("end_group"),
    )
    local = keyed.select(
        "path",
        "block",
        "grp",
        F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("docs_local"),
        F.max("last").over(inner).alias("end_local"),
    )
    return local.join(groups, ["path", "grp"]).select(
        "path",
        "block",
        (F.col("docs_group") + F.col("docs_local")).alias("docs_before"),
        F.coalesce("end_local", "end_group").alias("end_before"),
    )


def count_tokens(paths: DataFrame, end_id: int = 50256, block_tokens: int = 1 << 20, width: int = 2) -> DataFrame:
    """``path, ordinal, start, n_tokens, closed`` of every document, end ids not counted."""
    found = materialise(find_ends(paths, end_id, block_tokens, width), "ends")
    summary = found.select("path", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    before = prefix_scan(summary.select("path", "block", "n", "last"))
    stitched = found.join(before, ["path", "block"])
    docs = stitched.select(
        "path",
        "docs_before",
        "end_before",
        "ends",
        F.posexplode("ends").alias("k", "end"),
    )
    previous = F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1)).otherwise(F.col("end_before"))
    closed = docs.select(
        "path",
        (F.col("docs_before") + F.col("k")).alias("ordinal"),
        (previous + 1).alias("start"),
        (F.col("end") - previous - 1).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    tails = found.groupBy("path").agg(
        F.sum(F.size("ends")).cast("bigint").alias("ordinal"),
        (F.coalesce(F.max(F.array_max("ends")), F.lit(-1)) + 1).alias("start"),
        F.sum("tokens").alias("tokens"),
    )
    opened = tails.where("start < tokens").select(
        "path", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(opened)


def document_counts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Writes the documents as flat files, counts by scanning them and puts the ids back."""
    written = write_flat(docs, scratch_path(spark, "tokens"))
    counts = count_tokens(written.select("path").distinct(), **options)
    return written.join(counts, ["path", "ordinal"]).select("doc_id", "start", "n_tokens", "closed")
