"""Fixed-width binary files as a Python data source, read in row ranges.

``spark.read.format("tier_binary").option("kind", "dense").option("dim", 64).load(path)``

A file stores whole columns one after the other, so any row range can be read with one seek per
column. The planner only looks at file sizes and headers; every read task fetches its own byte
ranges and yields Arrow batches. Files of a folder are ordered by name and numbered through.
"""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "tier_binary"
# File signatures.
FEATURES_V1, FEATURES_V2 = b"L1FEATv1\0", b"L1FEATv2\0"
ROUTE_META, DISPATCH_META = b"L2RMTv1\0", b"L2DSPv1\0"

META_COLUMNS = (("tau_used", "<f4"), ("active", "u1"), ("exact_positive", "u1"))
SCHEMAS = {
    "dense": "row_idx bigint, features array<float>",
    "features": "row_idx bigint, txn_id bigint, label tinyint, features array<float>",
    "route_meta": "row_idx bigint, txn_id bigint, fold_id int, tau_used float, active boolean, exact_positive boolean",
    "dispatch_meta": "row_idx bigint, txn_id bigint, slot_id int, tau_used float, active boolean, exact_positive boolean",
}


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and inner path of a URI or plain path."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else path
    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Section:
    """One column of a file: byte offset, element type and elements per row."""

    column: str
    offset: int
    dtype: str
    width: int = 1


@dataclass(frozen=True)
class Layout:
    n_rows: int
    sections: tuple[Section, ...]


def dense_layout(size: int, dim: int) -> Layout:
    if dim <= 0 or size % (dim * 4):
        raise ValueError(f"file size {size} is not a multiple of {dim} floats")
    return Layout(size // (dim * 4), (Section("features", 0, "<f4", dim),))


def features_layout(head: bytes, size: int) -> Layout:
    magic = head[: len(FEATURES_V1)]
    at = len(FEATURES_V1)
    if magic not in (FEATURES_V1, FEATURES_V2) or len(head) < at + 8:
        raise ValueError("not a feature table")
    n, cols = struct.unpack_from("<II", head, at)
    if magic == FEATURES_V1:
        x = at + 8
        ids = x + n * cols * 4
        y = ids + n * 8
    else:
        x, ids, y = struct.unpack_from("<QQQ", head, at + 8)
    if max(x + n * cols * 4, ids + n * 8, y + n) > size:
        raise ValueError("feature table is truncated")
    return Layout(n, (Section("txn_id", ids, "<i8"), Section("label", y, "u1"), Section("features", x, "<f4", cols)))


def meta_layout(head: bytes, size: int, kind: str) -> Layout:
    magic = ROUTE_META if kind == "route_meta" else DISPATCH_META
    if head[: len(magic)] != magic:
        raise ValueError(f"not a {kind} table")
    (n,) = struct.unpack_from("<I", head, len(magic))
    at = len(magic) + 4
    key = "fold_id" if kind == "route_meta" else "slot_id"
    sections = []
    for column, dtype in (("txn_id", "<i8"), (key, "<i4"), *META_COLUMNS):
        sections.append(Section(column, at, dtype))
        at += n * np.dtype(dtype).itemsize
    if at > size:
        raise ValueError(f"{kind} table is truncated")
    return Layout(n, tuple(sections))


def list_files(path: str) -> list[tuple[str, int]]:
    fs, inner = open_fs(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(inner, info.size)]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=False))
    files = [(f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "_."]
    return sorted(files)


@dataclass
class RowRange(InputPartition):
    path: str
    layout: Layout
    start: int
    stop: int
    first_index: int


class BinaryReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind = options["path"], options.get("kind", "dense")
        self.dim = int(options.get("dim", "0"))
        self.rows = int(options.get("rowsperpartition", "1000000"))
        self.schema = schema

    def partitions(self) -> Sequence[InputPartition]:
        fs, _ = open_fs(self.path)
        parts, base = [], 0
        for name, size in list_files(self.path):
            if self.kind == "dense":
                layout = dense_layout(size, self.dim)
            else:
                with fs.open_input_file(name) as f:
                    head = f.read_at(min(size, 64), 0)
                layout = features_layout(head, size) if self.kind == "features" else meta_layout(head, size, self.kind)
            for start in range(0, layout.n_rows, self.rows):
                parts.append(RowRange(name, layout, start, min(start + self.rows, layout.n_rows), base + start))
            base += layout.n_rows
        return parts

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition is None or not hasattr(partition, "layout"):
            return
        fs, _ = open_fs(self.path)
        with fs.open_input_file(partition.path) as f:
            for start in range(partition.start, partition.stop, 16_384):
                n = min(16_384, partition.stop - start)
                index = np.arange(n, dtype=np.int64) + partition.first_index + (start - partition.start)
                cols = {"row_idx": pa.array(index)}
                for s in partition.layout.sections:
                    cols[s.column] = _read_section(f, s, start, n)
                yield pa.RecordBatch.from_arrays([cols[c] for c in self.schema.names], names=self.schema.names)


def _read_section(f: pa.NativeFile, s: Section, start: int, n: int) -> pa.Array:
    row_bytes = np.dtype(s.dtype).itemsize * s.width
    values = np.frombuffer(f.read_at(n * row_bytes, s.offset + start * row_bytes), dtype=s.dtype)
    if s.column == "features":
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * s.width)
        return pa.ListArray.from_arrays(offsets, pa.array(values))
    if s.column in ("active", "exact_positive"):
        return pa.array(values != 0)
    return pa.array(values.astype(np.int8) if s.column == "label" else values)


@dataclass
class FileWritten(WriterCommitMessage):
    part: str
    final: str
    rows: int


class BinaryWriter(DataSourceArrowWriter):
    """Writes one file per task, under a temporary name until the job commits.

    File names begin with the time of their job and a number of its own, so jobs that append never
    meet and their files keep the order of the jobs. Overwriting removes the earlier files after the
    new ones are in place.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.kind, self.schema = options["path"], options.get("kind", "dense"), schema
        self.overwrite, self.job = overwrite, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, inner = open_fs(self.path)
        fs.create_dir(inner, recursive=True)
        final = f"{inner}/part-{self.job}-{ctx.partitionId():06d}.bin"
        part = f"{inner}/_part-{self.job}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        rows = 0
        if self.kind == "dense":
            with fs.open_output_stream(part) as out:
                for batch in iterator:
                    out.write(_floats(batch.column("features")).tobytes())
                    rows += batch.num_rows
        else:
            batches = [b for b in iterator if b.num_rows]
            rows = sum(b.num_rows for b in batches)
            with fs.open_output_stream(part) as out:
                for block in _encode(batches, rows, self.kind):
                    out.write(block)
        return FileWritten(part, final, rows)

    def commit(self, messages: list[FileWritten | None]) -> None:
        fs, inner = open_fs(self.path)
        old = []
        if self.overwrite:
            entries = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
            old = [e.path for e in entries if e.type == pafs.FileType.File and e.base_name.startswith("part-")]
        for m in messages:
            if m is not None and m.rows:
                fs.move(m.part, m.final)
            elif m is not None:
                fs.delete_file(m.part)
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[FileWritten | None]) -> None:
        fs, _ = open_fs(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.part).type == pafs.FileType.File:
                fs.delete_file(m.part)


def _floats(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    if flat.null_count:
        flat = flat.fill_null(float("nan"))
    return flat.to_numpy(zero_copy_only=False).astype("<f4", copy=False)


def _encode(batches: list[pa.RecordBatch], rows: int, kind: str) -> Iterator[bytes]:
    def column(name: str, dtype: str) -> Iterator[bytes]:
        for b in batches:
            yield b.column(name).to_numpy(zero_copy_only=False).astype(dtype).tobytes()

    if kind == "features":
        dim = len(batches[0].column("features")[0]) if batches else 0
        head = len(FEATURES_V2) + 8 + 24
        ids = head + rows * dim * 4
        yield FEATURES_V2 + struct.pack("<IIQQQ", rows, dim, head, ids, ids + rows * 8)
        for b in batches:
            yield _floats(b.column("features")).tobytes()
        yield from column("txn_id", "<i8")
        yield from column("label", "u1")
        return
    yield (ROUTE_META if kind == "route_meta" else DISPATCH_META) + struct.pack("<I", rows)
    key = "fold_id" if kind == "route_meta" else "slot_id"
    for name, dtype in (("txn_id", "<i8"), (key, "<i4"), *META_COLUMNS):
        yield from column(name, dtype)


class TierBinary(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "dense")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return BinaryReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BinaryWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TierBinary)


def read_dense_rows(spark: SparkSession, path: str, dim: int, rows_per_partition: int = 1_000_000) -> DataFrame:
    """Headerless float rows: ``row_idx, features``."""
    register(spark)
    reader = spark.read.format(FORMAT).option("kind", "dense").option("dim", str(dim))
    return reader.option("rowsPerPartition", str(rows_per_partition)).load(path)


def read_feature_table(spark: SparkSession, path: str, rows_per_partition: int = 1_000_000) -> DataFrame:
    """Feature tables of either version: ``row_idx, txn_id, label, features``."""
    register(spark)
    reader = spark.read.format(FORMAT).option("kind", "features")
    return reader.option("rowsPerPartition", str(rows_per_partition)).load(path)


def read_row_meta(spark: SparkSession, path: str, kind: str = "route_meta") -> DataFrame:
    """Binary route or dispatch metadata."""
    if kind not in ("route_meta", "dispatch_meta"):
        raise ValueError(f"unknown metadata kind: {kind}")
    register(spark)
    return spark.read.format(FORMAT).option("kind", kind).load(path)


def write_binary(df: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """Write ``df`` in its partition order; range-partition and sort it first to fix row order.

    ``mode``: ``append`` keeps what the folder holds, ``overwrite`` replaces it.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode: {mode}")
    register(df.sparkSession)
    df.write.format(FORMAT).option("kind", kind).mode(mode).save(path)


