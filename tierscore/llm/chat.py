"""Conversations rendered by a compiled template, and read back from the rendered form.

``render_turns`` keeps one row per turn: its formatted text and the spans under the loss, so nothing
gathers a conversation. Turns of one conversation follow each other inside a sorted partition; the
only state between them is the turn's number. ``digests`` reads the formatted turns back in the same
pass; a digest of a whole conversation is a sequential hash by definition, so one task streams
through one conversation, holding one turn at a time, and its memory does not grow with it.

Rows with a null conversation form one conversation of their own; null roles and texts count as
empty; a null turn comes first; ties are ordered by role and text; repeated rows are kept; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscore.llm.common import whole_text
from tierscore.llm.templates import compile_template, unescape, unescape_line

CHAT = (
    "<|im_start|>{{ role | escape_line }}\n"
    "{% if role == 'assistant' %}{% generation %}{{ text | escape }}{% endgeneration %}"
    "{% else %}{{ text | escape }}{% endif %}<|im_end|>\n"
)
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
RENDERED = "conv_id bigint, turn bigint, formatted string, loss_spans array<struct<start:int,length:int>>"
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """The turns of a conversation one after another within a partition."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        whole_text("role").alias("role"),
        whole_text("text").alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rendered(batches: Iterator[pa.RecordBatch], template: str) -> Iterator[tuple]:
    """``conv_id, turn, formatted, spans`` of each row; the sort puts a null conversation first."""
    render, last, index = compile_template(template), object(), 0
    for batch in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            index = index + 1 if conv == last else 0
            last, spans, at, parts = conv, [], 0, []
            for piece, in_loss in render(role, text, index):
                if in_loss:
                    spans.append((at, len(piece)))
                parts.append(piece)
                at += len(piece)
            yield conv, turn, "".join(parts), spans


def render_turns(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """RENDERED rows; spans count code points from the start of the turn's formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in _rendered(batches, template):
            rows.append(row)
            if len(rows) == 2_000:
                yield pack(rows)
                rows = []
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        span = pa.struct([("start", pa.int32()), ("length", pa.int32())])
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
        columns.append(pa.array([r[2] for r in rows], pa.string()))
        columns.append(pa.array([[{"start": a, "length": n} for a, n in r[3]] for r in rows], pa.list_(span)))
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "formatted", "loss_spans"])

    return ordered_turns(conversations).mapInArrow(run, RENDERED)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.all, self.loss = conv, 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0

    def add(self, formatted: str, spans: list[tuple[int, int]]) -> None:
        """Reads one formatted turn back."""
        m = TURN.fullmatch(formatted)
        if not m:
            raise ValueError(f"not a turn: {formatted[:80]!r}")
        role, text = unescape_line(m[1]), unescape(m[2])
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for start, length in spans:
            plain = unescape(formatted[start : start + length])
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(plain)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """One row per conversation, from its formatted turns; the template must write CHAT's turn marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for conv, _, formatted, spans in _rendered(batches, template):
            if current is None or current.conv != conv:
                if current is not None:
                    rows.append(current.row())
                current = _Digest(conv)
            current.add(formatted, spans)
            if len(rows) == 5_000:
                yield pack(rows)
                rows = []
        if current is not None:
            rows.append(current.row())
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return ordered_turns(conversations).mapInArrow(run, DIGESTS)
