"""Benchmark items found in training documents: BM25 retrieval by block-max WAND, then verification.

The items are indexed: per term a posting list of (item, impact) with the largest impact of each
block of postings. An impact is the term's BM25 weight in the item over the item's score against
itself, so a score is the share of an item that a passage brings back, from 0 to 1. Every document is
cut into overlapping passages of two item lengths; each passage is a query and all items that reach
``threshold`` are retrieved. A bound skips passages first: the heaviest terms of every item carry more
than ``1 - threshold`` of its score, so a passage must bring enough of those, which is summed for a
block of documents at once. Hits are verified word by word: the item's question (all but its last
sentence) and its answer must each share enough word runs with the passage; neither is less than a
third of the item.

The index is cut into shards of at most ``shard_items`` items and ``shard_words`` words; a shard is
what a task holds, and documents are read once per shard, so nothing is assumed of the number of
items. Documents are never shuffled.

Null or empty texts match nothing; documents without an id are one document; repeated rows count once; of several hits of a document and an item
the best, earliest passage is kept; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscore.llm.common import whole_text

HITS = (
    "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint, n_words bigint"
)
EDGE = ".,;:!?()[]{}<>\"'`´“”„«»‘’*_~|/\\-–—…#%&$"
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
K1, B, BLOCK = 1.2, 0.75, 16


def words_of(text: str) -> list[str]:
    """Lower-case words without marks at either end; marks alone are no words."""
    return [w for w in (raw.strip(EDGE) for raw in text.lower().split()) if w]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence, and those of it, but neither less than a third of the item.

    A half of one or two words would be met or missed as a whole, so a copy cut before a short last
    sentence would pass as clean. A single sentence is cut after two thirds.
    """
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    words = [w for p in parts for w in p]
    longest = -(-2 * len(words) // 3)
    if len(parts) < 2:
        return words[:longest], words[longest:]
    cut = min(max(len(words) - len(parts[-1]), len(words) - longest), longest)
    return words[:cut], words[cut:]


def word_runs(words: list[str], size: int) -> set[tuple[str, ...]]:
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


class Index:
    """Posting lists of one shard. ``items``: (item_id, text); ``frequency``: items that hold a word."""

    def __init__(self, items: list[tuple], frequency: dict[str, int], total: int, mean_words: float, threshold: float):
        self.threshold, self.ids = threshold, [i for i, _ in items]
        self.halves = [question_answer(t) for _, t in items]
        self.longest = max((len(q) + len(a) for q, a in self.halves), default=1) or 1
        self.terms: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        essential: list[tuple[int, int, float]] = []
        self.rest = np.zeros(len(items))
        for i, (q, a) in enumerate(self.halves):
            words = q + a
            weights = []
            for w in dict.fromkeys(words):
                df, tf = frequency[w], words.count(w)
                idf = math.log(1 + (total - df + 0.5) / (df + 0.5))
                weights.append((idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words)), w))
            own = sum(x for x, _ in weights)
            light = 1.0
            for x, w in sorted(weights, reverse=True):
                t = self.terms.setdefault(w, len(self.terms))
                if t == len(postings):
                    postings.append([])
                postings[t].append((i, x / own))
                # Terms count as heavy until what is left is under half of what a hit needs.
                if light > threshold / 2:
                    essential.append((t, i, x / own))
                    light -= x / own
            self.rest[i] = light
        self.items = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.last = [[p[min(k + BLOCK, len(p)) - 1] for k in range(0, len(p), BLOCK)] for p in self.items]
        self.tops = [[max(p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)] for p in self.impacts]
        self.top = [max(p) for p in self.impacts]
        essential.sort()
        heavy = np.array([e[0] for e in essential], dtype=np.int64)
        self.heavy_start = np.searchsorted(heavy, np.arange(len(postings) + 1))
        self.heavy_item = np.array([e[1] for e in essential], dtype=np.int64)
        self.heavy_weight = np.array([e[2] for e in essential])

    def candidates(self, term: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Passages whose bound reaches the threshold; one entry per word of a passage, -1: no term."""
        known = term >= 0
        term, passage = term[known], passage[known]
        count = self.heavy_start[term + 1] - self.heavy_start[term]
        term, passage = term[count > 0], passage[count > 0]
        if not len(term):
            return term
        keys = np.unique(passage * len(self.items) + term)
        passage, term = keys // len(self.items), keys % len(self.items)
        count = self.heavy_start[term + 1] - self.heavy_start[term]
        at = np.repeat(self.heavy_start[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        pair, where = np.unique(np.repeat(passage, count) * len(self.ids) + self.heavy_item[at], return_inverse=True)
        bound = np.bincount(where, weights=self.heavy_weight[at]) + self.rest[pair % len(self.ids)]
        return np.unique(pair[bound >= self.threshold - 1e-9] // len(self.ids))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score with the query ``terms`` reaches the threshold."""
        need, found = self.threshold - 1e-9, []
        cursors = [[self.items[t][0], 0, t] for t in terms]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.top[t]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            bound, border = 0.0, len(self.ids)
            for _, _, t in cursors[: pivot + 1]:
                block = bisect.bisect_left(self.last[t], target)
                if block < len(self.last[t]):
                    bound += self.tops[t][block]
                    border = min(border, self.last[t][block] + 1)
            if bound < need:  # no item before the next block border can reach it
                if pivot + 1 < len(cursors):
                    border = min(border, cursors[pivot + 1][0])
                target = max(border, target + 1)
            elif cursors[0][0] == target:
                score = sum(self.impacts[t][at] for item, at, t in cursors[: pivot + 1] if item == target)
                if score >= need:
                    found.append((target, score))
                target += 1
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    c[1] = bisect.bisect_left(self.items[c[2]], target, c[1])
                    c[0] = self.items[c[2]][c[1]] if c[1] < len(self.items[c[2]]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def overlap(self, item: int, words: list[str], run: int) -> tuple[float, float]:
        """Shares of the question's and of the answer's word runs that the passage has."""
        shares = []
        for half in self.halves[item]:
            runs = word_runs(half, run)
            shares.append(len(runs & word_runs(words, min(run, len(half)))) / len(runs) if runs else 1.0)
        return shares[0], shares[1]


class Terms(dict):
    """Raw word to its number in the index: -1 for an unknown word, -2 for none."""

    def __init__(self, terms: dict[str, int], limit: int = 200_000):
        super().__init__()
        self.terms, self.limit = terms, limit

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        word = raw.strip(EDGE)
        value = self[raw] = self.terms.get(word, -1) if word else -2
        return value


def scan(docs: list[tuple[int | None, str]], index: Index, numbers: Terms, run: int, overlap: float) -> Iterator[tuple]:
    """Verified hits of a block of documents."""
    step = index.longest
    raws = [text.lower().split() for _, text in docs]
    flat = np.fromiter((numbers[w] for words in raws for w in words), dtype=np.int64, count=sum(map(len, raws)))
    owner = np.repeat(np.arange(len(docs)), list(map(len, raws)))
    owner, flat = owner[flat > -2], flat[flat > -2]
    sizes = np.bincount(owner, minlength=len(docs))
    starts = np.cumsum(sizes) - sizes
    passages = np.maximum(1, -(-sizes // step) - 1)
    first = np.cumsum(passages) - passages
    # A word at place j of its document lies in passages j // step - 1 and j // step, where they exist.
    place = (np.arange(len(flat)) - starts[owner]) // step
    own = np.minimum(place, passages[owner] - 1) + first[owner]
    before = np.maximum(place - 1, 0) + first[owner]
    both = np.concatenate([own, before]), np.concatenate([flat, flat])
    best: dict[tuple[int, int], tuple] = {}
    for p in index.candidates(both[1], both[0]).tolist():
        d = int(np.searchsorted(first, p, side="right")) - 1
        at = (p - int(first[d])) * step
        span = slice(int(starts[d]) + at, min(int(starts[d]) + at + 2 * step, int(starts[d] + sizes[d])))
        hits = index.retrieve(sorted({t for t in flat[span].tolist() if t >= 0}))
        if not hits:
            continue
        words = words_of(docs[d][1])[at : at + 2 * step]
        for item, score in hits:
            q, a = index.overlap(item, words, run)
            if q >= overlap and a >= overlap:
                row = (docs[d][0], index.ids[item], score, q, a, at, len(words))
                old = best.get((d, index.ids[item]))
                if old is None or (row[2], -row[5]) > (old[2], -old[5]):
                    best[(d, index.ids[item])] = row
    yield from best.values()


def index_shards(items: DataFrame, threshold: float, shard_items: int, shard_words: int) -> Iterator[Index]:
    """The index, one bounded shard after another; the statistics cover all items."""
    rows = items.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), whole_text().alias("text")).distinct()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [words_of(t.as_py()) for t in batch.column(1)]
            columns = [*batch.columns, pa.array(list(map(len, lists)), pa.int64())]
            columns.append(pa.array([list(set(x)) for x in lists], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "n", "words"])

    parsed = rows.mapInArrow(words, "item_id bigint, text string, n bigint, words array<string>").where("n > 0")
    parsed = parsed.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(1024)))
    total, mean = parsed.agg(F.count("*"), F.avg("n")).first()
    if not total:
        return
    buckets = parsed.groupBy("bucket").agg(F.count("*").alias("items"), F.sum("n").alias("n")).orderBy("bucket").collect()
    frequency = parsed.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    groups, held = [[]], [0, 0]
    for b in buckets:
        if groups[-1] and (held[0] + b["items"] > shard_items or held[1] + b["n"] > shard_words):
            groups.append([])
            held = [0, 0]
        groups[-1].append(b["bucket"])
        held = [held[0] + b["items"], held[1] + b["n"]]
    for group in groups:
        part = parsed.where(F.col("bucket").isin(group))
        wanted = part.select(F.explode("words").alias("word")).distinct()
        df = {r["word"]: r["df"] for r in frequency.join(wanted, "word").collect()}
        kept = sorted((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect())
        yield Index(kept, df, total, float(mean), threshold)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.6,
    overlap: float = 0.5,
    run: int = 3,
    shard_items: int = 20_000,
    shard_words: int = 2_000_000,
    block_words: int = 300_000,
) -> DataFrame:
    """HITS: every document and item found in it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    found = None
    for index in index_shards(items, threshold, shard_items, shard_words):

        def run_task(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            numbers = Terms(index.terms)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in HITS.split(", ")]

            def emit(block: list[tuple]) -> Iterator[pa.RecordBatch]:
                hits = list(scan(block, index, numbers, run, overlap))
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], k) for i, k in enumerate(kinds)], names=names)

            block, size = [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    block.append((doc_id, text.as_py()))
                    size += len(block[-1][1]) // 6
                    if size >= block_words:
                        yield from emit(block)
                        block, size = [], 0
            if block:
                yield from emit(block)

        hits = rows.mapInArrow(run_task, HITS)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], HITS)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "first_word")
    return found.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
