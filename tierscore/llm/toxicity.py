"""Toxicity scores from a learnt lexicon, matched with typing errors and weighed by context.

1. ``learn_lexicon``: prefixes and words that are far more frequent in toxic than in clean labelled
   documents, chosen by a log-likelihood test against the number of candidates. Of prefixes of one
   another the one with the strongest test stays; the longest of equal ones.
2. ``Lexicon``: a trie of these terms. ``match`` runs the Levenshtein automaton of a word over the
   trie, state set by state set, so all terms within one edit are found in one walk; two neighbouring
   letters that changed places are one edit. A term that mostly occurs inside longer words matches as a
   prefix.
3. ``fit``: what a hit says, by term, edits and context: a hit is quoted if quotation marks open
   before and close after it within a window of words. Rare cases fall back to the plain use.
4. ``score``: log odds of all hits of a document, as a probability.

Labels come from at most ``max_labelled`` rows (a hash sample; all of them if there are fewer) that
``may_learn`` admits; every document is scored whole. Scores use the text alone. Null texts count as
empty; labels with null ids or null toxic are left out, of several labels of a document the highest counts;
without labels every score is the prior 0.5 / (0 + 1); an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscore.llm.common import whole_text
from tierscore.session import materialise

EDGE = ".,;:!?()[]{}<>\"'`´“”„«»‘’‹›*_~|/\\-–—…#%&$"
# Marks that open and close a quotation.
OPENING, CLOSING = "\"“„«‘‹'", "\"”“»’›'"
SHORTEST, LONGEST = 3, 8


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that must not be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Lexicon:
    """Terms in a trie; a node is ``[children, term index or -1]``."""

    def __init__(self, terms: list[str], prefix: list[bool]):
        self.terms, self.prefix, self.edits = terms, prefix, 1
        self.root: list = [{}, -1]
        for i, t in enumerate(terms):
            node = self.root
            for ch in t:
                node = node[0].setdefault(ch, [{}, -1])
            node[1] = i
        # One edit leaves the first or the last half of a word as it is, unless it swaps the letters at the
        # border: a cheap test before the walk.
        heads = {t if p else t[: len(t) // 2] for t, p in zip(terms, prefix, strict=True)}
        for t in (t for t, p in zip(terms, prefix, strict=True) if not p):
            m = len(t) // 2
            heads.add(t[: m - 1] + t[m] + t[m - 1])
        self.heads = tuple(heads)
        self.tails = tuple({t[len(t) // 2 :] for t, p in zip(terms, prefix, strict=True) if not p})

    def _close(self, states: dict[int, tuple]) -> dict[int, tuple]:
        """Adds the states reached by skipping letters of a term."""
        todo = [s for s in states.values() if s[1] < self.edits]
        while todo:
            node, e = todo.pop()
            for child in node[0].values():
                old = states.get(id(child))
                if old is None or old[1] > e + 1:
                    states[id(child)] = (child, e + 1)
                    if e + 1 < self.edits:
                        todo.append((child, e + 1))
        return states

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term and its distance, if any is near enough; words under 3 letters match none."""
        if len(word) < SHORTEST or not (word.startswith(self.heads) or word.endswith(self.tails)):
            return None
        best: tuple[int, int] | None = None
        states = self._close({id(self.root): (self.root, 0)})
        before, last = {}, ""
        for ch in word:
            moved: dict[int, tuple] = {}
            for node, e in before.values():
                # The term has this letter and the last one the other way round.
                turned = node[0].get(ch)
                turned = turned and turned[0].get(last)
                if turned and e < self.edits and (id(turned) not in moved or moved[id(turned)][1] > e + 1):
                    moved[id(turned)] = (turned, e + 1)
            for node, e in states.values():
                exact = node[0].get(ch)
                if exact is not None and (id(exact) not in moved or moved[id(exact)][1] > e):
                    moved[id(exact)] = (exact, e)
                if e < self.edits:
                    for nxt in (node, *node[0].values()):
                        if id(nxt) not in moved or moved[id(nxt)][1] > e + 1:
                            moved[id(nxt)] = (nxt, e + 1)
            # Without states a swap can still begin one letter back, but only if there was a state there.
            if not moved and not states:
                break
            before, last, states = states, ch, self._close(moved)
            best = self._better(best, states, True)
        else:
            best = self._better(best, states, False)
        return best

    def _better(self, best, states: dict[int, tuple], only_prefix: bool):
        for node, e in states.values():
            t = node[1]
            # A prefix must be met exactly: with an edit it would be found inside unrelated words.
            if t >= 0 and (not e or not self.prefix[t]) and (self.prefix[t] or not only_prefix):
                if best is None or (e, -len(self.terms[t])) < (best[1], -len(self.terms[best[0]])):
                    best = (t, e)
        return best


class Matches(dict):
    """Raw word to its match or None, remembered for at most ``limit`` words."""

    def __init__(self, lexicon: Lexicon, limit: int = 100_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, raw: str):
        if len(self) >= self.limit:
            self.clear()
        value = self[raw] = self.lexicon.match(raw.strip(EDGE))
        return value

    def hits(self, text: str, window: int) -> set[tuple[int, int, bool]]:
        """Distinct (term, edits, quoted) of a text."""
        words = words_of(text)
        found = [(i, m) for i, m in enumerate(map(self.__getitem__, words)) if m is not None]
        return {(*m, quoted(words, i, window)) for i, m in found}


def quoted(words: list[str], at: int, window: int) -> bool:
    """Whether a quotation opened before the word is still open and closes after it, within the window."""
    opened = False
    for w in words[max(0, at - window) : at + 1]:
        if w[0] in OPENING:
            opened = True
        if w is not words[at] and len(w) > 1 and w.rstrip(".,;:!?")[-1:] in tuple(CLOSING):
            opened = False
    return opened and any(w.rstrip(".,;:!?")[-1:] in tuple(CLOSING) for w in words[at : at + window + 1])


@dataclass
class Model:
    lexicon: Lexicon
    weights: dict[tuple[int, int, bool], float] = field(default_factory=dict)
    prior: float = 0.0
    clean: float = 0.0
    window: int = 8

    def score(self, matches: Matches, text: str) -> float:
        found = [self.weights[h] for h in matches.hits(text, self.window) if h in self.weights]
        z = self.prior + (sum(found) if found else self.clean)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _ratio(pos: float, neg: float, n_pos: int, n_neg: int) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def gain(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """Log-likelihood gain of a term over the base rate; 0 if it is not more frequent in toxic rows."""
    total, share = pos + neg, n_pos / max(1, n_pos + n_neg)
    expected = total * share
    if pos <= expected:
        return 0.0
    return pos * math.log(pos / expected) + (neg * math.log(neg / (total - expected)) if neg else 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """``text, toxic`` of at most about ``max_labelled`` admitted labelled documents."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, max_labelled / max(1, known.count()))
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    # The sample has a fixed bound, so this side is small whatever the size of the table.
    picked = F.broadcast(known.where(mark))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    # Copies of one text say no more than one of them.
    rows = texts.join(picked, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    return materialise(rows, "labelled")


def learn_lexicon(rows: DataFrame, n_pos: int, n_neg: int, min_support: int, max_terms: int, min_alone: int = 2) -> Lexicon:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

        def flush() -> pa.RecordBatch:
            values = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 3)
            columns = [pa.array(list(seen)), *(pa.array(values[:, i]) for i in range(3))]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "pos", "neg", "whole"])

        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {w.strip(EDGE) for w in set(words_of(text))}
                whole = {w for w in words if SHORTEST <= len(w) <= 24}
                terms = whole | {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)}
                for t in terms:
                    seen[t][0 if toxic else 1] += 1
                if toxic:
                    for t in whole:
                        seen[t][2] += 1
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    counts = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(
        count, "term string, pos bigint, neg bigint, whole bigint"
    )
    summed = counts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("whole").alias("whole"))
    common = materialise(summed.where(F.col("pos") >= min_support), "terms")
    needed = math.log(max(2, common.count())) + 1
    # The strongest terms by pos * log(pos / expected), a fixed number of them, come to the driver.
    strength = F.expr(f"pos * ln(pos / ((pos + neg) * {n_pos / max(1, n_pos + n_neg)!r}))")
    top = common.orderBy(strength.desc(), "term").limit(20 * max_terms).collect()
    ranked = sorted(
        ((gain(r["pos"], r["neg"], n_pos, n_neg), len(r["term"]), r["term"], 2 * r["whole"] < r["pos"]) for r in top),
        key=lambda x: (-round(x[0], 6), -x[1], x[2]),
    )
    kept: dict[str, bool] = {}
    starts: set[str] = set()
    open_rows = _toxic_rows_with(rows, [r["term"] for r in top])
    for g, _, term, prefix in ranked:
        if g < needed or len(kept) == max_terms:
            break
        # Related to a stronger term: one of them starts the other.
        if term in starts or any(term[:k] in kept for k in range(SHORTEST, len(term))):
            continue
        # A weaker term has to explain rows that no stronger one explains: words that only go along
        # with an insult in copies of one text do not.
        if g < ranked[0][0] / 4 and sum(term in r for r in open_rows) < min_alone:
            continue
        kept[term] = prefix
        starts.update(term[:k] for k in range(1, len(term) + 1))
        open_rows = [r for r in open_rows if term not in r]
    return Lexicon(list(kept), list(kept.values()))


def _toxic_rows_with(rows: DataFrame, terms: list[str]) -> list[set[str]]:
    """The given terms in each toxic row; both sides are bounded by the parameters of ``fit``."""
    wanted = set(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                words = {w.strip(EDGE) for w in set(words_of(text.as_py()))}
                found.append(list({w[:k] for w in words for k in range(SHORTEST, min(24, len(w)) + 1)} & wanted))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["terms"])

    found = rows.where("toxic > 0").select("text").mapInArrow(run, "terms array<string>")
    return [set(r["terms"]) for r in found.collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    min_support: int = 3,
    max_terms: int = 500,
    window: int = 8,
) -> Model:
    """Learns a model; ``max_labelled`` bounds the labelled rows used, ``max_terms`` the lexicon."""
    rows = training_rows(docs, labels, max_labelled)
    size = {r["toxic"]: r["count"] for r in rows.groupBy(F.col("toxic") > 0).count().toDF("toxic", "count").collect()}
    n_pos, n_neg = size.get(True, 0), size.get(False, 0)
    lexicon = learn_lexicon(rows, n_pos, n_neg, min_support, max_terms)
    model = Model(lexicon, prior=math.log((n_pos + 0.5) / (n_neg + 0.5)), window=window)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, seen = Matches(lexicon), Counter()
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hits = matches.hits(text, window) or {(-1, 0, False)}
                seen.update((*h, toxic > 0) for h in hits)
        keys = list(seen)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["t", "e", "q", "y", "n"])

    found = rows.mapInArrow(features, "t int, e int, q boolean, y boolean, n bigint").groupBy("t", "e", "q", "y")
    counts: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for r in found.agg(F.sum("n").alias("n")).collect():
        counts[(r["t"], r["e"], r["q"])][0 if r["y"] else 1] += r["n"]
    model.clean = _ratio(*counts.pop((-1, 0, False), [0, 0]), n_pos, n_neg)
    for t in range(len(lexicon.terms)):
        exact = max(0.0, _ratio(*counts[(t, 0, False)], n_pos, n_neg))
        for e in (0, 1):
            plain, clean = exact, counts[(t, e, False)][1]
            if e:
                seen = _ratio(*counts[(t, 1, False)], n_pos, n_neg)
                # Never seen in a clean row: half of what the right spelling says, or more if it was seen.
                plain = max(seen, exact / 2) if not clean else seen
            inside = counts[(t, e, True)]
            # Too few labelled quotations of a term: a third of the plain use.
            cited = _ratio(*inside, n_pos, n_neg) if sum(inside) >= min_support else plain / 3
            # Weak evidence adds up in long texts and is left out.
            model.weights |= {(t, e, q): w for q, w in ((False, plain), (True, cited)) if w >= 1}
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    weights, prior, clean, window = model.weights, model.prior, model.clean, model.window
    terms, prefix = model.lexicon.terms, model.lexicon.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(Lexicon(terms, prefix), weights, prior, clean, window)
        matches = Matches(own.lexicon)
        for batch in batches:
            scores = [own.score(matches, t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score"])

    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), whole_text().alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
