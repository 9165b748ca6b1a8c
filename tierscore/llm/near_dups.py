"""Near-duplicate documents by a chosen-path set similarity join, confirmed on full shingle sets.

A document's set holds its distinct shingles of ``shingle`` words (lower-case A-Z, ASCII white space).
Equal sets are one class, numbered by their digest; classes are joined:

1. Every class gets minwise tokens. ``trees`` independent trees start at the root by one token each,
   now and then two, so that a pair at the threshold is expected to survive as one path.
2. The classes of a root are compared: in one block if there are at most ``node_limit``, else in random
   blocks. Comparing means estimating on the tokens with a margin. A spanning forest of the likely
   pairs of each block is confirmed on full sets, and the links give components.
3. Nodes whose classes are all in one component are done. Of the large ones those with at most FULL_CLASSES
   classes are compared in full on full sets: their classes outside the node's largest component against all
   of the node, block against block across tasks. So is a larger one of which at most ``node_limit`` classes
   are outside.
4. The rest branch again by tokens that their path chooses, level by level; deeper nodes hold ever more alike
   classes, and the rows of a level never outgrow the level before by more than a quarter. Their blocks are
   settled like those of the roots, and a node that is large at the deepest level is compared in full.

A small node whose forest was not confirmed as a whole is compared again: all its likely pairs between
different components are confirmed. Pairs inside a component change nothing. Every class asks one
partner at first, so a text is sent about once, whatever the number of trees that propose its pairs.

Rows with null ids are linked with nothing and kept; null or empty texts have empty sets and are linked
with nothing; repeated rows get equal results; rows with one id and different texts are one document,
linked with whatever one of its texts is linked with; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscore.llm.common import WordHash, ascii_words, mix, runs, shingle_hashes, whole_groups, whole_text
from tierscore.llm.components import components
from tierscore.operators.skew import lookup_join
from tierscore.session import materialise

SKETCH = 64
SIGNED = "doc_id bigint, digest binary, n_shingles bigint, roots array<bigint>, sketch binary"
BLOCK_CLASSES = 4_096  # of a block of a large node, or
BLOCK_SHINGLES = 1_000_000
FULL_CLASSES = 8_192  # of a large node that is compared in full without branching, so a row meets no more than these
TILE = 512
SURVIVE = 4  # at a similarity of 0.8 a path splits one time in four: 0.8 * 1.25 = 1


def _digest(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _shingles(number: WordHash, text: str, size: int) -> np.ndarray:
    return shingle_hashes(number.of(ascii_words(text)), size)


def minwise(sets: list[np.ndarray], roots: int, sketch: int) -> tuple[np.ndarray, np.ndarray]:
    """Minwise tokens of each non-empty set: ``roots`` of 64 bits, which name their shingle, and ``sketch`` of 8."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    seeds = mix(np.arange(1, 2 * (roots + sketch) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    named = np.empty((len(sets), roots), dtype=np.uint64)
    short = np.empty((len(sets), sketch), dtype=np.uint8)
    low = flat & np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for j in range(roots + sketch):
            values = (flat ^ seeds[2 * j]) * (seeds[2 * j + 1] | np.uint64(1))
            if j < roots:
                # The least of many values is small; the shingle itself keeps strangers apart.
                named[:, j] = np.minimum.reduceat(values >> np.uint64(32) << np.uint64(32) | low, starts)
            else:
                short[:, j - roots] = np.minimum.reduceat((values >> np.uint64(32)).astype(np.uint32), starts)
    return named, short


def sign(docs: DataFrame, shingle: int, roots: int) -> DataFrame:
    """SIGNED rows of all documents; an empty set has no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = WordHash()

        def emit(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            rows, sketches, digests = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                named, short = minwise([sets[i] for i in full], roots, SKETCH)
                for k, i in enumerate(full):
                    rows[i] = named[k].view(np.int64).tolist()
                    sketches[i] = short[k].tobytes()
                    digests[i] = _digest(sets[i])
            sizes = [len(s) for s in sets]
            columns = [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())]
            columns += [pa.array(rows, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_shingles", "roots", "sketch"])

        ids, sets, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                sets.append(_shingles(number, text.as_py(), shingle))
                size += len(sets[-1])
                if size >= 300_000 or len(ids) >= 5_000:
                    yield emit(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield emit(ids, sets)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, SIGNED)


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes with at least two classes, and their number."""
    counts = rows.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(counts, "node")


def _branch(big: DataFrame) -> DataFrame:
    """Children of the nodes in ``big``: one token chosen by the path, sometimes a second one."""

    def child(k: int) -> Column:
        at = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(SKETCH)).cast("int")
        return F.xxhash64("node", at, F.substring("sketch", at + 1, F.lit(1)))

    second = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(SURVIVE)) == 0
    nodes = F.when(second, F.array_distinct(F.array(child(0), child(1)))).otherwise(F.array(child(0)))
    return big.select(F.explode(nodes).alias("node"), "rep", "sketch", "n")


def root_nodes(classes: DataFrame, roots: int) -> DataFrame:
    """``node, rep, sketch, n, members`` of the roots of all trees that hold more than one class."""
    keys = F.transform("roots", lambda token, at: F.xxhash64(at, token))
    first = _counted(classes.select("rep", F.explode(keys).alias("node")))
    rows = first.join(classes.select("rep", "sketch", "n"), "rep").select("node", "rep", "sketch", "n", "members")
    return materialise(rows, "nodes")


def in_blocks(rows: DataFrame, node_limit: int, level: int) -> DataFrame:
    """``node, block, rep, sketch, n, whole``: nodes of one level, the large ones in random blocks."""
    block = F.pmod(F.xxhash64("rep", "node", F.lit(level)), F.ceil(F.col("members") / node_limit))
    whole = (F.col("members") <= node_limit).alias("whole")
    return rows.select(F.xxhash64("node", F.lit(level)).alias("node"), block.alias("block"), "rep", "sketch", "n", whole)


def with_components(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Adds ``comp``, the component of ``rep``, itself where it has no link yet."""
    if found is None:
        return rows.withColumn("comp", F.col("rep"))
    named = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return named.withColumn("comp", F.coalesce("component", "rep")).drop("component")


def unsettled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the groups that hold more than one component."""
    open_ = rows.groupBy(*keys).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi")
    return rows.join(open_.select(*keys), keys, "left_semi")


def _many_others(rows: DataFrame, few: int) -> DataFrame:
    """Rows of the nodes with more than ``few`` classes outside their largest component."""
    sizes = rows.groupBy("node", "comp").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("node").agg((F.sum("c") - F.max("c")).alias("_others")).where(F.col("_others") > few)
    return rows.join(open_.select("node"), "node", "left_semi")


def _widest(rows: DataFrame) -> DataFrame:
    """Rows of the nodes of at most FULL_CLASSES classes that are the largest such node of one of their classes."""
    fit = rows.where(F.col("members") <= FULL_CLASSES)
    first = fit.groupBy("rep").agg(F.max(F.struct("members", "node")).alias("_first"))
    return fit.join(first.select(F.col("_first.node").alias("node")).distinct(), "node", "left_semi")


def branches(rows: DataFrame, node_limit: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of all levels below ``rows`` (large nodes), and the nodes that stay large to the end."""
    found = None
    for level in range(1, levels + 1):
        rows = materialise(_counted(_branch(rows)).select("node", "rep", "sketch", "n", "members"), "nodes")
        blocks = in_blocks(rows, node_limit, level)
        found = blocks if found is None else found.unionByName(blocks)
        rows = rows.where(F.col("members") > node_limit)
        if level < levels and rows.isEmpty():
            break
    return found, rows


PAIRS = "node bigint, block bigint, a bigint, b bigint, same int"


def likely_pairs(blocks: DataFrame, share: float, margin: float, forest: bool) -> DataFrame:
    """PAIRS of different ``comp`` that are likely in a block: a spanning forest of its components, or all.

    The forest takes the likeliest pairs first. ``same`` counts the tokens that agree.
    """
    need = int(SKETCH * (share - margin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node", "block"]):
            cols = {n: t.column(n).to_numpy(zero_copy_only=False) for n in ("node", "block", "rep", "n", "comp")}
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            bounds = runs(cols["node"], cols["block"])
            sizes = np.diff(bounds)
            for m in np.unique(sizes[sizes > 1]).tolist():
                left, right = np.triu_indices(m, 1)
                starts = bounds[:-1][sizes == m]
                step = max(1, 200_000 // len(left))
                for at in range(0, len(starts), step):
                    base = starts[at : at + step]
                    a = (base[:, None] + left).ravel()
                    b = (base[:, None] + right).ravel()
                    n_a, n_b = cols["n"][a], cols["n"][b]
                    keep = (np.minimum(n_a, n_b) >= share * np.maximum(n_a, n_b) - 1e-9) & (cols["comp"][a] != cols["comp"][b])
                    a, b = a[keep], b[keep]
                    same = (sketch[a] == sketch[b]).sum(axis=1)
                    likely = same >= need
                    a, b, same = a[likely], b[likely], same[likely]
                    if forest and m > 2 and len(a):
                        kept = _forest(np.stack([a, b]), _parts(cols["comp"], base, m), same)
                        a, b, same = a[kept], b[kept], same[kept]
                    if len(a):
                        x, y = cols["rep"][a], cols["rep"][b]
                        columns = [cols["node"][a], cols["block"][a], np.minimum(x, y), np.maximum(x, y), same.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "block", "a", "b", "same"])

    dealt = blocks.repartition("node", "block").sortWithinPartitions("node", "block")
    return dealt.mapInArrow(run, PAIRS).where("a <> b")


def _parts(comp: np.ndarray, starts: np.ndarray, m: int) -> dict[int, int]:
    """Rows of the blocks at ``starts`` to the first row of their component in the block."""
    parts = {}
    for start in starts.tolist():
        first: dict[int, int] = {}
        for row in range(start, start + m):
            parts[row] = first.setdefault(int(comp[row]), row)
    return parts


def _forest(pairs: np.ndarray, parent: dict[int, int], weight: np.ndarray) -> list[int]:
    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i in np.argsort(-weight, kind="stable").tolist():
        x, y = root(int(pairs[0, i])), root(int(pairs[1, i]))
        if x != y:
            parent[x] = y
            kept.append(i)
    return kept


PARTNERS = 500  # of a class in one task


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union.

    The partners of a class stream past its own set, which comes first; a class with many partners
    meets them in several tasks.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("tasks"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("task"))
    dealt = materialise(dealt, "asked")
    partners = dealt.join(texts.select(F.col("rep").alias("b"), "text"), "b").select("a", "task", "b", "text")
    own = dealt.select(F.col("a").alias("rep"), "task").distinct().join(texts, "rep")
    rows = partners.unionByName(own.select(F.col("rep").alias("a"), "task", F.lit(None).cast("bigint").alias("b"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, current, mine = WordHash(), None, None
        for batch in batches:
            out = []
            for a, task, b, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                theirs = _shingles(number, text.as_py(), shingle)
                if b is None:
                    current, mine = (a, task), theirs
                elif (a, task) == current:
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(theirs) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"]
            )

    placed = rows.repartition("a", "task").sortWithinPartitions("a", "task", F.col("b").asc_nulls_first())
    return placed.mapInArrow(run, "a bigint, b bigint")


class Join:
    """Links and components so far; settles blocks of classes with their help."""

    def __init__(self, docs: DataFrame, classes: DataFrame, shingle: int, percent: int, margin: float):
        self.classes, self.shingle, self.percent, self.margin = classes, shingle, percent, margin
        self.source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
        self.links: DataFrame | None = None
        self.found: DataFrame | None = None

    @property
    def share(self) -> float:
        return self.percent / 100

    def texts_of(self, reps: DataFrame) -> DataFrame:
        """``rep, text``: a text of each class, read under its smallest id."""
        wanted = self.classes.join(reps, "rep", "left_semi").select("rep", "low", "digest", "mixed")
        # Broadcast up to a checked size: the texts of all documents need not move for a few classes.
        found = lookup_join(self.source, materialise(wanted.withColumnRenamed("low", "doc_id"), "wanted"), ["doc_id"], "inner")
        rows = materialise(found.select("rep", "digest", "mixed", "text"), "texts")
        plain = rows.where("not mixed").select("rep", "text")
        of_set = rows.where("mixed").mapInArrow(self._of_digest(), "rep bigint, text string")
        return plain.unionByName(of_set).dropDuplicates(["rep"])

    def _of_digest(self):
        """Texts that have the set of their class, for ids with several texts."""
        size = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = WordHash()
            for batch in batches:
                sets = [_shingles(number, t.as_py(), size) for t in batch.column("text")]
                same = [bool(len(s)) and _digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
                yield batch.select(["rep", "text"]).filter(pa.array(same, pa.bool_()))

        return run

    def add(self, links: DataFrame) -> None:
        links = materialise(links, "links")
        if not links.isEmpty():
            self.links = links if self.links is None else self.links.unionByName(links)
            self.found = materialise(components(self.links), "components")

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs of different components, with these."""
        named = with_components(pairs.withColumnRenamed("a", "rep"), self.found).withColumnsRenamed({"rep": "a", "comp": "comp_a"})
        named = with_components(named.withColumnRenamed("b", "rep"), self.found).withColumnsRenamed({"rep": "b", "comp": "comp_b"})
        return named.where("comp_a <> comp_b")

    def ask(self, pairs: DataFrame) -> DataFrame:
        """Confirm pairs as far as they can still change a component; the pairs that are no links.

        First every class asks its likeliest partner of a smaller id, then every two components that are still apart
        ask once, then all that is left is asked.
        """
        pairs = materialise(pairs.groupBy("a", "b").agg(F.max("same").alias("same")), "pairs")
        ends = [pairs.select(F.col(c).alias("rep")) for c in ("a", "b")]
        texts = self.texts_of(materialise(ends[0].unionByName(ends[1]).distinct(), "wanted"))
        asked = pairs.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a")).select("a", "b")
        rest = pairs
        for step in range(3):
            asked = materialise(asked, "asked")
            if asked.isEmpty():
                break
            self.add(confirm(asked, texts, self.shingle, self.percent))
            if step == 2:
                break
            rest = materialise(self._apart(rest.join(asked, ["a", "b"], "left_anti")).select("a", "b", "same"), "rest")
            asked = rest.select("a", "b")
            if step == 0:
                ways = self._apart(rest).select("a", "b", "same", F.least("comp_a", "comp_b").alias("x"), F.greatest("comp_a", "comp_b").alias("y"))
                best = ways.groupBy("x", "y").agg(F.max_by(F.struct("a", "b"), F.struct("same", "a", "b")).alias("p"))
                asked = best.select("p.*")
        return self._apart(pairs)

    def settle(self, blocks: DataFrame) -> None:
        """Find the links between components that meet in the blocks ``node, block, rep, sketch, n, whole``."""
        keys = ["node", "block"]
        rows = blocks if self.found is None else unsettled(with_components(blocks, self.found), keys)
        rows = rows if "comp" in rows.columns else with_components(rows, None)
        pairs = materialise(likely_pairs(rows, self.share, self.margin, True), "pairs")
        if pairs.isEmpty():
            return
        refused = self.ask(pairs.select("a", "b", "same")).select("a", "b")
        doubtful = materialise(pairs.join(refused, ["a", "b"], "left_semi").select(*keys).distinct(), "doubtful")
        if doubtful.isEmpty():
            return
        # Random blocks of large nodes only connect what is alike throughout; their nodes branch on.
        again = unsettled(with_components(blocks.where("whole").join(doubtful, keys, "left_semi"), self.found), keys)
        # Alike classes meet in most of their trees: a pair counts once before it is compared with the refused ones.
        every = likely_pairs(again, self.share, self.margin, False).groupBy("a", "b").agg(F.max("same").alias("same"))
        more = materialise(every.join(refused.distinct(), ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            self.ask(more)


def _meetings(large: DataFrame, most_others: int | None = None) -> DataFrame:
    """``node, i, j, own, rep, sketch, n, comp``: rows of every two blocks ``i <= j`` of a node that must meet.

    Classes of the node's largest component meet only the others, so a node of one component has no rows;
    nor has one with more than ``most_others`` others.
    """
    sizes = large.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    per = sizes.groupBy("node").agg(F.max(F.struct("c", "comp", "s")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))

    def blocks(c: Column, s: Column) -> Column:
        return F.ceil(F.greatest(c / BLOCK_CLASSES, s / BLOCK_SHINGLES)).cast("int")

    top, others = blocks(F.col("top.c"), F.col("top.s")), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s"))
    per = per.where("c > top.c")
    per = per if most_others is None else per.where(F.col("c") - F.col("top.c") <= most_others)
    per = per.select("node", F.col("top.comp").alias("main"), top.alias("tops"), others.alias("others"))
    rows, dealt = large.join(per, "node"), F.xxhash64("rep", "node", F.lit("block"))
    main = F.col("comp") == F.col("main")
    own = F.when(main, F.col("others") + F.pmod(dealt, F.col("tops"))).otherwise(F.pmod(dealt, F.col("others"))).cast("int")
    met = F.sequence(F.lit(0), F.col("others") - 1 + F.when(main, 0).otherwise(F.col("tops")))
    rows = rows.select("node", own.alias("own"), F.explode(met).alias("met"), "rep", "sketch", "n", "comp")
    return rows.select("node", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "rep", "sketch", "n", "comp")


def _sides(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the two blocks of each group of ``t``; equal for a block against itself."""
    cols = [t.column(n).to_numpy(zero_copy_only=False) for n in ("node", "i", "j", "own")]
    bounds = runs(*cols[:3])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = cols[3][lo:hi]
        left = lo + np.flatnonzero(own == cols[1][lo])
        yield left, left if cols[1][lo] == cols[2][lo] else lo + np.flatnonzero(own == cols[2][lo])


def _tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(left), TILE):
        for to in range(at if left is right else 0, len(right), TILE):
            yield left[at : at + TILE], right[to : to + TILE]


MET = "node bigint, i int, j int, own int, rep bigint, comp bigint"


def _with_partners(meetings: DataFrame, share: float, margin: float) -> DataFrame:
    """MET rows that have a likely pair with another component among the blocks that meet."""
    need = int(SKETCH * (share - margin))
    names = [c.split()[0] for c in MET.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node", "i", "j"]):
            n, comp = (t.column(c).to_numpy(zero_copy_only=False) for c in ("n", "comp"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            marked = np.zeros(len(n), dtype=bool)
            for left, right in _sides(t):
                for a, b in _tiles(left, right):
                    same = np.zeros((len(a), len(b)), dtype=np.uint8)
                    for x, y in zip(sketch[a].T, sketch[b].T, strict=True):
                        same += x[:, None] == y
                    small, big = np.minimum(n[a][:, None], n[b]), np.maximum(n[a][:, None], n[b])
                    likely = (same >= need) & (comp[a][:, None] != comp[b]) & (small >= share * big - 1e-9)
                    marked[a] |= likely.any(axis=1)
                    marked[b] |= likely.any(axis=0)
            yield from t.select(names).filter(pa.array(marked)).to_batches()

    return meetings.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(run, MET)


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, columns: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of the sets ``a`` with the sets ``b``."""
    flat = [np.concatenate([sets[k] for k in side]) for side in (a, b)]
    row = [np.repeat(np.arange(len(side)), [len(sets[k]) for k in side]) for side in (a, b)]
    both = np.intersect1d(*flat)
    held = []
    for values, of in zip(flat, row, strict=True):
        at = np.searchsorted(both, values)
        known = at < len(both)
        known[known] = both[at[known]] == values[known]
        at, of = at[known], of[known]
        order = np.argsort(at, kind="stable")
        held.append((at[order], of[order]))
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for lo in range(0, len(both), columns):
        ones = []
        for (at, of), side in zip(held, (a, b), strict=True):
            x, y = np.searchsorted(at, (lo, lo + columns))
            ones.append(np.zeros((len(side), min(columns, len(both) - lo)), dtype=np.float32))
            ones[-1][of[x:y], at[x:y] - lo] = 1
        out += (ones[0] @ ones[1].T).astype(np.int64)
    return out


def full_links(met: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``a, b`` on full sets: a spanning forest of all pairs of different components of the blocks that meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = WordHash()
        for t in whole_groups(batches, ["node", "i", "j"], 2_000):
            rep, comp = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp"))
            sets = [_shingles(number, text.as_py(), shingle) for text in t.column("text")]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            for left, right in _sides(t):
                label, out = comp.copy(), []
                rows = np.union1d(left, right)
                for a, b in _tiles(left, right):
                    apart = label[a][:, None] != label[b]
                    if not apart.any():
                        continue
                    both = _shared(sets, a, b)
                    linked = 100 * both >= percent * (n[a][:, None] + n[b] - both)
                    while (open_ := linked & (label[a][:, None] != label[b])).any():
                        for x in np.flatnonzero(open_.any(axis=1)).tolist():
                            p, q = a[x], b[open_[x].argmax()]
                            if label[p] != label[q]:
                                label[rows[label[rows] == label[q]]] = label[p]
                                out.append((min(rep[p], rep[q]), max(rep[p], rep[q])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = met.join(texts, "rep").select("node", "i", "j", "own", "rep", "comp", "text")
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    trees: int = 16,
    node_limit: int = 64,
    levels: int = 6,
    margin: float = 0.2,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    ``margin``: four standard deviations of the estimate on SKETCH tokens.
    """
    roots = trees + trees // SURVIVE
    signed = materialise(sign(docs, shingle, roots).withColumn("rep", F.xxhash64("digest")), "signed")
    full = signed.where("doc_id is not null and digest is not null")
    several = full.groupBy("doc_id").agg(F.min("rep").alias("one"), F.max("rep").alias("other")).where("one <> other")
    several = materialise(several.select("doc_id", "one"), "several")
    first = [F.first(c).alias(c) for c in ("roots", "sketch")]
    classes = full.groupBy("rep", "digest").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), *first)
    mixed = several.select(F.col("doc_id").alias("low"), F.lit(True).alias("mixed"))
    classes = materialise(classes.join(mixed, "low", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))), "classes")
    joined = Join(docs, classes, shingle, percent, margin)
    joined.add(full.join(several, "doc_id").where("rep <> one").select(F.col("one").alias("a"), F.col("rep").alias("b")).distinct())
    top = root_nodes(classes, roots)
    joined.settle(in_blocks(top, node_limit, 0))
    large = unsettled(with_components(top.where(F.col("members") > node_limit), joined.found), ["node"])
    large = materialise(large.drop("comp"), "nodes")
    if not large.isEmpty():
        # Nodes of bounded size meet in full and are done. The largest ones of each class come first: what they link is in
        # one component when the nodes of the other trees meet.
        wide = materialise(_widest(large), "nodes")
        _compare_large(joined, wide)
        rest = large.join(wide.select("node").distinct(), "node", "left_anti")
        _compare_large(joined, rest.where(F.col("members") <= FULL_CLASSES))
        # Larger ones with few classes outside their largest component can meet these in full.
        _compare_large(joined, large.where(F.col("members") > FULL_CLASSES), node_limit)
        large = _many_others(with_components(large.where(F.col("members") > FULL_CLASSES), joined.found), node_limit)
        large = materialise(large.drop("comp"), "nodes")
    if not large.isEmpty():
        blocks, left = branches(large, node_limit, levels)
        joined.settle(blocks)
        _compare_large(joined, left)
    owner = with_components(classes.select("rep", "low"), joined.found)
    least = owner.groupBy("comp").agg(F.min("low").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "rep", "digest")
    named = owner.join(least, "comp").select("rep", "component_id")
    rows = rows.withColumn("rep", F.when(F.col("digest").isNotNull(), F.col("rep"))).join(named, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _compare_large(joined: Join, left: DataFrame, most_others: int | None = None) -> None:
    """Links on full sets between the components of nodes that stayed large."""
    rows = with_components(left, joined.found).select("node", "rep", "sketch", "n", "comp")
    met = materialise(_with_partners(_meetings(rows, most_others), joined.share, joined.margin), "met")
    if not met.isEmpty():
        texts = joined.texts_of(met.select("rep").distinct())
        joined.add(full_links(met, texts, joined.shingle, joined.percent))
