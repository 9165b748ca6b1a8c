"""Main text of web pages: page structure, and boilerplate found by a suffix array per host.

1. Every page is read into blocks of text with their place in the page (article, main, other) and
   whether a menu, header, footer, sidebar, notice, advert, form or reader comment holds them.
2. The word streams of the pages of one host are put end to end and their suffixes sorted (prefix
   doubling, to the depth of ``min_run`` words). Suffixes that share that many words are neighbours;
   a run found on enough distinct pages is boilerplate, and every word under such a run is covered.
3. A page keeps its article if it has one, else its main part, else all blocks. Outside an article,
   blocks that boilerplate covers are removed and the unique runs stay. Inside one, a block goes only if
   runs cover it that stand on most pages of the host; copies of a page count once for that, and where
   such blocks make up more than a small part of an article, they are its text and stay.

Pages are always counted over the whole host. A host of at most ``bucket_pages`` pages and ``bucket_bytes``
bytes is judged in one group. A larger one is dealt at random to buckets of that size: a run that is on
enough pages of the host is on its part of them in at least one bucket, so the runs that are there in some
bucket are the only ones to count (``candidates``). A second look counts these on all pages of the host
(``common_runs``), and a last one removes what they cover. Pages move once, to their bucket; the later
looks read them where they lie. Null html counts as empty, null urls share one
unnamed host, repeated rows give repeated rows, pages without text give the empty text, an empty
table gives no rows and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscore.llm.common import MIX, WordHash, mix, whole_text
from tierscore.operators.skew import lookup_join
from tierscore.session import materialise

LEX = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
# Element names by their role in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = (
    set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small".split())
    | set("span strike strong sub sup time tt u var wbr img picture source center nobr".split())
)
BAD_TAGS = set("nav footer aside form button select dialog menu svg math canvas object template head datalist optgroup".split())
ENDS_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BAD_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer banner cookie cookies consent gdpr notice alert popup modal "
    "newsletter subscribe subscription promo promotion advert advertisement advertising ad ads sponsor sponsored comment comments "
    "disqus replies social share sharing related recommended widget pagination pager login signup search toolbar skip masthead".split()
)
HEADER_WORDS = {"header", "topbar"}
MAIN_WORDS = {"content", "main", "article", "post", "entry", "story"}
PARSED = "page_id bigint, url string, bucket string, host string, total bigint, texts array<string>, levels array<int>"
RUNS = "host string, inside boolean, run bigint"
COUNTED = "host string, inside boolean, run bigint, article string, n bigint"
KEPT_RUNS = 2_000_000  # runs that one look sends to every task, 16 MB of hashes
PAGES = "page_id bigint, url string, text string, n_chars bigint"


def attributes(source: str) -> dict[str, str]:
    return {n.lower(): v.strip("\"'") for n, v in ATTRIBUTE.findall(source)} if source.strip(" /\n\t\r") else {}


def _words(given: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id", "role") for w in WORD.findall(given.get(k, ""))}


def place_of(name: str, given: dict[str, str], in_article: bool) -> tuple[bool, int]:
    """Whether an element's text is no main text, and its level: 3 article, 2 main, 1 content, 0 other."""
    if name in ("html", "body"):
        return False, 0
    words = _words(given)
    bad = name in BAD_TAGS or bool(words & BAD_WORDS) or "hidden" in given
    if not in_article:
        bad = bad or name == "header" or bool(words & HEADER_WORDS)
    if name == "article":
        return bad, 3
    if name == "main" or given.get("role") == "main":
        return bad and name != "main", 2
    return bad, 1 if words & MAIN_WORDS else 0


def blocks_of(page: str) -> list[tuple[str, int]]:
    """Texts of the blocks outside bad elements, in page order, with their levels."""
    found: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, bad so far, level so far

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((text, stack[-1][2] if stack else 0))

    at = 0
    while True:
        m = LEX.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not (stack and stack[-1][1]):
            parts.append(page[at:end])
        if m is None:
            flush()
            return found
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name not in INLINE:
                flush()
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        outer = stack[-1] if stack else ("", False, 0)
        if name in INLINE:
            bad = bool(rest.strip()) and place_of(name, attributes(rest), True)[0]
            if bad and not rest.rstrip().endswith("/"):
                flush()
                stack.append((name, True, outer[2]))
            continue
        flush()
        while stack and (stack[-1][0] == "p" or stack[-1][0] in ENDS_SELF.get(name, ())):
            stack.pop()
        outer = stack[-1] if stack else ("", False, 0)
        bad, level = place_of(name, attributes(rest), outer[2] == 3)
        stack.append((name, outer[1] or bad, max(outer[2], level)))


def suffix_classes(tokens: np.ndarray, depth: int) -> np.ndarray:
    """For every suffix the rank of its first ``depth`` tokens among all suffixes (prefix doubling)."""
    _, rank = np.unique(tokens, return_inverse=True)
    have = 1
    while have < depth:
        # The last step overlaps so that exactly ``depth`` tokens are compared.
        step = min(have, depth - have)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (int(rank.max()) + 2) + after, return_inverse=True)
        have += step
    return rank


@dataclass(frozen=True)
class Rules:
    """When a run is boilerplate: ``min_run`` words on ``min_pages`` pages and ``min_share`` of a host's pages.

    A block is removed from ``covered`` of its words on. The article values hold inside articles;
    ``article_part`` is the largest part of an article that may be boilerplate.
    """

    min_run: int = 8
    min_pages: int = 3
    min_share: float = 0.02
    covered: float = 0.8
    article_pages: int = 8
    article_share: float = 0.5
    article_part: float = 0.25

    def need(self, total: int) -> int:
        """Pages that a run must be on, of a host of ``total`` pages."""
        return max(self.min_pages, math.ceil(self.min_share * total))

    def article_need(self, total: int) -> int:
        """Distinct articles that a run must be in."""
        return max(self.article_pages, math.ceil(self.article_share * total))


def covered_words(tokens: np.ndarray, page: np.ndarray, depth: int, min_pages: int, names: np.ndarray | None = None) -> np.ndarray:
    """Words under a run of ``depth`` words that occurs on at least ``min_pages`` distinct pages.

    ``names``: pages of one name count as one.
    """
    if len(tokens) < depth:
        return np.zeros(len(tokens), dtype=bool)
    rank = suffix_classes(tokens, depth)
    inside = np.zeros(len(tokens), dtype=bool)
    inside[: len(tokens) - depth + 1] = page[: len(tokens) - depth + 1] == page[depth - 1 :]
    named = page if names is None else names[page]
    pairs = np.unique(rank[inside].astype(np.int64) * (int(page.max()) + 1) + named[inside])
    pages = np.bincount(pairs // (int(page.max()) + 1), minlength=int(rank.max()) + 1)
    starts = inside & (pages[rank] >= min_pages)
    change = np.zeros(len(tokens) + 1, dtype=np.int64)
    change[:-1] += starts
    at = np.flatnonzero(starts) + depth
    np.add.at(change, at, -1)
    return np.cumsum(change)[:-1] > 0


def _shares(mask: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Covered part of each of the blocks that follow each other with ``sizes`` words."""
    total = np.concatenate([[0], np.cumsum(mask.astype(np.int64))])
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)


def _article_blocks(pages, lists, number, rules: Rules) -> dict[int, list[bool]]:
    """Per page with an article which of its article blocks stay."""
    own = {i: [k for k, n in enumerate(levels) if n == 3] for i, (_, levels) in enumerate(pages) if 3 in levels}
    need = rules.article_need(len(pages))
    if len(own) < need:
        return {}
    words = {i: [lists[i][k] for k in at] for i, at in own.items()}
    sizes = np.array([len(b) for blocks in words.values() for b in blocks], dtype=np.int64)
    tokens = number.of([w for blocks in words.values() for b in blocks for w in b])
    whole = {i: tuple(map(tuple, blocks)) for i, blocks in words.items()}
    copies: dict[tuple, int] = {}
    names = [copies.setdefault(whole[i], len(copies)) for i in words]
    if len(copies) < need:
        return {}
    owner = np.repeat(np.arange(len(words)), [sum(map(len, blocks)) for blocks in words.values()])
    mask = covered_words(tokens, owner, rules.min_run, need, np.array(names))
    gone = _shares(mask, sizes) >= rules.covered
    stay, at = {}, 0
    for i, blocks in words.items():
        here, length = gone[at : at + len(blocks)], sizes[at : at + len(blocks)]
        few = length[here].sum() <= rules.article_part * length.sum()
        stay[i] = (~here).tolist() if few else [True] * len(blocks)
        at += len(blocks)
    return stay


def main_texts(pages: list[tuple[list[str], list[int]]], rules: Rules) -> Iterator[str]:
    """The main text of each page of a host."""
    number = WordHash()
    lists = [[t.lower().encode("utf-8", "surrogatepass").split() for t in texts] for texts, _ in pages]
    sizes = np.array([len(words) for page in lists for words in page], dtype=np.int64)
    tokens = number.of([w for page in lists for words in page for w in words])
    owner = np.repeat(np.arange(len(pages)), [sum(map(len, page)) for page in lists])
    need = rules.need(len(pages))
    share = _shares(covered_words(tokens, owner, rules.min_run, need), sizes)
    articles = _article_blocks(pages, lists, number, rules)
    at = 0
    for i, (texts, levels) in enumerate(pages):
        best = max(levels, default=0)
        if best == 3:
            own = [t for t, level in zip(texts, levels, strict=True) if level == 3]
            keep = [t for t, stays in zip(own, articles.get(i, [True] * len(own)), strict=True) if stays]
        else:
            keep = [t for k, (t, level) in enumerate(zip(texts, levels, strict=True)) if level == best and share[at + k] < rules.covered]
        at += len(texts)
        yield "\n\n".join(keep)


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(whole_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def run_hashes(tokens: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the ``depth`` tokens from each place on, where there are as many."""
    if len(tokens) < depth:
        return np.zeros(0, dtype=np.int64)
    acc = np.zeros(len(tokens) - depth + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            acc = acc * MIX + tokens[k : len(tokens) - depth + 1 + k]
    return mix(acc).view(np.int64)


def _places(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the values are in the sorted ``known``, and where there."""
    if not len(known):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    met = np.flatnonzero(known[at] == values)
    return met, at[met]


class Page:
    """The runs of one page: of all its blocks, and of those of its article."""

    def __init__(self, texts: list[str], levels: list[int], number: WordHash, depth: int):
        self.texts, self.levels, self.depth = texts, levels, depth
        self.best = max(levels, default=0)
        self.lists = [words_of(t) for t in texts]
        self.own = [k for k, n in enumerate(levels) if n == 3]
        self.tokens = [number.of(words) for words in self.lists]

    def runs(self, inside: bool) -> np.ndarray:
        tokens = [self.tokens[k] for k in self.own] if inside else self.tokens
        return run_hashes(np.concatenate(tokens), self.depth) if tokens else np.zeros(0, dtype=np.int64)

    def article(self) -> str:
        """Equal for pages whose articles have the same words in the same blocks."""
        return hashlib.md5(b"\n".join(b" ".join(self.lists[k]) for k in self.own), usedforsecurity=False).hexdigest()

    def gone(self, inside: bool, common: np.ndarray, rules: Rules) -> np.ndarray:
        """Which blocks (of the article, if ``inside``) the runs in ``common`` cover."""
        sizes = np.array([len(self.tokens[k]) for k in (self.own if inside else range(len(self.texts)))], dtype=np.int64)
        change = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
        at, _ = _places(common, self.runs(inside))
        change[at] += 1
        change[at + self.depth] -= 1
        return _shares(np.cumsum(change)[:-1] > 0, sizes) >= rules.covered

    def text(self, common: tuple[np.ndarray, np.ndarray], rules: Rules) -> str:
        """The main text, without what the common runs of all blocks and of the articles cover."""
        if self.best == 3:
            gone = self.gone(True, common[1], rules)
            sizes = np.array([len(self.tokens[k]) for k in self.own], dtype=np.int64)
            few = sizes[gone].sum() <= rules.article_part * sizes.sum()
            return "\n\n".join(self.texts[k] for k, g in zip(self.own, gone, strict=True) if not (g and few))
        gone = self.gone(False, common[0], rules)
        return "\n\n".join(t for t, n, g in zip(self.texts, self.levels, gone, strict=True) if n == self.best and not g)


def common_in(pages: list[Page], inside: bool, need: int) -> np.ndarray:
    """Runs on at least ``need`` of the pages, or in as many distinct articles."""
    if inside:
        pages = list({p.article(): p for p in pages if p.own}.values())
    if len(pages) < need:
        return np.zeros(0, dtype=np.int64)
    found, counts = np.unique(np.concatenate([np.unique(p.runs(inside)) for p in pages]), return_counts=True)
    return found[counts >= need]


def parse_pages(pages: DataFrame) -> DataFrame:
    """PARSED rows: the blocks of every page of ``page_id, url, bucket, host, total, html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                blocks = [blocks_of(h.as_py()) for h in part.column(5)]
                texts = pa.array([[t for t, _ in b] for b in blocks], pa.list_(pa.string()))
                levels = pa.array([[n for _, n in b] for b in blocks], pa.list_(pa.int32()))
                names = ["page_id", "url", "bucket", "host", "total", "texts", "levels"]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], texts, levels], names=names)

    return pages.select("page_id", "url", "bucket", "host", "total", "html").mapInArrow(run, PARSED)


def _runs_table(host: str, parts: list[tuple[bool, np.ndarray]]) -> pa.Table:
    size = sum(len(r) for _, r in parts)
    return pa.table(
        {
            "host": pa.array([host] * size, pa.string()),
            "inside": pa.array([i for i, r in parts for _ in range(len(r))], pa.bool_()),
            "run": pa.array(np.concatenate([r for _, r in parts]) if parts else [], pa.int64()),
        }
    )


def candidates(parsed: DataFrame, rules: Rules) -> DataFrame:
    """RUNS that a bucket holds at least as often as its part of the pages a host needs; others are on too few.

    A null run says that the host has pages without an article; only there do runs of all blocks count.
    """

    def judge(group: pa.Table) -> pa.Table:
        number = WordHash()
        rows = zip(group.column("texts").to_pylist(), group.column("levels").to_pylist(), strict=True)
        pages = [Page(t, n, number, rules.min_run) for t, n in rows]
        host, total = group.column("host")[0].as_py(), group.column("total")[0].as_py()
        parts = []
        for inside, need in ((False, rules.need(total)), (True, rules.article_need(total))):
            parts.append((inside, common_in(pages, inside, -(-need * len(pages) // total))))
        found = _runs_table(host, parts)
        if any(p.texts and p.best < 3 for p in pages):
            mark = pa.table({"host": [host], "inside": [False], "run": pa.array([None], pa.int64())})
            found = pa.concat_tables([found, mark])
        return found

    found = materialise(parsed.groupBy("bucket").applyInArrow(judge, RUNS).distinct(), "runs")
    open_ = found.where("run is null").select("host")
    return found.where("inside").unionByName(found.where("not inside and run is not null").join(open_, "host", "left_semi"))


def _by_host(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted runs of all blocks and of the articles of each host; ``rows`` has a bounded number."""
    t = rows.select("host", "inside", "run").toArrow()
    hosts, inside, run = t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist()
    held: dict[str, tuple[list, list]] = {}
    for h, i, r in zip(hosts, inside, run, strict=True):
        held.setdefault(h, ([], []))[i].append(r)
    return {h: tuple(np.array(sorted(x), dtype=np.int64) for x in both) for h, both in held.items()}


def common_runs(rows: DataFrame, found: DataFrame, rules: Rules, kept_runs: int) -> DataFrame:
    """RUNS of ``found`` that are common on their whole host, counted on its pages ``host, total, html``."""
    found = materialise(found, "candidates")
    looks, counted = -(-found.count() // kept_runs), None
    for look in range(looks):
        wanted = _by_host(found.where(F.pmod(F.xxhash64("host", "inside", "run"), F.lit(looks)) == look))

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            number = WordHash()
            counts = {h: np.zeros(len(both[0]), dtype=np.int64) for h, both in wanted.items()}
            names = [c.split()[0] for c in COUNTED.split(", ")]
            for batch in batches:
                for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if host not in wanted:
                        continue
                    blocks = blocks_of(page.as_py())
                    one = Page([t for t, _ in blocks], [n for _, n in blocks], number, rules.min_run)
                    plain, inside = wanted[host]
                    counts[host][_places(plain, np.unique(one.runs(False)))[1]] += 1
                    met = inside[_places(inside, np.unique(one.runs(True)))[1]]
                    if len(met):
                        name, n = one.article(), len(met)
                        columns = [[host] * n, [True] * n, met, [name] * n, [1] * n]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            for host, n in counts.items():
                plain = wanted[host][0]
                columns = [pa.array([host] * len(n), pa.string()), pa.array([False] * len(n), pa.bool_()), pa.array(plain)]
                columns += [pa.array([None] * len(n), pa.string()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        part = rows.select("host", "html").mapInArrow(run, COUNTED)
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return found
    plain = counted.where("not inside").groupBy("host", "inside", "run").agg(F.sum("n").alias("n"))
    articles = counted.where("inside").select("host", "inside", "run", "article").distinct()
    articles = articles.groupBy("host", "inside", "run").agg(F.count("*").alias("n"))
    needs = rows.groupBy("host").agg(F.first("total").alias("total"))
    share, least = (F.when(F.col("inside"), a).otherwise(b) for a, b in ((rules.article_share, rules.min_share), (rules.article_pages, rules.min_pages)))
    need = F.greatest(least, F.ceil(share * F.col("total")))
    both = plain.unionByName(articles).join(needs, "host").where(F.col("n") >= need)
    return materialise(both.select("host", "inside", "run"), "common")


def cut_pages(rows: DataFrame, common: DataFrame, rules: Rules, kept_runs: int) -> DataFrame:
    """PAGES rows of ``page_id, url, host, html``, without what the common runs of their hosts cover."""
    looks, cut = max(1, -(-common.count() // kept_runs)), None
    look_of = F.pmod(F.xxhash64("host"), F.lit(looks))
    for look in range(looks):
        known = _by_host(common.where(look_of == look))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            number = WordHash()

            def text_of(host: str, page: str) -> str:
                blocks = blocks_of(page)
                if host not in known:
                    best = max((n for _, n in blocks), default=0)
                    return "\n\n".join(t for t, n in blocks if n == best)
                return Page([t for t, _ in blocks], [n for _, n in blocks], number, rules.min_run).text(known[host], rules)

            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    texts = [text_of(h, p.as_py()) for h, p in zip(part.column(2).to_pylist(), part.column(3), strict=True)]
                    columns = [*part.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

        part = rows.where(look_of == look).select("page_id", "url", "host", "html").mapInArrow(run, PAGES)
        cut = part if cut is None else cut.unionByName(part)
    return cut


def extract(
    pages: DataFrame, rules: Rules = Rules(), bucket_pages: int = 512, bucket_bytes: int = 8_000_000, kept_runs: int = KEPT_RUNS
) -> DataFrame:
    """PAGES rows."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host_of("url").alias("host"), whole_text("html").alias("html"))
    buckets = F.greatest(F.ceil(F.count("*") / bucket_pages), F.ceil(F.sum(F.octet_length("html")) / bucket_bytes), F.lit(1))
    sizes = rows.groupBy("host").agg(buckets.cast("int").alias("buckets"), F.count("*").alias("total")).where("buckets > 1")
    sizes = materialise(sizes, "hosts")
    rows = lookup_join(rows, sizes, ["host"])
    # One column: grouped by (host, bucket), all buckets of a host could stay in one task.
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("buckets", F.lit(1)))
    rows = rows.withColumn("bucket", F.concat_ws("#", part.cast("string"), "host"))

    def judge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("page_id", "ascending"), ("url", "ascending")])
        pages_ = list(zip(group.column("texts").to_pylist(), group.column("levels").to_pylist(), strict=True))
        texts = list(main_texts(pages_, rules))
        return pa.table(
            {
                "page_id": group.column("page_id"),
                "url": group.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
        )

    small, large = rows.where("buckets is null"), rows.where("buckets is not null")
    judged = parse_pages(small).groupBy("bucket").applyInArrow(judge, PAGES)
    if sizes.isEmpty():
        return judged
    common = common_runs(large, candidates(parse_pages(large), rules), rules, kept_runs)
    return judged.unionByName(cut_pages(large, common, rules, kept_runs))
