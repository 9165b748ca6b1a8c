"""Secrets in texts, and whose they are: widely copied examples apart from live-looking credentials.

Base kinds are found by fixed patterns, leftmost and without overlap per kind: assignments to secret
names, access keys, long hexadecimal numbers. The kind ``live`` adds what those miss: long mixed tokens
that belong to few owners of the corpus. A candidate's value is known by its digest; over the whole
corpus its distinct owners, and its distinct repositories of those owners, are counted. A value with
``example_owners`` owners or more is an example that everybody copies: such a token adds no span, and
a base span stays but is counted as an example.

Everything is built-in column functions. A text is cut at the matches of a pattern; the lengths of
what lies between and of the matches, added up along the text, give their places in code points.
Texts never move: only the candidates' numbers and digests do. A value that a third of all rows copy
is counted once per repository before it moves, and its verdict comes back by a broadcast of checked
size or by a salted join.

Null texts count as empty; null owners and repositories are one owner and one repository; repeated
rows get equal results each and are one repository; rows without secrets have empty spans; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscore.llm.common import whole_text
from tierscore.operators.skew import lookup_join
from tierscore.session import materialise

# The patterns of the base kinds and the least length of what counts.
NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = f"""(?i:({NAMES}))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# The added kind: a whole long run of token characters.
LIVE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LIVE_DISTINCT = 8  # characters at least, a digit and a letter among them
KINDS = ["assign", "access", "hex", "live"]
ANY = f"""(?i:{NAMES})["']?\\x20*[:=]|{ACCESS}|{HEX}|[A-Za-z0-9+/_=-]{{20}}"""

HIT = "array<struct<kind:int,at:int,gap:int,size:int,digest:string>>"


def _hits(kind: int, pattern: str, value: Column, counts: Column) -> Column:
    """Matches of one pattern in ``text`` in order: characters since the last one, own size, digest if it counts.

    ``value`` and ``counts`` are functions of the matched string.
    """
    between = F.split(F.col("text"), pattern, -1)
    found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))

    def hit(pair: Column, at: Column) -> Column:
        m = pair["1"]
        return F.struct(
            F.lit(kind).alias("kind"),
            at.cast("int").alias("at"),
            F.char_length(pair["0"]).alias("gap"),
            F.char_length(m).alias("size"),
            F.when(counts(m), F.sha2(value(m).cast("binary"), 256)).alias("digest"),
        )

    # What follows the last match has no match of its own.
    return F.transform(F.filter(F.arrays_zip(between, found), lambda pair: pair["1"].isNotNull()), hit)


def _assigned(m: Column) -> Column:
    return F.regexp_extract(m, ASSIGN, 2)


def _looks_live(m: Column) -> Column:
    variety = F.size(F.array_distinct(F.split(m, "")))
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (variety >= LIVE_DISTINCT)


def find_candidates(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """``row, doc_id, repository, owner, hits`` of every row."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        whole_text().alias("text"),
    )
    hits = F.concat(
        _hits(0, ASSIGN, _assigned, lambda m: F.char_length(_assigned(m)) >= ASSIGN_LEAST),
        _hits(1, ACCESS, lambda m: m, lambda m: F.lit(True)),
        _hits(2, HEX, lambda m: m, lambda m: F.lit(True)),
        _hits(3, LIVE, lambda m: m, _looks_live),
    )
    found = F.when(F.col("text").rlike(ANY), hits).otherwise(F.array().cast(HIT))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", found.cast(HIT).alias("hits"))


def place(found: DataFrame) -> DataFrame:
    """``row, repository, owner, kind, start, stop, digest``: one row per candidate that counts."""
    each = found.select("row", "repository", "owner", F.inline("hits"))
    line = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(line))
    placed = placed.withColumn("start", F.col("stop") - F.col("size")).where("digest is not null")
    return placed.select("row", "repository", "owner", "kind", "start", "stop", "digest")


def ownership(candidates: DataFrame) -> DataFrame:
    """``digest, owners, repositories``: distinct ones over the whole corpus, combined before they move."""
    pairs = candidates.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = 3) -> DataFrame:
    """``doc_id, spans`` of every row: structs ``start, kind, stop, owners, repositories, example`` in order.

    ``kind``: a place in KINDS. ``example_owners``: a value of so many owners is an example.
    """
    found = materialise(find_candidates(docs, repository, owner), "found")
    candidates = materialise(place(found), "candidates")
    owners = materialise(ownership(candidates), "ownership")
    known = lookup_join(candidates.drop("repository", "owner"), owners, ["digest"], "inner")
    known = known.withColumn("example", F.col("owners") >= example_owners)
    live = F.col("kind") == KINDS.index("live")
    # A token that touches a base span says nothing new.
    line = Window.partitionBy("row").orderBy("start", "kind")
    base_stop, base_start = F.when(~live, F.col("stop")), F.when(~live, F.col("start"))
    covered = F.coalesce(F.max(base_stop).over(line.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False))
    covers = F.coalesce(F.min(base_start).over(line.rowsBetween(1, Window.unboundedFollowing)) < F.col("stop"), F.lit(False))
    known = known.withColumn("touches", covered | covers).where(~live | ~(F.col("example") | F.col("touches")))
    span = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("start", "kind", "stop", "owners", "repositories")], "example")
    spans = known.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:bigint,stop:bigint,owners:bigint,repositories:bigint,example:boolean>>")
    joined = found.select("row", "doc_id").join(spans, "row", "left")
    return joined.select("doc_id", F.coalesce("spans", none).alias("spans"))


def as_string(spans: Column) -> Column:
    """``kind:start:stop`` of spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"], s["stop"]))
    return F.array_join(one, ",")
