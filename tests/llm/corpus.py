"""Small tables for the corpus tests, with the awkward rows every operator must take."""

from __future__ import annotations

import random

# Column names the operators use inside: they must not clash with extra columns of the input.
EXTRA = "node bin piece score grp shard rep place range bucket host block path members toxic comp a b".split()


def documents(spark, rows):
    """``rows``: (doc_id, text); adds extra columns with clashing names."""
    schema = "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], schema)


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(n: int = 30) -> list[tuple]:
    """Nulls, empty, blank and very long texts, copies, repeated rows, sparse and negative ids."""
    base = [(i * 7 - 3, prose(i, 5 + 9 * i)) for i in range(n)]
    copies = [(1000 + i, base[5][1]) for i in range(12)]
    odd = [(2000, None), (2001, ""), (2002, " \n\t "), (2003, prose(99, 9000)), (2004, "one"), (2005, "ÄÖ é 中文 🙂 <|endoftext|> end")]
    return [*base, *copies, *odd, base[3], base[3], (None, "no id here"), (None, None)]


def shape(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema]
