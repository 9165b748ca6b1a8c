"""Periodic runs against a scan of all periods, and the query against the contract in plain Python."""

import hashlib
import random
import re
import zlib

import corpus
import numpy as np
import pytest

from tierscore.llm import periodic_runs as pr
from tierscore.llm.queries import op11_periodic_runs

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """``(start, period, length)`` of all runs, by trying every period; the smallest one names a stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(least, 2 * q):
                found.setdefault((at, end + q), q)
            at = max(end, at) + 1
    return sorted((s, q, e - s) for (s, e), q in found.items())


def stitched(pieces):
    out = []
    for period, start, stop in sorted(set(pieces)):
        if out and out[-1][0] == period and start <= out[-1][2] - period:
            out[-1] = (period, out[-1][1], max(stop, out[-1][2]))
        else:
            out.append((period, start, stop))
    return sorted((start, period, stop - start) for period, start, stop in out)


def made(rng):
    n, k = rng.randrange(0, 240), rng.choice([1, 2, 2, 3, 5, 50])
    words = [rng.randrange(k) for _ in range(n)]
    if n > 5 and rng.random() < 0.6:
        at = rng.randrange(n)
        period = 1 + rng.randrange(max(1, (n - at) // 2 + 1))
        for i in range(at + period, n):
            words[i] = words[i - period]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(n)] = rng.randrange(k)
    return words


@pytest.mark.parametrize("least", [4, 7, 12])
def test_fragments_hold_every_run(least):
    rng = random.Random(least)
    for _ in range(300):
        words = made(rng)
        got = pr.fragments(np.array(words, dtype=np.int64), least) if len(words) >= least else []
        assert stitched(got) == brute(words, least), words


def test_long_runs_of_every_scale():
    rng = random.Random(5)
    block = [rng.randrange(1000) for _ in range(1500)]
    words = [*block, *block, *block[:700], *[1] * 400, *[1, 2, 3] * 200, *block[::-1]]
    assert stitched(pr.fragments(np.array(words), 12)) == brute(words)


def test_z_function():
    assert pr.z_function(np.array([1, 1, 2, 1, 1, 2, 1])).tolist() == [0, 1, 0, 4, 1, 0, 1]
    assert pr.z_function(np.full(100, 3)).tolist() == [0, *range(99, 0, -1)]


def contract(doc_id, text):
    words = SPACE.findall((text or "").encode())
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    head = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of():
    rng = random.Random(9)
    texts = [(20 + i, " ".join(f"w{x}" for x in made(rng))) for i in range(200)]
    odd = [(3000, "a " * 4000), (3001, "\x0bx y \x1c x y\t" * 9), (3002, None), (3003, " \n"), (None, "b c " * 9), (3004, "é " * 12)]
    return corpus.awkward(12) + texts + odd + texts[:2]


def test_query_against_plain_python(spark, tmp_path):
    corpus.documents(spark, rows_of()).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path)).select(*NAMES)
    expected = [contract(*r) for r in rows_of()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert [t for _, t in corpus.shape(got)] == ["bigint"] * 6 + ["string"] * 2


def test_operator_gives_texts(spark):
    docs = corpus.documents(spark, [(1, "p q " + "a b c " * 8 + "end"), (2, "nothing here"), (3, None)])
    got = {r["doc_id"]: r for r in pr.periodic_runs(docs).collect()}
    assert got[1]["collapsed"] == "p q a b c end" and [tuple(x) for x in got[1]["runs"]] == [(2, 3, 24)]
    assert got[2]["collapsed"] == "nothing here" and got[2]["runs"] == [] and got[3]["n_words"] == 0


def test_empty_table(spark):
    assert pr.periodic_runs(corpus.documents(spark, [])).count() == 0
