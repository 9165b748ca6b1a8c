"""Importance resampling against a plain count of feature strings."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus
import pytest

from tierscore.llm import importance
from tierscore.llm.queries import op13_importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NAMES = ["doc_id", "n_features", "weight", "score", "rank"]


def words_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def features(text, longest=2):
    words = words_of(text)
    return [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=25, buckets=10_000, longest=2, least=20):
    s, t = (Counter(zlib.crc32(f) % buckets for x in texts for f in features(x, longest)) for texts in ([d[1] for d in docs], target))
    size, goal = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        got = [gain[zlib.crc32(f) % buckets] for f in features(text, longest)]
        weight = sum(got) // len(got) if got else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(got), weight, score, None, len(words_of(text))])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def same(got, expected):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_words_and_chained_checksums():
    text = "Ab-c1  É_ÀB\x00x\x7fy ſK 中文 z"
    assert importance.words_of(text) == words_of(text)
    for longest in (1, 2, 3):
        got = [h for part in importance.feature_hashes(words_of(text), importance.Seeds(2), longest) for h in part]
        assert got == [zlib.crc32(f) for f in sorted(features(text, longest), key=lambda f: f.count(b" "))]


@pytest.mark.parametrize("longest", [1, 3])
def test_awkward_rows(spark, longest):
    rows = corpus.awkward()
    target = [corpus.prose(3, 60), None, ""]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = importance.resample(corpus.documents(spark, rows), benchmark, percent=60, buckets=50, longest=longest)
    same(got.select(*NAMES).collect(), plain(rows, target, percent=60, buckets=50, longest=longest))


def test_query_on_whole_table(spark, sf_dir):
    rows, target = (
        [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c).collect()]
        for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("text",)))
    )
    got = op13_importance(spark, sf_dir)
    assert corpus.shape(got) == [(n, "bigint") for n in NAMES]
    same(got.collect(), plain(rows, [t for (t,) in target]))


def test_ties_and_empty_tables(spark):
    rows = [(i // 2, " ".join(["same"] * 25)) for i in range(40)]
    target = spark.createDataFrame([], "item_id int, text string")
    got = importance.resample(corpus.documents(spark, rows), target, percent=50).select(*NAMES).collect()
    same(got, plain(rows, [], percent=50))
    assert importance.resample(corpus.documents(spark, []), target).count() == 0
