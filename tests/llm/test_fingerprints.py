import hashlib

from corpus import awkward, documents, prose, shape
from pyspark.sql import functions as F

from tierscore.llm import fingerprints as P


def test_edited_texts_and_likeness(spark):
    rows = [r for r in awkward() if r[0] is not None]
    rows = sorted({i: (i, t) for i, t in rows}.values())
    got = {r.doc_id: r for r in P.fingerprint(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (i, text) in enumerate(rows):
        text, after, r = text or "", rows[(k + 1) % len(rows)][1] or "", got[i]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.edited_fingerprint == r.fingerprint) == (edited == text) or len(text.split()) < 2
        if len(text.split()) > 60:
            assert r.near_edited > 0.35 > 0.1 > r.near_next or r.near_next == 1.0


def test_many_ranges_give_the_same_neighbours(spark):
    rows = awkward(120) * 2
    docs = documents(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = sorted(((i if i is not None else -(2**63), t or "") for i, t in rows))
    want = sorted((t, ordered[(k + 1) % len(ordered)][1]) for k, (_, t) in enumerate(ordered))
    for per_range in (1, 17, 10_000):
        got = P.with_next(docs, ["text"], rows_per_range=per_range).select("text", "next_text").collect()
        assert sorted(map(tuple, got)) == want


def test_nulls_and_repeated_rows(spark):
    got = P.fingerprint(documents(spark, awkward())).collect()
    assert len(got) == len(awkward())
    alone = P.fingerprint(documents(spark, [(5, "just one document here")])).collect()[0]
    assert alone.near_next == 1.0
    assert shape(P.fingerprint(documents(spark, [])))[0] == ("doc_id", "bigint")
    assert P.fingerprint(documents(spark, [])).count() == 0


def test_containment_of_unequal_texts_and_merging(spark):
    small, big = prose(1, 300, 10**6), prose(2, 20_000, 10**6)
    df = spark.createDataFrame([(small, f"{big} {small}", big)], "s string, u string, b string")
    for c in "sub":
        df = P.add_sketch(df, c, f"k{c}")
    kept, bound = P.merged("ks", "kb")
    r = df.select(
        P.containment("ks", "ku").alias("inside"), P.likeness("ks", "ku").alias("like"), P.containment("ks", "kb").alias("none"),
        F.size(F.array_except(kept, "ku_kept")).alias("lost"), (bound == F.col("ku_bound")).alias("same"),
    ).first()
    assert r.inside == 1.0 and r.none == 0.0 and r.like < 0.05 and r.lost == 0 and r.same


def test_no_python_in_the_plan(spark):
    plan = P.fingerprint(documents(spark, awkward()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
