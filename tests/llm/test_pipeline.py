from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pyarrow as pa
import pytest
from corpus import awkward, prose
from test_near_dups import brute
from test_packing import check
from test_toxicity import table

LEAK = "Which " + prose(8001, 25) + "? It is " + prose(8002, 10) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = table(600, 6)
    base = prose(8100, 120)
    words = base.split()
    rows += [(9000 + i, " ".join([*words[:-i], *["new"] * i]) if i else base) for i in range(3)]
    rows += [(9100 + i, f"{prose(8200 + i, 60)} {LEAK} {prose(8300 + i, 30)}") for i in range(4)]
    rows += [(i if i is None else i + 50_000, t) for i, t in awkward()]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, {i for i, _, y in labels if y}


def test_stages_against_plain_python(spark, folder):
    path, rows, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(pipeline.STAGES)
    got = stages["toxicity"](spark, docs, path)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert {i for i, _ in rows} - {i for i, _ in kept} == toxic
    got = stages["near_duplicates"](spark, got, path)
    assert got.columns == docs.columns
    want = brute(kept, 5)
    firsts = Counter({(i, t): 1 for i, t in kept if i is not None and want[i][1] == i})
    firsts.update(r for r in kept if r[0] is None)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == firsts
    got = stages["decontamination"](spark, got, path)
    assert got.columns == docs.columns
    final = [(r.doc_id, r.text) for r in got.collect()]
    assert Counter(final) == Counter({k: n for k, n in firsts.items() if LEAK not in (k[1] or "")})
    check(final, stages["packing"](spark, got, path).collect(), 2048)
    assert 0 < len(final) < len(kept)


def test_rejected_ids_go_to_the_texts(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    rejected = docs.where("doc_id % 2 = 0").select("doc_id")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = pipeline._without(docs, rejected)
        assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(pipeline, "BROADCAST_IDS", 10)
        many = pipeline._without(docs, rejected)
        assert "Exchange hashpartitioning" in many._jdf.queryExecution().executedPlan().toString()
        assert few.exceptAll(many).count() == 0 and few.count() == many.count() == docs.where("doc_id is null or doc_id % 2 <> 0").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_run_packs_what_the_stages_keep(spark, folder):
    path, rows, toxic = folder
    got = pipeline.run(spark, path).collect()
    ids = defaultdict(int)
    for r in got:
        ids[r.doc_id] += 1
    assert not set(ids) & (toxic | set(range(9100, 9104)) | {9001})
    assert {9000, 52_001, None} <= set(ids)


def test_stages_take_small_batches(spark, folder):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.range(3000).selectExpr("id doc_id", "'a few words' text").coalesce(1)
        pipeline.pack_sequences(spark, docs, folder[0])

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        assert max(r.n for r in docs.mapInArrow(sizes, "n bigint").collect()) <= 1000
    finally:
        spark.conf.set(key, before)
