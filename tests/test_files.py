"""Readers on small hand-written files: edge rows, broken documents, binary layouts."""

import json
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tierscore.functions import bins as B
from tierscore.functions import scalars as S
from tierscore.operators import lookups as L
from tierscore.sources import binary as SB
from tierscore.sources import files as SF
from tierscore.sources import sinks as SK

HEAD = "TransactionID\trow_idx\tl2_tau_used\tfold_id\tseg_prod_amtbin\n"


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_route_meta_last_line_wins_and_short_lines_go(spark, tmp_path):
    path = put(tmp_path, "m.tsv", HEAD + "10\t0\t0.25\t1\t4\n11\t1\t0.5\t2\t0\n10\t0\t0.75\t1\t4\n12\t2\t0.5\n\n")
    rows = {r.row_idx: r for r in SF.read_route_meta_tsv(spark, path, 3).collect()}
    assert rows[0].l2_tau_used == 0.75 and set(rows) == {0, 1}
    meta = SF.read_route_meta_tsv(spark, path, 3)
    assert [r.row_idx for r in L.missing_meta(spark, meta, 3).collect()] == [2]
    assert SF.count_short_lines(spark, path, ["row_idx", "seg_prod_amtbin"]).first().short_lines == 1


def test_route_meta_range_and_columns(spark, tmp_path):
    path = put(tmp_path, "m.tsv", HEAD + "10\t7\t0.25\t1\t4\n")
    with pytest.raises(PySparkException, match="row_idx out of range: 7"):
        SF.read_route_meta_tsv(spark, path, 3).collect()
    assert SF.read_route_meta_tsv(spark, path, 3, on_extra="skip").count() == 0
    with pytest.raises(PySparkException, match="bad fold_id"):
        SF.read_route_meta_tsv(spark, put(tmp_path, "b.tsv", HEAD + "10\t0\t0.25\tx\t4\n")).collect()
    with pytest.raises(ValueError, match="missing column"):
        SF.read_tsv(spark, path, ["nope"])


def test_segment_tau(spark, tmp_path):
    text = "fold\tgb_target\tseg_key\ttau_shrink\n1\t0.0005\t 3.0 \t0.5\n1\t5e-4\t3\t0.25\n2\t0.001\t3\t0.1\nx\t0.0005\t3\t0.1\n1\t0.0005\t\t0.75\n"
    rows = {(r.fold_id, r.seg_key): r.tau for r in SF.read_segment_tau(spark, put(tmp_path, "s.tsv", text), 0.0005).collect()}
    assert rows == {(1, "3"): 0.25, (1, "NA"): 0.75}


def test_policy_without_target_fails(spark, tmp_path):
    doc = {"name": "p", "decision": {"threshold": 0.5}, "thresholds": {"tau_global_by_fold": {"0.0005": {"2": 0.25, "bad": 1}}}}
    path = put(tmp_path, "p.json", json.dumps(doc, indent=1))
    row = SF.read_policy(spark, path, multi_line=True).collect()
    assert [(r.fold_id, r.tau, r.l1_threshold) for r in row] == [(2, 0.25, 0.5)]
    with pytest.raises(PySparkException, match="no fold-wide threshold in policy p"):
        SF.read_policy(spark, path, "0.9", multi_line=True).collect()


@pytest.mark.parametrize(
    "doc, want",
    [
        ('{"learner": {"learner_model_param": {"base_score": "[0.5]"}}}', 0.5),
        ('{"learner": {"learner_model_param": {"base_score": "5E-1"}}}', 0.5),
        ('{"a": [{"b": {"base_score": 0.25}}]}', 0.25),
        ('{"a": {"base_score": "[ 0.125 ]"}}', 0.125),
        ('{"a": 1}', None),
    ],
)
def test_base_score(spark, doc, want):
    assert spark.createDataFrame([(doc,)], "t string").select(SF.base_score(F.col("t"))).first()[0] == want


def test_broken_documents_fail(spark, tmp_path):
    band = {"ref_hi": [0.0] * 256, "rej_lo": [0.0] * 256}
    table = {"checkpoint": 4, "gap_edges": [0.0] * 257, "global_ref_hi": [0.0] * 256, "global_rej_lo": [0.0] * 256, "tau_edges": [0.0, 1.0], "fold_tables": [{"fold_id": 1, **band}], "tau_fold_tables": []}
    doc = {"format": "L2PrefixCalV2", "checkpoints": [4], "variants": [{"key": "v", "ref_q": 1, "rej_q": 0, "tables": [table]}]}
    assert SF.read_calibration(spark, put(tmp_path, "ok.json", json.dumps(doc)), "v").count() == 512
    table["gap_edges"] = [0.0] * 256
    with pytest.raises(PySparkException, match="broken band table v 4"):
        SF.read_calibration(spark, put(tmp_path, "b1.json", json.dumps(doc))).collect()
    table["gap_edges"], table["tau_fold_tables"] = [0.0] * 257, [{"fold_id": 2, "tau_bin": 0, **band}]
    with pytest.raises(PySparkException, match="broken band table v 4"):
        SF.read_calibration(spark, put(tmp_path, "b2.json", json.dumps(doc))).collect()
    doc["format"] = "other"
    with pytest.raises(PySparkException, match="unsupported calibration format other"):
        SF.read_calibration(spark, put(tmp_path, "b3.json", json.dumps(doc))).collect()


def test_mlp_and_approx_policy(spark, tmp_path):
    doc = {"format": "L2PrefixCalMlpV1", "variant_key": "v", "checkpoint_values": [4], "fold_values": [1], "tau_edges": [0.0, 1.0], "checkpoint_limit": 4,
           "mean": [0.0] * 11, "inv_std": [1.0] * 11, "w1": [[0.5] * 11], "b1": [0.0], "w2": [[1.0]], "b2": [0.0], "w3": [1.0], "b3": 0.0,
           "thresholds": [{"checkpoint": 4, "tau_ref": 0.25, "tau_rej": 0.75}]}
    net = SF.read_mlp(spark, put(tmp_path, "m.json", json.dumps(doc)))
    assert net.thresholds == {4: (0.25, 0.75)}
    doc["w1"] = [[0.5] * 10]
    with pytest.raises(ValueError, match="first layer"):
        SF.read_mlp(spark, put(tmp_path, "m2.json", json.dumps(doc)))
    raw = {"checkpoints": [2, 4], "tau_ref": [None, -0.5], "tau_pass": [0.5, None], "fallback_mode": "exact"}
    policy = SF.read_approx_policy(spark, put(tmp_path, "a.json", json.dumps(raw)))
    assert (policy.checkpoints, policy.tau_ref, policy.tau_pos, policy.hot_trees) == ((2, 4), (None, -0.5), (0.5, None), 4)
    with pytest.raises(ValueError, match="differ in length"):
        SF.read_approx_policy(spark, put(tmp_path, "a2.json", json.dumps({**raw, "tau_ref": [None]})))


def test_feature_table_versions(spark, tmp_path):
    x, ids, y = np.arange(6, dtype="<f4"), np.array([7, 8, 9], "<i8"), np.array([1, 0, 1], "u1")
    v1 = b"L1FEATv1\0" + struct.pack("<II", 3, 2) + x.tobytes() + ids.tobytes() + y.tobytes()
    head = 9 + 8 + 24
    v2 = b"L1FEATv2\0" + struct.pack("<IIQQQ", 3, 2, head + 27, head, head + 24) + ids.tobytes() + y.tobytes() + x.tobytes()
    for name, blob in (("v1.bin", v1), ("v2.bin", v2)):
        (tmp_path / name).write_bytes(blob)
        rows = SB.read_feature_table(spark, str(tmp_path / name), 2).orderBy("row_idx").collect()
        assert [(r.row_idx, r.txn_id, r.label, r.features) for r in rows] == [(0, 7, 1, [0.0, 1.0]), (1, 8, 0, [2.0, 3.0]), (2, 9, 1, [4.0, 5.0])]
    (tmp_path / "cut.bin").write_bytes(v1[:-1])
    with pytest.raises(PySparkException, match="truncated"):
        SB.read_feature_table(spark, str(tmp_path / "cut.bin")).collect()
    (tmp_path / "d.bin").write_bytes(x.tobytes())
    with pytest.raises(PySparkException, match="not a multiple"):
        SB.read_dense_rows(spark, str(tmp_path / "d.bin"), 4).collect()


def test_route_meta_binary_round_trip(spark, tmp_path):
    path = str(tmp_path / "meta")
    rows = spark.range(100).select(F.col("id").alias("txn_id"), (F.col("id") % 3).cast("int").alias("fold_id"), F.lit(0.5).cast("float").alias("tau_used"), (F.col("id") % 2 == 0).alias("active"), F.lit(False).alias("exact_positive"))
    SB.write_binary(rows.repartitionByRange(3, "txn_id").sortWithinPartitions("txn_id"), path, "route_meta")
    back = SB.read_row_meta(spark, path)
    assert back.where("row_idx <> txn_id").count() == 0
    assert back.drop("row_idx").exceptAll(rows).count() == 0 and back.count() == 100


def test_broken_model_table_fails(spark, tmp_path):
    from tierscore.operators.trees import NODE_SCHEMA

    bad = spark.createDataFrame([("m", 0, 0, 1, 0.5, 1, 2, 7, None, False)], NODE_SCHEMA)
    bad.write.parquet(str(tmp_path / "n"))
    with pytest.raises(PySparkException, match="broken split"):
        SF.read_tree_model(spark, str(tmp_path / "n")).collect()


def test_bins_on_edges_and_missing(spark):
    rows = spark.createDataFrame([(v,) for v in (-9.0, 0.0, 0.5, 1.0, 1.0 - 1e-7, 9.0, float("nan"), None)], "x float")
    b = B.bin_by_edges(F.col("x"), [0.0, 1.0, 2.0])
    lo, hi = B.guard_bins(F.col("x"), [0.0, 1.0, 2.0], b)
    got = [tuple(r) for r in rows.select(b, lo, hi).collect()]
    assert got == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 1), (0, 0, 1), (1, 1, 1), (0, 0, 0), (0, 0, 0)]
    edges = [float(i) for i in range(100)]
    wide = rows.select(B.count_at_most(edges, F.col("x") * 10), B.count_at_most(B.float_array(edges), F.col("x") * 10))
    assert all(r[0] == r[1] for r in wide.collect())


def test_rank_equals_comparison(spark):
    cuts = [-1.0, 0.0, 2.5]
    rows = spark.createDataFrame([(v,) for v in (-2.0, -1.0, -0.5, 0.0, 2.5, 3.0)], "x float")
    ranks, _ = B.rank_features(F.array("x"), [cuts])
    for r in rows.select("x", F.get(ranks, F.lit(0)).alias("k")).collect():
        assert [r.x < c for c in cuts] == [r.k <= i for i in range(3)]


def test_segment_text(spark):
    rows = spark.createDataFrame([(v,) for v in (3.0, -2.0, 0.5, float("nan"), float("inf"), None)], "x float")
    assert [r[0] for r in rows.select(S.segment_part(F.col("x"))).collect()] == ["3", "-2", "0.5", "NA", "NA", "NA"]
    text = spark.createDataFrame([(v,) for v in (" 7.0 |x", "", "0.50", "1e2|-3")], "t string")
    assert [r[0] for r in text.select(S.canonical_key_text(F.col("t"))).collect()] == ["7|x", "NA", "0.50", "100|-3"]


def test_layouts(spark):
    row = spark.sql("SELECT 1L AS txn_id, 0 AS label, CAST(NULL AS FLOAT) AS route_score, true AS reject, 3 AS visited_trees, 0.5f AS lower, 1f AS upper, true AS shadow_reject, true AS final_reject, false AS fallback_used, 4 AS work_evals, 0 AS exact_visits")
    assert SK.scored_layout(row, "dispatch").first().asDict() == {"TransactionID": 1, "isFraud": 0, "route_score": "NaN", "l2_decision": "REJECT", "visited_trees": 3}
    assert SK.scored_layout(row, "qs-fast").first().lower_bound == "0.500000000"
    with pytest.raises(ValueError, match="unknown layout"):
        SK.scored_layout(row, "other")


def test_binary_jobs_append_and_overwrite(spark, tmp_path):
    rows = spark.range(3).select(F.array(F.col("id").cast("float")).alias("features")).coalesce(1)
    more = spark.range(10, 13).select(F.array(F.col("id").cast("float")).alias("features")).coalesce(1)
    path = str(tmp_path / "dense")

    def values():
        return [r.features[0] for r in SB.read_dense_rows(spark, path, 1).orderBy("row_idx").collect()]

    SB.write_binary(rows, path, "dense")
    SB.write_binary(more, path, "dense")
    assert values() == [0, 1, 2, 10, 11, 12]
    SB.write_binary(more, path, "dense", mode="overwrite")
    assert values() == [10, 11, 12]


def test_several_documents_fail(spark, tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text('["x"]')
    with pytest.raises(ValueError, match="more than one document"):
        SF.read_feature_names(spark, str(tmp_path))
