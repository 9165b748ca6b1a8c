import numpy as np
from corpus import awkward, documents
from tokenizers import Tokenizer

from tierscore.llm import token_counts as C
from tierscore.llm.tokens import vocabulary


def test_counts_equal_the_tokenizer(spark):
    rows = awkward()
    whole = Tokenizer.from_file(vocabulary()[0])
    whole.encode_special_tokens = True
    rows = [(i, (t or "").replace("<|endoftext|>", "")) for i, t in rows]
    want = sorted((i if i is not None else -9, len(whole.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    for block in (7, 1000, 1 << 20):
        got = C.document_counts(spark, documents(spark, rows).repartition(3), block_tokens=block).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -9, r.n_tokens) for r in got) == want
        assert all(r.closed for r in got)


def test_special_tokens_in_texts_are_plain(spark):
    rows = [*awkward(), (70_001, "a<|endoftext|>b"), (70_002, "<|endoftext|>" * 3), (70_003, "after it")]
    whole = Tokenizer.from_file(vocabulary()[0])
    whole.encode_special_tokens = True
    want = sorted((i if i is not None else -9, len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = C.document_counts(spark, documents(spark, rows).repartition(3), block_tokens=1000).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -9, r.n_tokens) for r in got) == want


def test_scan_of_foreign_files(spark, tmp_path):
    streams = {"a": [9, 9, 0, 0, 5, 5, 5], "b": [], "c": [0], "d": [1] * 50 + [0] + [2] * 3 + [0], "e": [3, 3]}
    for name, ids in streams.items():
        np.array(ids, dtype="<u4").tofile(tmp_path / name)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in streams], "path string")
    want = []
    for name, ids in streams.items():
        start = ordinal = 0
        for k, x in enumerate(ids):
            if x == 0:
                want.append((name, ordinal, start, k - start, True))
                start, ordinal = k + 1, ordinal + 1
        if start < len(ids):
            want.append((name, ordinal, start, len(ids) - start, False))
    for block in (1, 3, 1000):
        got = C.count_tokens(paths, end_id=0, block_tokens=block, width=4).collect()
        assert sorted((r.path.rsplit("/")[-1], r.ordinal, r.start, r.n_tokens, r.closed) for r in got) == sorted(want)


def test_prefix_scan_over_groups(spark):
    rows = [("p", i, i % 3, 10 * i if i % 3 else None) for i in range(50)]
    got = C.prefix_scan(spark.createDataFrame(rows, "path string, block bigint, n bigint, last bigint"), group=4).collect()
    for r in got:
        before = [x for x in rows if x[1] < r.block]
        assert r.docs_before == sum(x[2] for x in before)
        assert r.end_before == max([x[3] for x in before if x[3] is not None], default=-1)


def test_empty_table(spark):
    assert C.document_counts(spark, documents(spark, [])).count() == 0
