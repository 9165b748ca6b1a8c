import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpus import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tierscore.llm import packing
from tierscore.llm.tokens import Codec, vocabulary


def test_ids_equal_the_tokenizer_file():
    whole, codec = Tokenizer.from_file(vocabulary()[0]), Codec(vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet=" \n\taé'sS9!<|endoftext>", max_size=60))
    def same(text):
        assert codec.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids

    same()
    assert codec.ids("a<|endoftext|>b").tolist() == whole.encode("a<|endoftext|>b", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_leaves_at_most_one_half_empty_bin(sizes):
    place = packing.best_fit(sizes, 64)
    fill = defaultdict(int)
    for s, b in zip(sizes, place, strict=True):
        fill[b] += s
    assert all(v <= 64 for v in fill.values())
    # Two bins that are half empty would have become one.
    assert sum(v <= 32 for v in fill.values()) <= 1


def check(rows, got, capacity):
    codec = Codec(vocabulary())
    want = defaultdict(int)
    for doc_id, text in rows:
        ids = np.append(codec.ids(text), np.uint32(0)).astype("<u4")
        first = len(ids) if len(ids) <= capacity else (len(ids) % capacity or capacity)
        cuts = [0, first, *range(first + capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    have, places = defaultdict(int), defaultdict(list)
    for r in got:
        have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(k[3] * v for k, v in want.items())


def test_all_rows_packed_without_gaps(spark):
    rows = awkward()
    for options in ({}, {"capacity": 128, "block": 16, "node_bins": 20}):
        df = packing.pack(documents(spark, rows).repartition(7), **options)
        used, tokens = check(rows, df.collect(), options.get("capacity", 2048))
        assert used <= 1.1 * -(-tokens // options.get("capacity", 2048)) + 1


@pytest.mark.parametrize("options", [{}, {"node_bins": 200}, {"node_pieces": 150}])
def test_complements_in_different_tasks_meet(spark, tmp_path, options):
    """One scan task holds only long documents, the other only short ones that complete them."""
    codec = Codec(vocabulary())
    text = lambda n: "a" * 1 + " a" * (n - 2)
    assert len(codec.ids(text(38))) + 1 == 38
    parts = [[(1000 * p + i, text(n)) for i in range(900)] for p, n in enumerate((38, 25))]
    for part in parts:
        documents(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert docs.rdd.getNumPartitions() == 2
    used, _ = check(parts[0] + parts[1], packing.pack(docs, capacity=64, slack=1, **options).collect(), 64)
    alone, _ = check(parts[0] + parts[1], packing.pack(docs.coalesce(1), capacity=64, slack=1).collect(), 64)
    assert alone == 900 and used <= 1.01 * alone


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0
