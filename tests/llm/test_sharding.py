import zlib
from collections import Counter, defaultdict

from corpus import awkward, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tierscore.llm import sharding


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(2, 6))
def test_differencing_keeps_sums(sizes, width):
    totals, ends = sharding.differencing([[n] + [0] * (width - 1) for n in sizes])
    back = [0] * width
    for n, end in zip(sizes, ends, strict=True):
        assert sorted(end) == list(range(width))
        back[end[0]] += n
    assert back == totals
    # No worse than putting the largest next into the emptiest shard could be.
    assert max(totals) <= sum(sizes) / width + max(sizes)


def test_differencing_beats_greedy_on_the_textbook_case():
    totals, _ = sharding.differencing([[n, 0] for n in (8, 7, 6, 5, 4)])
    assert max(totals) - min(totals) == 2


def test_groups_stay_whole_and_bytes_balance(spark):
    rows = awkward(60) + [(5000 + i, prose(i, 40)) for i in range(400)]
    got = sharding.shard_by_bytes(documents(spark, rows), 4).collect()
    text = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == text
    shards, size, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        shards[(r.size, r.text_crc32)].add(r.shard)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(n * sum(v for k, v in text.items() if k[1:] == (n, c)) for _, n, c in text)
    assert max(size.values()) - min(size.values()) <= max(4, largest - sum(size.values()) / 4)


def test_tree_of_buckets_equals_one_level_in_balance(spark):
    groups = spark.range(3000).selectExpr("cast(id as string) as grp", "id * 37 % 1009 + 1 as bytes")
    got = sharding.assign_groups(groups, 8, per_bucket=40, fan_in=4).join(groups, "grp").groupBy("shard").sum("bytes").collect()
    sums = [r[1] for r in got]
    assert len(sums) == 8 and max(sums) - min(sums) <= 8


def test_empty_table(spark):
    assert sharding.shard_by_bytes(documents(spark, []), 4).count() == 0
