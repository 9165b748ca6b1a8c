import random
import re

import pytest
from corpus import awkward, documents, prose

from tierscore.llm import near_dups as N
from tierscore.llm.components import components


def sets_of(text, size):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size):
    sets = [(i, sets_of(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (len(s), root(i)) for i, s in sets}


def edited(text, rng, share):
    w = text.split()
    for _ in range(int(share * len(w))):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng, rows = random.Random(5), awkward()
    passage = prose(77, 40)
    for g in range(6):
        base = prose(200 + g, 150)
        rows += [(10_000 + 100 * g + k, edited(base, rng, rng.choice([0.005, 0.02, 0.035, 0.05]))) for k in range(50)]
    rows += [(20_000 + k, f"{prose(400 + k, 20)} {passage}") for k in range(150)]
    return rows + [(30_000, "Hello World"), (30_001, "hello\tworld"), (30_002, "HELLO  WÖRLD"), (30_003, "hello wÖrld")]


def test_equals_brute_force(spark):
    rows = corpus()
    for size, limit in ((4, 64), (5, 8)):
        want = brute(rows, size)
        got = N.near_duplicates(documents(spark, rows), shingle=size, node_limit=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400), (900, 901), (901, 900)], "a bigint, b bigint")
    links = links.unionByName(spark.createDataFrame([(None, 7), (900, 901)], "a bigint, b bigint"))
    for block in (200_000, 20):
        got = {r.node: r.component for r in components(links, block).collect()}
        assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400, 900: 900, 901: 900}


def test_empty_table(spark):
    assert N.near_duplicates(documents(spark, [])).count() == 0
    assert N.near_duplicates(documents(spark, [(1, None), (2, "")])).count() == 2


def test_full_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_CLASSES", 40)
    rows = [r for r in corpus() if r[0] is not None and 10_000 <= r[0] < 20_000]
    large = [(1, i, bytes(N.SKETCH), len(sets_of(t, 4)), i if i >= 10_100 else 10_000) for i, t in rows]
    large = spark.createDataFrame(large, "node bigint, rep bigint, sketch binary, n bigint, comp bigint")
    met = N._with_partners(N._meetings(large), 0.8, 0.2)
    texts = spark.createDataFrame(rows, "rep bigint, text string")
    got = {tuple(r) for r in N.full_links(met, texts, 4, 80).collect()}
    sets = {i: sets_of(t, 4) for i, t in rows}
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in got)
    chain = [(10_000 + k, 10_001 + k) for k in range(99)]
    linked = {r.node: r.component for r in components(spark.createDataFrame([*got, *chain], "a bigint, b bigint")).collect()}
    want = brute(rows, 4)
    for i, _ in rows:
        if i >= 10_100:
            assert linked.get(i, i) == want[i][1]


def test_one_id_with_several_texts_is_one_document(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (2, b), (3, a), (3, b), (5, f"{b} x"), (4, prose(3, 60)), (2, b)]
    got = sorted(tuple(r) for r in N.near_duplicates(documents(spark, rows), shingle=4).collect())
    assert [(i, c, k) for i, _, c, k in got] == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 1, False)]


def test_group_of_near_copies_does_not_branch(spark, monkeypatch):
    """A group that its roots connect has no rows in deeper levels."""
    rng, base = random.Random(3), prose(31, 200)
    rows = [(k, edited(base, rng, 0.01)) for k in range(600)] + [(1000 + k, prose(500 + k, 50)) for k in range(50)]
    levels = []
    monkeypatch.setattr(N, "branches", lambda rows, *a: levels.append(rows) or pytest.fail("branched"))
    got = N.near_duplicates(documents(spark, rows), shingle=4).collect()
    assert {r.component_id for r in got if r.doc_id < 1000} == {0} and not levels


def test_star_of_separately_edited_copies(spark):
    rng, words = random.Random(9), [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(words))]
    for k in range(1, 5_001):
        copy = list(words)
        for at in rng.sample(range(300), 8):
            copy[at] = f"e{k}x{at}"
        rows.append((k, " ".join(copy)))
    base = sets_of(rows[0][1], 4)
    partners = {i for i, t in rows if 100 * len(base & sets_of(t, 4)) >= 80 * len(base | sets_of(t, 4))}
    assert len(partners) == 5_001
    got = {r.doc_id: r.component_id for r in N.near_duplicates(documents(spark, rows), shingle=4).collect()}
    # Probabilistic per pair: 1 of 5,000 is lost with these texts.
    assert sum(got[i] != 0 for i in partners) <= 5


def test_large_nodes_meet_in_one_join(spark):
    # Node 1: one outsider; node 2: one component; node 3: two outsiders.
    comps = {1: [7, 7, 7, 8], 2: [9, 9], 3: [4, 4, 4, 5, 6]}
    rows = [(node, 100 * node + i, bytearray(N.SKETCH), 10, comp) for node, cs in comps.items() for i, comp in enumerate(cs)]
    large = spark.createDataFrame(rows, "node bigint, rep bigint, sketch binary, n bigint, comp bigint")
    nodes = lambda most: {r.node for r in N._meetings(large, most).select("node").distinct().collect()}
    assert nodes(None) == {1, 3} and nodes(2) == {1, 3} and nodes(1) == {1}
    assert "LeftSemi" not in N._meetings(large, 1)._jdf.queryExecution().executedPlan().toString()


def test_large_nodes_of_bounded_size_do_not_branch(spark, monkeypatch):
    monkeypatch.setattr(N, "_branch", lambda big: pytest.fail("a node of at most FULL_CLASSES classes branched"))
    line = "one line that stands in every one of these texts"
    texts = [f"{line} {' '.join(f'own{i}x{k}' for k in range(4))}" for i in range(60)]
    texts += [f"{line} {' '.join(f'own{i}x{k}' for k in range(3))} own{i}x3 end" for i in range(0, 60, 10)]
    got = N.near_duplicates(documents(spark, list(enumerate(texts))), shingle=4, node_limit=8).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i if i < 60 else (i - 60) * 10 for i in range(66)}
