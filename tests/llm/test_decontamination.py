import random

from corpus import awkward, documents, prose

from tierscore.llm import decontamination as D

ITEMS = [(i, f"What {prose(500 + i, 20)}? It {prose(900 + i, 12)}.") for i in range(40)]


def items(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, score string")


def brute(index, terms):
    scores = {}
    for t in terms:
        for i, x in zip(index.items[t], index.impacts[t], strict=True):
            scores[i] = scores.get(i, 0) + x
    return {i for i, s in scores.items() if s >= index.threshold - 1e-9}


def test_wand_retrieves_what_full_scoring_finds():
    rng = random.Random(1)
    texts = [(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(12))) for i in range(300)]
    freq = {}
    for _, t in texts:
        for w in set(D.words_of(t)):
            freq[w] = freq.get(w, 0) + 1
    for threshold in (0.2, 0.5, 0.8):
        index = D.Index(texts, freq, len(texts), 12.0, threshold)
        for k in range(60):
            terms = sorted({index.terms[w] for w in D.words_of(texts[k][1] + " " + texts[k + 9][1])})
            assert {i for i, _ in index.retrieve(terms)} == brute(index, terms)


def test_planted_passages_are_found_and_clean_documents_left(spark):
    docs = awkward() + [(3000 + i, prose(i, 80 + 31 * i)) for i in range(20)]
    leaked = []
    for i, text in ITEMS[:20]:
        host = prose(700 + i, 50 * i).split()
        at = len(host) // 2
        docs.append((4000 + i, " ".join([*host[:at], text.upper() if i % 3 == 0 else text, *host[at:]])))
        leaked.append((4000 + i, i))
    docs += [(4500 + i, ITEMS[i][1].split("?")[0]) for i in range(20)]  # a question alone is no leak
    extra = [(100, None), (101, ""), (None, "no id"), ITEMS[0]]
    got = D.find_leaks(documents(spark, docs), items(spark, ITEMS + extra)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == leaked
    shards = D.find_leaks(documents(spark, docs), items(spark, ITEMS + extra), shard_items=7).collect()
    assert sorted(shards) == sorted(got)


def test_repeated_rows_count_once(spark):
    got = D.find_leaks(documents(spark, [(1, ITEMS[3][1])] * 3), items(spark, ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 3)]


def test_empty_tables(spark):
    assert D.find_leaks(documents(spark, []), items(spark, ITEMS)).count() == 0
    assert D.find_leaks(documents(spark, awkward()), items(spark, [])).count() == 0


def test_a_copy_cut_before_a_short_answer_is_found(spark):
    question = prose(321, 24)
    table = items(spark, [(1, f"What {question}? Yes."), (2, f"No. {prose(654, 24)}.")])
    assert [len(h) for h in D.question_answer(f"What {question}? Yes.")] == [18, 8]
    assert [len(h) for h in D.question_answer(f"No. {prose(654, 24)}.")] == [8, 17]
    rows = [(1, f"{prose(11, 60)} what {question}"), (2, f"{prose(12, 60)} {prose(654, 24)}"), (3, prose(13, 90))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, table).collect()}
    assert found == {(1, 1), (2, 2)}
