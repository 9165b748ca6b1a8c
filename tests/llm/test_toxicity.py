import random

from corpus import awkward, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tierscore.llm import toxicity as X

INSULTS = ["gromble", "snarfle", "blurgh"]


def distance(a, b):
    """Levenshtein distance in which a swap of neighbouring letters is one edit, if it is the only one."""
    swaps = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return min(row[-1], 1) if b in swaps else row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abc", min_size=3, max_size=7))
def test_automaton_equals_edit_distance(word):
    terms = ["abc", "abcab", "ccc", "bacab", "aabbcc"]
    got = X.Lexicon(terms, [False] * len(terms)).match(word)
    near = sorted((distance(word, t), -len(t)) for t in terms if distance(word, t) <= 1)
    assert (got is None) == (not near)
    if near:
        assert (got[1], -len(terms[got[0]])) == near[0]


def test_prefixes_match_exactly():
    lexicon = X.Lexicon(["grom", "idiot"], [True, False])
    assert lexicon.match("grombling") == (0, 0) and lexicon.match("grxmbling") is None
    assert lexicon.match("id1ot") == (1, 1) and lexicon.match("idiotic") is None and lexicon.match("no") is None


def test_swapped_letters_are_one_edit():
    lexicon = X.Lexicon(["idiot", "gromble"], [False, False])
    for word in ("idoit", "diiot", "iidot", "idito"):
        assert lexicon.match(word) == (0, 1), word
    assert lexicon.match("gormble") == lexicon.match("grobmle") == lexicon.match("grombel") == (1, 1)
    assert lexicon.match("gorbmle") is None and lexicon.match("idoti") is None


def test_quotations():
    words = X.words_of('he said "you idiot go" and left')
    assert X.quoted(words, 3, 8) and not X.quoted(X.words_of("you idiot go"), 1, 8)
    assert not X.quoted(X.words_of('"fine" she said you idiot now "yes"'), 4, 8)
    assert X.quoted(X.words_of('the word "idiot" is rude'), 2, 8)


def table(n, seed):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        text, toxic = prose(seed * 10_000 + i, 30 + i % 50), i % 5 == 0
        if toxic:
            words = text.split()
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", ".", "!", ","]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = table(1200, 3)
    truth = {i: y for i, _, y in labels}
    rows += [(7000, f"{prose(1, 20)} GR0MBLE {prose(2, 20)}"), (7001, f'{prose(3, 20)} he wrote "gromble" {prose(4, 9)}')]
    rows += [r for r in awkward() if r[0] is None or r[0] >= 2000]
    docs = documents(spark, rows)
    model = X.fit(docs, labelled(spark, labels + [(None, 1, 1), (5, 1, None), (10, 1, 1)]))
    assert set(INSULTS) <= set(model.lexicon.terms)
    got = X.score(docs, model).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r.doc_id in truth]
    held = [r for r in known if r.held_out]
    assert len(held) > 300 and all(r.predicted == truth[r.doc_id] for r in held)
    scores = {r.doc_id: r.score for r in got}
    assert scores[7000] > 0.5 > 0.1 > scores[2000] and scores[7001] < scores[7000]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_bounded_sample_learns_the_same_terms(spark):
    rows, labels = table(1500, 4)
    model = X.fit(documents(spark, rows), labelled(spark, labels), max_labelled=600)
    assert set(INSULTS) <= set(model.lexicon.terms)


def test_no_labels_and_empty_tables(spark):
    rows, _ = table(20, 5)
    model = X.fit(documents(spark, rows), labelled(spark, []))
    assert {r.predicted for r in X.score(documents(spark, rows), model).collect()} == {0}
    assert X.score(documents(spark, []), model).count() == 0
