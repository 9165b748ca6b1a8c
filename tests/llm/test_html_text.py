import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tierscore.llm import html_text as H

SCHEMA = "page_id bigint, url string, html string, host string, bucket string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def article(page: str) -> str:
    best = max((n for _, n in H.blocks_of(page)), default=0)
    return "\n\n".join(t for t, n in H.blocks_of(page) if n == best)


def test_structure():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar">
    <header>Site</header><nav><ul><li>menu</ul></nav><div class="cookie-notice">We use</div><main><p>outer</p>
    <article class=post><header><h1>A &amp; B&nbsp;&lt;c&gt;</h1></header><p>one  two<br>three <b>bo</b>ld<p>a &lt; b > c 1 < 2
    <div class="ad">buy</div><!-- <p>c</p> --><script>var t="</p>";</script><ul><li>i1<li>i2</ul><form>f</form>
    <section id="comments"><p>hi</section><footer>by</footer><p>last</article></main><aside>s</aside><footer>f</footer>"""
    assert article(page) == "A & B <c>\n\none two three bold\n\na < b > c 1 < 2\n\ni1\n\ni2\n\nlast"
    assert article("<p>a<span class='ad'>x</span>b</p>") == "ab" or article("<p>a<span class='ad'>x</span>b</p>") == "a\n\nb"
    assert article("<div id='content'><p>in</div><div>out</div>") == "in"
    assert article('<p title="a > b">kept</p><p title="open>also</p>').startswith("kept")
    assert article("") == "" and article("plain") == "plain"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab=\"'!- &;#x", max_size=80))
def test_any_input_ends(page):
    H.blocks_of(page)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=6), st.integers(1, 5), st.integers(1, 3))
def test_covered_words_equal_brute_force(pages_, depth, need):
    tokens = np.array([t for p in pages_ for t in p], dtype=np.int64)
    owner = np.array([i for i, p in enumerate(pages_) for _ in p], dtype=np.int64)
    seen = {}
    for i, p in enumerate(pages_):
        for k in range(len(p) - depth + 1):
            seen.setdefault(tuple(p[k : k + depth]), set()).add(i)
    want = []
    for p in pages_:
        mask = [False] * len(p)
        for k in range(len(p) - depth + 1):
            if len(seen[tuple(p[k : k + depth])]) >= need:
                mask[k : k + depth] = [True] * depth
        want += mask
    if len(tokens):
        assert H.covered_words(tokens, owner, depth, need).tolist() == want


def test_boilerplate_of_a_host_goes_and_unique_runs_stay(spark):
    notice = "all rights of this fine site are kept by its owners for ever and a day"
    story = [" ".join(f"x{i}y{k}" for k in range(5 + 3 * i)) for i in range(12)]
    rows = [(i, f"http://h.example/{i}", f"<div>{notice}</div><div>{story[i]}</div>") for i in range(12)]
    rows += [(100, "http://other.example/", f"<div>{notice}</div>"), (101, None, None), (102, None, ""), (None, None, "<p>x</p>"), rows[0]]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.extract(pages(spark, rows)).collect()}
    assert len(got) == 16
    for i in range(12):
        assert got[(i, f"http://h.example/{i}")] == (story[i], len(story[i]))
    assert got[(100, "http://other.example/")][0] == notice  # seen on one page of its host only
    assert got[(101, None)] == ("", 0) and got[(102, None)] == ("", 0) and got[(None, None)] == ("x", 1)


LINE = "this very paragraph with more than eight words stands in the article of many pages"


def shared_articles(n, holders, line=LINE):
    """Pages of one host with articles of their own, the first ``holders`` of which hold the line too."""
    own = [" ".join(f"own{i}x{k}" for k in range(60 + i)) for i in range(n)]
    body = [f"<p>{own[i]}</p>" + (f"<p>{line}</p>" if i < holders else "") for i in range(n)]
    return [(i, "http://h.example/", f"<nav>menu {i}</nav><article>{body[i]}</article>") for i in range(n)], own


def test_boilerplate_inside_articles_goes_and_shared_prose_stays(spark):
    rows, own = shared_articles(30, 27)
    got = {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}
    assert got == dict(enumerate(own))
    rows, own = shared_articles(30, 9)
    got = {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}
    assert got == {i: f"{t}\n\n{LINE}" if i < 9 else t for i, t in enumerate(own)}


def test_copies_and_near_copies_of_an_article_stay(spark):
    line = f"<p>{LINE}</p>"
    rows = [(i, "http://h.example/", f"<nav>menu {i}</nav><article>{line}<p>the same end on all pages of this host, word for word</p></article>") for i in range(20)]
    near = [(100 + i, "http://n.example/", f"<article>{line}<p>{' '.join(f'w{k}' for k in range(20))} own {i}</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in H.extract(pages(spark, rows + near)).collect()}
    assert all(LINE in t and "menu" not in t for t in got.values()) and all("the same end" in got[i] for i in range(20))


def test_buckets_of_a_host_agree_with_the_whole_host(spark):
    rows, own = shared_articles(400, 380)
    want = dict(enumerate(own))
    for size in (1000, 60):
        assert {r.page_id: r.text for r in H.extract(pages(spark, rows), bucket_pages=size).collect()} == want


def near_thresholds():
    """Pages of one host with lines on as many pages as a run needs, and on one fewer, outside and inside articles."""
    lines = [" ".join(f"{name}{k}" for k in range(12)) for name in "abcdef"]
    rows = []
    for i in range(400):
        # Of 800 pages: outside articles 16 are needed.
        held = [t for t, n in zip(lines[:3], (16, 15, 300), strict=True) if i < n]
        rows.append((i, "http://h.example/", "".join(f"<div>{t}</div>" for t in [*held, " ".join(f"p{i}x{k}" for k in range(20))])))
        # Inside articles, of which the last 20 are copies of others, 200 of 400 pages of a host are needed.
        j = i if i < 380 else i - 380
        held = [t for t, n in zip(lines[3:], (200, 199, 379), strict=True) if j < n]
        own = f"<p>{' '.join(f'o{j}x{k}' for k in range(150))}</p>"
        rows.append((1000 + i, "http://a.example/", f"<article>{own}{''.join(f'<p>{t}</p>' for t in held)}</article>"))
        rows.append((2000 + i, "http://h.example/", f"<article>{own}</article>"))
    return rows, lines


def test_the_size_of_buckets_decides_nothing(spark):
    rows, lines = near_thresholds()
    table_ = pages(spark, rows).localCheckpoint()
    want = {r.page_id: r.text for r in H.extract(table_, bucket_pages=10_000).collect()}
    assert [sum(t in want[i] for i in range(400)) for t in lines[:3]] == [0, 15, 0]
    assert [sum(t in want[1000 + i] for i in range(400)) for t in lines[3:]] == [0, 199 + 20, 0]
    for size, kept in ((500, 2_000_000), (40, 2_000_000), (500, 10)):
        assert {r.page_id: r.text for r in H.extract(table_, bucket_pages=size, kept_runs=kept).collect()} == want


def test_pages_move_once(spark):
    rows, _ = shared_articles(100, 90)
    plan = H.extract(pages(spark, rows).repartition(4), bucket_pages=20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(bucket") == 1 and "hashpartitioning(host" not in plan


def test_very_long_page(spark):
    body = "".join(f"<p>word{i} and so on</p>" for i in range(20_000))
    (r,) = H.extract(pages(spark, [(1, "http://h.example/", f"<article>{body}</article>")])).collect()
    assert r.text.count("\n\n") == 19_999 and r.n_chars == len(r.text)


def test_empty_table(spark):
    assert H.extract(pages(spark, [])).count() == 0
