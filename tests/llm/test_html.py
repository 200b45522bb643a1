import html
import random
import re

import numpy as np
import pytest

from trilith.llm import html_extract as X
from trilith.llm.html_dom import N_FEATURES, Page


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def forest(pages):
    return X.train([r["html"] for r in pages.orderBy("page_id").limit(120).collect()])


def expected(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_table(pages):
    want = {r["page_id"]: (r["url"], expected(r["html"])) for r in pages.collect()}
    got = X.extract_pages(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["url"], r["text"]) == want[r["page_id"]] and r["n_chars"] == len(r["text"])


def test_unseen_layouts(pages, forest):
    rng = random.Random(99)
    articles = [expected(r["html"]).split("\n\n") for r in pages.collect()]
    texts = [b for a in articles for b in a]
    good = 0
    for blocks in articles[:200]:
        page = Page(X.training_page(rng, texts, blocks))
        want = page.text(X.labels(page).tolist())
        good += X.extract([X.training_page(random.Random(1), texts, blocks)], forest) != [""] and want == page.text(
            X.decode(page, forest.log_odds(np.array(page.features()))))
    assert good / 200 > 0.75


def test_kept_nodes_have_kept_ancestors(pages):
    rng = np.random.default_rng(0)
    for r in pages.limit(30).collect():
        page = Page(r["html"])
        z = rng.normal(size=len(page.nodes)) * 3
        kept = dict(zip(map(id, page.nodes), X.decode(page, z)))
        assert all(kept[id(n.parent)] for n in page.nodes if kept[id(n)] and n.parent is not None)


def test_decoding_is_the_best_labelling():
    rng = np.random.default_rng(1)
    page = Page("<div>a<p>b</p><ul><li>c</li><li>d</li></ul></div><p>e</p>")
    order = {id(n): i for i, n in enumerate(page.nodes)}
    n = len(page.nodes)
    for _ in range(50):
        z = rng.normal(size=n) * 2
        keep, drop = -np.logaddexp(0, -z), -np.logaddexp(0, z)
        for i, node in enumerate(page.nodes):
            if not node.chars:
                keep[i] = drop[i] = 0

        def value(labels):
            return sum(keep[i] if x else drop[i] for i, x in enumerate(labels))

        best = max((value(labels) for m in range(2 ** n) if all(
            not (labels := [bool(m >> i & 1) for i in range(n)])[i] or page.nodes[i].parent is None
            or labels[order[id(page.nodes[i].parent)]] for i in range(n))), default=0)
        assert abs(value(X.decode(page, z)) - best) < 1e-9


def test_share_of_siblings_with_the_tag_is_exact_at_every_size():
    for n in (10, 49, 50, 400):
        page = Page("<article>" + "<p>words here</p>" * n + "<ul><li>a</li></ul></article>")
        shares = [f[-8] for node, f in zip(page.nodes, page.features()) if node.tag == "p"]
        assert shares == [n / (n + 1)] * n


def test_references_space_and_parts(forest):
    source = """<html><head><title>no</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav>
      <article><h1>A &amp; B</h1><p>one\n  two&nbsp;three<br>four <b>five</b></p><script>var x = "</p>";</script>
      <p>six &lt;tag&gt; &#233;, and some more words to make a sentence.</p><!-- no --></article>
      <section id="comments"><div class="comment"><p>I liked this, thank you for it.</p></div></section>
      <footer>&copy; someone</footer></body></html>"""
    assert X.extract([source], forest) == ["A & B\n\none two three four five\n\nsix <tag> é, and some more words to make "
                                           "a sentence."]


def test_broken_markup(forest):
    for source in ["", "plain", "<div " * 2000, "<p>" * 3000 + "x", "</p></div>", "<a <b 'q", "<script>no end", "<!-- open",
                   "<li>a<li>b</ul>c", "&bogus; &#99999999;", "<div>" * 1500 + "deep", "a < b > c <3"]:
        page = Page(source)
        assert all(len(r) == N_FEATURES for r in page.features())
        assert isinstance(X.extract([source], forest)[0], str)


def test_odd_rows(spark):
    page = "<article><p>" + "word " * 60_000 + "</p></article>"
    df = spark.createDataFrame([(1, "u", None, "x"), (1, None, "", "x"), (None, "u", page, "x"), (2, "u", page, "x"),
                                (2, "u", page, "x")], "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in X.extract_pages(df).collect())
    assert [g[0] for g in got] == ["1", "1", "2", "2", "None"] and got[0][1] == 0
    assert got[2] == got[3] == ("2", 299_999)
    assert X.extract_pages(df.limit(0)).count() == 0


def test_broken_pages_take_linear_time():
    import time

    from trilith.llm.html_dom import Page
    for page in ("<a " * 1_700_000, "<a '>" * 1_000_000, '<a ">"' * 800_000 + "'", "<b>" * 800_000 + "</i>" * 600_000,
                 "<p><table>" + "<b>" * 600_000 + "</p>" * 700_000, "< " * 2_500_000 + ">", "<a" * 2_500_000):
        start = time.process_time()
        Page(page)
        assert time.process_time() - start < 10


def test_ends_of_tags():
    from trilith.llm.html_dom import Page
    look = lambda s: [(n.tag) for n in Page(s).nodes[1:]] + [t for _, t, _ in Page(s).pieces]
    assert look("<p a='>'>x</p>") == ["p", "x"]
    assert look("<p a='>x</p>") == ["p", "x"]
    assert look('<p a=">"<div>y') == ["p", "y"]
    assert look("a <!-- b") == ["a "] and look("<p <!-- x") == ["<p "] and look("1 < 2 <p") == ["1 < 2 <p"]
