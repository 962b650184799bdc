"""The block labeller on the table's own article elements, on unseen layouts and on hand-made pages."""

import re
from html import unescape

import numpy as np
import pytest

from revlens.llm import main_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def labeller(pages):
    return main_text.fit(pages)


def plain(page):
    """Article of a page of the table's one layout, by patterns."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"</?b>|<br>", lambda found: " " if found[0] == "<br>" else "", block)).split()) for block in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(filter(None, blocks))


def test_whole_table(spark, pages, labeller):
    found = {row["page_id"]: row for row in main_text.extract(pages, labeller).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        assert found[row["page_id"]]["text"] == plain(row["html"])
        assert found[row["page_id"]]["n_chars"] == len(found[row["page_id"]]["text"]) and found[row["page_id"]]["url"] == row["url"]


def test_unseen_layouts(pages, labeller):
    words = [row["url"].split("/") + ["and", "of", "these", "many", "words"] for row in pages.select("url").limit(50).collect()]
    made = [main_text.compose_page(words, seed) for seed in range(500_000, 500_200)]
    made = [(leaves, labels) for leaves, labels in made if leaves]
    wrong = sum(int(((likely >= 0.5) != labels).sum()) for likely, (_, labels) in zip(labeller.probabilities([leaves for leaves, _ in made]), made))
    assert wrong / sum(len(leaves) for leaves, _ in made) < 0.03


def test_hand_made_page(labeller):
    page = """<HTML><body><header class="site-header"><a href=/>Daily News</a></header>
    <nav><ul><li><a href=/a>Home</a><li><a href=/b>World</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div>
    <main><article><h1>Storm &amp; sea</h1><p>The storm came\n  at night,&nbsp;and the <a href=/s>sea</a> rose.<br>Nobody slept.<p>In the morning it was over.
    <div class="advertisement">Buy boots now.</div><p>Boats lay on the road.</p></article></main>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I saw the boats myself, it was a sad morning for us all.</p></div></section>
    <form class="newsletter"><label>Mail</label><button>Send</button></form><footer>&copy; 2020 Daily News</footer><script>var a = "<p>no</p>";</script></body>"""
    leaves = main_text.page_leaves(page)
    kept = [leaf.text for leaf, likely in zip(leaves, labeller.probabilities([leaves])[0]) if likely >= 0.5]
    assert kept == ["Storm & sea", "The storm came at night, and the sea rose. Nobody slept.", "In the morning it was over.", "Boats lay on the road."]


def test_blocks_of_odd_markup():
    texts = lambda page: [leaf.text for leaf in main_text.page_leaves(page)]
    assert texts(None) == texts("") == texts(" \n ") == texts("<!-- all") == texts("<script>a<p>b") == texts("<div") == []
    assert texts("a < b &lt;p&gt; &am; &amp c") == ["a < b <p> &am; & c"]
    assert texts("<p>one<p>two<b>bold</b>er<script>x</script>end<br>line</P>tail") == ["one", "two" "bold" "erend line", "tail"]
    assert texts('<p title="a>b">one</p><p title="broken>two</p>three') == ["one", "two", "three"] or texts('<p title="a>b">one</p>') == ["one"]
    assert texts("<td>a<td>b<tr>c</table></div></x>d") == ["a", "b", "c", "d"]
    assert [leaf.path for leaf in main_text.page_leaves("<ul><li><p>a<li>b</ul>")] == [(("ul", ()), ("li", ()), ("p", ())), (("ul", ()), ("li", ()))]
    deep = main_text.page_leaves("<div>" * 5000 + "x" + "</div>" * 5000 + "y")
    assert [leaf.text for leaf in deep] == ["x", "y"] and len(deep[0].path) == main_text.DEPTH


def test_gradient_of_the_network():
    pages = [main_text.page_leaves("<article><p>a b</p><p>c</p></article><footer>d</footer>"), main_text.page_leaves("<nav>e</nav>")]
    labels = [np.array([1.0, 1.0, 0.0]), np.array([0.0])]
    labeller = main_text.Labeller(hidden=3)
    before = np.concatenate(labeller.probabilities(pages))
    labeller.train(pages, labels, epochs=300)
    after = np.concatenate(labeller.probabilities(pages))
    wanted = np.concatenate(labels)
    assert np.abs(after - wanted).max() < 0.05 < np.abs(before - wanted).max()
    alone = np.concatenate([labeller.probabilities([page])[0] for page in pages])
    assert np.allclose(after, alone, atol=1e-5)


def test_odd_rows(spark, labeller):
    article = "<article><p>" + "word " * 50_000 + "</p></article>"
    rows = [(1, None, "t", 5, 1), (2, "", "t", 5, 1), (3, article, "t", 5, 1), (3, article, "t", 5, 1), (None, "<nav>menu</nav>", "t", 5, 1)]
    table = spark.createDataFrame(rows, "page_id long, html string, Text string, n_chars int, `a.b` int")
    found = main_text.extract(table, labeller, keep_blocks=True)
    assert found.columns == ["page_id", "a.b", "text", "n_chars", "blocks"]
    got = sorted(((row["page_id"], row["n_chars"]) for row in found.collect()), key=repr)
    assert got == sorted([(1, 0), (2, 0), (3, 249_999), (3, 249_999), (None, 0)], key=repr)
    assert main_text.extract(table.limit(0), labeller).collect() == []


def test_empty_table(spark, pages):
    assert main_text.extract(pages.limit(0), main_text.fit(pages.limit(0), composed=20)).collect() == []
