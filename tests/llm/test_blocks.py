"""Parsing, gradients, and the labeller's texts against the pages' own structure."""

import html
import re

import numpy as np
import pytest

from obsload.llm import blocks
from obsload.llm.queries import op4_blocks

FOLDER = "/root/testdata/sf0.01"


def plain_text(page):
    """The given pages keep their main text in one article of paragraphs and headings."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
    parts = (re.sub(r"<[^>]*>", lambda m: " " * (m[0] == "<br>"), s) for s in re.split(r"</?(?:p|h1)>", body))
    return " ".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_parse():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
    <nav><ul><li><a href="x>y">One</a><li>Two</ul></nav><!-- <p>gone</p> --><script>var t="</p>";</script>
    <article class="Post big" id=top><h1>A &amp; B</h1><p>One<b>two</b>
    three<br>four &#233; 3 < 4<p>Open <a href='q'>link</a> end<div>5</div></article>tail <p unfinished"""
    got = [(b.path, b.text, b.linked) for b in blocks.parse(page)]
    item, post = ("html", "body", "nav", "ul", "li"), ("html", "body", "article.post.big#top")
    assert got == [
        (item, "One", 3),
        (item, "Two", 0),
        ((*post, "h1"), "A & B", 0),
        ((*post, "p"), "Onetwo three four é 3 < 4", 0),
        ((*post, "p"), "Open link end", 4),
        ((*post, "div"), "5", 0),
        (("html", "body"), "tail", 0),
    ]
    assert blocks.parse(None) == blocks.parse("") == blocks.parse("<script>x") == blocks.parse("<!-- x") == []


def test_slopes_agree_with_differences():
    rng = np.random.default_rng(0)
    net = blocks.Labeller(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(5, 3, blocks.PATHS + blocks.WORDS + blocks.MEASURES))
    live = np.arange(5)[:, None] < np.array([5, 2, 4])
    y = (rng.random((5, 3)) < 0.5).astype(float)

    def loss():
        p, _ = net.forward(x, live)
        return -(np.log(np.where(y == 1, p, 1 - p)) * live).sum() / live.sum()

    for name, slopes in net.slopes(x, live, y).items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in net.p[name].shape)
            old, step = net.p[name][at], 1e-3
            net.p[name][at] = old + step
            up = loss()
            net.p[name][at] = old - step
            down = loss()
            net.p[name][at] = old
            assert slopes[at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


@pytest.fixture(scope="module")
def net(spark):
    return blocks.learned(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_query_gives_the_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = op4_blocks(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    assert all(r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"] == plain_text(pages[r["page_id"]]["html"]) for r in rows) / len(rows) > 0.99


def test_side_matter_of_other_pages(net):
    page = (
        "<body><header><h1>Site</h1></header><div class='cookie-notice'><p>We use cookies here.</p></div><main><h1>Title</h1>"
        "<p>A first sentence of the story, long enough to read. A second one follows it.</p><aside>Related: more</aside>"
        "<p>The end of the story, which is a sentence too.</p><section class=comments><p>I liked it a lot, says a reader.</p>"
        "</section></main><form><label>Name</label></form><footer>Imprint</footer></body>"
    )
    assert blocks.main_texts([page], net) == [
        "Title A first sentence of the story, long enough to read. A second one follows it. "
        "The end of the story, which is a sentence too."
    ]


def test_nulls_empty_pages_repeats_and_clashing_columns(spark, net):
    good = "<article><h1>T</h1><p>Some words that make a sentence.</p></article>"
    rows = [(1, None, 1), (2, "", 2), (None, good, 3), (2, "<nav>menu</nav>", 4), (2, good, 5), (2, good, 5)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text int")
    out = blocks.with_main_text(pages, net)
    assert out.columns == pages.columns
    assert sorted(r["text"] for r in out.collect()) == ["", "", ""] + ["T Some words that make a sentence."] * 3
    assert blocks.learned(pages.limit(0)) is None
    assert blocks.with_main_text(pages.limit(0), None).count() == 0


def test_batches_are_bounded_by_padded_blocks_and_long_pages_read_in_pieces(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCKS_AT_ONCE", 50, raising=False)
    rng = np.random.default_rng(4)
    net, shapes, run = blocks.Labeller(rng), [], blocks.Labeller._run
    pages = []
    for n in [*rng.integers(1, 40, 150).tolist(), 233, 50, 51]:
        said = [f"<p class={'ad' if i % 7 == 0 else 'x'}>{'word ' * (i % 23 + 1)}{i}</p>" for i in range(n)]
        pages.append("".join(said))

    def spied(self, d, x, *rest, **more):
        shapes.append(x.shape[:2])
        return run(self, d, x, *rest, **more)

    monkeypatch.setattr(blocks.Labeller, "_run", spied)
    got = blocks.main_texts(pages, net)
    assert max(t * n for t, n in shapes) <= 50 and max(n for _, n in shapes) > 1
    for page, text in zip(pages, got, strict=True):
        cut = blocks.parse(page)
        p, _ = net.forward(*blocks._padded([blocks.features(cut)]))
        assert np.allclose(net.read(cut), p[:, 0], atol=1e-5)
        assert text == " ".join(b.text for b, k in zip(cut, p[:, 0] >= 0.5, strict=True) if k)


def test_end_tags_that_may_be_left_out():
    page = "<html><head><meta charset=utf-8><title>No</title><body><article><p>One<datalist><option>a<option>b</datalist> two"
    assert [b.text for b in blocks.parse(page)] == ["One two"]
    assert [b.text for b in blocks.parse("<p>One <svg><path d=x> two<p>three")] == ["One two", "three"]
    assert [b.text for b in blocks.parse("<head><title>t</title></head><p>One <canvas> two")] == ["One two"]
