"""Main text of pages: the given pages against a plain reading of their article element, and other layouts."""

from __future__ import annotations

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from plotrows.llm import crf, html, queries


def plain(page: str | None) -> str:
    """The blocks inside the article of the given pages."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", m[1])) if m else []
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


@pytest.fixture(scope="module")
def chain(spark, sf_small):
    return html.fit(queries.table(spark, sf_small, "pages"))


def text(page: str | None, chain: crf.Chain) -> str:
    return html.main_text(page, chain, {})


def test_given_pages(spark, sf_small):
    got = {r.page_id: r for r in queries.op5_html_text(spark, sf_small).collect()}
    pages = queries.table(spark, sf_small, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == plain(p.html)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


LONG = "The river rose by three feet overnight, and the town closed its oldest bridge. Nobody was hurt."
OTHER = "Residents said that the water had come faster than in any year they could remember, even in spring."


@pytest.mark.parametrize("page", [
    f"<body><div class='site-header'><a href=/>Home</a> <a href=/n>News</a></div><div id=content><h1>River</h1><p>{LONG}<p>{OTHER}</div>"
    f"<div class='sidebar'><p>Read our newsletter, it is free.</p></div><footer>Copyright 2020</footer>",
    f"<main><article><header><h1>River</h1></header><p>{LONG}</p><aside><p>Related: more rivers.</p></aside><p>{OTHER}</p>"
    f"<section class=comments><p>Great read, thank you very much for this.</p></section></article></main>",
    f"<div class=cookie-notice><p>We use cookies to improve this page.</p></div><article><h1>River</h1><div class=ad>Buy boots now.</div><p>{LONG}</p>"
    f"<p>{OTHER}</p><form><label>Mail</label><input><button>Send</button></form></article><div id=comments><p>First! {OTHER}</p></div>",
    f"<body><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><section class=post><h1>River</h1><p>{LONG}</p><script>x='<p>no</p>'</script><p>{OTHER}</p></section>",
])
def test_other_layouts(chain, page):
    assert text(page, chain).split("\n\n") == ["River", LONG, OTHER]


def test_blocks():
    assert [b.text for b in html.blocks("<p>a&amp;b &#8212;\n c<br>d</p><p> </p>e<!-- x --><i>f</i><div>g<p>h")] == ["a&b — c d", "ef", "g", "h"]
    assert html.blocks("") == [] and html.blocks("<p><script>alert(1)") == []
    assert [b.text for b in html.blocks("a < b <p title='x>y'>c</p")] == ["a < b", "c"]


def test_edge_pages(spark, chain):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<nav><a>x</a></nav>", "x"), (3, "u", "<nav><a>x</a></nav>", "x"),
            (None, "u", f"<article><p>{LONG}</p></article>", "x"), (5, "u", "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df, chain, ["page_id", "url"]).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert [by[k].text for k in (1, 2, 3)] == ["", "", ""] and by[None].text == LONG
    assert by[5].text == "\n\n".join([LONG] * 3000) and by[5].n_chars == 3000 * (len(LONG) + 2) - 2


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    model = html.fit(none)
    assert html.extract(none, model, ["page_id"]).count() == 0
    assert text(f"<article><p>{LONG}</p></article><footer>x</footer>", model) == LONG


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(50):
        c = crf.Chain(np.zeros(1), rng.normal(size=(2, 2)), float(rng.normal()))
        e = rng.normal(size=6)

        def total(p, c=c, e=e):
            return c.first * p[0] + sum(e[i] * p[i] for i in range(6)) + sum(c.pair[a][b] for a, b in zip(p, p[1:]))
        paths = list(itertools.product((0, 1), repeat=6))
        assert tuple(crf.viterbi(c, e.tolist())) == max(paths, key=total)
        weight = np.exp([total(p) for p in paths])
        odds = [weight[[p[i] == 1 for p in paths]].sum() / weight[[p[i] == 0 for p in paths]].sum() for i in range(6)]
        assert crf.odds(c, e) == pytest.approx(odds)


def test_hidden_marks_are_learned_around(spark, sf_small, chain):
    """Pages of the same kind without the marking element keep nearly all of their text."""
    pages = queries.table(spark, sf_small, "pages").select("page_id", "url", F.regexp_replace("html", "</?article>", "").alias("html"), F.col("html").alias("marked"))
    got = html.extract(pages, chain, ["page_id", "marked"]).collect()
    want, found = [], []
    for r in got:
        want += plain(r.marked).split("\n\n")
        found += r.text.split("\n\n")
    assert len(set(want) & set(found)) > 0.95 * len(set(want)) and len(set(found) - set(want)) < 0.05 * len(set(found))


@pytest.mark.parametrize("name", "script style template noscript svg iframe textarea select title object".split())
def test_nothing_is_lost_after_silent_elements(name):
    """Custom elements whose names begin like a silent one, and self-closed ones, hide nothing; closed ones only themselves."""
    for inner, want in ((f"<{name}-x></{name}-x>", ["A", "B"]), (f"<{name}-x>kept</{name}-x>", ["A", "kept", "B"]), (f"<{name}/>", ["A", "B"]),
                        (f'<{name} a="b" />', ["A", "B"]), (f"<{name}>gone</{name}>", ["A", "B"]), (f"<{name.upper()} a='b'>gone</{name} >", ["A", "B"])):
        assert [b.text for b in html.blocks(f"<article><p>A</p>{inner}<p>B</p></article>")] == want
    assert [b.text for b in html.blocks(f"<p>A</p><{name} a>open to the end<p>B</p>")] == ["A"]
