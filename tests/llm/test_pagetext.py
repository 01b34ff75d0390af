"""Main text of pages: small layouts with known articles, and held-out pages with the mark removed."""

import itertools
import re

import pytest

from runlens.llm import pagetext
from runlens.llm.pagetext import Page, Weights, main_text, region

PRIOR = Weights({})
TEXT = "The first sentence of a paragraph that has quite a few words, so that it is content."
SCHEMA = "page_id long, url string, html string, text string, n_chars int, C0 string"


def article(*blocks):
    return "".join(f"<p>{b}</p>" for b in blocks)


def frame(spark, pages):
    return spark.createDataFrame([(i, f"u{i}", p, "old", 1, "c") for i, p in enumerate(pages)], SCHEMA)


FURNITURE = [
    '<nav><ul><li><a href="/">Home</a></li><li><a href=/x>News of the day and more</a></li></ul></nav>',
    '<div class="ad">Buy many things here today, as cheap as never before, only this one week.</div>',
    '<header><h1>Name of the Site</h1><p>What the site is about, in one long line of words.</p></header>',
    '<aside><h2>Other articles</h2><p>A teaser with some words that belongs to another page altogether.</p></aside>',
    '<form action="/q"><label>Search for words</label><input name=q><button>Go there</button></form>',
    '<div id="cookie-notice">We use cookies and other things, please accept all of them and go on.</div>',
    '<script>if (a < b) { document.write("<p>not text</p>") }</script><style>p > a { color: red }</style>',
    '<section class="comments"><h3>Comments</h3><article><p>I read all of this and I liked it very much, thank you.</p></article></section>',
    '<div role="navigation">Go to many other places of this site</div><!-- <p>never shown</p> -->',
    '<div class="siteSidebar">Popular things that many people have read of late</div>',
    '<noscript>Please turn on scripts to see all of this page</noscript><p hidden>Not to be seen by anybody</p>',
    "<footer>&copy; 2020 The owner &middot; all rights reserved, as always.</footer>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", '<div class="post-content">{}</div>'])
@pytest.mark.parametrize("furniture", FURNITURE)
def test_furniture_before_inside_and_after(wrap, furniture):
    body = ["<h1>A headline</h1>" + article(TEXT, "Short."), article(TEXT + " And &eacute; &amp; more.", "The end is <b>bold</b> and <a href='x'>linked</a>.")]
    want = "\n\n".join(["A headline", TEXT, "Short.", TEXT + " And é & more.", "The end is bold and linked."])
    head = "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8></head><body>"
    for before, inside, after in itertools.product(("", furniture), repeat=3):
        if inside and wrap.startswith(("<article", "<main")) and "<header" in inside:
            continue  # an article's own header belongs to it
        page = head + before + wrap.format(body[0] + inside + body[1]) + after + "</body></html>"
        assert main_text(page, PRIOR) == want, page


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("<html></html>", ""), (" \n ", ""), ("plain words only", "plain words only"),
    (f"<body><p>{TEXT}<p>  two \n\t lines&nbsp;here <br>and a break", f"{TEXT}\n\ntwo lines here and a break"),
    (f"<p>1 < 2 &lt; 3 &amp;amp; &#233;&#x41; {TEXT}</p><p>it's <i title='a > b'>quoted</i> =\"no</p>", f"1 < 2 < 3 &amp; éA {TEXT}\n\nit's quoted =\"no"),
    (f"<p>{TEXT}</p><!-- open <p>gone</p>", TEXT), (f"<p>{TEXT}</p><script>gone <p>gone", TEXT), (f"<p>{TEXT}</p><a href='x", TEXT),
    (f"<div class='ad'><article><h1>Held</h1><p>{TEXT}</p></article>", f"Held\n\n{TEXT}"),
    (f"<form><div><h1>Held</h1><p>{TEXT}</p></div></form>", f"Held\n\n{TEXT}"),
    (f"<p class=x data-a='1'>{TEXT}</P><UL><LI>one<LI>two</UL><table><tr><td>a<td>b</table>", f"{TEXT}\n\none\n\ntwo\n\na\n\nb"),
    (f"<body class='has-sidebar no-ads'><div class=with-nav><p>{TEXT}</p></div>", TEXT),
])
def test_markup(html, want):
    assert main_text(html, PRIOR) == want


def test_region_is_the_maximum_of_all_regions():
    for page in ("".join(x) for x in itertools.permutations(["<div>a b</div>", "<p>c</p>", "<ul><li>d e f g h i</li></ul>", "<section>j", "<p>k l m n</p>"])):
        p = Page(page)
        score = []
        for i in range(len(p.items)):
            f = p.feature(i, p.zone(i))
            score.append(0.0 if f is None else PRIOR(f) * (p.words[i] if f[1] == "words" else 1))
        best = max(sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1))
        first, last = region(p, PRIOR)
        assert sum(score[first:last + 1]) == pytest.approx(best)


def test_long_page_is_whole():
    blocks = [f"Paragraph number {i} of many." for i in range(20_000)]
    assert main_text(f"<body>{article(*blocks)}</body>", PRIOR) == "\n\n".join(blocks)
    assert len(main_text("<p>" + "word " * 300_000, PRIOR)) == 5 * 300_000 - 1
    assert main_text("<div>" * 50_000 + TEXT, PRIOR) == TEXT


def test_weights_from_labelled_pages(spark, sf_dir):
    pages = [f"<body><menu>x</menu><div>{'menu words here ' * 3}</div><article><dl><dd>{TEXT}</dd></dl></article></body>"] * 40
    weights = pagetext.learn(frame(spark, pages))
    assert weights(("plain", "words", "dd")) > PRIOR(("plain", "words", "dd")) and weights(("plain", "words", "div")) < 0.5
    assert weights(("beside", "tag", "div")) < weights(("marked", "tag", "dl")) < 0
    counted = sum((pagetext.count_features(p) for p in pages), start=type(pagetext.count_features(""))())
    for (zone, what, kind, inside), n in counted.items():
        assert weights._counts[zone, what, kind][0 if inside else 1] == n


def test_pages_without_the_mark(spark, sf_dir):
    """Weights of half the pages, whose furniture is plain divs, find the articles of the others, their mark taken away too."""
    pages = [(r.page_id, re.sub(r"<(/?)(nav|footer)>", r"<\1div>", r.html).replace(' class="ad"', ""))
             for r in spark.read.parquet(f"{sf_dir}/pages.parquet").where("html IS NOT NULL").collect()]
    weights = pagetext.learn(frame(spark, [p for i, p in pages if i % 2 == 0]))
    assert len(pages) > 20
    for i, page in pages:
        if i % 2:
            truth = main_text(re.search(r"<article>.*</article>", page, re.S).group(), PRIOR)
            assert main_text(re.sub("</?article>", "", page), weights) == truth == main_text(page, weights)


def test_extract_keeps_rows_and_columns(spark):
    pages = [f"<article><p>{TEXT}</p></article>", None, "", f"<article><p>{TEXT}</p></article>"]
    df = frame(spark, pages).unionByName(spark.createDataFrame([(None, None, pages[0], None, None, None)], SCHEMA))
    out = pagetext.extract(df)
    assert out.columns == ["page_id", "url", "C0", "text", "n_chars"]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in out.collect())
    assert got == sorted([("0", TEXT, len(TEXT)), ("1", "", 0), ("2", "", 0), ("3", TEXT, len(TEXT)), ("None", TEXT, len(TEXT))])
    assert pagetext.extract(frame(spark, [])).count() == 0
