"""Pages without article or main, the shapes that class words used to hide, and the smoothing against plain sums."""

import html
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import pytest

from stridelake.llm import html_text
from stridelake.llm.html_text import Block, dense, main_text, smoothed

rng = random.Random(6)
say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."
LONG = [say(40) for _ in range(6)]

WRAPPERS = {
    "body": "{}",
    "div": "<div id=content>{}</div>",
    "deep": "<div class=page><div class='col col-8'><div class=text>{}</div></div></div>",
    "table": "<table><tr><td><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></td><td>{}</td></tr></table>",
    "section": "<section class='post-body'>{}</section>",
    "form": "<form action=x><input name=state>{}</form>",
    "sidebar layout": "<div class='layout sidebar-right'>{}</div>",
}
CONTENTS = {
    "paragraphs": ("<p>%s</p><p>%s</p><p>%s</p><p>%s</p>" % tuple(LONG[:4]), LONG[:4]),
    "unclosed": ("<p>%s<p>%s<p>%s" % tuple(LONG[:3]), LONG[:3]),
    "short between": (f"<p>{LONG[0]}</p><p>Yes.</p><p>{LONG[1]}</p><p>{LONG[2]}</p>", [LONG[0], "Yes.", LONG[1], LONG[2]]),
    "list": (f"<p>{LONG[0]}</p><ul><li>{LONG[1]}</li><li>{LONG[2]}</li></ul><p>{LONG[3]}</p>", [LONG[0], LONG[1], LONG[2], LONG[3]]),
    "markup": (f"<p>{LONG[0]} <b>bold</b> &amp; <a href=q>one link</a> {LONG[1]}</p><blockquote>{LONG[2]}</blockquote><p>{LONG[3]}</p>", [f"{LONG[0]} bold & one link {LONG[1]}", LONG[2], LONG[3]]),
    "headings": (f"<h1>The head</h1><p>{LONG[0]}</p><h2>Part</h2><p>{LONG[1]}</p><p>{LONG[2]}</p>", ["The head", LONG[0], "Part", LONG[1], LONG[2]]),
    "divs": ("<div>%s</div><div>%s</div><div>%s</div>" % tuple(LONG[3:6]), LONG[3:6]),
}
BEFORE = "<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div class='cookie-banner'><p>We use cookies and you should accept them all now</p></div>"
AFTER = "<div class=ad>Buy this wonderful thing today</div><aside><p>Text beside the page that goes on for a while here</p></aside><footer><p>All rights reserved by someone, in a long line of words</p></footer>"


@pytest.mark.parametrize("wrapper, content", list(itertools.product(WRAPPERS, CONTENTS)))
def test_bare_pages(wrapper, content):
    made, want = CONTENTS[content]
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{BEFORE}{WRAPPERS[wrapper].format(made)}{AFTER}</body></html>"
    assert main_text(page) == "\n".join(want)


P = "".join(f"<p>{t}</p>" for t in LONG)
TEXT = "\n".join(LONG)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8><body>{BEFORE}<article>{P}</article>{AFTER}",
        f"<html><body>{BEFORE}<div class='layout sidebar-right'><article>{P}</article></div>{AFTER}</body></html>",
        f"<html><body>{BEFORE}<article class='post comments-open'>{P}</article>{AFTER}</body></html>",
        f"<html><body>{BEFORE}<div id=social-history><article>{P}</article></div>{AFTER}</body></html>",
        f"<html><body>{BEFORE}<article><a href=x>{P}</article>{AFTER}</body></html>".replace("<a href=x><p>", "<p><a href=x name=y></a>", 1),
        f"<html><body>{BEFORE}<article>{P}<ul class=social-share><li><a href=1>Another page</a><li><a href=2>And one more</a><li><a href=3>And the last</a></ul></article>{AFTER}</body></html>",
        f"<html><body><header><h1>Site</h1><p>Slogan</p></header><form><article>{P}</article><input></form>{AFTER}</body></html>",
    ],
)
def test_nothing_of_the_article_is_hidden(page):
    assert main_text(page) == TEXT


def test_small_things_stay():
    assert main_text(f"<body><article><p>{LONG[0]}</p><p class='note reply-to'>To whom it concerns.</p><fieldset>Boxed</fieldset><p>x <math><mi>y</mi></math></p><p>{LONG[1]}</p></article>") == f"{LONG[0]}\nTo whom it concerns.\nBoxed\nx y\n{LONG[1]}"
    assert main_text(f"<article><p>{LONG[0]}<a href=x>never closed</p><p>{LONG[1]}</p><p>Short.</p></article>") == f"{LONG[0]}never closed\n{LONG[1]}\nShort."
    assert main_text("<div class=ad>Buy this now</div><article></article>") == "" and main_text("<div class=ad>Buy this now</div><article><h1>A</h1></article>") == "A"
    assert main_text("<p>Same<p>Same") == "Same\nSame" and main_text(f"<body><p>{'word ' * 200_000}</p>") == ("word " * 200_000).strip()


@pytest.mark.parametrize("name", ["newsletter-signup", "ad-slot", "sidebar-widget", "site-header", "cookie_notice", "comments-area", "reader-comments", "related-posts", "social-share", "main-nav", "menu-main", "post-comments", "advert", "adsbygoogle", "notice"])
def test_furniture_by_whole_words(name):
    """Blocks of such classes go, and so do all inside them; near misses stay."""
    junk = f"<div class='x {name}'><p>{say(30)}</p></div>"
    page = f"<body><div class=page>{junk}<p>{LONG[0]}</p><p>{LONG[1]}</p>{junk}<p>{LONG[2]}</p><p>{LONG[3]}</p></div></body>"
    assert main_text(page) == "\n".join(LONG[:4])
    near = page.replace(f"x {name}", f"x{name}x")
    assert len(main_text(near).split("\n")) == 6


def test_parts_around_an_article():
    head = f"<header><h1>The title</h1><p>By someone</p></header><p>{LONG[0]}</p><figure><img src=x><figcaption>A caption</figcaption></figure><pre>code  of\n it</pre><dl><dt>Term<dd>{LONG[1]}</dl>"
    page = f"<main><article>{head}<table><tr><th>Year<td>1999</table></article><aside>{say(40)}</aside><section class=related><article><p>{say(30)}</p></article></section></main>"
    assert main_text(f"<body>{BEFORE}{page}{AFTER}</body>") == f"The title\n{LONG[0]}\nA caption\ncode of it\nTerm\n{LONG[1]}\nYear\n1999"


def test_links_of_an_article_stay():
    """A list of references is part of the article; without one blocks of links stay where their surroundings are dense."""
    links = "".join(f"<li><a href={i}>Link number {i}</a>" for i in range(8))
    inner = f"<p>{LONG[0]}</p><p><a href=q>The source</a></p><p>{LONG[1]}</p><ul>{links}</ul>"
    assert main_text(f"<body>{BEFORE}<article>{inner}</article>{AFTER}").split("\n") == [LONG[0], "The source", LONG[1], *[f"Link number {i}" for i in range(8)]]
    assert main_text(f"<body>{BEFORE}<div>{inner}</div>{AFTER}").split("\n") == [LONG[0], "The source", LONG[1]]


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><section id=share><p>{LONG[0]}</p></section></article>", [LONG[0]]),
        (f"<article><p>{LONG[0]}</p><section id=share><p>{LONG[1]}</p></section><p>{LONG[2]}</p></article>", LONG[:3]),
        (f"<article><p>{LONG[0]}</p><div class=menu><p>Soup 3.50</p><p>Fish 9</p></div></article>", [LONG[0], "Soup 3.50", "Fish 9"]),
        (f"<article><p>{LONG[0]}</p><div class=share><a href=1>Here</a> <a href=2>There</a></div></article>", [LONG[0]]),
        (f"<article><div class=related><p>{LONG[0]}</p><p>{LONG[1]}</p></div></article>", LONG[:2]),
        (f"<body>{BEFORE}<div><p>{LONG[0]}</p><p>{LONG[1]}</p><p>{LONG[2]}</p></div><div><p>{LONG[3]}</p></div>{AFTER}", LONG[:4]),
        (f"<body><div><p>{LONG[0]}</p></div><div>Buy it</div><footer>x</footer>", [LONG[0]]),
        (f"<body><div>Hello you</div><div><h1>Head</h1><p>Intro.</p><p>{LONG[0]}</p><blockquote>Said.</blockquote></div>{AFTER}", ["Head", "Intro.", LONG[0], "Said."]),
        ("<p>x y<select><option>A<option>Bee</select> z</p>", ["x y z"]),
        ("<p>v</p><video><p>fallback</video><p>w</p><textarea>x<p>y</textarea><noscript><div>q</noscript>", ["v", "w"]),
        *[(f"<body><div><p>{LONG[0]}</p><p>{LONG[1]}</p></div><{tag} class='{name}'>{LONG[2]}</{tag}></body>", LONG[:2]) for tag, name in (("div", "c-comments__item"), ("section", "discussion"), ("div", "newsletter-cta"), ("div", "outbrain"), ("figure", "ad-slot"), ("p", "sponsored-text"))],
        (f"<article><p>{LONG[0]}</p><div class=byline-share-tools><a href=1>Tweet</a></div><p>{LONG[1]}</p></article>", LONG[:2]),
    ],
)
def test_names_are_weak_and_edges_are_whole(page, want):
    assert main_text(page).split("\n") == want


def test_pages_of_the_fixture_without_help():
    """Articles renamed to plain elements, and class words removed: at least 99 % of the blocks, nothing else."""
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    whole = lost = more = 0
    for page in pages:
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        want = Counter(main_text(page).split("\n"))
        assert "".join(main_text(page).split()) == "".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())
        bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
        for version in (bare, re.sub(r' class="[^"]*"', "", bare)):
            got = Counter(main_text(version).split("\n"))
            whole, lost, more = whole + want.total(), lost + (want - got).total(), more + (got - want).total()
    assert lost <= 0.01 * whole and more <= 0.001 * whole


def test_smoothing_and_threshold_by_plain_sums():
    for n in (1, 2, 5, 40):
        blocks = [Block("x" * rng.randint(1, 300), rng.randint(0, 9), 0, 0) for _ in range(n)]
        ratios = [len(b.text) / max(1, b.tags) for b in blocks]
        want = []
        for i in range(n):
            near = [(math.exp(-((i - j) ** 2) / 2), ratios[j]) for j in range(n) if abs(i - j) <= 2]
            want.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        assert smoothed(ratios) == pytest.approx(want)
        spread = (sum((r - sum(want) / n) ** 2 for r in want) / n) ** 0.5
        assert dense(blocks) == [r >= spread for r in smoothed(ratios)]


def test_kept_columns_are_replaced(spark):
    pages = spark.createDataFrame([(1, "old", 7, f"<article>{P}</article>"), (None, None, None, None)], "page_id long, text string, n_chars long, html string")
    rows = html_text.extract_pages(pages, keep=("page_id", "text", "n_chars")).collect()
    assert sorted((r.text, r.n_chars) for r in rows) == [("", 0), (TEXT, len(TEXT))]
