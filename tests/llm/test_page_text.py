"""Page text against a plain version of the scores, the articles of the sample, and odd markup."""

import html as entities
import math
import random
import re

import numpy as np
import pytest

from strandline.llm import page_text

LONG = " ".join(["The quick brown fox jumps over the lazy dog and runs through the long green field until evening."] * 3)
NONE = lambda values, places: values.astype(float)


def article_of(page):
    """The article of a page of the sample, by patterns."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|article)>", re.sub(r"<!--.*?-->", "", inner[1], flags=re.S).replace("<br>", " ")) if inner else []
    texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", x))).strip() for x in blocks]
    return "\n\n".join(x for x in texts if x)


def test_articles_of_the_sample(spark, sample):
    for r in page_text.extracted(spark.read.parquet(f"{sample}/pages.parquet")).join(spark.read.parquet(f"{sample}/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text == article_of(r.html) and r.n_chars == len(r.text)


def plain_content(lines):
    places, at = [], 0.0
    for i, x in enumerate(lines):
        at += 0 if i == 0 else 1 + page_text.GAP * (x[3] != lines[i - 1][3])
        places.append(at)
    value = [x[5] * math.log1p(len(x[0]) * (1 - x[2]) / x[1]) for x in lines]
    score = []
    for i, x in enumerate(lines):
        reach = math.ceil(3 * page_text.SIGMA)
        k = {j: math.exp(-(((places[i] - places[j]) / page_text.SIGMA) ** 2) / 2) for j in range(max(0, i - reach), min(len(lines), i + reach + 1))}
        score.append(x[5] * sum(k[j] * value[j] for j in k) / sum(k.values()))
    mean = sum(score) / len(score)
    limit = page_text.THRESHOLD * math.sqrt(sum((s - mean) ** 2 for s in score) / len(score))
    seed = [s >= max(limit, 1e-12) for s in score] if max(score) > 0 else [True] * len(lines)
    region = [-x[4] if x[4] else x[3] for x in lines]
    keep = []
    for i, x in enumerate(lines):
        own = [lines[j][5] for j in range(len(lines)) if seed[j] and region[j] == region[i]]
        keep.append(seed[i] or bool(own) and score[i] >= page_text.JOIN * limit and x[5] >= 0.3 * max(own))
    for i in reversed(range(len(lines) - 1)):
        if lines[i][6] and keep[i + 1] and lines[i][5] >= 0.3 * lines[i + 1][5] and lines[i][2] < 1:
            keep[i] = True
    return keep


def test_scores_equal_a_plain_version():
    rng = random.Random(4)
    for _ in range(300):
        lines = [("x" * rng.choice((1, 5, 40, 300)), rng.randint(1, 6), rng.choice((0.0, 0.0, 0.5, 1.0)), rng.randint(0, 4), rng.choice((0, 0, 1)), rng.choice((0.15, 0.5, 1.0, 2.0)), rng.random() < 0.2) for _ in range(rng.randint(1, 25))]
        assert page_text.content(lines).tolist() == plain_content(lines)


PAGES = {
    "a frame named after a sidebar": (f'<div class="content with-sidebar"><h2>Head</h2><p>{LONG}</p><p>Short.</p></div><div class="sidebar"><p>Also read this and that.</p></div>', f"Head\n\n{LONG}\n\nShort."),
    "a frame named after a header": (f'<div id="page-header-wrap"><article><h1>A</h1><p>{LONG}</p></article></div>', f"A\n\n{LONG}"),
    "an article named after a search": (f'<nav><a href=x>Home</a></nav><article class="search-results-study"><h1>A</h1><p>{LONG}</p></article>', f"A\n\n{LONG}"),
    "an unclosed menu": (f"<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><article><h1>A</h1><p>{LONG}</p><p>End.</p></article><footer>copyright someone 2024</footer>", f"A\n\n{LONG}\n\nEnd."),
    "main around an article": (f"<main><h1>Head</h1><article><p>{LONG}</p></article><p>A closing paragraph.</p></main><footer>All rights reserved by somebody</footer>", f"Head\n\n{LONG}\n\nA closing paragraph."),
    "two parts and comments": (f"<div class=story><div><p>{LONG}</p><p>{LONG}</p></div><div><p>A short second part.</p></div></div><div class=comments><p>{LONG} No!</p></div>", f"{LONG}\n\n{LONG}\n\nA short second part."),
    "no article element": (f"<body><div class=menu><a href=1>one</a> <a href=2>two</a></div><h1>T</h1><p>{LONG}</p><ul><li>a<li>b</ul><p>Fin.</p><form><label>Mail</label><input></form><div id=comments><p>I think {LONG}</p></div></body>", f"T\n\n{LONG}\n\na\n\nb\n\nFin."),
    "a long notice, a short article": ('<div class="cookie-notice"><p>We use cookies to improve your stay on this site and to show you ads. By going on you agree to all of it.</p></div><header><h1>Site</h1></header><article><h2>T</h2><p>One line only.</p></article>', "T\n\nOne line only."),
    "a page inside a form": (f"<form id=f><div><h1>T</h1><p>{LONG}</p></div></form>", f"T\n\n{LONG}"),
    "cards below an article": (f'<main><article><h1>T</h1><p>{LONG}</p></article><section class="related"><article class="teaser"><h3>Other</h3><p>Teaser of another story here</p></article></section></main>', f"T\n\n{LONG}"),
    "markup and references": ("<p>a &lt;b&gt; &amp;amp; <script>x</script><b>c</p></i></div>", "a <b> &amp; c"),
    "no markup": ("plain\n text", "plain text"),
    "only a menu": ("<nav><a href=x>Home</a></nav>", "Home"),
    "only markup": ("<div><br><img src=x></div>", ""),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_odd_pages(name):
    page, want = PAGES[name]
    assert page_text.main_text(page) == want


def test_the_method_decides_where_tags_do_not():
    page = f"<div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>Short end.</p></div></div>" + "".join(f"<div><p><a href={i}>more</a> <a href={i}>and more</a> ok</p></div>" for i in range(12))
    assert page_text.main_text(page).endswith("Short end.") and "and more" not in page_text.main_text(page)
    assert "Short end." not in page_text.main_text(page, lambda v, p: np.where(v > v.mean() + v.std(), v, 0.0))
    quiet = f"<div><div><p>{LONG}</p></div><div><p>.</p></div></div>" + "<div><p><a href=x>more</a></p></div>" * 3
    assert page_text.main_text(quiet).endswith("\n\n.") and not page_text.main_text(quiet, NONE).endswith("\n\n.")


def test_long_and_deep_pages():
    page = "<div>" * 30_000 + f"<article><h1>T</h1><p>{LONG}</p>" + "<p>word word word</p>" * 20_000 + "</article>" + "</div>" * 30_000 + "<footer>f</footer>"
    text = page_text.main_text(page)
    assert text.count("word word word") == 20_000 and text.startswith(f"T\n\n{LONG}")
