"""Main text of every given page, with and without telling tags, and of hostile pages in time."""

from __future__ import annotations

import random
import re
import time
from html import unescape
from pathlib import Path

import pytest

from riskloom.llm import extract
from riskloom.llm.common import table


def article(html: str) -> str:
    """The article element of a given page: its tags are <h1>, <p>, <b> and <br>, of which only <b> is no block."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:h1|p|br)>", re.sub(r"</?b>", "", inner))
    return " ".join(t for p in parts if (t := re.sub(r"\s+", " ", unescape(p)).strip()))


def neutral(html: str) -> str:
    return re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", html).replace(' class="ad"', "")


@pytest.fixture(scope="module")
def pages(spark, data_dir):
    """The pages of the next larger table where there is one: 250, against 50 of the smallest."""
    larger = Path(data_dir).parent / "sf0.01"
    folder = str(larger) if (larger / "pages.parquet").exists() else data_dir
    return [r.html for r in table(spark, folder, "pages").collect() if r.html]


def test_every_given_page(pages):
    assert [h for h in pages if extract.main_text(h) != article(h)] == []


def test_density_finds_the_article_without_telling_tags(pages):
    right = sum(extract.main_text(neutral(h)) == article(h) for h in pages)
    assert right >= 0.95 * len(pages)


def test_without_densities_it_does_not(pages, monkeypatch):
    weigh = extract.weigh

    def shuffled(nodes):
        weigh(nodes)
        drawn = [(n.density, n.total) for n in nodes]
        random.Random(1).shuffle(drawn)
        for n, (n.density, n.total) in zip(nodes, drawn):
            pass

    monkeypatch.setattr(extract, "weigh", shuffled)
    right = sum(extract.main_text(neutral(h)) == article(h) for h in pages)
    assert right <= 0.3 * len(pages)


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<b>" * n + "<p>x</p>" * n,
        lambda n: "<div>" * n + "</section>" * n,
        lambda n: "<b><div>" + "<i>" * n + "</b>" * n,
        lambda n: "<ul>" + "<li><b>" * n + "x",
        lambda n: "<table>" + "<tr><td>" * n + "x",
        lambda n: "<a " * n + '"',
        lambda n: "<header>" * n + "x",
        lambda n: "<dl>" + "<dt>a<dd>b" * n,
        lambda n: '<div class="ad"><form>' * n + "x",
    ],
)
def test_time_is_in_proportion_to_the_page(page):
    html = page(3 * (1 << 20) // len(page(1)))
    began = time.time()
    extract.main_text(html)
    assert len(html) >= 1 << 20 and time.time() - began < 12


STORY = "<h1>T</h1>" + "<p>Some long paragraph of the story, that goes on for quite a while here and there.</p>" * 5


def test_comments_and_other_stories_inside_main():
    talk = "<p>Reader one said something at length about the story.</p><p>Reader two did too, a good deal more than that.</p>"
    page = f'<body><main>{STORY}<p><a href="x">Another story to read</a></p><div id="responses">{talk}</div></main></body>'
    assert extract.main_text(page) == extract.main_text(f"<body><main>{STORY}</main></body>")
    assert extract.main_text(f"<main>{STORY}<aside>{talk}</aside><nav>Go</nav></main>") == extract.main_text(f"<main>{STORY}</main>")


def test_a_title_beside_the_text():
    page = f'<body><div><div class="head"><h1>Title</h1></div><div>{STORY.replace("h1", "h2")}</div></div><div>Short end.</div></body>'
    assert extract.main_text(page).startswith("T Some long") or extract.main_text(page).startswith("Title T Some long")
    assert "Short end." not in extract.main_text(page)


def test_open_elements_close_as_before():
    assert extract.main_text("<p>a<b>b<p>c</b>d") == "ab cd"
    assert extract.main_text("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a b c"
    assert extract.main_text("<table><tr><td>a<td>b<tr><td>c</table>d") in ("a b c d", "a b c")
    assert extract.main_text("<div>a</span></p></div>b") == "a b"
    assert extract.main_text("<i>a<div>b</i>c</div>") == "a bc"
