"""The region of a page: found by the clusters of text-to-tag ratios, not by tags or names."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pytest

from docloom.llm import html_text


def test_sibling_sections():
    rng = random.Random(2)

    def lines(n):
        return [" ".join(f"word{rng.randrange(1000)}" for _ in range(40)) for _ in range(n)]

    big, small, loose = lines(8), lines(2), lines(1)

    def marked(x):
        return "".join(f"<p>{t}</p>" for t in x)

    page = f"<html><body><ul><li><a>Home</a></li><li><a>About</a></li></ul><div>{marked(big)}</div><div><h2>Short</h2>{marked(small)}</div>{marked(loose)}</body></html>"
    assert html_text.main_text(page) == " ".join([*big, "Short", *small, *loose])


def test_between_and_lists():
    text = "words of a paragraph that is long enough to be content " * 3
    page = f"<body><div><p>{text}</p><div>Yes.</div><p>{text}</p><ul><li>one thing</li><li>two</li></ul></div><div>short</div></body>"
    assert html_text.main_text(page) == " ".join(f"{text}Yes. {text}one thing two".split())
    page = f"<body><div>short</div><article><p>{text}</p><div>Yours, A.</div></article><div>short</div></body>"
    assert html_text.main_text(page) == " ".join(f"{text}Yours, A.".split())


@pytest.fixture(scope="module")
def stripped(duck):
    """(page without the tags and names that tell what is content, its article's text)"""
    out = []
    for (page,) in duck.sql("SELECT html FROM pages WHERE html IS NOT NULL ORDER BY page_id").fetchall():
        own = re.search("<article>(.*)</article>", page, re.S)[1]
        bare = re.sub("</?(?:article|main)>", "", re.sub(' (?:class|id|role)="[^"]*"', "", page))
        out.append((bare, " ".join(html.unescape(re.sub("<[^>]*>", " ", own)).split())))
    return out


def share(stripped):
    return np.mean([html_text.main_text(page) == want for page, want in stripped])


def test_without_names(stripped):
    """Of articles of 200 characters and more; shorter ones hardly differ from an advert."""
    assert share([x for x in stripped if len(x[1]) >= 200]) >= 0.95 and share(stripped) >= 0.85


def test_noise_finds_nothing(stripped, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: rng.random(len(ratios)))
    assert share(stripped) < 0.6
