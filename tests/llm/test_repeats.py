"""Planted repeats against brute force: exact windows of 25 words, edited paragraphs."""

from __future__ import annotations

import random

import pytest

from docloom.llm import substring_dedup

RNG = random.Random(8)


def fresh(n):
    return [f"w{RNG.randrange(10**12)}" for _ in range(n)]


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def edited(words, places):
    return [*(fresh(1)[0] if k in places else w for k, w in enumerate(words))]


SHORT = [fresh(n) for n in range(25, 50)]
INSIDE = [(fresh(60), fresh(n), fresh(60)) for n in range(25, 50)]
LONG = [(fresh(90), fresh(n), fresh(90)) for n in (50, 51, 60, 75, 100)]
EXACT = dict(enumerate([*SHORT, *(sum(x, []) for x in (*INSIDE, *LONG))]))
EXACT |= {500 + d: w for d, w in enumerate([*SHORT, *(fresh(70) + p + fresh(70) for _, p, _ in INSIDE), *(fresh(100) + p + fresh(100) for _, p, _ in LONG)])}
MIDDLE = [(p, edited(p, at)) for n, at in ((60, {30}), (100, {33, 66}), (200, {50, 100, 150})) for p in (fresh(n) for _ in range(20))]
EDGES = [(p, edited(p, at)) for at in ({0}, {1}, {24}, {23}) for p in (fresh(25) for _ in range(5))]
EDGES += [(p, edited(p, {0, 1})) for p in (fresh(60) for _ in range(10))]


@pytest.fixture(scope="module")
def removed(spark):
    rows = [(d, " ".join(w)) for d, w in EXACT.items()]
    for k, (a, b) in enumerate([*MIDDLE, *EDGES]):
        rows += [(d, "\n".join(" ".join(x) for x in (fresh(40), own, fresh(30)))) for d, own in ((2000 + k, a), (3000 + k, b))]
    out = {}
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect():
        out.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    return out


def expected(documents):
    """The words of windows of 25 words that a document with a smaller doc_id holds."""
    first, out = {}, {}
    for d, w in sorted(documents.items()):
        own = {k for i in range(len(w) - 24) if first.setdefault(tuple(w[i : i + 25]), d) != d for k in range(i, i + 25)}
        out |= {d: own} if own else {}
    return out


def test_short(removed):
    """Exact repeats of 25 to 49 words, as texts and inside of other texts."""
    for d, own in expected(EXACT).items():
        if d < 500 + len(SHORT) + len(INSIDE):
            assert removed[d] == own


def test_whole(removed):
    """Passages of 50 words and more are removed from end to end, and nothing else is."""
    assert {d: x for d, x in removed.items() if d < 2000} == expected(EXACT)
    assert {len(removed[500 + len(SHORT) + len(INSIDE) + k]) for k in range(len(LONG))} == {50, 51, 60, 75, 100}


def near(removed, pairs, after):
    for k, (a, b) in enumerate(pairs, after):
        assert jaccard(a, b) >= 0.8
        assert removed.get(3000 + k) == set(range(40, 40 + len(b))) and 2000 + k not in removed


def test_edited(removed):
    """Paragraphs with words changed in the middle go as a whole."""
    near(removed, MIDDLE, 0)


def test_edited_edges(removed):
    """So do those with changed first or last words."""
    near(removed, EDGES, len(MIDDLE))
