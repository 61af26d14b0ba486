"""Lines that drift, word by word, against brute force over all pairs: none may be left out
because it is near a representative that its other neighbours are not near."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np

from docloom.llm import substring_dedup

RNG = random.Random(4)
FAMILIES, STEPS, WORDS = 30, 40, 60


def fresh(n):
    return [f"w{RNG.randrange(10**12)}" for _ in range(n)]


def drifted():
    """Families of lines, each with one word changed of the line before or of an earlier one."""
    out = []
    for _ in range(FAMILIES):
        w = fresh(WORDS)
        for s in range(STEPS):
            w = list(w) if not out or RNG.random() < 0.7 or s == 0 else list(RNG.choice(out[-s:]))
            w[RNG.randrange(WORDS)] = fresh(1)[0]
            out.append(w)
    return out


LINES = drifted()


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def firsts(lines):
    """The smallest line that each can reach over pairs at Jaccard 0.8."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lines]
    root = list(range(len(lines)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and near(a, sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def documents(spark):
    return spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(LINES)], "doc_id long, text string")


def test_op8_links(spark):
    """Classes of lines are those of all pairs, not of pairs with a representative."""
    found = {r.doc_id: r.first_doc_id for r in substring_dedup.near_pieces(documents(spark)).collect()}
    assert [found.get(d, d) for d in range(len(LINES))] == firsts(LINES)


def test_link_group_classes():
    """Groups at the start and pairs that are told already spare comparisons, not links."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 14, 12)).astype(np.uint32) for _ in range(60)]
    sets += [np.unique(rng.integers(100, 110, 9)).astype(np.uint32) for _ in range(60)]
    whole = substring_dedup.link_group(sets)
    told = np.arange(len(sets)) % 3 == 0
    among = np.arange(len(sets))
    among[told] = np.flatnonzero(told)[substring_dedup.link_group([s for s, t in zip(sets, told) if t])]
    assert (among != whole).any()
    assert substring_dedup.link_group(sets, root=among, told=told).tolist() == whole.tolist()


def test_pipeline_links(spark):
    """The pipeline's stage keeps one document of each class, and no near copy of it."""
    kept = corpus_pipeline.substring_dedup_stage(spark, documents(spark), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(firsts(LINES)))


def test_many_keys(spark, monkeypatch):
    """Keys that are too many to be broadcast are joined, with the same result."""
    monkeypatch.setattr(substring_dedup, "KEYS", 0)
    monkeypatch.setattr(substring_dedup, "frequent", lambda keys: np.empty(0, np.int64))
    lines = substring_dedup.stored(documents(spark).mapInArrow(substring_dedup._own_lines, substring_dedup.LINES), "lines")
    found = substring_dedup.components(substring_dedup.near_links(documents(spark), lines), "a", "b")
    of = {r.content: r.doc_id for r in lines.collect()}
    classes = {}
    for r in found.collect():
        classes.setdefault(r.component, set()).add(of[r.node])
    want = firsts(LINES)
    assert sorted(map(sorted, classes.values())) == sorted([d for d, f in enumerate(want) if f == first] for first in set(want))
