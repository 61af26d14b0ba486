"""Second computations in plain Python: language profiles, repeated passages, and the
pipeline stage by stage, each on its own input."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from docloom.llm import common, language, queries, substring_dedup


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


# language: ranks and distances


def grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            out.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip())
    return out


def ranked(counts):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[: language.TOP]


def predictions(documents):
    sums = {}
    for d, t, lang in documents:
        if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            sums.setdefault(lang, Counter()).update(grams(t or ""))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in sorted(sums.items())}
    out = {}
    for d, t, _ in documents:
        own = ranked(grams(t or ""))
        apart = {lang: sum(min(abs(p[g] - k), language.TOP) if g in p else language.TOP for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda x: (apart[x], x)) if own else None
        out[d] = (best, 1 - apart[best] / (language.TOP * len(own))) if own else ("und", 0.0)
    return out


def test_language(spark, sf_dir, documents):
    want = predictions(documents)
    found = {r["doc_id"]: r for r in queries.QUERIES["op4_language_id"](spark, sf_dir).collect()}
    assert found.keys() == want.keys()
    for d, (lang, score) in want.items():
        r = found[d]
        assert (r.lang_pred, r.held_out) == (lang, zlib.crc32(str(d).encode()) % 4 == 2) and r.score == pytest.approx(score)


# repeats: every window of 25 words, every pair of lines


def lines_of(text):
    at = 0
    for line in text.encode().lower().splitlines():
        own = line.split()
        if len(own) >= 25:
            yield at, own
        at += len(own)


def repeats(documents):
    """({doc_id: removed words}, {doc_id: words of any class}) by windows and by lines."""
    first, last, windows = {}, {}, {}
    for d, t, _ in documents:
        own = (t or "").encode().lower().split()
        for i in range(len(own) - 24):
            w = tuple(own[i : i + 25])
            if len(set(w)) > 1:
                windows.setdefault(w, []).append((d, i))
                first.setdefault(w, d)
                last[w] = d
    gone, any_ = {}, {}
    for w, places in windows.items():
        if first[w] != last[w]:
            for d, i in places:
                any_.setdefault(d, set()).update(range(i, i + 25))
                if d != first[w]:
                    gone.setdefault(d, set()).update(range(i, i + 25))
    lines = [(d, at, own) for d, t, _ in documents for at, own in lines_of(t or "")]
    shingles = [{tuple(own[i : i + 5]) for i in range(len(own) - 4)} for _, _, own in lines]
    having = {}
    for k, own in enumerate(shingles):
        for s in own:
            having.setdefault(s, []).append(k)
    root = list(range(len(lines)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, own in enumerate(shingles):
        for other, both in Counter(o for s in own for o in having[s] if o < k).items():
            if len(own) > 1 and both >= 0.8 * len(own | shingles[other]):
                a, b = sorted((find(k), find(other)))
                root[b] = a
    groups = {}
    for k in range(len(lines)):
        groups.setdefault(find(k), []).append(k)
    for own in groups.values():
        least = min(lines[k][0] for k in own)
        if any(lines[k][0] != least for k in own):
            for d, at, words in (lines[k] for k in own):
                any_.setdefault(d, set()).update(range(at, at + len(words)))
                if d != least:
                    gone.setdefault(d, set()).update(range(at, at + len(words)))
    return gone, any_


def test_repeats(spark, sf_dir, documents):
    gone, any_ = repeats(documents)
    assert len(gone) > 20
    removed, every = {}, {}
    for r in queries.QUERIES["op8_substring_dedup"](spark, sf_dir).collect():
        every.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
        if r.removed:
            removed.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    assert removed == gone and every == any_


@pytest.mark.parametrize("n, edits", [(25, 1), (40, 1), (60, 2)])
def test_recall(spark, n, edits):
    """Lines with words changed at every place, all of Jaccard 0.8 and more by brute force."""
    rng, rows, near = np.random.default_rng(n), [], []
    fresh = lambda k: [f"w{x}" for x in rng.integers(10**12, size=k)]
    for place in list(range(n)) * (1 if edits == 1 else 4):
        own = fresh(n)
        other = list(own)
        for p in {place, *(rng.integers(n, size=edits - 1).tolist())}:
            other[p] = fresh(1)[0]
        a, b = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (own, other))
        k = len(rows) // 2
        if len(a & b) >= 0.8 * len(a | b):
            near.append(10_000 + k)
        rows += [(k, " ".join(fresh(30)) + "\n" + " ".join(own)), (10_000 + k, " ".join(fresh(28)) + "\n" + " ".join(other))]
    found = {r.doc_id for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where(f"removed and n_words = {n}").collect()}
    assert near and len(found & set(near)) >= 0.97 * len(near)


@pytest.mark.parametrize("lowered", [{"HOT": 64, "KEYS": 10_000}, {"HELD": 100}, {"LEADERS": 2, "BLOCK": 3}])
def test_repeats_of_frequent_keys(spark, sf_dir, documents, monkeypatch, lowered):
    """The same results where keys are salted, flood a task, or fill several blocks."""
    for name, value in lowered.items():
        monkeypatch.setattr(substring_dedup, name, value)
    if "HOT" in lowered:
        monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
        monkeypatch.setattr(substring_dedup.frequent, "__defaults__", (3,))
    gone, _ = repeats(documents)
    removed = {}
    for r in queries.QUERIES["op8_substring_dedup"](spark, sf_dir).where("removed").collect():
        removed.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    assert removed == gone


# the pipeline


def simhash(text):
    w = text.encode()
    w = w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    root = {d: d for d in prints}
    order = sorted(prints)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark, sf_dir, documents, duck):
    docs = common.table(spark, sf_dir, "documents")
    rows, kept = {d: t or "" for d, t, _ in documents}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        found = [(r.doc_id, r.text or "") for r in docs.collect()]
        kept = dict(found)
        assert len(found) == len(kept)
        if name == "language_id":
            want = {d: rows[d] for d, (lang, _) in predictions(documents).items() if lang != "und"}
        elif name == "simhash_near_dedup":
            root = components({d: simhash(t) for d, t in rows.items()})
            want = {d: t for d, t in rows.items() if root[d] == d}
        elif name == "substring_dedup":
            gone = repeats([(d, t, None) for d, t in sorted(rows.items())])[0]
            want = {d: [w for k, w in enumerate(t.encode().split()) if k not in gone.get(d, ())] for d, t in rows.items()}
            want = {d: w for d, w in want.items() if w or not gone.get(d)}
            assert {d: t.encode().split() for d, t in kept.items()} == want
            want = kept
        else:
            items = [bench_words(t) for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()]
            windows = {tuple(x[i : i + 8]) for x in items for i in range(len(x) - 7)}
            want = {d: t for d, t in rows.items() if not any(tuple(w[i : i + 8]) in windows for w in (bench_words(t),) for i in range(len(w) - 7))}
        assert kept == want, name
        rows = kept
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert pieces.keys() == rows.keys()
    assert all(sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) for own in pieces.values())
