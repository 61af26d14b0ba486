"""I-Match against a second computation, its ranges, and how well it tells an edit."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from docloom.llm import imatch, queries

MASK = 0xFFFFFFFF


def murmur(values, seed=42):
    """Spark's 32-bit hash of an array of 64-bit integers."""

    def turned(x, n):
        return (x << n | x >> 32 - n) & MASK

    h = seed
    for v in values:
        for half in (v & MASK, v >> 32 & MASK):
            h = turned(h ^ (turned(half * 0xCC9E2D51 & MASK, 15) * 0x1B873593 & MASK), 13) * 5 + 0xE6546B64 & MASK
        h ^= 8
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> shift) * by & MASK
    return h


def terms(text):
    return {xxhash.xxh64_intdigest(w.encode(), 42) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def tree(own, levels):
    own = sorted(own, key=signed)
    for level in range(levels + 1):
        for k in range(min(2**level, imatch.WIDTH)):
            # the number of a subset: which way its terms went at each level, of which early ones went the first
            free = min(level, imatch.WIDTH.bit_length() - 1)
            bits = [0] * (level - free) + [k >> (free - 1 - i) & 1 for i in range(free)]
            some = [x for x in own if all(x >> (63 - i) & 1 == b for i, b in enumerate(bits))]
            yield murmur(some) if some else None


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return {r["doc_id"]: r for r in queries.QUERIES["op5_imatch"](spark, sf_dir).collect()}


@pytest.fixture(scope="module")
def texts(duck):
    return duck.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def test_second_computation(found, texts):
    n, counts = len(texts), Counter(x for _, t in texts for x in terms(t))
    band = {x for x, k in counts.items() if max(2, imatch.LOW * n) <= k <= max(2, imatch.HIGH * n)}

    def marks(text):
        own = terms(text)
        return [*tree(own & band, imatch.LEVELS), *tree(own, imatch.ALL_LEVELS)]

    def likeness(a, b):
        known = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
        return sum(x == y for x, y in known) / len(known) if known else 1.0

    def shown(a):
        return ":".join("-" if x is None else f"{x:08x}" for x in a)

    own = [marks(t) for _, t in texts]
    for k, (d, t) in enumerate(texts):
        after, half, r = texts[(k + 1) % n][1], len(t) // 2, found[d]
        edited = t[: len(t) - half] + after[:half]
        other = marks(edited)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own[k]), shown(other))
        assert r.near_edited == pytest.approx(likeness(own[k], other)) and r.near_next == pytest.approx(likeness(own[k], own[(k + 1) % n]))


def test_tells_edits(found):
    """An edit of half of a text leaves more than the next text has."""
    long = [r for r in found.values() if r.n_chars >= 50]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)


@pytest.mark.parametrize("ids", ["id", "case when id = 7 then 1000000000000000 else id end", "id * id * id", "-9223372036854775807 + id * 400000000000000"])
def test_ranges_are_even(spark, monkeypatch, ids):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 100)
    monkeypatch.setattr(imatch, "COARSE", 12)
    df = spark.range(20_000).select(F.expr(ids).alias("doc_id"))
    sizes = [r["count"] for r in df.groupBy(imatch.ranges(df).alias("range")).count().collect()]
    assert max(sizes) <= 4 * 20_000 / 144


def test_order(spark, monkeypatch):
    """Nulls first, equal ids by text, the last before the first; in one range or several."""
    rows = [(None, "b"), (None, "a"), (5, "y"), (5, "x"), (-(2**63), "low"), (2**63 - 1, "high"), (0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash"))
    order = ["a", "b", "low", "", "x", "y", "high"]
    for per_range in (2048, 1):
        monkeypatch.setattr(imatch, "RANGE_ROWS", per_range)
        docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        table = imatch.look_up(imatch.lexicon(docs))
        got = {r.text: r.next for r in imatch.with_next(docs, table).select("text", F.col("next.text").alias("next")).collect()}
        assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}
    one = imatch.imatch(spark.createDataFrame([(3, "abc")], "doc_id long, text string")).first()
    assert one.marks == one.next_marks and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
