"""The registered queries against SQL or brute force on a small scale."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pytest
import xxhash

from docloom.llm import queries

RAN: dict[str, list[dict]] = {}


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    def run(name):
        if name not in RAN:
            RAN[name] = [x.asDict() for x in queries.QUERIES[name](spark, sf_dir).collect()]
        return RAN[name]

    return run


@pytest.fixture(scope="module")
def texts(duck):
    return duck.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: [*e.ids, 2] for (d, _), e in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False))}


def crc(own):
    return zlib.crc32(np.array(own, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, rows, duck):
    want = duck.sql(queries.ORACLE_SQL[name])
    found = sorted(tuple(r[c] for c in want.columns) for r in rows(name))
    assert [tuple(sorted(r)) for r in rows(name)][:1] == [tuple(sorted(want.columns))]
    assert sorted(found, key=repr) == sorted(want.fetchall(), key=repr)


def test_op3(rows, ids):
    start, want = 0, []
    for d, own in ids.items():
        want.append({"doc_id": d, "start": start, "n_tokens": len(own), "ids_crc32": crc(own)})
        start += len(own)
    assert sorted(rows("op3_token_files"), key=lambda r: r["doc_id"]) == want


def test_op4(rows, duck, texts):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    found = {r["doc_id"]: r for r in rows("op4_language_id")}
    assert set(found) == set(lang)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in found.items())
    held = [d for d, r in found.items() if r["held_out"] and len(dict(texts)[d]) > 40]
    assert sum(found[d]["lang_pred"] == lang[d] for d in held) >= 0.97 * len(held)


def test_op5_has_no_python(spark, sf_dir):
    plan = queries.QUERIES["op5_imatch"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op6(rows, duck):
    pages = dict(duck.sql("SELECT page_id, html FROM pages").fetchall())
    assert len(rows("op6_html_extract")) == len(pages)
    for r in rows("op6_html_extract"):
        own = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", own)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_op7(rows, ids):
    places, seen = {}, {}
    for r in rows("op7_best_fit_packing"):
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert seen.keys() == ids.keys()
    for d, own in ids.items():
        at = 0
        for k, (piece, start, length, check) in enumerate(sorted(seen[d])):
            assert (piece, start) == (k, at) and check == crc(own[start : start + length])
            assert length == 1024 or k == 0
            at += length
        assert at == len(own)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_op8(rows, texts):
    """Every run of 50 words that two documents share is seen in both."""
    spans, grams, words = {}, {}, {}
    for r in rows("op8_substring_dedup"):
        assert r["removed"] == (r["first_doc_id"] != r["doc_id"]) and r["n_words"] == r["stop"] - r["start"]
        spans.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    for d, t in texts:
        words[d] = t.encode().lower().split()
        for i in range(len(words[d]) - 49):
            grams.setdefault(tuple(words[d][i : i + 50]), []).append((d, i))
    shared = [(d, i) for own in grams.values() if len({d for d, _ in own}) > 1 for d, i in own]
    assert shared
    for d, i in shared:
        assert any(a < i + 50 and i < b for a, b in spans[d])
    # and nothing is said of documents that share no run of 15 words
    short = {}
    for d, w in words.items():
        for i in range(len(w) - 14):
            short.setdefault(tuple(w[i : i + 15]), set()).add(d)
    assert set(spans) <= {d for own in short.values() if len(own) > 1 for d in own}


def test_op9(rows, texts):
    def brute(t):
        w = t.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: brute(t) for d, t in texts}
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
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows("op9_simhash_trie")} == {d: (f"{p:016x}", root[d]) for d, p in prints.items()}
