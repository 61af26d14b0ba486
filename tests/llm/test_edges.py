"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import gzip
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import chat, common, components, decontamination, html_text, imatch, language, packing, simhash, substring_dedup, token_files, tokens, warc

LONG = " ".join(f"w{i}" for i in range(60_000))
EXTRA = {"count": "long", "key": "string", "lang_pred": "int", "fp": "long", "component": "string", "rank": "int"}
DOCS = [
    (1, "the of and to in is that it", "en", "s", 27), (2, None, "en", None, None), (3, "", None, "s", 0), (4, "der die und ist nicht von mit", "de", "s", 29),
    (5, LONG, "en", "s", len(LONG)), (5, LONG, "en", "s", len(LONG)), (None, "no id here", "en", "s", 10), (6, "123 456 !?", "en", "s", 10), (7, "the of and to in is that it", "en", "s", 27),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    for name, kind in EXTRA.items():
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, LONG[:80]), (2, None), (None, "no id here"), (3, ""), (3, ""), (4, "the of and")], "item_id long, text string")


def test_chat(spark):
    events = [
        (1, 0, "message", "a", "user", "hi"), (1, 1, "delta", None, "assistant", "par"), (1, 2, "delta", None, "assistant", "tial"), (1, 3, "edit", "a", None, "hello"),
        (1, 4, "regenerate", None, None, None), (1, 5, "message", "b", "assistant", "full"), (1, 5, "message", "b", "assistant", "full"), (1, 6, "delete", "zz", None, None),
        (None, 0, "message", None, None, None), (2, None, "message", None, "user", None),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, op string, msg_id string, role string, text string").withColumn("count", F.lit(1))
    found = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chats(df).collect()}
    assert found == {1: [("user", "hello"), ("assistant", "full"), ("assistant", "full")], None: [(None, "")], 2: [("user", "")]}
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


def naive(events):
    """A conversation's turns by searching a list of messages for every event."""
    said = []
    for op, name, role, text in events:
        text = text or ""
        if name is None:
            at = len(said) - 1
        else:
            at = max((k for k, m in enumerate(said) if m[0] == name), default=-1)
        if op in (None, "message"):
            said.append([name, role, text, False])
        elif op == "delta" and at >= 0 and (name is not None or said[at][3] and said[at][1] == role):
            said[at][2] += text
        elif op == "delta":
            said.append([name, role, text, True])
        elif at >= 0 and op == "edit":
            said[at][2] = text
        elif at >= 0 and op == "delete":
            said.pop(at)
        elif op == "regenerate":
            own = [k for k, m in enumerate(said) if m[1] == (role or "assistant")]
            said = said[: own[-1]] if own else said
    return [(role, text) for _, role, text, _ in said]


def test_chat_logs():
    """Random logs of deltas, edits, regenerations and deletions against a naive fold."""
    dealt = random.Random(4)
    for _ in range(2000):
        events = [
            (dealt.choice([None, "message", "delta", "delta", "edit", "delete", "regenerate"]), dealt.choice([None, None, "a", "b", "c"]), dealt.choice([None, "user", "assistant", "assistant"]), dealt.choice([None, "", "x", "yz"]))
            for _ in range(dealt.randint(0, 25))
        ]
        own = chat.Fold()
        for e in events:
            own.apply(*e)
        assert own.turns() == naive(events)


def test_chat_turns_as_events(spark):
    """Turns, repeated and tied ones too, come back from a log of drafts, deltas and edits."""
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "abcdefgh"), (1, 1, "assistant", "abcdefgh"), (1, 2, "assistant", None), (1, 3, None, "x"), (1, 4, "tool", ""), (None, 0, "assistant", "a😀c"), (2, None, "user", None)]
    log = chat.as_events(spark.createDataFrame(rows, "conv_id long, seq long, role string, text string"))
    assert {r.op for r in log.select("op").distinct().collect()} == {"message", "edit", "delta", "regenerate"}
    found = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chats(log).collect()}
    assert found == {1: [("user", "hello"), ("assistant", "abcdefgh"), ("assistant", "abcdefgh"), ("assistant", ""), (None, "x"), ("tool", "")], None: [("assistant", "a😀c")], 2: [("user", "")]}


def test_chat_round_trip():
    random.seed(1)
    parts = ["</s>", "<s>", "[INST]", " [/INST]", "\\", "<", "[", "]", "x", "é", "\n", "<a>", "[TURN u] ", "[/TURN]", " ", "[NONE] "]
    for _ in range(3000):
        turns = [(random.choice(["user", "assistant", "system", "tool", None, "a] b", "]\\"]), "".join(random.choices(parts, k=random.randint(0, 7)))) for _ in range(3)]
        formatted, loss = chat.render(turns)
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_warc(spark):
    big = "x" * 2000
    pages = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", big + "y"), (4, "u", None), (5, "u", ""), (None, "u", big), (2, None, big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_archives(df, common.scratch(spark, "warc"))
    found = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(index).collect()), key=repr)
    assert found == sorted([(1, "revisit", 2, 2000), (2, "response", None, 2000), (2, "response", None, 2000), (3, "response", None, 2001), (4, "response", None, 0), (5, "response", None, 0), (0, "response", None, 2000)], key=repr)
    one = warc.read_records(index.where("page_id = 3")).collect()
    assert len(one) == 1 and one[0].payload.decode() == big + "y"
    heads = []
    for (uri,) in index.select("file").distinct().collect():
        with gzip.open(uri.removeprefix("file://")) as file:
            heads += re.findall(rb"WARC-Type: (\w+)\r\nWARC-Record-ID: (\S+)", file.read())
    assert len({name for _, name in heads}) == len(heads) and {kind for kind, _ in heads} == {b"warcinfo", b"response", b"revisit"}
    assert warc.read_records(warc.write_archives(df.where("false"), common.scratch(spark, "warc"))).count() == 0


def test_token_files(spark, docs, none):
    made = token_files.write_tokens(docs, common.scratch(spark, "tokens"), tokens.default_path(), block=1000)
    found = token_files.read_tokens(made).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    assert [r.n_tokens for r in found if r.doc_id in (2, 3)] == [1, 1]
    shard = max(made.collect(), key=lambda r: r.n_tokens)
    reader = token_files.Reader(shard.path)
    whole = b"".join(ids for _, _, ids in reader.documents())
    assert reader.ids(0, shard.n_tokens) == whole and reader.ids(995, 2003) == whole[4 * 995 : 4 * 2003] and reader.ids(5, 5) == b""
    assert token_files.read_tokens(token_files.write_tokens(none, common.scratch(spark, "tokens"), tokens.default_path())).count() == 0


def test_encoder():
    own = tokens.Encoder(tokens.default_path())
    odd = ["", " ", "a  b", " a", "a ", "a\n b", "a \nb", "x y z", "<|endoftext|> a b<|endoftext|>", "é è\n\nà", "it's he'll go", "\n", "a\tb c", "\U0001f600 b", "1 2,3   x", "a b c", "a\xa0 b"]
    want = [np.array([*x.ids, 2], "<u4").tobytes() for x in own.library.encode_batch(odd, add_special_tokens=False)]
    assert own(odd) == want and own(odd) == want


def test_a_worker_drops_its_encoder_at_the_next_stage(spark, docs, monkeypatch):
    def left(batches):
        for batch in common.slices(batches):
            yield batch_of_counts(batch.num_rows, len(tokens._encoders))

    def batch_of_counts(rows, n):
        return pa.RecordBatch.from_arrays([pa.array([n] * rows, pa.int64())], names=["n"])

    packing.token_pieces(docs.repartition(8), tokens.default_path()).count()
    assert spark.range(64).repartition(8).mapInArrow(left, "n long").agg(F.max("n")).first()[0] == 0

    monkeypatch.setattr(common, "_stage", None)
    monkeypatch.setattr(common.TaskContext, "get", lambda: SimpleNamespace(stageId=lambda: stage))
    stage = 1
    first = tokens.encoder(tokens.default_path(), 2)
    list(common.slices([]))
    assert tokens.encoder(tokens.default_path(), 2) is first
    stage = 2
    list(common.slices([]))
    assert not tokens._encoders


def test_encoder_cuts_where_the_library_does(monkeypatch):
    """Ids of random texts of letters, marks and white space, also when the memo is full."""
    import random

    own, dealt = tokens.Encoder(tokens.default_path()), random.Random(7)
    signs = ["a", "b", "\u00e9", "1", "\u00b2", " ", " ", "\n", ",", ".", "'", "s", "t", "-", "\u0301", "\u65e5", "\u00bb", "\t", "<|endoftext|>", "\r"]
    odd = ["", "\n", "\n\n", "\n\na", "a\n", "a\n\n", "a\n\n\nb", "don't, don't' x", "'s 's,\n'll", "<|endoftext|>, z"]
    odd += ["".join(dealt.choices(signs, k=dealt.randint(0, 14))) for _ in range(5000)]
    want = [np.array([*x.ids, 2], "<u4").tobytes() for x in own.library.encode_batch(odd, add_special_tokens=False)]
    assert own(odd) == want and own(odd) == want
    monkeypatch.setattr(tokens, "MEMO", 100)
    monkeypatch.setattr(tokens, "PART_CHARS", 50)
    small = tokens.Encoder(tokens.default_path())
    assert small(odd) == want and small(odd) == want and len(small.memo) <= 100


def test_language(docs, none):
    model = language.learn(docs)
    found = [(r.doc_id, r.lang_pred) for r in language.classify(docs, model).collect()]
    assert len(found) == len(DOCS) and (2, "und") in found and (3, "und") in found and (6, "und") in found
    assert language.classify(none, model).count() == 0
    assert {r.lang_pred for r in language.classify(docs.drop("lang_pred"), language.learn(none)).collect()} == {"und"}


def test_imatch(docs, none):
    found = imatch.imatch(docs).select("doc_id", imatch.shown(F.col("marks")).alias("m")).collect()
    marks = {r.doc_id: r.m for r in found}
    assert len(found) == len(DOCS) and marks[1] == marks[7] and marks[2] == marks[3] and set(marks[2]) == {"-", ":"}
    assert imatch.imatch(none).count() == 0


def test_html(spark):
    cases = {
        None: "", "": "", "<": "<", "plain text": "plain text", "<p>a &amp; b<p>c": "a & b c",
        "<nav>menu</nav><article><h1>T</h1><p>one <b>two</b>\n three<br>four</p><aside>x</aside><div class='comments'>no</div></article><footer>f</footer>": "T one two three four",
        "<div id=sidebar>links here</div><div class=body><p>The article text is long enough to be content.</p><p>Yes.</p></div><form>f</form>": "The article text is long enough to be content. Yes.",
        "<script>var a='</p>'</script><style>p{}</style>": "",
    }
    df = spark.createDataFrame([(k, None, h) for k, h in enumerate(cases)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()} == {k: (t, len(t)) for k, t in enumerate(cases.values())}
    assert html_text.extract(df.where("false")).count() == 0


def test_packing(docs, none):
    found = packing.pack_documents(docs).collect()
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = [0] + [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024
    assert sum(1 for r in found if r.doc_id == 2) == 1 and packing.pack_documents(none).count() == 0


def test_packing_plan():
    random.seed(2)

    def best(items, capacity):
        found = len(items)

        def go(k, room):
            nonlocal found
            if len(room) >= found:
                return
            if k == len(items):
                found = len(room)
                return
            for i in {r: i for i, r in enumerate(room)}.values():
                if room[i] >= items[k]:
                    go(k + 1, [*room[:i], room[i] - items[k], *room[i + 1 :]])
            go(k + 1, [*room, capacity - items[k]])

        go(0, [])
        return found

    for _ in range(60):
        items = sorted((random.randint(1, 20) for _ in range(8)), reverse=True)
        counts = {x: items.count(x) for x in items}
        plan = packing.Plan(counts, 20)
        # the reduction is exact: what it fixes can be completed to a best packing
        rest = [x for x in items]
        for x, runs in plan.runs.items():
            ends = [r[0] for r in runs[1:]] + [counts[x]]
            for (first, sequence, _, _), end in zip(runs, ends):
                if sequence < plan.fixed:
                    for _ in range(end - first):
                        rest.remove(x)
        assert plan.fixed + best(rest, 20) == best(items, 20)
        assert plan.sequences <= best(items, 20) + 1
    assert packing.Plan({}).sequences == 0
    # an item that isn't the largest is reduced though the largest can't be, and steps are counted
    plan = packing.Plan({11: 1, 10: 1, 9: 1, 8: 1, 1: 4}, 20)
    assert plan.steps["filled by two"] == 1 and sum(plan.steps.values()) == plan.fixed
    assert packing.Plan({x: 1 for x in (55, 53, 44, 36, 29, 26, 16)}, 100).runs[44][0][1] == 0  # (44, 55), though 55 alone decides nothing


def test_substring(spark, docs, none):
    passage = " ".join(f"p{i}" for i in range(51))
    near = passage.replace("p40", "other")
    texts = {10: f"alpha beta {passage} gamma", 11: f"one\n{passage} two", 12: near, 13: "x " * 400, 14: "x " * 300, 15: "clean words only here", 16: " ".join(f"q{i}" for i in range(25)), 17: " ".join(f"q{i}" for i in range(25))}
    df = docs.unionByName(spark.createDataFrame([(d, t, None, None, None) for d, t in texts.items()], SCHEMA), allowMissingColumns=True)
    found = substring_dedup.repeated_passages(df).collect()
    assert {r.doc_id for r in found} == {10, 11, 12, 13, 14, 16, 17} and {r.first_doc_id for r in found if r.doc_id in (10, 11)} == {10}
    kept = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert kept[10].text == texts[10] and passage not in kept[11].text and kept[15].text == texts[15] and 17 not in kept and kept[11].n_chars == len(kept[11].text)
    assert kept.keys() >= {None, 1, 2, 3, 4, 5, 6, 7, 13, 14, 16} and substring_dedup.repeated_passages(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0


def test_link_group():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (4, 21), dtype=np.uint64)
    rows = np.array([np.sort(np.r_[base[rng.integers(4)][: 21 - k], rng.integers(0, 2**63, k, dtype=np.uint64)]) for k in rng.integers(0, 5, 60)])
    sets = [set(r.tolist()) for r in rows]
    near = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    root = list(range(60))
    for _ in range(60):
        root = [min(root[j] for j in range(60) if near[i][j]) for i in range(60)]
    assert substring_dedup.link_group(rows).tolist() == root


def test_simhash(docs, none):
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (7, 1), (2, 2), (3, 2), (5, 5)} <= found and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
def test_trie_links(spark, monkeypatch, hot):
    """All links are found, also where a shared block is divided again."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:12]:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(signed)], "doc_id long, fp long")
    root = list(range(len(signed)))
    near = [[j for j, b in enumerate(signed) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3] for a in signed]
    for _ in signed:
        root = [min(root[j] for j in near[i]) for i in range(len(root))]
    assert {r.doc_id: r.component_id for r in simhash.near_components(df).collect()} == dict(enumerate(root))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, k) for k in range(201, 260)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100} | {k: 200 for k in range(200, 260)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_decontamination(docs, none, bench):
    found = {r.doc_id: r for r in decontamination.find_contamination(docs, bench).collect()}
    assert found[5]["items"] == ["1"] and found[1]["items"] == ["4"] and found[1].n_hit == 3 and found[2].n_words == 0
    assert found[None].n_hit == 3 and found[None]["items"] == [] and found[6].n_hit == 0
    assert decontamination.find_contamination(none, bench).count() == 0
    assert {r.n_hit for r in decontamination.find_contamination(docs, bench.where("false")).collect()} == {0}
    kept = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench).collect()}
    assert set(kept) == {None, 2, 3, 4, 6} and kept[None] == ""
    assert decontamination.cut_words("a B, c. D e", [{"start": 1, "stop": 3}]) == "a . D e"


def test_decontamination_with_a_full_filter(docs, bench, monkeypatch):
    """What the filter lets through by mistake the join drops."""
    whole = sorted(map(repr, decontamination.find_contamination(docs, bench).collect()))
    kept = sorted(map(repr, decontamination.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "FILTER_BITS", 64)
    assert sorted(map(repr, decontamination.find_contamination(docs, bench).collect())) == whole
    assert sorted(map(repr, decontamination.decontaminate(docs, bench).collect())) == kept


@pytest.mark.parametrize("table", ["docs", "none"])
def test_stages(spark, sf_dir, table, request):
    df = request.getfixturevalue(table)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns
        df = common.stored(out, "stage")
    if table == "docs":
        assert sorted(r.doc_id or 0 for r in df.select("doc_id").collect()) == [0, 1, 4, 5, 5]  # 0: null
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).columns[0] == "doc_id"


def test_pipeline(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    own = SimpleNamespace(**found.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("sequences")).first().asDict())
    assert own.docs > 100 and own.sequences <= 1.02 * -(-own.tokens // 1024) + 1
