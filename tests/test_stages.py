"""The filter stages: one case per line of the semantics, on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.functions.clients import Retrying, Scripted
from docloom.functions.langid import NgramDetector, detect, learn_profiles
from docloom.functions.text import char_ngrams, literal_list, py_strip
from docloom.operators.base import BATCH, BATCH_ROWS, tagged
from docloom.operators.filters import DedupQuestions, Language, LanguageOcr, NGramOverlap, TextLength, local_dedup
from docloom.schema import QA

LONG = "the quick brown fox jumps over the lazy dog and it is on the way to the river with all of that"


@pytest.fixture(scope="module")
def made(spark):
    def make(text=LONG, ocr="", questions=(), answers=(), split="train"):
        return spark.createDataFrame([(1, split, None, text, ocr, list(questions) if questions is not None else None, list(answers) if answers is not None else None)], QA)

    return make


def one(stage, df):
    return stage.annotate(df).first()


@pytest.mark.parametrize("text, ocr, value, removed", [("x" * 60, "", 60, False), ("x" * 59, "", 59, True), ("", "y" * 61, 61, False), (None, None, 0, True), ("é😀" * 30, None, 60, False)])
def test_length(made, text, ocr, value, removed):
    r = one(TextLength(), made(text, ocr))
    assert (r.filter_value, r.removed, r.questions) == (value, removed, [])


@pytest.mark.parametrize("engine", ["arrow", "sql"])
@pytest.mark.parametrize(
    "text, question, value",
    [("abc", "abcdef", 0.0), ("abcdefgh", "abc", 0.0), ("abcdefgh", "a b c", None), ("abcdefgh", "abcdefgh", 1.0), ("abcdefgh", "abcdxyzw", 0.2), ("a😀b😀c", "😀b😀c", 1.0), ("ab\rcd\te", "b\rcd", 1.0), ("ab cd ef", "bcde", 1.0), (None, "abcdef", 0.0), ("ABCDE", "abcde", 0.0)],
)
def test_overlap(made, engine, text, question, value):
    r = one(NGramOverlap(engine=engine), made(text, questions=[question], answers=["x"]))
    assert r.filter_value == [value] and r.removed == (not value or value <= 0.12)
    assert r.questions == ([] if r.removed else [question]) and r.answers == ([] if r.removed else ["x"])


@pytest.mark.parametrize("engine", ["arrow", "sql"])
@pytest.mark.parametrize("text", [LONG, "a😀b😀c d\ne" * 9, "abc", "a b c", "", None])
def test_overlap_of_many_questions(made, engine, text):
    """Questions that share n-grams with each other, repeat n-grams, are null or too short."""
    asked = [LONG[:30], LONG[10:40], "zzzzzz", "the the the the", None, "", "abc", "a b c", "😀b😀c d", LONG[:30], "d\nea😀"]
    grams = lambda x: {x.replace(" ", "")[k : k + 4] for k in range(len(x.replace(" ", "")) - 3)}
    share = lambda q: 0.0 if not text or len(text) < 4 or not q or len(q) < 4 else len(grams(q) & grams(text)) / len(grams(q)) if grams(q) else None
    df = made(text, questions=asked, answers=["x"] * len(asked))
    assert one(NGramOverlap(engine=engine), df).filter_value == [share(q) for q in asked]
    assert one(NGramOverlap(engine=engine), made(text, questions=None)).filter_value is None


def test_batches_of_texts_are_small(spark, made):
    """However many rows a task has, Python gets few at a time; a session's own setting stays."""
    before = spark.conf.get(BATCH)
    try:
        for own, want in (("10000", str(BATCH_ROWS)), ("500", "500")):
            spark.conf.set(BATCH, own)
            NGramOverlap().annotate(made())
            assert spark.conf.get(BATCH) == want
    finally:
        spark.conf.set(BATCH, before)


def test_overlap_threshold_is_strict(made):
    df = made("abcdefgh", questions=["abcdxyzw"], answers=["x"])
    assert one(NGramOverlap(threshold=0.2), df).removed and not one(NGramOverlap(threshold=0.19), df).removed


@pytest.mark.parametrize("stage", [NGramOverlap(), Language("en"), DedupQuestions(lambda: Scripted(local_dedup))])
@pytest.mark.parametrize("questions", [[], None])
def test_no_questions(made, stage, questions):
    r = one(stage, made(questions=questions))
    assert r.removed


def test_realignment(made):
    q, a = ["the quick", "brown fox", "the quick"], ["1", "2", "3"]
    assert one(NGramOverlap(), made(questions=q, answers=a)).answers == ["3", "2", "3"]
    assert one(NGramOverlap(), made(questions=q, answers=["1"])).answers == ["1", "1"]
    assert one(NGramOverlap(mode="strict"), made(questions=q, answers=["1"])).answers == ["1", None, "1"]
    assert one(NGramOverlap(), made(questions=q[:1], answers=a)).answers == ["1"]


def test_misalignment_over_two_stages(made):
    df = made(questions=["the quick", "brown fox", "the quick"], answers=["a"])
    again = NGramOverlap().annotate(NGramOverlap().annotate(df).drop("removed")).first()
    assert again.answers == ["a", "a", "a"]


def test_language(made):
    q = ["is it on the way", "12345", "le chat est dans la rue avec une souris"]
    r = one(Language("en"), made(questions=q, answers=["1", "2", "3"]))
    assert (r.filter_value, r.removed, r.questions, r.answers) == ("en", False, q[:1], ["1"])
    assert not one(Language("en"), made("12345", questions=q)).removed
    assert one(Language("hu"), made(questions=q)).removed
    assert one(Language("en"), made(None, questions=q)).filter_value == "en"


def test_language_ocr(made):
    q = ["is it on the way"]
    assert one(LanguageOcr("en"), made("", "", questions=q)).filter_value == ["None", "None"]
    assert one(LanguageOcr("en"), made("", None, questions=q)).removed
    assert not one(LanguageOcr("en"), made("der die und das ist nicht", LONG, questions=q)).removed


REPLIES = [
    ("['Q1', 'Q2']", ["Q1", "Q2"]), ("```python\n['Q2']\n```", ["Q2"]), ("here: ['Q1'] done", ["Q1"]), ("none", ["Q1", "Q2"]), ('["a"] ["b"]', ["Q1", "Q2"]), ("['Q1','Q1','Q1','Q1']", ["Q1", "Q2"]),
    ("['new', 'Q2']", ["Q2"]), ("['Q2', 'Q1']", ["Q2", "Q1"]), ("['Q1', 'Q1']", ["Q1", "Q1"]), ("[]", []), ("['it's']", ["Q1", "Q2"]), ("[' Q1 ']", ["Q1"]), ("[1, 'Q1']", ["Q1", "Q2"]),
]


@pytest.mark.parametrize("reply, kept", REPLIES)
def test_dedup(made, reply, kept):
    r = one(DedupQuestions(lambda: Scripted(lambda _: reply)), made(questions=["Q1", "Q2", " Q3"], answers=["1", "2", "3"]))
    assert (r.questions, r.filter_value, r.removed) == (kept, 3 - len(kept), not kept)
    assert r.answers == [q[1] for q in kept]


def test_dedup_asks_nothing_of_single_questions(made):
    def fail(_):
        raise AssertionError

    stage = DedupQuestions(lambda: Scripted(fail))
    assert one(stage, made(questions=["Q"], answers=["1"])).questions == ["Q"]
    assert one(stage, made(questions=[" Q"], answers=["1"])).removed
    assert "key" not in stage.label()


def test_local_dedup(made):
    r = one(DedupQuestions(lambda: Scripted(local_dedup)), made(questions=["What is it?", "what is it", "Who?"], answers=["1", "2", "3"]))
    assert (r.questions, r.answers, r.filter_value) == (["What is it?", "Who?"], ["1", "3"], 1)


def test_retries():
    calls, waits = [], []

    def flaky(_):
        calls.append(1)
        if len(calls) == 1:
            raise OSError
        return "" if len(calls) == 2 else "ok"

    assert Retrying(Scripted(flaky), sleep=waits.append).complete([{"content": "x"}]) == "ok" and len(waits) == 2
    with pytest.raises(RuntimeError):
        Retrying(Scripted(lambda _: ""), attempts=20, sleep=waits.append).complete([{"content": "x"}])
    assert len(waits) == 21


def test_apply_keeps_every_row(made):
    df = made(questions=["Q"]).unionByName(made("x", questions=["Q"]))
    kept, gone = TextLength().apply(df)
    assert kept.count() == gone.count() == 1
    assert {r.split for r in tagged(TextLength().annotate(df)).collect()} == {"removed", "remaining"}


def test_apply_stores_or_releases(made, tmp_path):
    df = made(questions=["What is it?", "what is it"], answers=["1", "2"])
    for store in (None, f"file://{tmp_path}/rows"):
        stage = DedupQuestions(lambda: Scripted(local_dedup))
        kept, gone = stage.apply(df, store)
        assert kept.first().questions == ["What is it?"] and gone.count() == 0
        assert kept.storageLevel.useMemory is False and (store is None) == (getattr(stage, "_held", None) is not None)
        stage.released()
        assert getattr(stage, "_held", None) is None


def test_ngram_detector(spark, made):
    learned = NgramDetector.learn(spark.createDataFrame([("the then there these", "en"), ("der den des dem", "de"), ("x", None), (None, "fr")], "text string, lang string"), 5)
    assert set(learned.learned) == {"en", "de"} and learned.learned["en"][0] == " th"
    one = learned.told()
    assert [one(x) for x in ("THE", "der", "zzz", "", None, "12 3", "qth the")] == ["en", "de", None, None, None, None, "en"]
    r = Language("en", learned).annotate(made("the", questions=["then", "der", "?"], answers=["1", "2", "3"])).first()
    assert (r.filter_value, r.removed, r.questions, r.answers) == ("en", False, ["then"], ["1"])
    r = LanguageOcr("en", learned).annotate(made("", None, questions=["then"])).first()
    assert r.filter_value == ["None", "None"] and r.removed
    assert Language("en", learned).annotate(made("the", questions=None)).first().removed
    assert NgramDetector({}).told()("the") is None


def test_text_functions(spark):
    df = spark.createDataFrame([("\x1c  a b\t\n",), ("",), (None,)], "t string")
    assert [r.t for r in df.select(py_strip(F.col("t")).alias("t")).collect()] == ["a b", "", None]
    assert [r.t for r in df.select(literal_list(F.col("t")).alias("t")).collect()] == [None] * 3
    grams = spark.createDataFrame([("a😀é b",), ("ab",)], "t string").select(char_ngrams(F.col("t"), 3).alias("g")).collect()
    assert [set(r.g) for r in grams] == [{"a😀é", "😀éb"}, set()]
    learned = learn_profiles(spark.createDataFrame([("uno dos dos", "xx"), ("ein zwei ein", "yy"), ("z", None)], "text string, lang string"), 1)
    assert learned == {"xx": ["dos"], "yy": ["ein"]}
    told = spark.createDataFrame([("dos",), ("ein",), ("dos ein",), ("?",)], "t string").select(detect(F.col("t"), learned).alias("l"))
    assert [r.l for r in told.collect()] == ["xx", "yy", "xx", None]
