"""The filter stages of the curation cascade."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clients import asking
from ..functions.langid import detect
from ..functions.qa import realign
from ..functions.text import literal_list, overlaps, overlaps_arrow, py_strip
from .base import FilterStage, no_questions, once, small_batches


def _keep(df: DataFrame, kept: Column, mode: str) -> DataFrame:
    """``df`` with the questions ``kept`` and the answers that belong to them."""
    names = df.columns
    df = once(df, "__kept", kept).withColumn("answers", realign(F.col("questions"), F.col("answers"), F.col("__kept"), mode))
    return df.withColumn("questions", F.col("__kept")).select(*names)


@dataclass
class TextLength(FilterStage):
    """Removes rows of which neither text nor OCR has ``min_length`` code points."""

    min_length: int = 60

    def label(self) -> str:
        return f"TextLength(min_length={self.min_length})"

    def annotate(self, df: DataFrame) -> DataFrame:
        size = lambda c: F.coalesce(F.length(c), F.lit(0))
        return df.withColumn("filter_value", F.greatest(size("text"), size("ocr"))).withColumn("removed", F.col("filter_value") < self.min_length)


@dataclass
class NGramOverlap(FilterStage):
    """Keeps questions whose share of character n-grams found in the text is above
    ``threshold``; rows without a kept question go."""

    n: int = 4
    threshold: float = 0.12
    engine: str = "arrow"
    mode: str = "compat"

    def label(self) -> str:
        return f"NGramOverlap(n={self.n}, threshold={self.threshold})"

    def annotate(self, df: DataFrame) -> DataFrame:
        score = overlaps_arrow(self.n)(F.col("text"), F.col("questions")) if self.engine == "arrow" else overlaps(F.col("text"), F.col("questions"), self.n)
        df = once(small_batches(df), "filter_value", score)
        pairs = F.filter(F.arrays_zip("questions", "filter_value"), lambda x: F.coalesce(x["filter_value"] > self.threshold, F.lit(False)))
        df = _keep(df, F.transform(pairs, lambda x: x["questions"]), self.mode)
        return df.withColumn("removed", no_questions(F.col("questions")))

    def values(self, annotated: DataFrame) -> DataFrame:
        return annotated.select(F.explode("filter_value").alias("value")).where("value is not null")


@dataclass
class Language(FilterStage):
    """Keeps questions in ``language``; removes rows whose text is in another one (a text
    that can't be told passes) or that have no such question.  ``detector`` maps a column to
    a language: a column expression, or a service with ``each`` for arrays."""

    language: str = "hu"
    detector: Callable[[Column], Column] = field(default=detect, repr=False)
    mode: str = "compat"
    histogram = "categories"

    def label(self) -> str:
        return f"Language(language={self.language})"

    def _asked(self, df: DataFrame) -> DataFrame:
        right = lambda told: F.coalesce(told == self.language, F.lit(False))
        if not hasattr(self.detector, "each"):  # a column expression
            return _keep(df, F.filter("questions", lambda q: right(self.detector(q))), self.mode)
        names = df.columns
        df = df.withColumn("__told", self.detector.each(F.col("questions")))
        pairs = F.filter(F.arrays_zip("questions", "__told"), lambda x: right(x["__told"]))
        return _keep(df, F.transform(pairs, lambda x: x["questions"]), self.mode).select(*names)

    def annotate(self, df: DataFrame) -> DataFrame:
        df = self._asked(once(df, "filter_value", F.coalesce(self.detector(F.col("text")), F.lit(self.language))))
        return df.withColumn("removed", (F.col("filter_value") != self.language) | no_questions(F.col("questions")))


@dataclass
class LanguageOcr(Language):
    """As ``Language``, by text and OCR: rows go if neither is in ``language``; what can't
    be told is ``None``, which is no language."""

    def label(self) -> str:
        return f"LanguageOcr(language={self.language})"

    def annotate(self, df: DataFrame) -> DataFrame:
        told = lambda c: F.coalesce(self.detector(F.col(c)), F.lit("None"))
        df = self._asked(once(df, "filter_value", F.array(told("text"), told("ocr"))))
        return df.withColumn("removed", ~F.array_contains("filter_value", self.language) | no_questions(F.col("questions")))

    def values(self, annotated: DataFrame) -> DataFrame:
        return annotated.select(F.explode("filter_value").alias("value"))


# The instruction that a model is given.
DEDUP_PROMPT = (
    "Here is a list of questions, please deduplicate the list so that any if any pair of questions are the same, similar or paraphrases then remove them, and only return the deduplicated list. "
    "Please reply with a list of the deduplicated questions that is python list format, with no other text or code, just the python list. "
    "The deduplicated list must be a subset of original list, of less than or equal length. \n"
    "Original Question List: {questions}\nDeduplicated Question List: "
)


def local_dedup(prompt: str) -> str:
    """A reply without a model: the first of all questions that are equal but for case,
    white space and punctuation."""
    import ast

    listed = ast.literal_eval(prompt[prompt.index("Original Question List: ") + 24 : prompt.rindex("\nDeduplicated Question List:")])
    seen: dict[str, str] = {}
    for q in listed:
        seen.setdefault("".join(c for c in q.lower() if c.isalnum()), q)
    return repr(list(seen.values()))


@dataclass
class DedupQuestions(FilterStage):
    """Drops questions that a language model finds to repeat others.

    ``client`` makes a chat client, once per task; it is asked about ``parallel`` rows at a
    time.  Rows with one question or none never reach it.  Replies that are no list, or too long, leave the questions as they are;
    questions that aren't in the row are dropped.
    """

    client: Callable[[], object] = field(repr=False)
    model: str = ""
    mode: str = "compat"
    parallel: int = 1
    costly = True

    def label(self) -> str:
        return f"DedupQuestions(model={self.model})"

    def replies(self, df: DataFrame) -> DataFrame:
        """``df`` with ``reply``: null where the model isn't asked."""
        def one(client, questions):
            if questions is None or len(questions) <= 1:
                return None
            return client.complete([{"role": "user", "content": DEDUP_PROMPT.format(questions=str(list(questions)))}], max_tokens=1024, temperature=0)

        return df.withColumn("reply", asking(self.client, one, self.parallel)(F.col("questions")))

    def decide(self, df: DataFrame) -> DataFrame:
        """From ``reply`` to kept questions, answers, value and decision; no model here."""
        df = df.withColumn("__listed", literal_list(F.col("reply")))
        usable = F.col("__listed").isNotNull() & (F.size("questions") > 1) & (F.size("__listed") <= F.size("questions"))
        named = F.transform(F.when(usable, F.col("__listed")).otherwise(F.col("questions")), py_strip)
        df = df.withColumn("__before", F.coalesce(F.size("questions"), F.lit(0)))
        df = _keep(df, F.filter(named, lambda q: F.array_contains(F.col("questions"), q)), self.mode)
        df = df.withColumn("filter_value", F.col("__before") - F.coalesce(F.size("questions"), F.lit(0)))
        return df.withColumn("removed", no_questions(F.col("questions"))).drop("__before", "__listed", "reply")

    def annotate(self, df: DataFrame) -> DataFrame:
        return self.decide(self.replies(df))
