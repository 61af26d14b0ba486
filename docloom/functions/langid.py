"""Language detection: by common words, as a column expression, or by profiles of
character n-grams that are learned from labelled texts.

By words, a text's score for a language is the number of its words that are among the
language's common words.  By n-grams, it is the sum of the weights of all its trigrams; a
trigram's weight falls by one with each rank in the language's profile.  The best score
wins, ties go to the first name, and no hit is null.  Scores are integers, so every engine
gives the same answer.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Common words by language.
PROFILES: dict[str, list[str]] = {
    "de": "der die das und ist nicht von mit den dem ein eine zu auf für sich im auch es als".split(),
    "en": "the of and to in is that it for was on are as with be by this at from or".split(),
    "es": "el los las una y que es por con para se del no su al lo como más pero sus".split(),
    "fr": "le les des et est une du que qui dans pour au par sur pas plus ne avec ce il".split(),
    "hu": "a az és hogy nem egy is van volt meg csak de ez azt ha még el már mint vagy".split(),
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")


def _among(known: list[str]):
    return lambda w: w.isin(known)


def detect(text: Column, profiles: dict[str, list[str]] | None = None) -> Column:
    """The language of a text, or null if no profile has any of its words."""
    profiles = profiles or PROFILES
    names = sorted(profiles)

    def best(found: Column) -> Column:
        hits = [F.size(F.filter(found, _among(profiles[n]))) for n in names]
        top = F.greatest(*hits) if len(hits) > 1 else hits[0]
        choice = F.when(hits[0] == top, names[0])
        for n, h in zip(names[1:], hits[1:]):
            choice = choice.when(h == top, n)
        return F.when(top > 0, choice)

    return F.get(F.transform(F.array(words(text)), best), F.lit(0))


def learn_profiles(docs: DataFrame, top: int = 20) -> dict[str, list[str]]:
    """The ``top`` most frequent words of each language of ``docs`` (text, lang)."""
    counts = docs.where("lang is not null").select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    out: dict[str, list[str]] = {}
    for x in counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).orderBy("lang", "r").collect():  # top rows per language
        out.setdefault(x.lang, []).append(x.word)
    return out


#: Trigrams of a language's profile.
TOP = 300


def padded(text: Column) -> Column:
    """The words of a text, lower-cased, with one blank before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(text: Column) -> Column:
    """All runs of three code points of a padded text."""
    return F.regexp_extract_all(padded(text), F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"), F.lit(1))


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, n, rank from 0) of the ``top`` most frequent trigrams of each language of
    ``docs`` (text, lang); ties by the trigram."""
    counts = docs.where("lang is not null").select("lang", F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top)


@dataclass
class NgramDetector:
    """A detector by trigram profiles: {language: trigrams in order}.  It detects a text
    column, or with ``each`` every element of an array column."""

    learned: dict[str, list[str]]

    @staticmethod
    def learn(docs: DataFrame, top: int = TOP) -> NgramDetector:
        out: dict[str, list[str]] = {}
        for x in profiles(docs, top).orderBy("lang", "rank").collect():  # ``top`` rows per language
            out.setdefault(x.lang, []).append(x.gram)
        return NgramDetector(out)

    def told(self):
        """The detection of one text, as a function without Spark."""
        names = sorted(self.learned)
        weights: dict[str, list[tuple[int, int]]] = {}
        for k, name in enumerate(names):
            for rank, gram in enumerate(self.learned[name]):
                weights.setdefault(gram, []).append((k, len(self.learned[name]) - rank))
        marks = regex.compile(r"[^\p{L}]+")

        def one(text: str | None) -> str | None:
            if not text or not names:
                return None
            own = f" {marks.sub(' ', text.lower()).strip(' ')} "
            scores = [0] * len(names)
            for gram, n in Counter(map("".join, zip(own, own[1:], own[2:]))).items():
                for k, weight in weights.get(gram, ()):
                    scores[k] += n * weight
            best = max(scores)
            return names[scores.index(best)] if best else None

        return one

    def __call__(self, text: Column) -> Column:
        make = self.told

        @F.pandas_udf(T.StringType())
        def detected(texts: pd.Series) -> pd.Series:
            one = make()
            return pd.Series([one(x) for x in texts], dtype=object)

        return detected(text)

    def each(self, texts: Column) -> Column:
        make = self.told

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def detected(rows: pd.Series) -> pd.Series:
            one = make()
            return pd.Series([None if row is None else [one(x) for x in row] for row in rows], dtype=object)

        return detected(texts)
