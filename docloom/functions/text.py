"""Text expressions: character n-grams and their overlap, Unicode strip, literal lists."""

from __future__ import annotations

import ast

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of Python's str.strip: Java's Unicode class and four separators.
_SPACE = r"[\s\x1c-\x1f]"


def py_strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def _runs(text: Column, n: int) -> Column:
    """All runs of ``n`` code points once U+0020 is removed, repeats included."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    rest = f".{{{n - 1}}}" if n > 1 else ""
    look = rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}]{rest}))"
    return F.regexp_extract_all(F.replace(text, F.lit(" "), F.lit("")), F.lit(look), F.lit(1))


def char_ngrams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` code points once U+0020 is removed; none if too short."""
    return F.array_distinct(_runs(text, n))


def overlaps(text: Column, questions: Column, n: int) -> Column:
    """For each question the share of its n-grams that the text has.

    0.0 if text or question has fewer than ``n`` code points, spaces included; null if the
    question has no n-gram left without spaces.  The text's n-grams are made once, and met
    once with those of all questions; what a question has of the few found ones is counted.
    Both are bound as the element of a one-element array, so they aren't computed anew.
    """
    none = F.array().cast(T.ArrayType(T.StringType()))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def share(q: Column, own: Column, found: Column) -> Column:
        had = F.try_divide(F.size(F.array_intersect(found, own)).cast("double"), F.size(own).cast("double"))
        return F.when(q.isNull() | (F.length(q) < n), F.lit(0.0)).otherwise(had)

    def shares(own: Column) -> Column:
        met = F.array_intersect(_runs(text, n), F.flatten(own))
        return bound(met, lambda found: F.zip_with(questions, own, lambda q, g: share(q, g, found)))

    scores = bound(F.transform(questions, lambda q: F.coalesce(char_ngrams(q, n), none)), shares)
    return F.when(text.isNull() | (F.length(text) < n), F.transform(questions, lambda q: F.lit(0.0))).otherwise(scores)


def overlaps_arrow(n: int):
    """The same as one Arrow batch function of (text, questions); faster on long texts.

    Of a batch one row at a time is made into Python objects, and of its text's n-grams only
    those stay that a question has.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pa.Array, questions: pa.Array) -> pa.Array:
        def grams(x: str):
            x = x.replace(" ", "")
            return (x[i : i + n] for i in range(len(x) - n + 1))

        def row(text, asked):
            if asked is None:
                return None
            if text is None or len(text) < n:
                return [0.0] * len(asked)
            own = [None if q is None or len(q) < n else set(grams(q)) for q in asked]
            met = set().union(*(g for g in own if g)).intersection(grams(text))
            return [0.0 if g is None else len(g & met) / len(g) if g else None for g in own]

        return pa.array([row(t.as_py(), q.as_py()) for t, q in zip(texts, questions)], pa.list_(pa.float64()))

    return score


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(reply: pd.Series) -> pd.Series:
    """The Python list between the first ``[`` and the last ``]`` of a reply; null if there
    is none or it is no literal.  Items that aren't strings make the reply null too."""

    def parse(x):
        if x is None or "[" not in x or "]" not in x:
            return None
        try:
            found = ast.literal_eval(x[x.index("[") : x.rindex("]") + 1])
        except (ValueError, SyntaxError):
            return None
        return found if isinstance(found, list) and all(isinstance(i, str) for i in found) else None

    return reply.map(parse).astype(object).where(lambda s: s.notna(), None)


def display(text: Column, size: int = 100) -> Column:
    """The first ``size`` code points, with ``$`` spelled out."""
    return F.replace(F.substring(text, 1, size), F.lit("$"), F.lit("[DOLLAR]"))
