"""Pairing of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def realign(questions: Column, answers: Column, new: Column, mode: str = "compat") -> Column:
    """The answers of the questions ``new``.

    compat: by question text; of repeated questions the last answered one counts for all,
    and questions without an answer give none, so the arrays may differ in length.
    strict: as compat, but a question without an answer gives a null in its place.
    """
    known = F.least(F.size(questions), F.size(answers))
    paired = F.slice(questions, F.lit(1), F.greatest(known, F.lit(0)))

    def answer(q: Column) -> Column:
        return F.get(answers, (known - F.array_position(F.reverse(paired), q)).cast("int"))

    if mode == "compat":
        return F.transform(F.filter(new, lambda q: F.array_contains(paired, q)), answer)
    if mode == "strict":
        return F.transform(new, lambda q: F.when(F.array_contains(paired, q), answer(q)))
    raise ValueError(f"mode is compat or strict, not {mode!r}")


def mismatched(questions: Column, answers: Column) -> Column:
    """Whether the arrays differ in length; a missing array differs from any other."""
    return F.coalesce(F.size(questions), F.lit(-1)) != F.coalesce(F.size(answers), F.lit(-1))
