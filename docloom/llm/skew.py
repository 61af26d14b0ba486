"""Aggregates and joins by keys of which one may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that a key's rows are dealt to.
SALTS = 64
_DO = {"min": F.min, "max": F.max, "sum": F.sum}


def salted(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``__salt``, by a column that deals a key's rows evenly."""
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by, F.lit(5)), F.lit(SALTS)).cast("int"))


def with_totals(rows: DataFrame, key: str, by: str, **totals: tuple[str, str]) -> DataFrame:
    """``rows`` with aggregates over ``key`` (name=(min, max or sum, column)): those of a key
    and salt are merged, and handed back to each salt that there is.  Rows with a null key
    are left out."""
    rows = salted(rows, by)
    parts = rows.groupBy(key, "__salt").agg(*[_DO[f](c).alias(name) for name, (f, c) in totals.items()])
    whole = parts.groupBy(key).agg(*[_DO[f](name).alias(name) for name, (f, _) in totals.items()], F.collect_list("__salt").alias("__salts"))  # SALTS at most
    return rows.join(whole.withColumn("__salt", F.explode("__salts")).drop("__salts"), [key, "__salt"]).drop("__salt")


def join_one(rows: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``other``, which has each key once."""
    rows = salted(rows, by)
    places = other.join(rows.select(key, "__salt").distinct(), key)
    return rows.join(places, [key, "__salt"]).drop("__salt")
