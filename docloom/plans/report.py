"""Counts, histograms and samples of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.qa import mismatched
from ..functions.text import display
from ..schema import COUNTED

BINS = 30


def counts(df: DataFrame) -> DataFrame:
    """One row: n_rows and n_questions in the counted splits, other_rows beside them."""
    known = F.col("dataset_split").isin(*COUNTED)
    return df.agg(
        F.count(F.when(known, 1)).alias("n_rows"),
        F.coalesce(F.sum(F.when(known, F.coalesce(F.size("questions"), F.lit(0)))), F.lit(0)).cast("long").alias("n_questions"),
        F.count(F.when(~F.coalesce(known, F.lit(False)), 1)).alias("other_rows"),
    )


def length_mismatches(df: DataFrame) -> DataFrame:
    """Rows of the counted splits whose questions and answers differ in number."""
    bad = df.where(F.col("dataset_split").isin(*COUNTED) & mismatched(F.col("questions"), F.col("answers")))
    return bad.select("doc_id", "dataset_split", F.size("questions").alias("n_questions"), F.size("answers").alias("n_answers"))


def histogram(values: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, low, n, density) of ``value`` within 1.5 interquartile ranges of the quartiles,
    both ends included; equal bins, the last one closed; all-equal values lie in the middle
    of a range of width 1.  Empty bins have no row; no values give no rows."""
    v = values.where("value is not null").groupBy(F.col("value").cast("double").alias("v")).agg(F.count("*").alias("k"))  # each value once: scored once
    box = v.agg(F.percentile("v", F.lit(0.25), F.col("k")).alias("q1"), F.percentile("v", F.lit(0.75), F.col("k")).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    kept = v.join(F.broadcast(box), (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)).select("v", "k")  # one row
    ends = kept.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum("k").alias("total"))
    ends = ends.select("total", F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = kept.join(F.broadcast(ends), F.col("v") >= F.col("lo")).withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))  # one row
    groups = binned.groupBy("bin", "lo", "hi", "total").agg(F.sum("k").alias("n"))
    return groups.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def categories(values: DataFrame) -> DataFrame:
    return values.groupBy("value").agg(F.count("*").alias("n"))


def sample_per_split(df: DataFrame, size: int, key=None) -> DataFrame:
    """Up to ``size`` rows of each split, in the order of ``key`` (a hash of doc_id by
    default): exact in number, and the same in every run.

    Only the ids are ranked, and each task passes on at most ``size`` of a split.
    """
    order = Window.partitionBy("dataset_split").orderBy(key if key is not None else F.xxhash64("doc_id", F.lit(42)), "doc_id")
    ids = df.select("doc_id", "dataset_split").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return df.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def head(df: DataFrame, size: int | None = None, most: int = 20) -> DataFrame:
    return df.orderBy("dataset_split", "doc_id").limit(min(size or most, most))


def displayed(df: DataFrame, value: str | None = None) -> DataFrame:
    """What a sample shows of a row: first question and text cut to 100 code points."""
    columns = ["doc_id", display(F.try_element_at("questions", F.lit(1))).alias("question"), display(F.col("text")).alias("text")]
    return df.select(*columns, *([F.round(value, 4).alias("value")] if value else []))


def showable(df: DataFrame) -> DataFrame:
    """Rows that have all that a sample shows: image, text and a question."""
    return df.where(F.col("image").isNotNull() & F.col("text").isNotNull() & (F.size("questions") > 0))
