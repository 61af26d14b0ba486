"""Filter stages: what a stage does to rows, and how a stage is applied."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterStage(ABC):
    """A stage annotates rows with ``value`` (what it decided on) and ``removed``, and may
    rewrite ``questions`` and ``answers``.  ``value`` has one type per stage."""

    #: Whether the stage calls a service or model; such results are kept and not recomputed.
    costly = False
    #: ``numbers`` or ``categories``: what the stage's histogram shows.
    histogram = "numbers"

    @abstractmethod
    def label(self) -> str: ...

    @abstractmethod
    def annotate(self, df: DataFrame) -> DataFrame:
        """``df`` with ``filter_value`` and ``removed`` set."""

    def values(self, annotated: DataFrame) -> DataFrame:
        """One row (value) per value that the histogram counts."""
        return annotated.select(F.col("filter_value").alias("value"))

    def apply(self, df: DataFrame, store: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(kept, removed): the rows are annotated once for both, in ``store`` if a shared
        folder is named.  A costly stage without one keeps its rows with the executors
        until ``released``; what a lost executor held is asked for again."""
        both = self.annotate(df)
        if store is not None:
            both.write.mode("overwrite").parquet(store)
            both = df.sparkSession.read.schema(both.schema).parquet(store)
        elif self.costly:
            self._held = both = both.persist(StorageLevel.MEMORY_AND_DISK)
        return both.where(~F.col("removed")), both.where("removed")

    def released(self) -> None:
        """Lets go of the rows that ``apply`` kept with the executors."""
        if (held := getattr(self, "_held", None)) is not None:
            held.unpersist()
            self._held = None


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row, as the only element of an
    exploded array: the optimizer neither copies the expression to where it is used nor
    moves a filter on it below."""
    return df.select(*[F.col(c) for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


#: Rows of texts in a batch between the JVM and Python.  Spark's default takes tens of
#: megabytes on both sides of each task, and more the more rows a task has.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now has small batches; a session's own setting stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == "10000":
        conf.set(BATCH, str(BATCH_ROWS))
    return df


def tagged(df: DataFrame) -> DataFrame:
    """The stored form: ``split`` is ``removed`` or ``remaining`` in place of the flag."""
    return df.withColumn("split", F.when(F.col("removed"), "removed").otherwise("remaining")).drop("removed")


def no_questions(questions: Column) -> Column:
    return F.coalesce(F.size(questions), F.lit(0)) <= 0
