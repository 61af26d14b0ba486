"""The cascade: stages in order, kept and removed rows of each, and a summary."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.langid import detect
from ..operators.base import FilterStage, tagged
from ..operators.filters import DedupQuestions, Language, NGramOverlap, TextLength
from ..schema import COUNTED
from ..sources.datasets import overlapping, read_dataset, write_dataset
from . import drawing, report

log = logging.getLogger(__name__)


def default_stages(client, model: str = "", language: str = "hu", detector=detect) -> list[FilterStage]:
    """From cheap to costly; the order matters to the counts of each stage."""
    return [TextLength(60), NGramOverlap(4, 0.12), Language(language, detector), DedupQuestions(client, model)]


def chained(df: DataFrame, stages: list[FilterStage]) -> list[DataFrame]:
    """The annotated rows that enter each stage, lazily.  Each frame repeats the stages
    before it, so use ``through`` where more than one of them is wanted."""
    out = []
    for stage in stages:
        out.append(stage.annotate(df))
        df = out[-1].where(~F.col("removed")).drop("removed")
    return out


def through(df: DataFrame, stages: list[FilterStage]) -> DataFrame:
    """All rows with ``removed_at``, the number of the stage (from 1) that removes a row or
    null, and ``asked``: the numbers of questions before the first and after each stage,
    null from the removal on.  One pass: every stage runs once, and what is removed has its
    texts and questions blanked, so later stages do no work and ask no service for it."""
    texts = ("text", "ocr", "questions", "answers")
    size = F.coalesce(F.size("questions"), F.lit(0))
    names = [c for c in df.columns if c not in ("removed_at", "asked", "filter_value", "removed")]
    df = df.select(*names).withColumn("removed_at", F.lit(None).cast("int")).withColumn("asked", F.array(size))
    for k, stage in enumerate(stages, 1):
        live = F.col("removed_at").isNull()
        df = df.select(*[F.when(live, F.col(c)).alias(c) if c in texts else F.col(c) for c in (*names, "removed_at", "asked")])
        df = stage.annotate(df).withColumn("removed_at", F.when(live & F.col("removed"), k).otherwise(F.col("removed_at")))
        df = df.withColumn("asked", F.concat("asked", F.array(F.when(live, size)))).select(*names, "removed_at", "asked")
    return df


def summary(df: DataFrame, stages: list[FilterStage]) -> DataFrame:
    """A row per stage, the input first: stage, label, remaining and removed rows and
    questions, and the share of rows that remain.  One pass and one aggregate."""
    rows = through(df, stages).where(F.col("dataset_split").isin(*COUNTED)).select("removed_at", "asked")
    labels = ["Original", *(s.label() for s in stages)]
    told = []
    for k, label in enumerate(labels):
        stays = F.col("removed_at").isNull() | (F.col("removed_at") > k)
        asked = F.coalesce(F.sum(F.when(stays, F.get("asked", F.lit(k)))), F.lit(0)).cast("long")
        told.append(F.struct(F.lit(k).alias("stage"), F.lit(label).alias("label"), F.count(F.when(stays, 1)).alias("n_rows"), asked.alias("n_questions")))
    at = rows.agg(F.array(*told).alias("told")).select(F.inline("told"))
    order = Window.orderBy("stage")  # as many rows as stages
    less = lambda c: F.coalesce(F.lag(c).over(order) - F.col(c), F.lit(0)).cast("long")
    share = F.round(F.try_divide(F.col("n_rows") * 100.0, F.first("n_rows").over(order)), 6)
    return at.select("stage", "label", "n_rows", less("n_rows").alias("removed_rows"), "n_questions", less("n_questions").alias("removed_questions"), share.alias("percent"))


@dataclass
class Cascade:
    """Runs stages one by one, each written before the next, so that counts, times and
    intermediate outputs are of real runs and no service call is repeated.

    Beside the tables, pictures (SVG) are written of each stage's histogram and of its
    samples, of the share of rows that remain, and of the summary.  ``translator`` makes
    the service that samples are translated by, if any.  ``source``, the input's path,
    keeps the output from replacing its own input.
    """

    stages: list[FilterStage]
    output: str
    intermediate: str = "none"
    sample: int = 10
    source: str | None = None
    translator: Callable[[], object] | None = None

    def run(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(final rows, summary); both are written under ``output`` too."""
        if self.intermediate not in ("none", "subsample", "all"):
            raise ValueError("intermediate is none, subsample or all")
        if self.source and overlapping(self.output, self.source):
            raise ValueError(f"{self.output} overlaps the input {self.source}")
        spark, rows, base = df.sparkSession, [], report.counts(df).first()
        before = base
        rows.append((0, "Original", before.n_rows, 0, before.n_questions, 0, 100.0 if before.n_rows else None, 0.0))
        for k, stage in enumerate(self.stages, 1):
            began, path = time.monotonic(), f"{self.output}/stages/{k}"
            df = stage.annotate(df)
            write_dataset(df, path)
            annotated = read_dataset(spark, path, df.schema)
            kept, gone = annotated.where(~F.col("removed")), annotated.where("removed")
            after = report.counts(kept).first()
            mismatches = report.length_mismatches(kept).count()
            took = time.monotonic() - began
            if mismatches:
                log.warning("%s: %d rows with unequal questions and answers", stage.label(), mismatches)
            per_1000 = 1000 * took / before.n_rows if before.n_rows else 0.0
            share = 100.0 * after.n_rows / base.n_rows if base.n_rows else None
            rows.append((k, stage.label(), after.n_rows, before.n_rows - after.n_rows, after.n_questions, before.n_questions - after.n_questions, share, per_1000))
            log.info("%s: %d rows remain (%s %%), %.3f s per 1000", stage.label(), after.n_rows, share, per_1000)
            values = stage.values(annotated)
            shown = report.histogram(values) if stage.histogram == "numbers" else report.categories(values)
            name = f"{self.output}/intermediate/{stage.label()}_{k}"
            shown.write.mode("overwrite").parquet(f"{name}_histogram")
            drawing.bars(spark, f"{name}_histogram.svg", stage.label(), spark.read.parquet(f"{name}_histogram"))
            for name, part in (("remaining", kept), ("removed", gone)):
                if self.intermediate == "all":
                    write_dataset(tagged(part), f"{self.output}/intermediate/{stage.label()}_{k}_{name}")
                elif self.intermediate == "subsample":
                    write_dataset(tagged(report.sample_per_split(part, self.sample)), f"{self.output}/intermediate/{stage.label()}_{k}_{name}_subsample")
                if self.intermediate != "none":
                    drawing.samples(spark, f"{self.output}/intermediate/{stage.label()}_{k}_{name}_samples.svg", part, self.sample, self.translator)
            df, before = kept, after
        final = tagged(df) if "removed" in df.columns else df
        write_dataset(final, f"{self.output}/final_dataset")
        told = spark.createDataFrame(rows, "stage int, label string, n_rows long, removed_rows long, n_questions long, removed_questions long, percent double, s_per_1000 double")
        told.write.mode("overwrite").parquet(f"{self.output}/summary")
        drawing.remaining(spark, f"{self.output}/filtering_process.svg", rows)
        drawing.table(spark, f"{self.output}/filtering_summary_table.svg", rows)
        return read_dataset(spark, f"{self.output}/final_dataset", final.schema), told
