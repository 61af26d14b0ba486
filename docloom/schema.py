"""Tables of the curation engine, and the view that the queries run on.

A row is a document with parallel arrays of questions and answers.  Named splits are one
table with a ``dataset_split`` column; only ``COUNTED`` splits take part in statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTED = ("train", "test", "val")
#: What a task reads of a large table, by Spark's default.
SPLIT_BYTES = 128 << 20
STRINGS = T.ArrayType(T.StringType())
GENERATION_INPUT = T.StructType().add("doc_id", "long").add("dataset_split", "string").add("image", "binary").add("text", "string").add("ocr", "string")
QA = T.StructType([*GENERATION_INPUT, T.StructField("questions", STRINGS), T.StructField("answers", STRINGS)])


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table so small that its files hold fewer splits than there are cores, dealt to all
    cores; any larger table stays as it is read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SPLIT_BYTES else df


def qa_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer documents derived from ``documents`` and ``conversations``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    many = said.agg(F.coalesce(F.max("conv_id") + 1, F.lit(1))).scalar()  # conversations are numbered from 0

    def turns(role: str):
        own = F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))
        return F.transform(F.array_sort(own), lambda x: x["text"])

    talks = said.groupBy("conv_id").agg(turns("user").alias("asked"), turns("assistant").alias("told"))
    joined = docs.withColumn("own", F.pmod("doc_id", many)).join(talks, F.col("own") == F.col("conv_id"), "left")
    d, text, none = F.col("doc_id"), F.col("text"), F.array().cast(STRINGS)
    first = F.substring("text", 1, 60)
    return joined.select(
        "doc_id",
        F.when(d % 10 == 8, "val").when(d % 10 == 9, "test").otherwise("train").alias("dataset_split"),
        "text",
        F.when(d % 3 == 0, "").when(d % 3 == 1, F.substring("text", 1, 40)).otherwise(F.concat(text, F.lit(" "), text)).alias("ocr"),
        F.concat(
            F.when(d % 7 == 0, none).otherwise(F.array(first, F.substring("text", 101, 60))),
            F.coalesce("asked", none),
            F.when(d % 50 == 0, F.array(F.lit("a b c"))).when(d % 5 == 0, F.array(first)).otherwise(none),
        ).alias("questions"),
        F.concat(F.array(F.lit("first answer"), F.lit("second answer")), F.coalesce("told", none)).alias("answers"),
    )
