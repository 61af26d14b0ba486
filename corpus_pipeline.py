"""From documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, written as Parquet in the shared folder
and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common, decontamination, language, packing, simhash, substring_dedup

#: SQL has neither rank-order profiles nor XXH64 nor the tokenizer: tested by brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters go, null and empty
    texts with them.

    If no row has a language to learn from, all documents with letters stay.  Null ids
    and repeated rows are judged as any other; an empty table stays empty.
    """
    model = language.learn(docs)
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.classify(docs, model, "__lang", "__score")
    return found.where(F.col("__lang") != language.UNKNOWN).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Null and empty texts are copies of each other.  Rows without a doc_id stay, and so do
    repeated rows of a doc_id that stays; an empty table stays empty.
    """
    found = simhash.near_duplicates(docs)
    return docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents hold; those of which nothing
    is left go.

    Null and empty texts and rows without a doc_id stay as they are; rows with equal
    doc_id are one document; an empty table stays empty.
    """
    return substring_dedup.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of eight words of a benchmark item, without the words
    of shorter items.

    Null and empty texts stay, and so do all documents if the benchmark is empty; null ids
    and repeated rows are judged as any other; an empty table stays empty.
    """
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), short=False)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens.

    Null and empty texts are a piece of the end id alone; repeated rows have pieces of
    their own; an empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontaminate),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        made = common.made()
        docs = common.stored_alone(made, stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return docs
