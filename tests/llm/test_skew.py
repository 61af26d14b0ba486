"""Aggregates and joins by salted keys against plain ones; scratch tables and their deletion."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.llm import common, skew


@pytest.fixture(scope="module")
def rows(spark):
    """One key has most of the rows, another has one; one key is null."""
    key = F.expr("case when id < 900 then 1 when id < 999 then id % 7 + 10 end")
    return spark.range(1000).select(key.alias("key"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(99, 5)], "key long, v long"))


def test_with_totals(rows):
    found = skew.with_totals(rows, "key", "v", low=("min", "v"), high=("max", "v"), total=("sum", "v"))
    plain = rows.where("key is not null").groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))
    assert found.columns == ["key", "v", "low", "high", "total"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.join(plain, "key").collect()))
    assert skew.with_totals(rows.where("false"), "key", "v", low=("min", "v")).count() == 0


def test_join_one(rows, spark):
    other = spark.createDataFrame([(1, "a"), (10, "b"), (1000, "c")], "key long, name string")
    found = skew.join_one(rows, other, "key", "v")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.join(other, "key").collect()))


def test_scratch_goes(rows):
    before = common.made()
    one = common.stored(rows, "one")
    two = common.stored_alone(before, one.where("v > 5"), "two")
    assert common.made() == before + 1 and two.count() == rows.where("v > 5").count()
    common.discard(two)
    assert common.made() == before
    for df in (one, two):
        with pytest.raises(Exception, match="exist"):
            df.sparkSession.read.parquet(df._scratch)
