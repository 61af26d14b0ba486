"""The pipeline's decontamination with benchmark items shorter than a window."""

from __future__ import annotations

import corpus_pipeline


def test_short_items(spark, tmp_path):
    item = " ".join(f"i{k}" for k in range(12))
    spark.createDataFrame([(1, "of the"), (2, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "one of the clean ones"), (2, f"a {item} b"), (3, "untouched")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert found == {1: "one clean ones", 3: "untouched"}
