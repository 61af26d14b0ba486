"""Cascade, reports, generation, sources and streams."""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import cli, queries
from docloom.functions.clients import Scripted
from docloom.operators.filters import DedupQuestions, Language, NGramOverlap, TextLength, local_dedup
from docloom.plans import cascade, generate, report
from docloom.schema import QA, qa_docs
from docloom.sources.datasets import assemble, read_arrow_splits, read_dataset, write_dataset
from docloom.streaming.filters import filter_files


def stages():
    return [TextLength(), NGramOverlap(), Language("en"), DedupQuestions(lambda: Scripted(local_dedup))]


class Upper:
    def translate(self, text):
        return text.upper()


def test_cascade(spark, sf_dir, tmp_path):
    docs = qa_docs(spark, sf_dir)
    docs = docs.withColumn("image", F.when(F.col("doc_id") % 2 == 0, F.lit(b"\x89PNG").cast("binary")))
    final, told = cascade.Cascade(stages(), f"file://{tmp_path}/out", "subsample", 3, "file:///elsewhere", lambda: Upper()).run(docs)
    rows = told.orderBy("stage").collect()
    assert [r.label for r in rows][:2] == ["Original", "TextLength(min_length=60)"]
    for before, after in zip(rows, rows[1:]):
        assert after.n_rows + after.removed_rows == before.n_rows and after.n_questions + after.removed_questions == before.n_questions
    lazy = cascade.summary(docs, stages()).orderBy("stage").collect()
    assert [(r.n_rows, r.n_questions) for r in lazy] == [(r.n_rows, r.n_questions) for r in rows]
    assert {r.split for r in final.select("split").collect()} == {"remaining"} and final.count() == rows[-1].n_rows
    part = read_dataset(spark, f"file://{tmp_path}/out/intermediate/{rows[1].label}_1_remaining_subsample")
    assert all(r["count"] <= 3 for r in part.groupBy("dataset_split").count().collect())
    made = {str(p.relative_to(tmp_path / "out")): ElementTree.parse(p).getroot() for p in (tmp_path / "out").rglob("*.svg")}
    name = f"intermediate/{rows[1].label}_1"
    assert {"filtering_process.svg", "filtering_summary_table.svg", f"{name}_histogram.svg", f"{name}_remaining_samples.svg"} <= made.keys()
    cards = "".join(made[f"{name}_remaining_samples.svg"].itertext())
    assert cards.count("Question: ") == 3 and "Question, translated: " in cards and "Value: " in cards
    assert all(r.label.partition("(")[0] in "".join(made["filtering_process.svg"].itertext()) for r in rows)
    with pytest.raises(ValueError, match="overlaps"):
        cascade.Cascade(stages(), f"{tmp_path}/in/out", source=f"{tmp_path}/in").run(docs)


def test_summary_runs_every_stage_once(spark, sf_dir):
    """One scan of each table, one Python evaluation, also of what is kept."""
    docs = qa_docs(spark, sf_dir)
    for df in (cascade.summary(docs, stages()[:3]), cascade.chained(docs, stages()[:3])[-1].where(~F.col("removed"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("documents.parquet") + plan.count("doc_id#") >= 1
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert physical.count("ArrowEvalPython") == 1 and physical.split("Subqueries")[0].count("FileScan") <= 3


def test_rows_are_scored_once(spark, sf_dir):
    """Exploding the scores scores no row twice, with Python or without."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    stage = NGramOverlap()
    assert plan(stage.values(stage.annotate(qa_docs(spark, sf_dir)))).count("ArrowEvalPython") == 1
    assert plan(queries.ngram_overlap_per_question(spark, sf_dir)).count("ArrowEvalPython") == 1
    assert plan(queries.ngram_overlap_expression(spark, sf_dir)).count("regexp_extract_all") == 2


def test_no_service_for_removed_rows(spark):
    asked = spark.sparkContext.accumulator(0)

    def count(_):
        asked.add(1)
        return "['a', 'b']"

    rows = [(1, "train", None, "x" * 80, "", ["a", "b"], ["1", "2"]), (2, "train", None, "short", "", ["a", "b"], ["1", "2"])]
    told = cascade.summary(spark.createDataFrame(rows, QA), [TextLength(), DedupQuestions(lambda: Scripted(count), parallel=3), TextLength(100)]).orderBy("stage").collect()
    assert [(r.n_rows, r.n_questions) for r in told] == [(2, 4), (1, 2), (1, 2), (0, 0)] and asked.value == 1


def test_cascade_of_nothing(spark, tmp_path):
    final, told = cascade.Cascade(stages(), f"file://{tmp_path}/out", "all").run(spark.createDataFrame([], QA))
    assert told.where("stage = 4").first().percent is None


def test_counts(spark):
    rows = [(k, s, None, "t", "", q, []) for k, (s, q) in enumerate([("train", ["a", "b"]), ("val", None), ("validation", ["c"]), (None, ["d"])])]
    df = spark.createDataFrame(rows, QA)
    assert tuple(report.counts(df).first()) == (2, 2, 2)
    assert report.length_mismatches(df).count() == 2


def test_histogram(spark):
    made = lambda v: report.histogram(spark.createDataFrame([(float(x),) for x in v], "value double")).orderBy("bin").collect()
    rows = made([*range(1, 31), 1000])
    assert sum(r.n for r in rows) == 30 and rows[0].low == 1.0 and sum(r.density for r in rows) * (29 / 30) == pytest.approx(1)
    assert [(r.bin, r.low + 15 / 30, r.n) for r in made([5, 5])] == [(15, pytest.approx(5.5), 2)] and made([]) == []


def test_samples(spark, sf_dir):
    docs = qa_docs(spark, sf_dir)
    one = sorted(r.doc_id for r in report.sample_per_split(docs, 2).collect())
    assert len(one) == 6 and one == sorted(r.doc_id for r in report.sample_per_split(docs.repartition(7), 2).collect())
    assert report.head(docs, 50).count() == 20
    assert report.displayed(docs.withColumn("questions", F.array().cast("array<string>"))).first().question is None


def test_generation(spark):
    docs = spark.createDataFrame([(1, "train", None, "szöveg", "ocr"), (2, "train", None, "rossz", "rossz"), (3, "val", None, "szöveg", None)], "doc_id long, dataset_split string, image binary, text string, ocr string")

    def answer(prompt):
        if "Szöveg: rossz" in prompt:
            return "Kérdés: nincs sorvég"
        return f"Kérdés: {'O' if prompt.endswith('Szöveg: ocr' + chr(10) + 'Kérdés: ') else 'T'}\nVálasz: v\nmás"

    found = {r.doc_id: (r.questions, r.answers) for r in generate.generate(docs, lambda: Scripted(answer)).collect()}
    assert found == {1: (["O", "T", "O", "T"], ["v"] * 4), 3: (["T", "T"], ["v", "v"])}
    assert generate.with_ocr(docs, None) is docs
    ocr = generate.with_ocr(docs.drop("ocr"), lambda: type("O", (), {"read": staticmethod(lambda image: "read")})).first().ocr
    assert ocr == "read"
    with pytest.raises(ValueError, match="OCR"):
        generate.generate(docs.drop("ocr"), lambda: Scripted(answer))


def test_generation_asks_once(spark, tmp_path):
    """Replies are stored: whatever is done with the pairs asks no service again."""
    asked = spark.sparkContext.accumulator(0)

    def answer(prompt):
        asked.add(1)
        return "Kérdés: k\nVálasz: v"

    docs = spark.createDataFrame([(1, "train", b"i", "szöveg")], "doc_id long, dataset_split string, image binary, text string")
    reader = type("O", (), {"read": staticmethod(lambda image: "ocr")})
    pairs = generate.generate(docs, lambda: Scripted(answer), ocr=lambda: reader, store=f"file://{tmp_path}/store", parallel=2)
    assert pairs.first().questions == ["k"] * 4 and pairs.count() == 1 and asked.value == 4


def test_prompt(spark):
    df = spark.createDataFrame([("<question>", "q", "a")], "t string, q string, a string")
    assert df.select(generate.filled(F.col("t"), F.col("q"), F.col("a"))).first()[0] == "Szöveg: q\nKérdés: q\nVálasz: a"
    replies = spark.createDataFrame([("Kérdés: a\rb\nVálasz: c\rd\ne",), ("Kérdés: \nVálasz: x",), (None,)], "r string")
    got = replies.select(generate.extract_question(F.col("r")).alias("q"), generate.extract_answer(F.col("r")).alias("a")).collect()
    assert [tuple(r) for r in got] == [("a\rb", "c\rd"), (None, "x"), (None, None)]


def test_datasets(spark, tmp_path):
    df = assemble({"train": spark.createDataFrame([(1, "t")], "doc_id long, text string"), "val": spark.createDataFrame([(2,)], "doc_id long")})
    write_dataset(df, f"{tmp_path}/d")
    assert {(r.doc_id, r.text, r.dataset_split) for r in read_dataset(spark, f"{tmp_path}/d").collect()} == {(1, "t", "train"), (2, None, "val")}
    with pytest.raises(ValueError):
        write_dataset(df, f"{tmp_path}/d", f"{tmp_path}/d/x")
    (tmp_path / "hf/train").mkdir(parents=True)
    (tmp_path / "hf/dataset_dict.json").write_text(json.dumps({"splits": ["train"]}))
    table = pa.table({"doc_id": [5], "text": ["x"]})
    with pa.OSFile(str(tmp_path / "hf/train/data-0.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    r = read_arrow_splits(spark, str(tmp_path / "hf")).first()
    assert (r.doc_id, r.text, r.ocr, r.dataset_split) == (5, "x", None, "train")


def test_stream(spark, sf_dir, tmp_path):
    docs = qa_docs(spark, sf_dir)
    docs.write.parquet(f"{tmp_path}/in")
    query = filter_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, stages()[:3], f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    want = cascade.chained(docs, stages()[:3])[-1].where(~F.col("removed"))
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(r.doc_id for r in want.collect())


def arrow_dataset(folder, rows):
    (folder / "train").mkdir(parents=True)
    (folder / "dataset_dict.json").write_text(json.dumps({"splits": ["train"]}))
    for k in range(0, len(rows), 2):
        table = pa.Table.from_pylist(rows[k : k + 2])
        with pa.OSFile(str(folder / f"train/data-{k}.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
            w.write_table(table, max_chunksize=1)


SERVICES = """
from docloom.functions.clients import Scripted
from docloom.operators.filters import local_dedup


def client(key, model):
    return Scripted(lambda prompt: "Kérdés: mi?\\nVálasz: ez" if "Szöveg" in prompt else local_dedup(prompt))


class Reader:
    def __init__(self, data):
        self.data = data

    def read(self, image):
        return f"{self.data}:{len(image)}"
"""


def test_commands(spark, tmp_path, monkeypatch):
    """Both commands on a directory of Arrow streams without ids and OCR."""
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    long = "the quick brown fox jumps over the lazy dog and it is on the way to the river"
    arrow_dataset(tmp_path / "raw", [{"image": {"bytes": b"abc", "path": None}, "text": f"{long} {k}"} for k in range(3)])
    (tmp_path / "services_of_a_test.py").write_text(SERVICES)
    spark.sparkContext.addPyFile(str(tmp_path / "services_of_a_test.py"))
    cli.main(["generate", "--input-dataset-path", f"{tmp_path}/raw", "--output-path", f"{tmp_path}/made", "--client", "services_of_a_test:client", "--ocr", "services_of_a_test:Reader", "--ocr-data", "tess"])
    made = spark.read.parquet(f"{tmp_path}/made").collect()
    assert {(r.ocr, tuple(r.questions), r.dataset_split) for r in made} == {("tess:3", ("mi?",) * 4, "train")} and len({r.doc_id for r in made}) == 3
    with pytest.raises(SystemExit):
        cli.main(["clean", "--dataset_path", f"{tmp_path}/made", "--output_dir", f"{tmp_path}/out"])
    with pytest.raises(ValueError, match="overlaps"):
        cli.main(["clean", "--local_dedup", "--dataset_path", f"{tmp_path}/made", "--output_dir", f"{tmp_path}/made"])
    cli.main(["clean", "--local_dedup", "--dataset_path", f"{tmp_path}/made", "--output_dir", f"{tmp_path}/out", "--language", "en"])
    assert [(r.stage, r.n_rows) for r in spark.read.parquet(f"{tmp_path}/out/summary").orderBy("stage").collect()][0] == (0, 3)
    assert (tmp_path / "out/filtering_process.svg").exists()


def test_command_line():
    args = cli.parser().parse_args(["clean", "--dataset_path", "a", "--output_dir", "b"])
    assert (args.save_intermediate, args.subsample_size, args.model) == ("subsample", 10, "Meta-Llama-3.1-8B-Instruct")
    assert cli.parser().parse_args(["generate", "--input-dataset-path", "a", "--output-path", "b", "--client", "m:f"]).seed == 42
