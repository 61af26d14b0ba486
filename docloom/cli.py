"""Command line: ``python -m docloom.cli clean|generate ...``.

The model service is named by ``--client module:function``; the function takes the key and
the model's name and returns a chat client.
"""

from __future__ import annotations

import argparse
import importlib
import os
from functools import partial

from pyspark.sql import SparkSession

from .functions.clients import Retrying, Scripted, credential
from .functions.langid import NgramDetector, detect
from .operators.filters import local_dedup
from .plans.cascade import Cascade, default_stages
from .plans.generate import SEED, generate
from .sources.datasets import open_dataset, overlapping, write_dataset


def _named(spec: str):
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def _client(spec: str | None, key: str, model: str, **retries):
    return Retrying(_named(spec)(key, model), **retries) if spec else Scripted(local_dedup)


def _ocr(spec: str, data: str | None):
    return _named(spec)(data)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docloom")
    commands = top.add_subparsers(dest="command", required=True)
    clean = commands.add_parser("clean")
    clean.add_argument("--dataset_path", required=True)
    clean.add_argument("--output_dir", required=True)
    clean.add_argument("--api_key_variable", default="DOCLOOM_API_KEY")
    clean.add_argument("--model", default="Meta-Llama-3.1-8B-Instruct")
    clean.add_argument("--api_key", help="the key itself; better name a variable")
    clean.add_argument("--client")
    clean.add_argument("--local_dedup", action="store_true", help="no service: drop questions that are equal but for case, white space and punctuation")
    clean.add_argument("--translator", help="module:function that makes a translator for sample pictures")
    clean.add_argument("--parallel", type=int, default=1, help="calls of the service at a time in a task")
    clean.add_argument("--language", default="hu")
    clean.add_argument("--language_samples", help="Parquet of (text, lang) that trigram profiles are learned from; common words otherwise")
    clean.add_argument("--save_intermediate", choices=["none", "subsample", "all"], default="subsample")
    clean.add_argument("--subsample_size", type=int, default=10)
    make = commands.add_parser("generate")
    make.add_argument("--input-dataset-path", required=True)
    make.add_argument("--output-path", required=True)
    make.add_argument("--client", required=True)
    make.add_argument("--model", default="Meta-Llama-3.3-70B-Instruct")
    make.add_argument("--seed", type=int, default=SEED)
    make.add_argument("--ocr", help="module:function that makes an OCR provider, for tables without ocr; it gets --ocr-data")
    make.add_argument("--ocr-data", default=os.environ.get("TESSDATA_PREFIX"), help="folder of the OCR engine's data")
    make.add_argument("--parallel", type=int, default=1)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    if a.command == "clean":
        if not a.client and not a.local_dedup:
            raise SystemExit("name a --client, or ask for --local_dedup")
        key = a.api_key or (credential(a.api_key_variable) if a.client else "")
        detector = NgramDetector.learn(spark.read.parquet(a.language_samples)) if a.language_samples else detect
        stages = default_stages(partial(_client, a.client, key, a.model, attempts=20, least=10, most=10, pace=2), a.model, a.language, detector)
        stages[-1].parallel = a.parallel
        translator = _named(a.translator) if a.translator else None
        Cascade(stages, a.output_dir, a.save_intermediate, a.subsample_size, a.dataset_path, translator).run(open_dataset(spark, a.dataset_path))
    else:
        docs = open_dataset(spark, a.input_dataset_path)
        client = partial(_client, a.client, credential("OPENAI_API_KEY"), a.model)
        ocr = partial(_ocr, a.ocr, a.ocr_data) if a.ocr else None
        if overlapping(a.output_path, a.input_dataset_path):
            raise ValueError(f"{a.output_path} overlaps the input {a.input_dataset_path}")
        store = f"{a.output_path.rstrip('/')}_services"
        pairs = generate(docs, client, seed=a.seed, ocr=ocr, store=store, parallel=a.parallel)
        if "ocr" not in docs.columns:
            docs = docs.join(spark.read.parquet(f"{store}/ocr").select("doc_id", "ocr"), "doc_id")
        write_dataset(docs.join(pairs.drop("dataset_split"), "doc_id"), a.output_path)


if __name__ == "__main__":
    main()
