"""Split datasets on disk: Parquet by split, and directories of Arrow streams."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import GENERATION_INPUT, STRINGS


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A dataset written by ``write_dataset``; splits are pruned by their folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def open_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset of either form: a directory of Arrow streams, or Parquet.  A document
    number is added to one that has none."""
    if exists(spark, f"{path}/dataset_dict.json"):
        return numbered(read_arrow_splits(spark, path, None))
    return numbered(read_dataset(spark, path))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with doc_id; if there is none, by a hash of split, text and image, so that it
    is the same in every run (and equal for equal rows)."""
    return df if "doc_id" in df.columns else df.withColumn("doc_id", F.xxhash64("dataset_split", "text", *[c for c in ("image",) if c in df.columns]))


def overlapping(path: str, source: str) -> bool:
    """Whether one path is, holds or lies in the other."""
    a, b = f"{path.rstrip('/')}/", f"{source.rstrip('/')}/"
    return a.startswith(b) or b.startswith(a)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, wherever Spark can write."""
    files, where = _hadoop(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_dataset(df: DataFrame, path: str, source: str | None = None) -> None:
    """Parquet, a folder per split.  An output that holds, or lies in, its input is refused."""
    if source and overlapping(path, source):
        raise ValueError(f"{path} overlaps the input {source}")
    df.write.mode("overwrite").partitionBy("dataset_split").parquet(path)


def assemble(splits: dict[str, DataFrame]) -> DataFrame:
    """Named tables as one with ``dataset_split``; columns that some lack are null there."""
    out = None
    for name, df in splits.items():
        df = df.withColumn("dataset_split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no splits")
    return out


#: What a dataset may have, by name; ``image`` may be a struct with its bytes.
KNOWN = T.StructType([*GENERATION_INPUT, T.StructField("questions", STRINGS), T.StructField("answers", STRINGS)])


def read_arrow_splits(spark: SparkSession, path: str, schema: T.StructType | None = GENERATION_INPUT) -> DataFrame:
    """A directory with dataset_dict.json and a folder of Arrow stream files per split.

    The executors open the files by path and read them record batch by record batch, so a
    file may be larger than a task's memory.  Columns that a file lacks are null; without a
    schema, the known columns are taken that the first file of the first split has.
    """
    names = json.loads("".join(x.value for x in spark.read.text(f"{path}/dataset_dict.json").collect()))["splits"]

    def files(split: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(f"{path}/{split}").select("path")

    if schema is None:
        first = files(names[0]).agg(F.min("path")).first()[0] if names else None
        have = set(_open(first)[0].names) if first else set()
        schema = T.StructType([f for f in KNOWN if f.name in have])
    fields = [f for f in schema if f.name != "dataset_split"]

    def decode(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(T.StructType(fields))
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                for part in _open(uri)[1]:
                    yield pa.RecordBatch.from_arrays([_column(part, f) for f in target], schema=target)

    return assemble({n: files(n).mapInArrow(decode, T.StructType(fields)) for n in names})


def _open(uri: str):
    """(schema, record batches) of an Arrow stream file."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    where, path = fs.FileSystem.from_uri(uri)
    stream = pa.ipc.open_stream(where.open_input_file(path))
    return stream.schema, stream


def _column(part: pa.RecordBatch, field: pa.Field) -> pa.Array:
    if field.name not in part.schema.names:
        return pa.nulls(part.num_rows, field.type)
    column = part.column(field.name)
    if pa.types.is_struct(column.type) and pa.types.is_binary(field.type):
        column = column.field("bytes")
    return column.cast(field.type)
