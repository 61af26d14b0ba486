"""Plumbing that the training-data operators share: cluster-visible scratch space,
materialised tables, byte streams in the shared folder, batch helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
_made: list[tuple[object, str]] = []
#: What empties the things that a Python worker keeps from task to task.
drops: list[Callable[[], None]] = []
_stage: int | None = None  # of this worker's last task


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent (tests on a local master) a temporary folder is
    made and set.  On a cluster without the setting this raises, because a
    machine-local folder would lose data.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def _delete(spark, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; leftovers are only files
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)
        _made.remove((df.sparkSession, df._scratch))


def stored_alone(made: int, df: DataFrame, name: str) -> DataFrame:
    """``df`` stored; then all scratch of its making, which began when there were ``made``
    paths, is deleted."""
    out = stored(df, name)
    for spark, path in _made[made:]:
        if path != out._scratch:
            _delete(spark, path)
    _made[made:] = [(df.sparkSession, out._scratch)]
    return out


def made() -> int:
    return len(_made)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder, on driver or executor."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream for a new file; its folder is made if missing."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return files.open_output_stream(path, compression=None)


def texts(column: pa.Array) -> list[str]:
    """A string column as a list, nulls as empty strings."""
    return [x if x is not None else "" for x in column.to_pylist()]


def begin() -> None:
    """In the first task of a stage, drops what this Python worker kept for the stage
    before, and gives freed memory back to the system: Spark uses its workers again for
    other stages, and allocators hold on to what was freed."""
    global _stage
    task = TaskContext.get()
    if task is None or task.stageId() == _stage:
        return
    _stage = task.stageId()
    for drop in drops:
        drop()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, rows: int = 512, size: int = 8 << 20):
    """The record batches cut into pieces of at most ``rows`` rows, and of at most about
    ``size`` bytes of strings or one row, so that what a worker holds as Python objects
    stays small."""
    begin()
    for batch in batches:
        strings = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        total = np.zeros(batch.num_rows, np.int64)
        for c in strings:
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(total), 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))
            stop = min(batch.num_rows, at + rows, max(fit, at + 1))
            yield batch.slice(at, stop - at)
            at = stop


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in a batch between the JVM and Python than Spark's default, which on both
    sides takes tens of megabytes of a task for texts of ordinary size.  A session's own
    setting stays."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
