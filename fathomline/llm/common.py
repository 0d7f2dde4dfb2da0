"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one is set only where there is none, and is
    gone with the driver's process."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        found = spark.sparkContext.getCheckpointDir()
    return found


_paths: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, *, sort_within: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives a lost executor. All tables of an
    application are in one folder of its name; what an operator's result doesn't need it discards itself."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fathomline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort_within) if sort_within else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that ``written`` gave and that nothing needs any more."""
    for df in tables:
        path = _paths.pop(df, None) if df is not None else None
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def column_values(batch: pa.RecordBatch, name: str, default) -> list:
    """The values of a column, nulls replaced by ``default``."""
    col = batch.column(batch.schema.get_field_index(name))
    return [default if v is None else v for v in col.to_pylist()] if col.null_count else col.to_pylist()


def utf8_values(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return column_values(pa.record_batch([batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())], ["x"]), "x", b"")


#: Bytes of text that a task turns into Python objects at a time (one text, if that is longer).
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text_col: str | int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each are of about ``most`` bytes. At the end freed memory is given back: Python
    workers live on for the tasks of later stages."""
    for batch in batches:
        at = text_col if isinstance(text_col, int) else batch.schema.get_field_index(text_col)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, (int(sizes[start - 1]) if start else 0) + most, "right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def per_row(df: DataFrame, keep: list[str], schema: str, rows: Callable[[pa.RecordBatch], dict[str, list]], after: Callable[[], None] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (the second is the text) mapped part by part to ``schema``; ``rows`` gives each output
    column as a list. ``after`` is called at a task's end, before freed memory is given back."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches
        if after:
            after()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(all_of(batches), 1):
            yield pa.RecordBatch.from_pydict(rows(batch))

    return df.select(*keep).mapInArrow(run, schema)
