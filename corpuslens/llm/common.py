"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


#: Paths that this process has named and not yet removed.
_paths: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _paths.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what operators have written to the shared folder; for when their results are stored elsewhere."""
    _remove_from(spark, 0)


def _remove_from(spark: SparkSession, first: int) -> None:
    jvm = spark.sparkContext._jvm
    while len(_paths) > first:
        path = jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later stages restart from files, whatever executor is lost.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialise`` of what ``make`` gives. What was written on the way is deleted, as no later read needs it."""
    first = len(_paths)
    out = materialise(make(), name)
    own = _paths.pop()
    _remove_from(out.sparkSession, first)
    _paths.append(own)
    return out


def batches_of(batches: Iterator[pa.RecordBatch], rows: int, size: int, column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and bytes of a text or binary ``column`` at most, or of one row.

    Bounds what a Python worker unpacks at once, whatever the session's own settings are.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = int(np.searchsorted(ends, before + size, side="right"))
            upto = max(at + 1, min(at + rows, upto))
            yield batch.slice(at, upto - at)
            at = upto


def unused(name: str, columns: list[str]) -> str:
    """``name``, or the first of ``name_``, ``name__`` and so on that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def filled(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))
