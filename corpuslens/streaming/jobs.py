"""Structured Streaming jobs: resumable ingest and queue folding from arriving files.

A job has one folder: its checkpoint, which holds the files already taken, and below ``rows``
what each batch stored, under the batch's number. Started again on the same folder it takes
new files only; a batch that runs again writes the same rows to the same place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.components import shared_folder
from corpuslens.operators.enrich import enqueue

QUEUE = "paper_id bigint, source string, priority int, reason string, reasons array<string>, full_detail boolean, status string"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for a job that nobody resumes."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _arriving(spark: SparkSession, path: str) -> DataFrame:
    """The files that match ``path``, one a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)


def _stored(spark: SparkSession, folder: str, schema, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one, with their ``batch``."""
    empty = spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    try:
        rows = spark.read.schema(empty.schema).parquet(f"{folder}/rows")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    return rows if before is None else rows.filter(F.col("batch") < before)


def _run(spark: SparkSession, path: str, folder: str, store: Callable[[DataFrame, int], DataFrame]) -> None:
    """``store(batch, number)`` gives the rows that a batch adds."""

    def write(batch: DataFrame, number: int) -> None:
        store(batch, number).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream = _arriving(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()


def ingest_stream(spark: SparkSession, path: str, keys: list[str], folder: str) -> DataFrame:
    """Store each record once, by ``keys``, however late it comes and whatever is sent again; all that is stored."""
    schema = spark.read.parquet(path).schema

    def store(batch: DataFrame, number: int) -> DataFrame:
        known = _stored(batch.sparkSession, folder, schema, number).select(*keys)
        return batch.dropDuplicates(keys).join(known, keys, "left_anti")

    _run(spark, path, folder, store)
    return _stored(spark, folder, schema).drop("batch")


def queue_stream(spark: SparkSession, path: str, to_requests: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Fold arriving requests into the queue. A batch writes the rows that it asks for; of each row the newest batch's state counts."""
    keys = ["paper_id", "source"]

    def newest(rows: DataFrame) -> DataFrame:
        state = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch")
        return rows.groupBy(*keys).agg(state.alias("s")).select(*keys, "s.*")

    def store(batch: DataFrame, number: int) -> DataFrame:
        requests = to_requests(batch)
        asked = _stored(batch.sparkSession, folder, QUEUE, number).join(requests.select(*keys).distinct(), keys, "left_semi")
        return enqueue(newest(asked), requests)

    _run(spark, path, folder, store)
    return newest(_stored(spark, folder, QUEUE))
