"""Two-pass external shuffle into shards.

Pass one scatters rows uniformly, by a seeded hash, into buckets that fit a
task's memory. Pass two shuffles each bucket (Fisher-Yates, seeded by bucket) and
writes it. Buckets laid end to end are one random order of all rows; shard ``s``
of ``k`` is its slice from ``s*n/k`` to ``(s+1)*n/k``, so shards differ by one row
at most (law ``rows``) and a bucket touches one shard or two.

The driver learns the row count of each bucket only: one number for each
``BUCKET_BYTES`` of text. Cases: null text counts as empty; repeated rows are
kept, each with its own slot; every input column is written; an empty table gives
an empty one. Equal seeds give equal orders, however the input is split. Columns
named shard or slot in the input are replaced; others are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import filled, new_path, read, unused

BUCKET_BYTES = 16 << 20
#: A floor, so that small tables spread over tasks as well.
MIN_BUCKETS = 64
SEED = 20_240_601


def shuffle_rows(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows in shuffled order with ``shard`` and ``slot``."""
    docs = docs.drop("shard", "slot")
    own_hash, own_bucket = unused("__hash", docs.columns), unused("__bucket", docs.columns)
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes")).first()["bytes"] or 0
    buckets = max(MIN_BUCKETS, -(-total // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(filled(text_col)))
    keyed = docs.withColumn(own_hash, hashed).withColumn(own_bucket, F.pmod(own_hash, F.lit(buckets)).cast("int"))
    starts = np.zeros(buckets + 1, np.int64)
    for row in keyed.groupBy(own_bucket).agg(F.count("*").alias("n")).collect():
        starts[row[own_bucket] + 1] = row["n"]
    starts = np.cumsum(starts)
    rows = int(starts[-1])
    bounds = np.array([s * rows // shards for s in range(shards)], np.int64)

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one bucket
        table = table.take(pa.compute.sort_indices(table, [(own_hash, "ascending"), (id_col, "ascending")]))
        bucket = table[own_bucket][0].as_py()
        order = np.random.default_rng([seed, bucket]).permutation(table.num_rows)  # Fisher-Yates
        place = starts[bucket] + np.arange(table.num_rows)
        shard = np.searchsorted(bounds, place, side="right") - 1
        out = table.drop_columns([own_hash, own_bucket]).take(pa.array(order))
        out = out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(place - bounds[shard]))
        yield from out.to_batches(max_chunksize=1000)

    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return keyed.groupBy(own_bucket).applyInArrow(shuffled, schema)


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED, **named) -> DataFrame:
    """Write the shards as Parquet, one folder each, and read them back."""
    out = shuffle_rows(docs, shards, seed, **named)
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = write_shards(docs, new_path(spark, "shards"))
    text = filled("text")
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
