"""Write patterns over Parquet tables: upsert, insert-ignore, append-only runs, cascading removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert_latest(stored: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Both tables with one row per key: the one with the largest ``seq`` (incoming on ties)."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(seq), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__new")


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` and the rows of ``incoming`` with new keys, one a key."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def replace_children(stored: DataFrame, incoming: DataFrame, touched: DataFrame, parent: str = "paper_id") -> DataFrame:
    """The children of touched parents give way to the incoming ones."""
    return stored.join(touched.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def append_run(run: DataFrame, children: dict[str, DataFrame], path: str) -> None:
    """Write the children of a run below ``run_id=`` folders, then its own row: readers see whole runs only."""
    for name, rows in children.items():
        rows.write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")
    run.write.mode("append").parquet(f"{path}/runs")


def read_run_children(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Children of succeeded runs."""
    done = spark.read.parquet(f"{path}/runs").filter("status = 'SUCCEEDED'").select("run_id")
    return spark.read.parquet(f"{path}/{name}").join(done, "run_id", "left_semi")


def delete_run_cascade(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of removed runs."""
    return {name: rows.join(removed.select("run_id"), "run_id", "left_anti") for name, rows in tables.items()}
