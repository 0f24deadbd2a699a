"""Data-quality rules: each gives (tbl, rule, key, n), a row for each key that breaks it and how many rows have that key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by_key(table: str, rule: str, broken: DataFrame, keys: list[str]) -> DataFrame:
    key = F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return broken.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(table).alias("tbl"), F.lit(rule).alias("rule"), "key", "n")


def unique(table: str, rows: DataFrame, keys: list[str], where: str | None = None) -> DataFrame:
    """Keys that repeat; ``where`` for a partial rule, as one row at most that is the latest."""
    rule = f"unique {','.join(keys)}" + (f" where {where}" if where else "")
    return _by_key(table, rule, rows.filter(where) if where else rows, keys).filter("n > 1")


def holds(table: str, rows: DataFrame, rule: str, check: Column, keys: list[str]) -> DataFrame:
    return _by_key(table, rule, rows.filter(~F.coalesce(check, F.lit(False))), keys)


def refers(table: str, rows: DataFrame, key: str, parent: str, parents: DataFrame, parent_key: str) -> DataFrame:
    own = rows.select(key).filter(F.col(key).isNotNull())
    return _by_key(table, f"{key} in {parent}", own.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti"), [key])


def report(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
