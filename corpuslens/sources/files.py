"""Entries from XML files, and JSON payloads whose shape drifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_entry_files(spark: SparkSession, path: str, tag: str = "entry") -> DataFrame:
    """(file, entry): one row per ``tag`` element in the files below ``path``, as XML text for ``parse_entries``.

    Records are cut at closing tags by the text source, so large files are split among tasks, prefixes are kept
    and a broken entry costs itself alone. (The XML source's own row tag gives up the entry after a broken one.) An entry that
    isn't closed ends where the next one begins, and one that the file's end cuts off is closed there; what's left of either
    is judged by ``parse_entries``. Files without entries give no rows.
    """
    whole = spark.read.option("lineSep", f"</{tag}>").option("recursiveFileLookup", True).text(path)
    pieces = F.explode(F.split("value", rf"(?=<{tag}[\s>])"))
    rows = whole.select(F.col("_metadata.file_name").alias("file"), pieces.alias("piece")).filter(F.regexp_like("piece", F.lit(rf"^<{tag}[\s>]")))
    return rows.select("file", F.concat("piece", F.lit(f"</{tag}>")).alias("entry"))


def read_drifting(rows: DataFrame, fields: dict[str, tuple[str, str]], body: str = "payload") -> DataFrame:
    """``rows`` with their JSON ``body`` taken apart as a variant: no field is lost, and no payload fails a task.

    ``fields`` gives (path, type) by column name. Besides them come ``unknown`` (top-level fields that no path begins with, as
    JSON by name), ``clashes`` (columns whose value is there and can't be read as the type, with the type found) and
    ``is_object``. A payload that is null, no JSON or no object has nulls, no unknown fields and no clashes. JSON nulls are
    nulls. The payload is parsed once a row.
    """
    known = sorted({path.removeprefix("$.").split(".")[0].split("[")[0] for path, _ in fields.values()})
    parsed = rows.withColumn("__v", F.explode(F.array(F.try_parse_json(body))))  # a generator: nothing later parses again
    whole = F.try_variant_get("__v", "$", "map<string,variant>")
    parsed = parsed.withColumn("__m", F.explode(F.array(whole)))

    def clash(name: str, path: str, kind: str) -> Column:
        found = F.try_variant_get("__v", path, "variant")
        bad = found.isNotNull() & ~F.is_variant_null(found) & F.try_variant_get("__v", path, kind).isNull()
        return F.when(bad, F.concat(F.lit(f"{name}: "), F.schema_of_variant(found)))

    others = F.map_filter("__m", lambda k, v: ~k.isin(known))
    empty = F.expr("CAST(map() AS map<string,string>)")
    clashes = F.array_compact(F.array(*(clash(name, path, kind) for name, (path, kind) in fields.items())))
    return parsed.select(
        *[c for c in rows.columns if c != body],
        *(F.when(F.col("__m").isNotNull(), F.try_variant_get("__v", path, kind)).alias(name) for name, (path, kind) in fields.items()),
        F.coalesce(F.transform_values(others, lambda k, v: F.to_json(v)), empty).alias("unknown"),
        F.when(F.col("__m").isNotNull(), clashes).otherwise(F.expr("CAST(array() AS array<string>)")).alias("clashes"),
        F.col("__m").isNotNull().alias("is_object"),
    )
