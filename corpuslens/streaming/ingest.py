"""Ingest as a stream: raw entries are parsed, split, and stored in several tables under one batch number.

A batch writes what it adds to each table below ``table/batch=N`` and then, last, a row to ``commits``. Readers see committed
batches only, so all tables or none of a batch; a batch that runs again overwrites its own folders and its own commit. No batch
reads an earlier one: tables are folded when they are read, newest batch first, as upserts would have left them. ``compact``
folds what is committed into one snapshot, after which readers start from that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import normalize_text
from corpuslens.operators.ingest import parse_entries, split_bad

TABLES = {
    "papers": "arxiv_id string, title string, normalized_title string, abstract string, primary_category string, doi string, published timestamp, updated timestamp, first_batch bigint",
    "versions": "arxiv_id string, version_number int, submitted timestamp, verified boolean, is_latest boolean",
    "categories": "code string",
    "paper_categories": "arxiv_id string, code string, is_primary boolean",
    "authors": "normalized string, display_name string",
    "paper_authors": "arxiv_id string, normalized string, author_order bigint",
    "failures": "source_identifier string, error string",
}


def tables_of(records: DataFrame, number: int) -> dict[str, DataFrame]:
    """What valid records add to each table. Of several entries of a paper in a batch the one with the highest version, then last updated, counts."""
    order = F.struct("version", "updated", "title")
    one = records.groupBy("arxiv_id").agg(F.max_by(F.struct(*[c for c in records.columns if c != "arxiv_id"]), order).alias("r")).select("arxiv_id", "r.*")
    first = F.struct(F.lit(1).alias("version_number"), F.col("published").alias("submitted"), F.lit(False).alias("verified"), F.lit(False).alias("is_latest"))
    latest = F.struct(F.col("version").alias("version_number"), F.col("updated").alias("submitted"), F.lit(True).alias("verified"), F.lit(True).alias("is_latest"))
    versions = one.select("arxiv_id", F.explode(F.when(F.col("version") > 1, F.array(first, latest)).otherwise(F.array(latest))).alias("v")).select("arxiv_id", "v.*")
    codes = F.concat(F.array("primary_category"), "secondary_categories")
    categories = one.select("arxiv_id", F.posexplode(codes).alias("place", "code")).select("arxiv_id", "code", (F.col("place") == 0).alias("is_primary"))
    named = one.select("arxiv_id", F.explode("authors").alias("a")).select("arxiv_id", normalize_text(F.col("a.name")).alias("normalized"), F.col("a.name").alias("display_name"), F.col("a.author_order").alias("author_order"))
    return {
        "papers": one.select("arxiv_id", "title", "normalized_title", "abstract", "primary_category", "doi", "published", "updated", F.lit(number).cast("long").alias("first_batch")),
        "versions": versions,
        "categories": categories.select("code").distinct(),
        "paper_categories": categories,
        "authors": named.groupBy("normalized").agg(F.min_by("display_name", F.struct("arxiv_id", "author_order")).alias("display_name")),
        "paper_authors": named.groupBy("arxiv_id", "normalized").agg(F.min("author_order").alias("author_order")),
    }


def _newest(c: str) -> Column:
    return F.max_by(c, "batch").alias(c)


def folded(name: str, rows: DataFrame) -> DataFrame:
    """A table as upserts in the order of batches leave it: ``rows`` have their ``batch``."""
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    if name == "papers":  # new titles win, an absent doi keeps the old one, the first batch stays
        return rows.groupBy("arxiv_id").agg(*[_newest(c) for c in columns[1:] if c not in ("doi", "first_batch")], F.max_by("doi", F.when(F.col("doi").isNotNull(), F.col("batch"))).alias("doi"), F.min("first_batch").alias("first_batch")).select(columns)
    if name in ("paper_categories", "paper_authors"):  # the children of a paper are those of its newest batch
        last = rows.groupBy("arxiv_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["arxiv_id", "batch"], "left_semi").select(columns)
    if name == "versions":  # one row a version; the highest is the latest
        one = rows.groupBy("arxiv_id", "version_number").agg(F.max_by(F.struct("submitted", "verified"), F.struct("verified", "batch")).alias("v"))
        top = one.groupBy("arxiv_id").agg(F.max("version_number").alias("top"))
        return one.join(top, "arxiv_id").select("arxiv_id", "version_number", "v.submitted", "v.verified", (F.col("version_number") == F.col("top")).alias("is_latest"))
    if name == "authors":  # the first name of an author stays
        return rows.groupBy("normalized").agg(F.min_by("display_name", "batch").alias("display_name")).select(columns)
    return rows.select(columns).distinct() if name == "categories" else rows.select(columns)


class EntryStore:
    """The tables of one ingest, below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, path: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def committed(self) -> tuple[int, list[int]]:
        """(batch that the newest snapshot reaches or -1, committed batches after it): a number each."""
        snapshots = self._read(f"{self.folder}/snapshots", "upto bigint")
        upto = -1 if snapshots is None else snapshots.agg(F.max("upto")).first()[0]
        commits = self._read(f"{self.folder}/commits", "batch bigint")
        return upto, [] if commits is None else sorted(r["batch"] for r in commits.filter(F.col("batch") > upto).select("batch").distinct().collect())

    def rows(self, name: str) -> DataFrame:
        """All stored rows of a table with their ``batch``, snapshot first."""
        upto, batches = self.committed()
        schema = f"{TABLES[name]}, batch bigint"
        out = self.spark.createDataFrame([], schema)
        if upto >= 0:
            out = self.spark.read.schema(schema).parquet(f"{self.folder}/base/upto={upto}/{name}")
        if batches:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").filter(F.col("batch").isin(batches)))
        return out

    def table(self, name: str) -> DataFrame:
        return folded(name, self.rows(name))

    def write(self, entries: DataFrame, number: int) -> None:
        """Store one batch of entries; parsed once, whatever the number of tables."""
        parsed = parse_entries(entries).persist()
        try:
            good, bad = split_bad(parsed)
            for name, rows in (tables_of(good, number) | {"failures": bad}).items():
                rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
            self._commit(number)
        finally:
            parsed.unpersist()

    def _commit(self, number: int) -> None:
        self.spark.createDataFrame([(number,)], "n bigint").write.mode("overwrite").parquet(f"{self.folder}/commits/batch={number}")

    def compact(self) -> None:
        """Fold all committed batches into a snapshot. Readers change to it when its own row is there."""
        upto, batches = self.committed()
        if not batches:
            return
        last = batches[-1]
        for name in TABLES:
            rows = self.rows(name)
            keep = rows if name in ("paper_categories", "paper_authors") else None
            if keep is not None:  # a later batch must still replace a paper's children as a whole
                newest = rows.groupBy("arxiv_id").agg(F.max("batch").alias("batch"))
                out = rows.join(newest, ["arxiv_id", "batch"], "left_semi")
            else:
                out = folded(name, rows).withColumn("batch", F.lit(last).cast("long"))
            out.write.mode("overwrite").parquet(f"{self.folder}/base/upto={last}/{name}")
        self.spark.createDataFrame([(last,)], "n bigint").write.mode("overwrite").parquet(f"{self.folder}/snapshots/upto={last}")


def ingest_entries(spark: SparkSession, path: str, folder: str, before_commit: Callable[[int], None] | None = None) -> EntryStore:
    """Take the new files of entries (a column ``entry`` of XML) that match ``path``, one a batch; resumable on ``folder``.

    ``before_commit`` is called between a batch's tables and its commit, for tests.
    """
    store = EntryStore(spark, folder)
    if before_commit is not None:
        commit = store._commit
        store._commit = lambda number: (before_commit(number), commit(number))[1]
    place, _, name = path.rpartition("/")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(place)
    job = stream.writeStream.foreachBatch(store.write).option("checkpointLocation", f"{folder}/checkpoint")
    job.trigger(availableNow=True).start().awaitTermination()
    return store
