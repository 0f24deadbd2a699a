"""Ingest: Atom entries to records, dimensions, upserts, quotas and back-fill plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import id_and_version, normalize_text
from corpuslens.operators.components import kept

ENTRY = (
    "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, "
    "`arxiv:primary_category` struct<_term:string>, category array<struct<_term:string>>, `arxiv:doi` string, "
    "link array<struct<_href:string,_rel:string,_title:string>>, _broken string"
)
STAMP = "yyyy-MM-dd'T'HH:mm:ssX"


def secondary(categories: Column, primary: Column) -> Column:
    """Categories other than the primary one, each once, in order."""
    return F.array_except(F.array_distinct(categories), F.array(primary))


def link_of(links: Column, field: str, value: str) -> Column:
    """The last link whose ``field`` is ``value``."""
    return F.try_element_at(F.transform(F.filter(links, lambda x: x[field] == value), lambda x: x["_href"]), F.lit(-1))


def parse_entries(entries: DataFrame, xml: str = "entry") -> DataFrame:
    """One row per entry with its fields, or with ``error`` where a required one is missing. Nothing is raised in a task."""
    e = entries.select("*", F.explode(F.array(F.from_xml(xml, ENTRY, {"columnNameOfCorruptRecord": "_broken"}))).alias("e"))  # a generator: later filters don't parse again
    url = F.col("e.id")
    ids = id_and_version(url)
    primary = F.col("e")["arxiv:primary_category"]["_term"]
    categories = F.filter(F.transform("e.category", lambda c: c["_term"]), lambda t: F.length(t) > 0)
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    error = (
        F.when(F.col("e._broken").isNotNull(), "broken entry").when(blank(url), "missing id").when(ids["base_id"].isNull(), "no version in id").when(blank(F.col("e.title")), "missing title")
        .when(blank(F.col("e.summary")), "missing abstract").when(blank(primary), "missing category")
        .when(F.try_to_timestamp("e.published", F.lit(STAMP)).isNull(), "missing published date")
        .when(F.try_to_timestamp("e.updated", F.lit(STAMP)).isNull(), "missing updated date")
    )
    placed = F.transform("e.author", lambda a, i: F.struct((i + 1).cast("long").alias("author_order"), F.trim(a["name"]).alias("name")))
    authors = F.filter(placed, lambda a: F.length(a["name"]) > 0)  # one without a name keeps its place from others
    other_links = F.filter("e.link", lambda x: ~F.coalesce(x["_title"] == "pdf", F.lit(False)))
    return e.select(
        *[c for c in entries.columns if c != xml],
        ids["base_id"].alias("arxiv_id"), ids["version"].alias("version"), normalize_text(F.col("e.title")).alias("normalized_title"),
        F.col("e.title").alias("title"), F.col("e.summary").alias("abstract"), primary.alias("primary_category"), secondary(categories, primary).alias("secondary_categories"),
        F.try_to_timestamp("e.published", F.lit(STAMP)).alias("published"), F.try_to_timestamp("e.updated", F.lit(STAMP)).alias("updated"),
        F.nullif(F.trim(F.col("e")["arxiv:doi"]), F.lit("")).alias("doi"), authors.alias("authors"),
        link_of(F.col("e.link"), "_title", "pdf").alias("pdf_url"), link_of(other_links, "_rel", "alternate").alias("abstract_url"),
        error.alias("error"), F.coalesce(ids["base_id"], url).alias("source_identifier"),
    )


def split_bad(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, failures: source_identifier, error)."""
    return parsed.filter("error IS NULL").drop("error"), parsed.filter("error IS NOT NULL").select("source_identifier", "error")


def version_rows(records: DataFrame) -> DataFrame:
    """(paper_id, version_number, submitted, verified, is_latest): the latest version, and an unverified first one below it."""
    latest = F.struct(F.col("version").alias("version_number"), F.col("updated").alias("submitted"), F.lit(True).alias("verified"), F.lit(True).alias("is_latest"))
    first = F.struct(F.lit(1).cast("long").alias("version_number"), F.col("published").alias("submitted"), F.lit(False).alias("verified"), F.lit(False).alias("is_latest"))
    both = F.when(F.col("version") > 1, F.array(first, latest)).otherwise(F.array(latest))
    return records.select("paper_id", F.explode(both).alias("v")).select("paper_id", "v.*")


def new_names(rows: DataFrame, stored: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """(key, value) of keys that aren't stored; the first value by ``seq``."""
    firsts = rows.groupBy(key).agg(F.min_by(value, seq).alias(value))
    return firsts.join(stored.select(key), key, "left_anti")


def paper_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """By arxiv_id: new titles and dois win, an absent doi keeps the old one, first observations stay; ``created`` marks new rows."""
    old = stored.select("arxiv_id", F.col("doi").alias("old_doi"), F.col("title").alias("old_title"), F.col("first_observed_at").alias("old_first"), F.lit(True).alias("known"))
    rows = old.join(incoming, "arxiv_id", "full")
    return rows.select(
        "arxiv_id", F.coalesce("title", "old_title").alias("title"), F.coalesce(F.nullif("doi", F.lit("")), "old_doi").alias("doi"),
        F.coalesce("old_first", "first_observed_at").alias("first_observed_at"), F.col("known").isNull().alias("created"),
    )


def first_positions(links: DataFrame) -> DataFrame:
    """An author repeated in a paper keeps the first position."""
    return links.groupBy("paper_id", "author_id").agg(F.min("author_order").alias("author_order"))


def new_candidates(entries: DataFrame, stored: DataFrame, quota: int) -> DataFrame:
    """The first ``quota`` entries, by ``place``, that aren't stored; entries without an id count as new."""
    return entries.join(stored.select("arxiv_id"), "arxiv_id", "left_anti").orderBy("place").limit(quota)


def quota_split(new: DataFrame, backlog: DataFrame, quota: int) -> DataFrame:
    """One row: how a quota splits between new papers, which go first, and the backlog, and what stays unused."""
    counts = new.agg(F.count("*").alias("new")).crossJoin(backlog.agg(F.coalesce(F.sum("remaining"), F.lit(0)).alias("backlog")))
    first = F.least("new", F.lit(quota))
    second = F.least("backlog", F.lit(quota) - first)
    return counts.select("new", "backlog", first.cast("long").alias("new_selected"), second.cast("long").alias("backlog_selected"), (F.lit(quota) - first - second).cast("long").alias("unused"))


def quota_rows(new: DataFrame, backlog: DataFrame, windows: DataFrame, quota: int) -> DataFrame:
    """(paper_id, kind, window, place) of what a quota takes: new papers by date, then the backlog's, oldest window first.

    ``new`` and ``backlog``: paper_id, published, the latter with its ``window``; ``windows``: window, of those that
    are planned or running. Each kind is cut to the quota before it is ranked.
    """
    own = new.orderBy("published", "paper_id").limit(quota).select("paper_id", "published", F.lit(None).cast("string").alias("window"), F.lit("new").alias("kind"))
    open_ = backlog.join(windows.select("window"), "window", "left_semi").orderBy("window", "published", "paper_id").limit(quota)
    both = own.unionByName(open_.select("paper_id", "published", "window", F.lit("backlog").alias("kind")))
    order = Window.orderBy(F.when(F.col("kind") == "new", 0).otherwise(1), "window", "published", "paper_id")  # twice the quota at most
    ranked = both.withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("place") <= quota).select("paper_id", "kind", "window", "place")


def plan_windows(papers: DataFrame, start: str, end: str, threshold: int = 1000) -> DataFrame:
    """(granularity, window_start, window_end, n, status): months; weeks of months over the threshold; days of weeks over it.

    Windows are half-open. Weeks count from the month's first day.
    """
    days = papers.groupBy(F.to_date("published").alias("day")).agg(F.count("*").alias("n"))
    calendar = papers.sparkSession.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}' - INTERVAL 1 DAY)) AS day")
    daily = calendar.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    month = F.trunc("day", "month")
    week = F.date_add(month, (F.floor((F.dayofmonth("day") - 1) / 7) * 7).cast("int"))
    daily = daily.withColumns({"month": month, "week": week})

    def grouped(level: str, key: str, split: bool) -> DataFrame:
        total = daily.groupBy("month", *([key] if key != "month" else [])).agg(F.min("day").alias("window_start"), F.date_add(F.max("day"), 1).alias("window_end"), F.sum("n").alias("n"))
        over = F.when(F.col("n") == 0, "SKIPPED_EMPTY").when((F.col("n") > threshold) & F.lit(split), "SPLIT").otherwise("PLANNED")
        return total.withColumn("status", over).withColumn("granularity", F.lit(level))

    months, weeks, single = grouped("monthly", "month", True), grouped("weekly", "week", True), grouped("daily", "day", False)
    split_months = months.filter("status = 'SPLIT'").select("month")
    weeks = weeks.join(split_months, "month", "left_semi")
    split_weeks = weeks.filter("status = 'SPLIT'").select("month", "week")
    single = daily.join(split_weeks, ["month", "week"], "left_semi").select("month", "day").join(single, ["month", "day"])
    columns = ["granularity", "window_start", "window_end", "n", "status"]
    return months.select(columns).unionByName(weeks.select(columns)).unionByName(single.select(columns))


def window_pages(rows: DataFrame, page_size: int) -> DataFrame:
    """``rows`` with the page of their window that holds them, by date and id."""
    order = Window.partitionBy("window").orderBy("published", "paper_id")
    return rows.withColumn("page", F.floor((F.row_number().over(order) - 1) / page_size).cast("long"))


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row per run: created, updated, failed, and the status that follows."""
    counted = outcomes.groupBy("run_id").agg(
        F.count("*").alias("processed"), F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome") == "updated").alias("updated"), F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    status = F.when(F.col("failed") == 0, "succeeded").when(F.col("failed") == F.col("processed"), "failed").otherwise("partial")
    return counted.withColumn("status", status)


def count_in_windows(rows: DataFrame, windows: DataFrame, at: str = "published") -> DataFrame:
    """``windows`` (window, window_start, window_end) with ``n``, the rows in [start, end); any windows, overlapping ones too.

    Rows before the end less rows before the start: rows of an instant and bounds of windows are each counted
    once, put in order by ranges of time, and summed up along it, so the work grows with rows and windows and not with what they share.
    Empty and reversed windows, and those without a start or end, count 0; rows without a time count nowhere.
    """
    instants = rows.filter(F.col(at).isNotNull()).groupBy(F.col(at).alias("__at")).agg(F.count("*").alias("__n"))
    own = windows.filter(F.col("window_start") < F.col("window_end"))
    bounds = own.select(F.explode(F.array("window_start", "window_end")).alias("__at")).distinct()
    line = instants.join(bounds.withColumn("__bound", F.lit(True)), "__at", "full").withColumn("__n", F.coalesce("__n", F.lit(0).cast("long")))
    placed = kept(line.repartitionByRange("__at").withColumn("__part", F.spark_partition_id()))
    # one number a range: what lies in the ranges before it
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.sum("__n").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long")).alias("__start"))
    before = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).filter("__bound")
    upto = kept(summed.join(starts, "__part").select("__at", (F.col("__before") + F.col("__start")).alias("__upto")))
    first, last = upto.toDF("window_start", "__first"), upto.toDF("window_end", "__last")
    met = windows.join(first, "window_start", "left").join(last, "window_end", "left")
    n = F.when(F.col("window_start") < F.col("window_end"), F.col("__last") - F.col("__first"))
    return met.select(*windows.columns, F.coalesce(n, F.lit(0).cast("long")).alias("n"))


def write_counted(outcomes: DataFrame, path: str, mode: str = "append") -> dict:
    """Write ``outcomes`` (with an ``outcome``) and give the run's report, counted by the write itself: no second scan.

    {processed, created, updated, failed, status}; counts of a write that fails are not given, as nothing was stored.
    """
    from pyspark.sql import Observation

    seen = Observation("outcomes")
    kind = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    outcomes.observe(seen, F.count(F.lit(1)).alias("processed"), kind("created"), kind("updated"), kind("failed")).write.mode(mode).parquet(path)
    report = dict(seen.get)
    failed, processed = report["failed"], report["processed"]
    return report | {"status": "succeeded" if not failed else "failed" if failed == processed else "partial"}
