"""Trend analysis of two cohorts of papers."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import trend as T

GAP_DAYS = 30


def publication_days(papers: DataFrame) -> DataFrame:
    return papers.select(F.to_date("published").alias("day")).distinct()


def in_window(papers: DataFrame, start, end) -> DataFrame:
    """Papers published in [start, end)."""
    return papers.filter((F.col("published") >= F.lit(start).cast("timestamp_ntz")) & (F.col("published") < F.lit(end).cast("timestamp_ntz")))


def freshness_inputs(papers: DataFrame, now: datetime, window: int = T.WINDOW_DAYS, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each ``by``): total, days since the latest paper, counts in the two windows before ``now``, distinct days of the recent one."""
    recent, before = now - timedelta(days=window), now - timedelta(days=2 * window)
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    p = F.col("published")
    own = (p >= at(recent)) & (p < at(now))
    elapsed = F.timestamp_diff("SECOND", F.max(p), at(now))
    return papers.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.greatest(F.lit(0), F.floor(elapsed / 86400)).cast("long").alias("days_since"),
        F.count_if(own).alias("recent"),
        F.count_if((p >= at(before)) & (p < at(recent))).alias("comparison"),
        F.count_distinct(F.when(own, F.to_date(p))).alias("distinct_days"),
    )


def cohort_groups(days: DataFrame, gap: int = GAP_DAYS) -> DataFrame:
    """(day, grp): a new group begins after a gap of more than ``gap`` days. One row a calendar day, so one task holds it."""
    order = Window.orderBy("day")
    fresh = F.when(F.date_diff("day", F.lag("day").over(order)) > gap, 1).otherwise(0)
    return days.withColumn("fresh", fresh).select("day", F.sum("fresh").over(order).alias("grp"))


def cohort_windows(papers: DataFrame, gap: int = GAP_DAYS) -> tuple[date, date, date, date]:
    """(comparison start, end, recent start, end) of the first and the last group of days; ends are exclusive.

    Raises ValueError with fewer than two groups.
    """
    groups = cohort_groups(publication_days(papers), gap).groupBy("grp").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    ends = groups.agg(F.min_by(F.struct("a", "b"), "grp").alias("first"), F.max_by(F.struct("a", "b"), "grp").alias("last"), F.count("*").alias("n")).first()
    if ends["n"] < 2:
        raise ValueError("there are no two cohorts to compare")
    one = timedelta(days=1)
    return ends["first"]["a"], ends["first"]["b"] + one, ends["last"]["a"], ends["last"]["b"] + one


def window_counts(members: DataFrame, windows: tuple[date, date, date, date]) -> DataFrame:
    """(entity_type, entity_id, recent_count, previous_count) of (entity_type, entity_id, paper_id, published)."""
    c0, c1, r0, r1 = (F.lit(x).cast("timestamp_ntz") for x in windows)
    p = F.col("published")
    return members.groupBy("entity_type", "entity_id").agg(
        F.count_if((p >= r0) & (p < r1)).alias("recent_count"), F.count_if((p >= c0) & (p < c1)).alias("previous_count")
    )


def measured(counts: DataFrame, windows: tuple[date, date, date, date], now: date, recent_days: int) -> DataFrame:
    """All measures, score, class and quality of each entity; totals and maxima are by entity type."""
    whole = Window.partitionBy("entity_type")
    r, p = F.col("recent_count"), F.col("previous_count")
    rows = counts.select(
        "*",
        (r + p).alias("total_papers"), (r - p).alias("absolute_growth"),
        F.sum(r).over(whole).alias("recent_total"), F.sum(p).over(whole).alias("previous_total"), F.max(r).over(whole).alias("max_recent"),
        T.growth_rate(r, p).alias("growth_rate"), T.is_new(r, p).alias("is_new_activity"),
        T.consistency(F.array(p > 0, r > 0)).alias("consistency"),
        F.when(r > 0, T.recency(F.lit((now - windows[3]).days))).when(p > 0, T.recency(F.lit((now - windows[1]).days))).otherwise(0.0).alias("recency"),
        F.lit(None).cast("boolean").alias("acceleration"),
    )
    rows = rows.withColumns({"recent_share": T.share_of(r, F.col("recent_total")), "previous_share": T.share_of(p, F.col("previous_total"))})
    rows = rows.withColumn("share_change", F.col("recent_share") - F.col("previous_share"))
    rate, total = F.col("growth_rate"), F.col("total_papers")
    parts = {
        "volume": T.volume(r, F.col("max_recent")), "growth": T.growth_normalized(rate), "share": T.share_part(F.col("share_change")),
        "acceleration": T.acceleration_part(F.col("acceleration")), "recency": F.col("recency"), "consistency": F.col("consistency"),
    }
    return rows.withColumns(
        {
            "momentum": T.momentum(r, F.col("max_recent"), rate),
            "trend_score": T.trend_score(parts, total),
            # Two windows can't show steadiness: a threshold over 1 keeps that class out.
            "trend_class": T.trend_class(total, r, p, rate, F.col("acceleration"), F.col("consistency"), steady_from=1.01),
            "data_quality": T.data_quality(total, p, F.lit(recent_days), F.lit(False)),
        }
    )


def evidence(members: DataFrame, windows: tuple[date, date, date, date], n: int = 10) -> DataFrame:
    """(entity_type, entity_id, role, paper_id, rank): the first ``n`` papers of each entity and window by date."""
    c0, c1, r0, r1 = (F.lit(x).cast("timestamp_ntz") for x in windows)
    p = F.col("published")
    role = F.when((p >= r0) & (p < r1), "RECENT").when((p >= c0) & (p < c1), "COMPARISON")
    rows = members.withColumn("role", role).filter("role IS NOT NULL")
    order = Window.partitionBy("entity_type", "entity_id", "role").orderBy("published", "paper_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n).select("entity_type", "entity_id", "role", "paper_id", "rank")


def analyse(papers: DataFrame, members: DataFrame, now: date) -> tuple[DataFrame, DataFrame]:
    """(scores, evidence) of a dry run. Cohort bounds are one small row that becomes literals."""
    windows = cohort_windows(papers)
    days = in_window(papers, windows[2], windows[3]).agg(F.count_distinct(F.to_date("published"))).first()[0]
    return measured(window_counts(members, windows), windows, now, days), evidence(members, windows)


def resolve_run(runs: DataFrame, run_id: int | None = None) -> DataFrame:
    """The run asked for, whatever its status, or else the newest one that succeeded: one row, or none where there is no such run."""
    if run_id is not None:
        return runs.filter(F.col("run_id") == run_id)
    return runs.filter("status = 'SUCCEEDED'").orderBy(F.desc("completed_at"), F.desc("run_id")).limit(1)


def trend_list(
    scores: DataFrame, names: DataFrame, entity_type: str | None = None, trend_class: str | None = None, quality: str | None = None, min_score: int | None = None,
    sort: str = "trend_score", descending: bool = True, limit: int = 20, offset: int = 0,
) -> DataFrame:
    """A page of scores with entity_name and ``total``, the number before the limit; nulls last either way, ties by entity name and id.

    ``names``: entity_type, entity_id, entity_name; an entity without a name goes by its id.
    """
    if sort not in ("trend_score", "growth_rate", "recent_count", "momentum"):
        raise ValueError(f"no sort field {sort}")
    for column, value in (("entity_type", entity_type), ("trend_class", trend_class), ("data_quality", quality)):
        if value is not None:
            scores = scores.filter(F.col(column) == value)
    if min_score is not None:
        scores = scores.filter(F.col("trend_score") >= min_score)
    rows = scores.join(names, ["entity_type", "entity_id"], "left").withColumn("entity_name", F.coalesce("entity_name", "entity_id"))
    total = scores.agg(F.count("*").alias("total"))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    page = rows.orderBy(order, "entity_name", "entity_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def overview(scores: DataFrame, names: DataFrame, windows: tuple[date, date, date, date], top: int = 5) -> DataFrame:
    """(section, entity_type, item, place, value): what a start page of trends shows.

    Sections: entities, classes and qualities counted by entity type; the ``top`` entities of
    three classes by score; and a message with both cohorts' first and last days.
    """
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, section, kind, item, place, value: df.select(F.lit(section).alias("section"), kind.alias("entity_type"), item.alias("item"), place.alias("place"), value.alias("value"))
    own = F.col("entity_type")
    entities = row(scores.groupBy("entity_type").agg(F.count("*").alias("n")), "entities", own, none("string"), none("long"), F.col("n"))
    parts = [entities]
    for section, column in (("classes", "trend_class"), ("qualities", "data_quality")):
        counted = scores.groupBy("entity_type", column).agg(F.count("*").alias("n"))
        parts.append(row(counted, section, own, F.col(column), none("long"), F.col("n")))
    named = scores.filter(F.col("trend_class").isin("Emerging", "Stable", "Cooling")).join(names, ["entity_type", "entity_id"], "left")
    order = Window.partitionBy("trend_class").orderBy(F.desc_nulls_last("trend_score"), F.coalesce("entity_name", "entity_id"), "entity_id")
    best = named.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= top)
    label = F.concat_ws(": ", "trend_class", F.coalesce("entity_name", "entity_id"))
    parts.append(row(best, "top", own, label, F.col("place"), F.col("trend_score")))
    c0, c1, r0, r1 = windows[0], windows[1] - timedelta(days=1), windows[2], windows[3] - timedelta(days=1)
    message = f"{T.MODE_LABELS['HISTORICAL_OK']}: papers of {c0} to {c1} against papers of {r0} to {r1}."
    parts.append(row(scores.agg(F.count("*").alias("n")), "message", none("string"), F.lit(message), none("long"), F.col("n")))
    return reduce(DataFrame.unionByName, parts)


def history_trends(members: DataFrame, end: date, days: int, windows: int, by: tuple[str, ...] = ("entity_type", "entity_id")) -> DataFrame:
    """One row per entity over ``windows`` windows of ``days`` days up to ``end`` (exclusive): counts, growth of each over the one before, and what follows.

    ``members``: the entity's columns and ``published``. A window without papers counts as 0 from the first window on; entities without a
    paper in any window have no row. Acceleration needs three growth rates, so four windows; history is long where three windows and more are active.
    """
    if windows < 2 or days < 1:
        raise ValueError("at least two windows of a day and more")
    day = F.to_date("published")
    place = F.floor(F.date_diff(day, F.lit(end - timedelta(days=days * windows))) / days).cast("int")
    counted = members.withColumn("w", place).filter(F.col("w").between(0, windows - 1)).groupBy(*by, "w").agg(F.count("*").alias("n"), F.count_distinct(day).alias("d"))
    held = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("n", "d")))).alias("held"))  # a row a window at most
    n_of = lambda w: F.coalesce(F.try_element_at("held", w)["n"], F.lit(0).cast("long"))
    rows = held.withColumn("counts", F.array(*[n_of(F.lit(w)) for w in range(windows)]))
    rates = F.array(*[T.growth_rate(F.col("counts")[w], F.col("counts")[w - 1]) for w in range(1, windows)])
    recent, previous = F.col("counts")[windows - 1], F.col("counts")[windows - 2]
    rows = rows.select(
        *by, "counts", rates.alias("rates"), recent.alias("recent_count"), previous.alias("previous_count"), (recent + previous).alias("total_papers"),
        F.coalesce(F.try_element_at("held", F.lit(windows - 1))["d"], F.lit(0).cast("long")).alias("distinct_days"),
    )
    active = F.transform("counts", lambda n: n > 0)
    rows = rows.withColumns({"growth_rate": F.element_at("rates", -1), "acceleration": T.acceleration(F.col("rates")), "consistency": T.consistency(active), "active": F.size(F.filter(active, lambda x: x))})
    kind = T.trend_class(F.col("total_papers"), F.col("recent_count"), F.col("previous_count"), F.col("growth_rate"), F.col("acceleration"), F.col("consistency"))
    quality = T.data_quality(F.col("total_papers"), F.col("previous_count"), F.col("distinct_days"), F.col("active") >= 3, days)
    return rows.withColumns({"trend_class": kind, "data_quality": quality}).drop("active")
