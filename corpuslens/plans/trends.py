"""Queries G1-G27 and H1-H11: measuring and reading trends."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import trend as T
from corpuslens.operators import trends as O
from corpuslens.plans.registry import query
from corpuslens.sources import views as W

NOW = date(2001, 8, 10)


def members(spark, d):
    p = W.cohort_papers(spark, d).select("paper_id", "category_code", "published")
    k = W.assignments(spark, d).filter("NOT is_noise").select("paper_id", "cluster_id")
    by_category = p.select(F.lit("category").alias("entity_type"), F.col("category_code").alias("entity_id"), "paper_id", "published")
    by_cluster = k.join(p, "paper_id").select(F.lit("cluster").alias("entity_type"), F.col("cluster_id").cast("string").alias("entity_id"), "paper_id", "published")
    return by_category.unionByName(by_cluster)


def scores(spark, d):
    return O.analyse(W.cohort_papers(spark, d), members(spark, d), NOW)


def r6(name):
    return F.round(name, 6).alias(name)


@query("publication_days", "SELECT DISTINCT strftime(published, '%Y-%m-%d') AS day FROM canonical")
def _(spark, d):
    return O.publication_days(W.canonical(spark, d)).select(W.day("day").alias("day"))


@query("date_range", "SELECT strftime(min(published), '%Y-%m-%d') AS first_day, strftime(max(published), '%Y-%m-%d') AS last_day FROM canonical")
def _(spark, d):
    return W.canonical(spark, d).agg(W.day(F.min("published")).alias("first_day"), W.day(F.max("published")).alias("last_day"))


@query("count_in_window", "SELECT count(*) AS papers FROM canonical WHERE published >= '1996-01-01' AND published < '1997-01-01'")
def _(spark, d):
    return O.in_window(W.canonical(spark, d), "1996-01-01", "1997-01-01").agg(F.count("*").alias("papers"))


@query("distinct_days_in_window", "SELECT count(DISTINCT CAST(published AS DATE)) AS days FROM canonical WHERE published >= '1996-01-01' AND published < '1997-01-01'")
def _(spark, d):
    return O.in_window(W.canonical(spark, d), "1996-01-01", "1997-01-01").agg(F.count_distinct(F.to_date("published")).alias("days"))


FRESH = """SELECT count(*) AS total, greatest(0, CAST(floor(date_diff('second', max(published), TIMESTAMP '2001-08-10') / 86400) AS BIGINT)) AS days_since,
    count(*) FILTER (WHERE published >= TIMESTAMP '2001-08-10' - INTERVAL 90 DAY AND published < TIMESTAMP '2001-08-10') AS recent,
    count(*) FILTER (WHERE published >= TIMESTAMP '2001-08-10' - INTERVAL 180 DAY AND published < TIMESTAMP '2001-08-10' - INTERVAL 90 DAY) AS comparison,
    count(DISTINCT CASE WHEN published >= TIMESTAMP '2001-08-10' - INTERVAL 90 DAY AND published < TIMESTAMP '2001-08-10' THEN CAST(published AS DATE) END) AS distinct_days
    FROM canonical"""


@query("freshness_inputs", FRESH)
def freshness(spark, d):
    return O.freshness_inputs(W.canonical(spark, d).select("published"), datetime(2001, 8, 10))


STATUS = """CASE WHEN total < 30 THEN 'INSUFFICIENT_DATA' WHEN days_since > 180 OR recent = 0 THEN 'HISTORICAL_ONLY'
    WHEN comparison < 5 OR distinct_days < 9 THEN 'PARTIALLY_CURRENT' ELSE 'CURRENT' END"""


@query("freshness_status", f"SELECT total, recent, {STATUS} AS status FROM ({FRESH})")
def _(spark, d):
    status = T.freshness(*(F.col(c) for c in ("total", "days_since", "recent", "comparison", "distinct_days")))
    return freshness(spark, d).select("total", "recent", status.alias("status"))


MODE = """CASE WHEN requested = 'current' THEN CASE WHEN status = 'CURRENT' THEN 'CURRENT_OK' ELSE 'CURRENT_UNAVAILABLE' END
    WHEN status = 'INSUFFICIENT_DATA' THEN 'HISTORICAL_UNAVAILABLE' ELSE 'HISTORICAL_OK' END"""
LABEL = """CASE state WHEN 'CURRENT_OK' THEN 'Trending Now' WHEN 'HISTORICAL_OK' THEN 'Historical Cohort Comparison'
    WHEN 'CURRENT_UNAVAILABLE' THEN 'Current Trends Unavailable' ELSE 'Insufficient Data For Historical Comparison' END"""


@query(
    "trend_mode",
    f"""SELECT *, {LABEL} AS label FROM (SELECT requested, status, {MODE} AS state, status <> 'INSUFFICIENT_DATA' AS historical_available
    FROM (SELECT {STATUS} AS status FROM ({FRESH})), (VALUES ('current'), ('historical')) r(requested))""",
)
def _(spark, d):
    status = T.freshness(*(F.col(c) for c in ("total", "days_since", "recent", "comparison", "distinct_days")))
    rows = freshness(spark, d).select(status.alias("status"), F.explode(F.array(F.lit("current"), F.lit("historical"))).alias("requested"))
    state = T.resolved_mode(F.col("requested"), F.col("status"))
    return rows.select("requested", "status", state.alias("state"), (F.col("status") != "INSUFFICIENT_DATA").alias("historical_available"), T.mode_label(state).alias("label"))


GROUPED = FRESH.replace("SELECT count(*)", "SELECT category_code, count(*)").replace("FROM canonical", "FROM canonical GROUP BY category_code")


@query(
    "mode_label",
    f"""SELECT category_code, status, state, {LABEL} AS label FROM (SELECT *, {MODE} AS state FROM (SELECT category_code, {STATUS} AS status,
    CASE WHEN CAST(substr(category_code, 4) AS BIGINT) % 2 = 0 THEN 'current' ELSE 'historical' END AS requested FROM ({GROUPED})))""",
)
def _(spark, d):
    """Each category's own mode: even ones ask for current trends, odd ones for history."""
    rows = O.freshness_inputs(W.canonical(spark, d).select("category_code", "published"), datetime(2001, 8, 10), by=("category_code",))
    status = T.freshness(*(F.col(c) for c in ("total", "days_since", "recent", "comparison", "distinct_days")))
    requested = F.when(F.substring("category_code", 4, 10).cast("long") % 2 == 0, "current").otherwise("historical")
    rows = rows.withColumn("status", status).withColumn("state", T.resolved_mode(requested, F.col("status")))
    return rows.select("category_code", "status", "state", T.mode_label(F.col("state")).alias("label"))


@query(
    "resolve_trend_run",
    """SELECT 'latest' AS asked, run_id, status, strftime(completed_at, '%Y-%m-%d') AS completed FROM (SELECT * FROM runs WHERE status = 'SUCCEEDED' ORDER BY completed_at DESC, run_id DESC LIMIT 1)
    UNION ALL SELECT 'by id', run_id, status, strftime(completed_at, '%Y-%m-%d') FROM runs WHERE run_id = (SELECT min(run_id) FROM runs WHERE status = 'FAILED')
    UNION ALL SELECT 'unknown', run_id, status, strftime(completed_at, '%Y-%m-%d') FROM runs WHERE run_id = -1""",
)
def _(spark, d):
    """The newest run that succeeded, a failed one by its id, and an id that no run has."""
    runs = W.runs(spark, d)
    failed = runs.filter("status = 'FAILED'").agg(F.min("run_id").alias("run_id")).first()["run_id"]
    asked = {"latest": None, "by id": failed, "unknown": -1}
    rows = [O.resolve_run(runs, run_id).withColumn("asked", F.lit(name)) for name, run_id in asked.items()]
    return reduce(DataFrame.unionByName, rows).select("asked", "run_id", "status", W.day("completed_at").alias("completed"))


@query("cohort_groups", "SELECT CAST(grp AS BIGINT) AS grp, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS days FROM cohort_groups GROUP BY grp")
def _(spark, d):
    groups = O.cohort_groups(O.publication_days(W.cohort_papers(spark, d)))
    return groups.groupBy("grp").agg(W.day(F.min("day")).alias("first_day"), W.day(F.max("day")).alias("last_day"), F.count("*").alias("days"))


@query(
    "cohort_windows",
    """SELECT strftime(comparison_start, '%Y-%m-%d') AS comparison_start, strftime(comparison_end, '%Y-%m-%d') AS comparison_end,
    strftime(recent_start, '%Y-%m-%d') AS recent_start, strftime(recent_end, '%Y-%m-%d') AS recent_end FROM cohorts""",
)
def _(spark, d):
    names = ("comparison_start", "comparison_end", "recent_start", "recent_end")
    papers = W.cohort_papers(spark, d)
    ends = O.cohort_windows(papers)
    return papers.limit(1).select(*(F.lit(x.isoformat()).alias(n) for n, x in zip(names, ends)))


for kind in ("cluster", "category"):

    @query(f"{kind}_counts", f"SELECT entity_id, recent_count, previous_count FROM counts WHERE entity_type = '{kind}'")
    def _(spark, d, kind=kind):
        windows = O.cohort_windows(W.cohort_papers(spark, d))
        return O.window_counts(members(spark, d).filter(F.col("entity_type") == kind), windows).drop("entity_type")


@query(
    "category_universe",
    """SELECT u.code, coalesce(c.recent_count, 0) AS recent_count, coalesce(c.previous_count, 0) AS previous_count
    FROM (SELECT DISTINCT category_code AS code FROM canonical) u LEFT JOIN counts c ON c.entity_type = 'category' AND c.entity_id = u.code""",
)
def _(spark, d):
    windows = O.cohort_windows(W.cohort_papers(spark, d))
    counted = O.window_counts(members(spark, d).filter("entity_type = 'category'"), windows).withColumnRenamed("entity_id", "code")
    rows = W.canonical(spark, d).select(F.col("category_code").alias("code")).distinct().join(counted, "code", "left")
    zero = F.lit(0).cast("long")
    return rows.select("code", F.coalesce("recent_count", zero).alias("recent_count"), F.coalesce("previous_count", zero).alias("previous_count"))


@query("approved_labels", "SELECT l.cluster_id, l.cluster_name, count(k.paper_id) AS papers FROM cluster_labels l LEFT JOIN assignments k ON k.cluster_id = l.cluster_id WHERE review_status = 'APPROVED' GROUP BY ALL")
def _(spark, d):
    rows = W.cluster_labels(spark).filter("review_status = 'APPROVED'").join(W.assignments(spark, d), "cluster_id", "left")
    return rows.groupBy("cluster_id", "cluster_name").agg(F.count("paper_id").alias("papers"))


def measure(name, sql, columns):
    """A query of some measures of every entity; columns are made when it runs."""

    @query(name, f"SELECT entity_type, entity_id, {sql} FROM trend")
    def _(spark, d):
        return scores(spark, d)[0].select("entity_type", "entity_id", *columns())


measure("growth_rate", "round(growth_rate, 6) AS growth_rate, is_new_activity", lambda: [r6("growth_rate"), "is_new_activity"])
measure("absolute_growth", "recent_count - previous_count AS absolute_growth", lambda: ["absolute_growth"])
measure(
    "publication_share",
    "round(recent_share, 6) AS recent_share, round(previous_share, 6) AS previous_share, round(share_change, 6) AS share_change",
    lambda: [r6("recent_share"), r6("previous_share"), r6("share_change")],
)
measure(
    "growth_normalized", "round(growth_normalized, 6) AS growth_normalized",
    lambda: [F.round(T.growth_normalized(F.col("growth_rate")), 6).alias("growth_normalized")],
)
measure("momentum", "round(momentum, 6) AS momentum", lambda: [r6("momentum")])
measure("consistency", "CAST(consistency AS DOUBLE) AS consistency", lambda: ["consistency"])
measure("recency", "round(recency, 6) AS recency", lambda: [r6("recency")])
measure(
    "support_gates", "total_papers >= 5 AS total_supported, recent_count >= 3 AS recent_supported",
    lambda: [(F.col("total_papers") >= T.MIN_TOTAL).alias("total_supported"), (F.col("recent_count") >= T.MIN_PERIOD).alias("recent_supported")],
)
measure("trend_score", "trend_score", lambda: ["trend_score"])
measure("trend_class", "trend_class", lambda: ["trend_class"])
measure("data_quality", "data_quality", lambda: ["data_quality"])


@query(
    "acceleration",
    """SELECT category_code, CASE WHEN count(*) >= 3 AND count(rate) FILTER (WHERE r > n - 3) = 3 THEN
    max(rate) FILTER (WHERE r = n - 2) < max(rate) FILTER (WHERE r = n - 1) AND max(rate) FILTER (WHERE r = n - 1) < max(rate) FILTER (WHERE r = n) END AS acceleration
    FROM (SELECT *, row_number() OVER (PARTITION BY category_code ORDER BY y) AS r, count(*) OVER (PARTITION BY category_code) AS n FROM (
        SELECT category_code, y, (n - lag(n) OVER w) / CAST(lag(n) OVER w AS DOUBLE) AS rate FROM (
            SELECT category_code, year(published) AS y, count(*) AS n FROM canonical GROUP BY ALL) WINDOW w AS (PARTITION BY category_code ORDER BY y)))
    GROUP BY category_code""",
)
def _(spark, d):
    """Yearly growth rates of each category, oldest first."""
    from pyspark.sql import Window

    yearly = W.canonical(spark, d).groupBy("category_code", F.year("published").alias("y")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("category_code").orderBy("y"))
    rates = yearly.select("category_code", "y", ((F.col("n") - before) / before).alias("rate"))
    ordered = rates.groupBy("category_code").agg(F.array_sort(F.collect_list(F.struct("y", "rate"))).alias("all"))
    return ordered.select("category_code", T.acceleration(F.transform("all", lambda x: x["rate"])).alias("acceleration"))


EVIDENCE = """SELECT entity_type, entity_id, role, paper_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, role ORDER BY published, paper_id) AS rank
    FROM (SELECT m.*, CASE WHEN published >= recent_start AND published < recent_end THEN 'RECENT' WHEN published >= comparison_start AND published < comparison_end THEN 'COMPARISON' END AS role
    FROM members m, cohorts) WHERE role IS NOT NULL) WHERE rank <= 10"""


@query("evidence_papers", EVIDENCE)
def _(spark, d):
    return scores(spark, d)[1]


@query(
    "trend_pipeline",
    """SELECT entity_type, entity_id, recent_count, previous_count, CAST(recent_total AS BIGINT) AS recent_total, CAST(previous_total AS BIGINT) AS previous_total,
    round(growth_rate, 6) AS growth_rate, round(share_change, 6) AS share_change, round(momentum, 6) AS momentum, round(recency, 6) AS recency, trend_score, trend_class, data_quality FROM trend""",
)
def trend_pipeline(spark, d):
    return scores(spark, d)[0].select(
        "entity_type", "entity_id", "recent_count", "previous_count", "recent_total", "previous_total",
        r6("growth_rate"), r6("share_change"), r6("momentum"), r6("recency"), "trend_score", "trend_class", "data_quality",
    )


@query(
    "trend_context",
    f"""SELECT requested, status, state, {LABEL} AS label, strftime(comparison_start, '%Y-%m-%d') AS comparison_first, strftime(comparison_end - 1, '%Y-%m-%d') AS comparison_last,
    strftime(recent_start, '%Y-%m-%d') AS recent_first, strftime(recent_end - 1, '%Y-%m-%d') AS recent_last, total AS papers, (SELECT count(*) FROM counts) AS entities
    FROM (SELECT *, {MODE} AS state FROM (SELECT *, {STATUS} AS status FROM ({FRESH})), (VALUES ('current'), ('historical')) r(requested)), cohorts""",
)
def _(spark, d):
    """The header of a run asked for either way: its state follows from the corpus."""
    w = O.cohort_windows(W.cohort_papers(spark, d))
    counted = O.window_counts(members(spark, d), w).agg(F.count("*").alias("entities"))
    status = T.freshness(*(F.col(c) for c in ("total", "days_since", "recent", "comparison", "distinct_days")))
    rows = freshness(spark, d).select(F.col("total").alias("papers"), status.alias("status"), F.explode(F.array(F.lit("current"), F.lit("historical"))).alias("requested"))
    rows = rows.withColumn("state", T.resolved_mode(F.col("requested"), F.col("status"))).crossJoin(F.broadcast(counted))  # one row
    return rows.select(
        "requested", "status", "state", T.mode_label(F.col("state")).alias("label"), F.lit(w[0].isoformat()).alias("comparison_first"), W.day(F.date_sub(F.lit(w[1]), 1)).alias("comparison_last"),
        F.lit(w[2].isoformat()).alias("recent_first"), W.day(F.date_sub(F.lit(w[3]), 1)).alias("recent_last"), "papers", "entities",
    )


def page(name, where, order, cut, **named):
    columns = "entity_type, entity_id, coalesce(entity_name, entity_id) AS entity_name, recent_count, trend_score, round(growth_rate, 6) AS growth_rate, trend_class, count(*) OVER () AS total"

    @query(name, f"SELECT {columns} FROM trend LEFT JOIN names USING (entity_type, entity_id) {where} ORDER BY {order} NULLS LAST, coalesce(entity_name, entity_id), entity_id {cut}")
    def _(spark, d):
        rows = O.trend_list(scores(spark, d)[0], W.entity_names(spark, d), **named)
        return rows.select("entity_type", "entity_id", "entity_name", "recent_count", "trend_score", r6("growth_rate"), "trend_class", "total")


page("trend_list", "WHERE trend_score >= 10", "trend_score DESC", "LIMIT 10 OFFSET 5", min_score=10, limit=10, offset=5)
page("trend_list_growth", "WHERE entity_type = 'category'", "growth_rate ASC", "LIMIT 15", entity_type="category", sort="growth_rate", descending=False, limit=15)
page("trend_by_class", "WHERE trend_class = 'Cooling'", "trend_score DESC", "LIMIT 100", trend_class="Cooling", limit=100)
page("top_movers", "", "trend_score DESC", "LIMIT 8", limit=8)


@query(
    "trend_detail",
    f"""SELECT t.entity_type, t.entity_id, t.trend_score, (SELECT string_agg(paper_id, ',' ORDER BY rank) FROM ({EVIDENCE}) e WHERE e.entity_type = t.entity_type AND e.entity_id = t.entity_id AND role = 'RECENT') AS recent_papers,
    (SELECT string_agg(paper_id, ',' ORDER BY rank) FROM ({EVIDENCE}) e WHERE e.entity_type = t.entity_type AND e.entity_id = t.entity_id AND role = 'COMPARISON') AS comparison_papers
    FROM trend t WHERE t.entity_type = 'category' AND t.entity_id = 'src1'""",
)
def _(spark, d):
    rows, proof = scores(spark, d)
    one = lambda x: x.filter("entity_type = 'category' AND entity_id = 'src1'")
    ordered = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("rank", "paper_id")))), lambda x: x["paper_id"].cast("string")), ",")
    found = one(proof).groupBy("entity_type", "entity_id").agg(
        F.nullif(ordered("RECENT"), F.lit("")).alias("recent_papers"), F.nullif(ordered("COMPARISON"), F.lit("")).alias("comparison_papers")
    )
    return one(rows).select("entity_type", "entity_id", "trend_score").join(found, ["entity_type", "entity_id"], "left")


@query(
    "evidence_counts",
    f"""SELECT t.entity_type, t.entity_id, count(*) FILTER (WHERE role = 'RECENT') AS recent_evidence, count(*) FILTER (WHERE role = 'COMPARISON') AS comparison_evidence
    FROM counts t LEFT JOIN ({EVIDENCE}) e ON e.entity_type = t.entity_type AND e.entity_id = t.entity_id GROUP BY ALL""",
)
def _(spark, d):
    rows, proof = scores(spark, d)
    counted = proof.groupBy("entity_type", "entity_id").pivot("role", ["RECENT", "COMPARISON"]).count()
    joined = rows.select("entity_type", "entity_id").join(counted, ["entity_type", "entity_id"], "left").fillna(0, ["RECENT", "COMPARISON"])
    return joined.withColumnsRenamed({"RECENT": "recent_evidence", "COMPARISON": "comparison_evidence"})


@query("class_counts", "SELECT entity_type, trend_class, count(*) AS n FROM trend GROUP BY ALL")
def _(spark, d):
    return scores(spark, d)[0].groupBy("entity_type", "trend_class").agg(F.count("*").alias("n"))


@query("quality_counts", "SELECT coalesce(entity_type, 'all') AS entity_type, data_quality, count(*) AS n FROM trend GROUP BY GROUPING SETS ((entity_type, data_quality), (data_quality))")
def _(spark, d):
    rows = scores(spark, d)[0].groupingSets([["entity_type", "data_quality"], ["data_quality"]], "entity_type", "data_quality").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("entity_type", F.lit("all")).alias("entity_type"), "data_quality", "n")


@query(
    "class_distribution",
    """SELECT place, c.name AS trend_class, n FROM (VALUES (1, 'Emerging'), (2, 'Accelerating'), (3, 'Consistently Active'), (4, 'Stable'), (5, 'Cooling'), (6, 'Insufficient Data')) c(place, name)
    JOIN (SELECT trend_class, count(*) AS n FROM trend GROUP BY ALL) t ON t.trend_class = c.name""",
)
def _(spark, d):
    order = ["Emerging", "Accelerating", "Consistently Active", "Stable", "Cooling", "Insufficient Data"]
    counted = scores(spark, d)[0].groupBy("trend_class").agg(F.count("*").alias("n"))
    place = F.array_position(F.lit(order), F.col("trend_class")).cast("int")
    return counted.select(place.alias("place"), "trend_class", "n")


@query(
    "trend_overview",
    """SELECT 'entities' AS section, entity_type, NULL AS item, NULL AS place, count(*) AS value FROM trend GROUP BY entity_type
    UNION ALL SELECT 'classes', entity_type, trend_class, NULL, count(*) FROM trend GROUP BY ALL
    UNION ALL SELECT 'qualities', entity_type, data_quality, NULL, count(*) FROM trend GROUP BY ALL
    UNION ALL SELECT 'top', entity_type, trend_class || ': ' || entity_name, r, trend_score FROM (SELECT *, row_number() OVER (PARTITION BY trend_class ORDER BY trend_score DESC NULLS LAST, entity_name, entity_id) AS r
        FROM (SELECT t.*, coalesce(n.entity_name, t.entity_id) AS entity_name FROM trend t LEFT JOIN names n USING (entity_type, entity_id)) WHERE trend_class IN ('Emerging', 'Stable', 'Cooling')) WHERE r <= 5
    UNION ALL SELECT 'message', NULL, 'Historical Cohort Comparison: papers of ' || strftime(comparison_start, '%Y-%m-%d') || ' to ' || strftime(comparison_end - 1, '%Y-%m-%d')
        || ' against papers of ' || strftime(recent_start, '%Y-%m-%d') || ' to ' || strftime(recent_end - 1, '%Y-%m-%d') || '.', NULL, (SELECT count(*) FROM trend) FROM cohorts""",
)
def _(spark, d):
    return O.overview(scores(spark, d)[0], W.entity_names(spark, d), O.cohort_windows(W.cohort_papers(spark, d)))


@query(
    "history_trends",
    """WITH m AS (SELECT 'group' AS entity_type, CAST(o_custkey % 150 AS VARCHAR) AS entity_id, o_orderdate AS published FROM orders
        UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT *, floor(date_diff('day', DATE '2000-10-06', CAST(published AS DATE)) / 60.0) AS w FROM m),
    q AS (SELECT * FROM p WHERE w BETWEEN 0 AND 4 AND (CAST(entity_id AS BIGINT) % 5 <> 0 OR w >= 3)),
    c AS (SELECT entity_type, entity_id, count(*) FILTER (WHERE w = 0) AS n0, count(*) FILTER (WHERE w = 1) AS n1, count(*) FILTER (WHERE w = 2) AS n2, count(*) FILTER (WHERE w = 3) AS n3,
        count(*) FILTER (WHERE w = 4) AS n4, count(DISTINCT CASE WHEN w = 4 THEN CAST(published AS DATE) END) AS distinct_days FROM q GROUP BY ALL),
    r AS (SELECT *, n3 + n4 AS total_papers, CASE WHEN n1 > 0 THEN (n2 - n1) / CAST(n1 AS DOUBLE) WHEN n2 = 0 THEN 0.0 END AS r2,
        CASE WHEN n2 > 0 THEN (n3 - n2) / CAST(n2 AS DOUBLE) WHEN n3 = 0 THEN 0.0 END AS r3, CASE WHEN n3 > 0 THEN (n4 - n3) / CAST(n3 AS DOUBLE) WHEN n4 = 0 THEN 0.0 END AS rate,
        CAST(n0 > 0 AS INTEGER) + CAST(n1 > 0 AS INTEGER) + CAST(n2 > 0 AS INTEGER) + CAST(n3 > 0 AS INTEGER) + CAST(n4 > 0 AS INTEGER) AS active FROM c),
    s AS (SELECT *, CASE WHEN r2 IS NOT NULL AND r3 IS NOT NULL AND rate IS NOT NULL THEN r2 < r3 AND r3 < rate END AS acceleration FROM r)
    SELECT entity_type, entity_id, concat_ws(',', n0, n1, n2, n3, n4) AS counts, round(rate, 6) AS growth_rate, acceleration, active / 5.0 AS consistency,
    CASE WHEN total_papers < 5 THEN 'Insufficient Data' WHEN n3 = 0 AND n4 >= 3 THEN 'Emerging' WHEN rate > 0.20 AND acceleration AND n3 >= 3 THEN 'Accelerating'
        WHEN active / 5.0 >= 0.75 AND (rate IS NULL OR rate BETWEEN -0.10 AND 0.20) THEN 'Consistently Active' WHEN rate BETWEEN -0.10 AND 0.10 AND n3 >= 3 THEN 'Stable'
        WHEN rate < -0.20 AND n3 >= 3 THEN 'Cooling' ELSE 'Insufficient Data' END AS trend_class,
    CASE WHEN total_papers < 5 THEN 'INSUFFICIENT' WHEN n3 < 3 OR least(distinct_days, 60) / 60.0 < 0.10 THEN 'LOW' WHEN active >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS data_quality FROM s""",
)
def _(spark, d):
    """Orders by group of customers and by nation in five windows of 60 days; the history of every fifth entity begins in the last two."""
    from datetime import date

    orders = W.table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("published"))
    customers = W.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    groups = orders.select(F.lit("group").alias("entity_type"), (F.col("o_custkey") % 150).cast("string").alias("entity_id"), "published")
    nations = orders.join(customers, "o_custkey").select(F.lit("nation").alias("entity_type"), F.col("c_nationkey").cast("string").alias("entity_id"), "published")
    late = (F.col("entity_id").cast("long") % 5 != 0) | (F.to_date("published") >= F.lit(date(2001, 4, 4)))
    rows = O.history_trends(groups.unionByName(nations).filter(late), date(2001, 8, 2), 60, 5)
    return rows.select(
        "entity_type", "entity_id", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"), r6("growth_rate"), "acceleration", "consistency", "trend_class", "data_quality"
    )
