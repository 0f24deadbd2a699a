"""Queries F1-F26: clusters, profiles and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.functions.text import short_abstract
from corpuslens.operators import clusters as C
from corpuslens.operators.clusters import STOP_WORDS
from corpuslens.plans.registry import query
from corpuslens.sources import views as W

DISTRIBUTION = """SELECT cluster_id, category_code, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cluster_id), 1) AS percent
    FROM clustered WHERE NOT is_noise GROUP BY cluster_id, category_code"""
DOMINANT = f"SELECT cluster_id, category_code AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, category_code) AS r FROM ({DISTRIBUTION})) WHERE r = 1"
SIZES = "SELECT cluster_id, count(*) AS papers, (20000 * sum(CAST(round(membership * 1e9) AS BIGINT)) + 1000000000 * count(*)) // (2000000000 * count(*)) / 10000.0 AS average_membership FROM clustered WHERE NOT is_noise GROUP BY cluster_id"
CLUSTERS = f"""SELECT l.*, coalesce(s.papers, 0) AS papers, s.average_membership, x.dominant FROM cluster_labels l
    LEFT JOIN ({SIZES}) s ON s.cluster_id = l.cluster_id LEFT JOIN ({DOMINANT}) x ON x.cluster_id = l.cluster_id WHERE review_status = 'APPROVED'"""
NEAREST = """SELECT cluster_id, paper_id, distance, row_number() OVER (PARTITION BY cluster_id ORDER BY round(distance, 9), paper_id) AS rank FROM (
    SELECT k.cluster_id, k.paper_id, sqrt(pow(coords[1] - c1, 2) + pow(coords[2] - c2, 2) + pow(coords[3] - c3, 2) + pow(coords[4] - c4, 2) + pow(coords[5] - c5, 2)) AS distance
    FROM (SELECT cluster_id, paper_id, CAST(coords AS DOUBLE[]) AS coords FROM clustered WHERE NOT is_noise) k JOIN (SELECT cluster_id, avg(CAST(coords[1] AS DOUBLE)) AS c1, avg(CAST(coords[2] AS DOUBLE)) AS c2,
    avg(CAST(coords[3] AS DOUBLE)) AS c3, avg(CAST(coords[4] AS DOUBLE)) AS c4, avg(CAST(coords[5] AS DOUBLE)) AS c5 FROM clustered WHERE NOT is_noise GROUP BY cluster_id) m ON k.cluster_id = m.cluster_id)"""
WORDS = f"""SELECT cluster_id, word, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, word) AS rank FROM (
    SELECT k.cluster_id, trim(w, '()[]{{}}"''') AS word FROM clustered k JOIN papers p USING (paper_id),
    unnest(regexp_split_to_array(translate(lower(p.title || ' ' || p.abstract), ',.:', '   '), '\\s+')) t(w) WHERE NOT k.is_noise)
    WHERE length(word) > 2 AND word NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}) GROUP BY cluster_id, word"""


@query("cluster_input", "SELECT paper_id, CAST(len(embedding) AS BIGINT) AS dimension FROM active ORDER BY paper_id")
def _(spark, d):
    return W.active(spark, d).select("paper_id", F.size("embedding").cast("long").alias("dimension")).orderBy("paper_id")


@query(
    "assignment_rows",
    """SELECT paper_id, cluster_id, CAST(membership AS DOUBLE) AS membership, is_noise, (is_noise = (cluster_id IS NULL)) AND membership BETWEEN 0 AND 1
    AND len(list_filter(coords, lambda x: isnan(x) OR isinf(x))) = 0 AS sound FROM assignments""",
)
def _(spark, d):
    infinite = F.exists("coords", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    sound = (F.col("is_noise") == F.col("cluster_id").isNull()) & F.col("membership").between(0, 1) & ~infinite
    return W.assignments(spark, d).select("paper_id", "cluster_id", "membership", "is_noise", sound.alias("sound"))


@query(
    "clustering_run_row",
    """SELECT sha256('run-1' || count(*)) AS run_id, count(*) AS papers, count(DISTINCT cluster_id) AS clusters, count(*) FILTER (WHERE is_noise) AS noise,
    round(100.0 * count(*) FILTER (WHERE is_noise) / count(*), 1) AS noise_percent, 'SUCCEEDED' AS status FROM clustered""",
)
def _(spark, d):
    rows = W.clustered(spark, d).agg(F.count("*").alias("papers"), F.count_distinct("cluster_id").alias("clusters"), F.count_if("is_noise").alias("noise"))
    return rows.select(
        F.sha2(F.concat(F.lit("run-1"), F.col("papers").cast("string")), 256).alias("run_id"), "papers", "clusters", "noise",
        F.round(100.0 * F.col("noise") / F.nullif("papers", F.lit(0)), 1).alias("noise_percent"), F.lit("SUCCEEDED").alias("status"),
    )


@query("representatives", f"SELECT cluster_id, paper_id, round(distance, 6) AS distance, rank FROM ({NEAREST}) WHERE rank <= 3")
def _(spark, d):
    return C.representatives(W.clustered(spark, d)).withColumn("distance", F.round("distance", 6))


@query("category_distribution", DISTRIBUTION)
def _(spark, d):
    return C.category_distribution(W.clustered(spark, d))


@query("dominant_category", DOMINANT)
def _(spark, d):
    return C.dominant_category(W.clustered(spark, d))


@query("cluster_keywords", f"SELECT cluster_id, word, n, rank FROM ({WORDS}) WHERE rank <= 8")
def _(spark, d):
    return C.keywords(W.clustered(spark, d))


@query(
    "cluster_report",
    f"""SELECT s.*, (SELECT string_agg(word, ',' ORDER BY rank) FROM ({WORDS}) w WHERE w.cluster_id = s.cluster_id AND rank <= 8) AS keywords,
    (SELECT string_agg(paper_id, ',' ORDER BY rank) FROM ({NEAREST}) r WHERE r.cluster_id = s.cluster_id AND rank <= 3) AS representatives,
    (SELECT string_agg(category_code || ':' || n, ',' ORDER BY n DESC, category_code) FROM ({DISTRIBUTION}) c WHERE c.cluster_id = s.cluster_id) AS mix FROM ({SIZES}) s""",
)
def _(spark, d):
    rows = W.clustered(spark, d)
    listed = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.cast("string").alias("v")))), lambda x: x["v"]), ",")
    words = C.keywords(rows).groupBy("cluster_id").agg(listed(F.col("rank"), F.col("word")).alias("keywords"))
    near = C.representatives(rows).groupBy("cluster_id").agg(listed(F.col("rank"), F.col("paper_id")).alias("representatives"))
    mix = C.category_distribution(rows).groupBy("cluster_id").agg(
        listed(F.struct(-F.col("n"), F.col("category_code")), F.concat("category_code", F.lit(":"), F.col("n").cast("string"))).alias("mix")
    )
    return C.cluster_sizes(rows).join(words, "cluster_id").join(near, "cluster_id").join(mix, "cluster_id")


@query("list_clusters", f"SELECT cluster_id, cluster_name, papers, average_membership, dominant FROM ({CLUSTERS})")
def _(spark, d):
    return C.list_clusters(W.clustered(spark, d), W.cluster_labels(spark)).select("cluster_id", "cluster_name", "papers", "average_membership", "dominant")


@query(
    "cluster_detail",
    f"""SELECT c.cluster_id, c.cluster_name, c.keywords, c.papers, c.dominant, (SELECT string_agg(category_code || ':' || percent, ',' ORDER BY n DESC, category_code) FROM ({DISTRIBUTION}) x WHERE x.cluster_id = 1) AS mix,
    (SELECT string_agg(paper_id, ',' ORDER BY rank) FROM ({NEAREST}) r WHERE r.cluster_id = 1 AND rank <= 3) AS representatives FROM ({CLUSTERS}) c WHERE c.cluster_id = 1""",
)
def _(spark, d):
    rows = W.clustered(spark, d).filter("cluster_id = 1")
    one = C.list_clusters(rows, W.cluster_labels(spark).filter("cluster_id = 1"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category_code", "percent")))
    mix = C.category_distribution(rows).groupBy("cluster_id").agg(
        F.array_join(F.transform(ordered, lambda x: F.concat(x["category_code"], F.lit(":"), x["percent"].cast("string"))), ",").alias("mix")
    )
    near = C.representatives(rows).groupBy("cluster_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))), lambda x: x["paper_id"].cast("string")), ",").alias("representatives")
    )
    return one.join(mix, "cluster_id").join(near, "cluster_id").select("cluster_id", "cluster_name", "keywords", "papers", "dominant", "mix", "representatives")


def page(name, where, category=None):
    extra = f"AND category_code = '{category}'" if category else ""

    @query(
        name,
        f"""SELECT paper_id, arxiv_id, CAST(membership AS DOUBLE) AS membership, (SELECT count(*) FROM clustered WHERE {where} {extra}) AS total
        FROM clustered WHERE {where} {extra} ORDER BY membership DESC, arxiv_id LIMIT 10 OFFSET 2""",
    )
    def _(spark, d):
        return C.papers_page(W.clustered(spark, d).filter(where), category, limit=10, offset=2).select("paper_id", "arxiv_id", "membership", "total")


page("cluster_papers", "cluster_id = 2 AND membership >= 0.6")
page("noise_papers", "is_noise")
page("cluster_papers_category", "NOT is_noise", "src1")


@query(
    "latest_run",
    """SELECT kind, run_id, strftime(completed_at, '%Y-%m-%d') AS completed FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY completed_at DESC, run_id DESC) AS r
    FROM runs WHERE status = 'SUCCEEDED') WHERE r = 1""",
)
def _(spark, d):
    return C.latest_runs(W.runs(spark, d)).select("kind", "run_id", W.day("completed_at").alias("completed"))


HEAD = "substr(abstract, 1, 500)"
DOT = f"strpos(reverse({HEAD}), ' .')"
BLANK = f"500 - strpos(reverse({HEAD}), ' ')"
SHORT = f"""CASE WHEN length(abstract) <= 500 THEN abstract WHEN {DOT} > 0 AND 499 - {DOT} > 250 THEN substr({HEAD}, 1, 500 - {DOT}) || '..'
    WHEN {BLANK} > 0 AND {BLANK} < 500 THEN substr({HEAD}, 1, {BLANK}) || '...' ELSE {HEAD} || '...' END"""


@query("truncate_abstract", f"SELECT paper_id, sha256({SHORT}) AS digest, CAST(length({SHORT}) AS BIGINT) AS chars FROM papers")
def _(spark, d):
    short = short_abstract(F.col("abstract"))
    return W.papers(spark, d).select("paper_id", F.sha2(short, 256).alias("digest"), F.length(short).cast("long").alias("chars"))


@query(
    "coherence_notes",
    f"""SELECT s.cluster_id, nullif(concat_ws('; ', CASE WHEN average_membership < 0.8 THEN 'low average membership' END,
    CASE WHEN n >= 3 AND top < 60 THEN 'mixed categories' END), '') AS notes FROM ({SIZES}) s
    JOIN (SELECT cluster_id, count(*) AS n, max(percent) AS top FROM ({DISTRIBUTION}) GROUP BY cluster_id) x USING (cluster_id)""",
)
def _(spark, d):
    rows = W.clustered(spark, d)
    mix = C.category_distribution(rows).groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("percent").alias("top"))
    notes = C.coherence_notes(F.col("average_membership"), F.col("n"), F.col("top"))
    return C.cluster_sizes(rows).join(mix, "cluster_id").select("cluster_id", notes.alias("notes"))


@query("label_inputs")
def _(spark, d):
    """The hash is of Spark's JSON text, which SQL elsewhere doesn't spell alike; tests hold the parts."""
    return C.label_inputs(W.clustered(spark, d)).select("cluster_id", "papers", "average_membership", "coherence_notes", "input_hash")


PLANNED = f"SELECT cluster_id, CASE WHEN cluster_id % 3 = 0 THEN 'CACHED' ELSE 'GENERATE' END AS action FROM ({SIZES})"


def label_plan(spark, d):
    """Stored labels: every third cluster's of the same input, another third's of an older one."""
    inputs = C.label_inputs(W.clustered(spark, d)).select("cluster_id", "input_hash")
    stored = inputs.filter("cluster_id % 3 < 2").select(
        "cluster_id", F.when(F.col("cluster_id") % 3 == 0, F.col("input_hash")).otherwise("older").alias("input_hash"), F.lit("SUCCEEDED").alias("status")
    )
    return C.label_plan(inputs, stored)


query("label_plan", PLANNED)(label_plan)
VALIDATED = """SELECT cluster_id, CASE WHEN cluster_id % 4 = 3 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE cluster_id % 4 WHEN 0 THEN 'primary' WHEN 3 THEN NULL ELSE 'fallback' END AS used,
    CASE WHEN cluster_id % 4 < 3 THEN 'Group ' || cluster_id END AS cluster_name, CASE WHEN cluster_id % 4 < 3 THEN 0.9 END AS confidence
    FROM (SELECT DISTINCT cluster_id FROM clustered WHERE NOT is_noise)"""


def label_validate(spark, d):
    """Responses made from the clusters: good ones (without keywords), a confidence out of range, a paper of the cluster that isn't
    among the representatives supplied, and none that is valid."""
    near = C.representatives(W.clustered(spark, d), 4)
    first = near.groupBy("cluster_id").agg(F.min_by("paper_id", "rank").alias("paper_id"), F.max(F.when(F.col("rank") == 4, F.col("paper_id"))).alias("fourth"))
    responses = first.withColumn("provider", F.explode(F.array(F.lit("primary"), F.lit("fallback"))))
    kind, primary = F.col("cluster_id") % 4, F.col("provider") == "primary"
    confidence = F.when((kind == 1) & primary | (kind == 3), 1.5).otherwise(0.9)
    cited = F.when((kind == 2) & primary, F.coalesce("fourth", F.lit(-1))).otherwise(F.col("paper_id"))
    body = F.to_json(
        F.struct(
            F.concat(F.lit("Group "), F.col("cluster_id").cast("string")).alias("cluster_name"), F.lit("About it").alias("short_description"),
            F.when(kind == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("k"))).alias("keywords"), confidence.alias("confidence"), F.array(F.struct(cited.alias("paper_id"), F.lit("fits").alias("reason"))).alias("evidence"),
        )
    )
    return C.label_validate(responses.select("cluster_id", "provider", body.alias("body")), near.filter("rank <= 3"))


query("label_validate", VALIDATED)(label_validate)


@query(
    "label_upsert",
    f"""SELECT 'run-1' AS run_id, v.cluster_id, provider, CASE WHEN fresh THEN v.status ELSE 'SUCCEEDED' END AS generation_status,
    CASE WHEN fresh THEN v.cluster_name ELSE 'Old ' || v.cluster_id END AS cluster_name, CASE WHEN fresh THEN 'PENDING_REVIEW' ELSE 'APPROVED' END AS review_status
    FROM (SELECT v.*, p.action FROM ({VALIDATED}) v JOIN ({PLANNED}) p USING (cluster_id)) v,
    LATERAL (SELECT 'primary' AS provider, v.used = 'primary' AND action = 'GENERATE' AS fresh UNION ALL SELECT 'fallback', true WHERE v.used = 'fallback' AND action = 'GENERATE') x""",
)
def _(spark, d):
    """Every cluster has an approved label of the primary provider; those to generate get a new one of the provider that served, in its place or beside it."""
    made = label_validate(spark, d).join(label_plan(spark, d).filter("action = 'GENERATE'"), "cluster_id").filter("used IS NOT NULL")
    fixed = [F.lit(v).alias(n) for n, v in (("run_id", "run-1"), ("model", "m"), ("model_version", "1"), ("prompt_version", "p1"))]
    incoming = made.select(*fixed, "cluster_id", F.col("used").alias("provider"), F.col("status").alias("generation_status"), "cluster_name")
    ids = W.clustered(spark, d).filter("NOT is_noise").select("cluster_id").distinct()
    old = F.concat(F.lit("Old "), F.col("cluster_id").cast("string"))
    stored = ids.select(*fixed, "cluster_id", F.lit("primary").alias("provider"), F.lit("SUCCEEDED").alias("generation_status"), old.alias("cluster_name"), F.lit("APPROVED").alias("review_status"))
    return C.label_upsert(stored, incoming).select("run_id", "cluster_id", "provider", "generation_status", "cluster_name", "review_status")


@query(
    "label_summary",
    f"""SELECT count(*) AS attempted, count(*) FILTER (WHERE action = 'GENERATE' AND status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE action = 'CACHED') AS cached,
    count(*) FILTER (WHERE action = 'GENERATE' AND status = 'FAILED') AS failed FROM ({PLANNED}) p JOIN ({VALIDATED}) v USING (cluster_id)""",
)
def _(spark, d):
    return C.label_summary(label_plan(spark, d), label_validate(spark, d))


@query("cluster_discovery", f"SELECT cluster_id, cluster_name, papers, dominant FROM ({CLUSTERS}) WHERE contains(lower(concat_ws(' ', cluster_name, short_description, dominant, keywords)), 'area1')")
def _(spark, d):
    rows = C.list_clusters(W.clustered(spark, d), W.cluster_labels(spark))
    return C.cluster_discovery(rows, "Area1", sort="name_asc").select("cluster_id", "cluster_name", "papers", "dominant")


@query("cluster_category_options", f"SELECT DISTINCT dominant FROM ({CLUSTERS}) WHERE dominant IS NOT NULL")
def _(spark, d):
    rows = C.list_clusters(W.clustered(spark, d), W.cluster_labels(spark))
    return rows.select("dominant").filter("dominant IS NOT NULL").distinct().orderBy("dominant")


@query(
    "cluster_size_chart",
    f"""SELECT row_number() OVER (ORDER BY papers DESC, cluster_id) AS place, symbol, cluster_name AS name, papers FROM
    (SELECT *, 'C' || lpad(CAST(row_number() OVER (ORDER BY cluster_id) AS VARCHAR), 2, '0') AS symbol FROM ({CLUSTERS}) ORDER BY papers DESC, cluster_id LIMIT 6)
    UNION ALL SELECT 7, NULL, 'Unclustered', count(*) FROM clustered WHERE is_noise""",
)
def _(spark, d):
    rows = W.clustered(spark, d)
    return C.size_chart(C.list_clusters(rows, W.cluster_labels(spark)), rows.filter("is_noise"))


@query(
    "lead_representatives",
    f"""SELECT DISTINCT r.paper_id FROM ({NEAREST}) r JOIN (SELECT cluster_id FROM ({CLUSTERS}) ORDER BY papers DESC, cluster_id LIMIT 2) t USING (cluster_id) WHERE rank <= 3""",
)
def _(spark, d):
    rows = W.clustered(spark, d)
    top = C.list_clusters(rows, W.cluster_labels(spark)).limit(2).select("cluster_id")
    return C.representatives(rows).join(top, "cluster_id", "left_semi").select("paper_id").dropDuplicates(["paper_id"])


@query(
    "label_evidence_titles",
    f"""SELECT e.cluster_id, e.paper_id, c.title FROM (SELECT cluster_id, min(paper_id) AS paper_id FROM clustered WHERE NOT is_noise GROUP BY cluster_id
    UNION ALL SELECT cluster_id, paper_id FROM ({NEAREST}) WHERE rank = 1) e LEFT JOIN (SELECT r.cluster_id, r.paper_id, c.title FROM ({NEAREST}) r JOIN clustered c USING (paper_id) WHERE rank <= 3) c
    ON c.cluster_id = e.cluster_id AND c.paper_id = e.paper_id""",
)
def _(spark, d):
    """Cited: each cluster's first paper and its nearest one; titles of those that are representatives."""
    rows = W.clustered(spark, d)
    near = C.representatives(rows)
    cited = rows.filter("NOT is_noise").groupBy("cluster_id").agg(F.min("paper_id").alias("paper_id")).unionByName(near.filter("rank = 1").select("cluster_id", "paper_id"))
    titled = near.select("cluster_id", "paper_id").join(rows.select("paper_id", "title"), "paper_id")
    return cited.join(titled, ["cluster_id", "paper_id"], "left").select("cluster_id", "paper_id", "title")
