"""Clusters: assignments, profiles and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import vector as V
from corpuslens.functions.text import short_abstract

#: Words left out of cluster keywords.
STOP_WORDS = (
    "the", "a", "an", "of", "and", "to", "in", "for", "on", "with", "is", "are",
    "we", "this", "that", "by", "as", "our", "be", "can", "using", "from",
    "these", "which", "it", "its", "at", "or", "such", "based", "propose", "paper",
)


def representatives(clustered: DataFrame, n: int = 3) -> DataFrame:
    """(cluster_id, paper_id, distance, rank): the ``n`` papers nearest to the centroid of their cluster's coordinates.

    The centroid is averaged per dimension, so no cluster is gathered in one row.
    """
    own = clustered.filter("NOT is_noise").select("cluster_id", "paper_id", "coords")
    axes = own.select("cluster_id", F.posexplode("coords").alias("axis", "x")).groupBy("cluster_id", "axis").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroid = axes.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("axis", "x"))).alias("c"))
    rows = own.join(centroid, "cluster_id")
    gap = F.zip_with("coords", F.transform("c", lambda a: a["x"]), lambda a, b: a.cast("double") - b)
    rows = rows.withColumn("distance", F.sqrt(V.dot(gap, gap)))
    order = Window.partitionBy("cluster_id").orderBy(F.round("distance", 9), "paper_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n).select("cluster_id", "paper_id", "distance", "rank")


def category_distribution(clustered: DataFrame) -> DataFrame:
    """(cluster_id, category_code, n, percent)."""
    counted = clustered.filter("NOT is_noise").groupBy("cluster_id", "category_code").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("cluster_id"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / whole, 1))


def dominant_category(clustered: DataFrame) -> DataFrame:
    """(cluster_id, dominant): the most frequent category; ties to the smaller code."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "category_code")
    ranked = category_distribution(clustered).withColumn("r", F.row_number().over(order))
    return ranked.filter("r = 1").select("cluster_id", F.col("category_code").alias("dominant"))


def keywords(clustered: DataFrame, n: int = 8) -> DataFrame:
    """(cluster_id, word, n, rank): the most frequent words of titles and abstracts; ties to the smaller word."""
    text = F.translate(F.lower(F.concat_ws(" ", "title", "abstract")), ",.:", "   ")
    words = clustered.filter("NOT is_noise").select("cluster_id", F.explode(F.split(text, r"\s+")).alias("word"))
    bare = words.select("cluster_id", F.regexp_replace("word", "^[()\\[\\]{}\"']+|[()\\[\\]{}\"']+$", "").alias("word"))
    counted = bare.filter((F.length("word") > 2) & ~F.col("word").isin(*STOP_WORDS)).groupBy("cluster_id", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "word")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def average(c: Column) -> Column:
    """The mean, rounded half up to 4 places. Decimals are summed, so that no order of summing changes it."""
    return F.round(F.sum(c.cast("decimal(18,9)")) / F.count(c), 4).cast("double")


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.filter("NOT is_noise").groupBy("cluster_id").agg(F.count("*").alias("papers"), average(F.col("membership")).alias("average_membership"))


def list_clusters(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    """Approved labels with size, membership and dominant category, largest first."""
    rows = labels.filter("review_status = 'APPROVED'").join(cluster_sizes(clustered), "cluster_id", "left").join(dominant_category(clustered), "cluster_id", "left")
    return rows.withColumn("papers", F.coalesce("papers", F.lit(0).cast("long"))).orderBy(F.desc("papers"), "cluster_id")


def papers_page(rows: DataFrame, category: str | None = None, min_membership: float | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of cluster or noise papers with ``total``, the number before the limit."""
    if category is not None:
        rows = rows.filter(F.col("category_code") == category)
    if min_membership is not None:
        rows = rows.filter(F.col("membership") >= min_membership)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("membership"), "arxiv_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def coherence_notes(average: Column, categories: Column, top_percent: Column) -> Column:
    """What speaks against a cluster, else null."""
    notes = F.concat_ws(
        "; ",
        F.when(average < 0.8, F.lit("low average membership")),
        F.when((categories >= 3) & (top_percent < 60), F.lit("mixed categories")),
    )
    return F.nullif(notes, F.lit(""))


def label_inputs(clustered: DataFrame, n: int = 3) -> DataFrame:
    """One row per cluster: a JSON summary for labelling and its hash."""
    words = keywords(clustered).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("top_keywords"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "category_code", "n", "percent")))
    mix = category_distribution(clustered).groupBy("cluster_id").agg(
        F.transform(order, lambda x: F.struct(x["category_code"].alias("code"), x["n"].alias("n"), x["percent"].alias("percent"))).alias("category_distribution")
    )
    texts = clustered.select("paper_id", "title", short_abstract(F.col("abstract")).alias("abstract"))
    near = representatives(clustered, n).join(texts, "paper_id").groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id", "title", "abstract"))), lambda x: F.struct(x["paper_id"].alias("paper_id"), x["title"].alias("title"), x["abstract"].alias("abstract"))).alias("representative_papers")
    )
    rows = cluster_sizes(clustered).join(words, "cluster_id").join(mix, "cluster_id").join(near, "cluster_id")
    notes = coherence_notes(F.col("average_membership"), F.size("category_distribution"), F.col("category_distribution")[0]["percent"])
    rows = rows.withColumn("coherence_notes", notes)
    return rows.withColumn("input_json", F.to_json(F.struct(*[c for c in rows.columns]))).withColumn("input_hash", F.sha2("input_json", 256))


def label_plan(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """(cluster_id, action): CACHED where a label of the same input succeeded, else GENERATE."""
    known = stored.filter("status = 'SUCCEEDED'").select("cluster_id", "input_hash").distinct().withColumn("known", F.lit(True))
    return inputs.join(known, ["cluster_id", "input_hash"], "left").select("cluster_id", F.when(F.col("known"), "CACHED").otherwise("GENERATE").alias("action"))


RESPONSE = "cluster_name string, short_description string, keywords array<string>, confidence double, evidence array<struct<paper_id:long,reason:string>>"


def label_validate(responses: DataFrame, allowed: DataFrame) -> DataFrame:
    """(cluster_id, status, used, cluster_name, confidence): the primary response if valid, else the fallback, else FAILED.

    ``responses``: cluster_id, provider (primary or fallback), body (JSON). ``allowed``: cluster_id, paper_id of the
    representatives that the labeller was given; a response that cites any other paper is not valid. Keywords and evidence may be empty lists, not absent;
    name and description may not be empty.
    """
    r = responses.select("cluster_id", "provider", F.explode(F.array(F.from_json("body", RESPONSE))).alias("r"))  # parsed once
    cited = r.select("cluster_id", "provider", F.explode("r.evidence").alias("e")).select("cluster_id", "provider", F.col("e.paper_id").alias("paper_id"))
    invented = cited.join(allowed.select("cluster_id", "paper_id"), ["cluster_id", "paper_id"], "left_anti").select("cluster_id", "provider").distinct()
    text = lambda c: F.length(F.col(c)) > 0
    whole = F.forall("r.evidence", lambda e: e["paper_id"].isNotNull() & e["reason"].isNotNull()) & F.forall("r.keywords", lambda k: k.isNotNull())
    valid = text("r.cluster_name") & text("r.short_description") & F.col("r.confidence").between(0, 1) & whole
    best = F.min_by(F.struct("provider", "r.cluster_name", "r.confidence"), F.when(F.col("provider") == "primary", 0).otherwise(1))
    good = r.filter(F.coalesce(valid, F.lit(False))).join(invented, ["cluster_id", "provider"], "left_anti").groupBy("cluster_id").agg(best.alias("b"))
    rows = responses.select("cluster_id").distinct().join(good, "cluster_id", "left")
    return rows.select(
        "cluster_id", F.when(F.col("b").isNull(), "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.col("b.provider").alias("used"), F.col("b.cluster_name").alias("cluster_name"), F.col("b.confidence").alias("confidence"),
    )


LABEL_KEY = ["run_id", "cluster_id", "provider", "model", "model_version", "prompt_version"]


def label_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored labels after a generation: one row per LABEL_KEY. A label that is made anew takes the place of
    the old one and waits for review again, whatever the old one's review said; others stay."""
    fresh = incoming.withColumn("review_status", F.lit("PENDING_REVIEW")).dropDuplicates(LABEL_KEY)
    return stored.join(fresh.select(*LABEL_KEY), LABEL_KEY, "left_anti").unionByName(fresh)


def label_summary(plan: DataFrame, validated: DataFrame) -> DataFrame:
    """One row: clusters attempted, cached, and of those to generate succeeded and failed (no response counts as failed)."""
    rows = plan.join(validated.select("cluster_id", "status"), "cluster_id", "left")
    fresh, good = F.col("action") == "GENERATE", F.coalesce(F.col("status") == "SUCCEEDED", F.lit(False))
    return rows.agg(
        F.count("*").alias("attempted"), F.count_if(fresh & good).alias("succeeded"), F.count_if(F.col("action") == "CACHED").alias("cached"), F.count_if(fresh & ~good).alias("failed")
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest succeeded run of each kind; ties to the larger id."""
    newest = runs.filter("status = 'SUCCEEDED'").groupBy("kind").agg(F.max_by(F.struct("run_id", "completed_at"), F.struct("completed_at", "run_id")).alias("x"))
    return newest.select("kind", "x.run_id", "x.completed_at")


SORTS = {
    "papers_desc": lambda: [F.desc("papers"), F.asc("cluster_id")],
    "papers_asc": lambda: [F.asc("papers"), F.asc("cluster_id")],
    "name_asc": lambda: [F.asc("cluster_name"), F.asc("cluster_id")],
    "name_desc": lambda: [F.desc("cluster_name"), F.asc("cluster_id")],
    "membership_desc": lambda: [F.desc_nulls_last("average_membership"), F.asc("cluster_id")],
}


def cluster_discovery(clusters: DataFrame, text: str = "", category: str | None = None, sort: str = "papers_desc") -> DataFrame:
    """Clusters whose name, description, category or keywords hold ``text``."""
    whole = F.lower(F.concat_ws(" ", "cluster_name", "short_description", "dominant", "keywords"))
    rows = clusters.filter(F.contains(whole, F.lit(text.strip().lower())))
    if category is not None:
        rows = rows.filter(F.col("dominant") == category)
    return rows.orderBy(*SORTS[sort]())


def size_chart(sizes: DataFrame, unclustered: DataFrame, n: int = 6) -> DataFrame:
    """(place, symbol, name, papers): the ``n`` largest clusters and a last row for papers without one."""
    symbol = F.concat(F.lit("C"), F.lpad(F.row_number().over(Window.orderBy("cluster_id")).cast("string"), 2, "0"))
    top = sizes.withColumn("symbol", symbol).orderBy(F.desc("papers"), "cluster_id").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("papers"), "cluster_id")).cast("long")
    rows = top.select(place.alias("place"), "symbol", F.col("cluster_name").alias("name"), "papers")
    rest = unclustered.agg(F.count("*").alias("papers")).select(F.lit(n + 1).cast("long").alias("place"), F.lit(None).cast("string").alias("symbol"), F.lit("Unclustered").alias("name"), "papers")
    return rows.unionByName(rest)
