"""The corpus views: papers, versions, authors, embeddings and clusters over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import normalize_text

MODEL_VERSION = "v1"
NOW = "2001-08-10"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are orders. The canonical paper of equal texts has the smallest id; texts meet by hash, null ones too. A doc_id is one document."""
    docs = table(spark, d, "documents")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    hashed = docs.select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("hash")).join(orders, "doc_id")
    firsts = hashed.groupBy("hash").agg(F.min("doc_id").alias("keeper"))
    keyed = hashed.join(firsts, "hash").select("doc_id", "o_orderdate", "keeper")  # ids and dates only; texts join last
    title = F.substring(normalize_text(F.col("text")), 1, 60)  # before the join, so that the texts of queries on titles alone don't move
    return docs.select("doc_id", "text", "source", title.alias("title")).join(keyed, "doc_id").select(
        F.col("doc_id").alias("paper_id"),
        F.concat(F.date_format("o_orderdate", "yyMM"), F.lit("."), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("arxiv_id"),
        "title",
        F.col("text").alias("abstract"),
        F.col("source").alias("category_code"),
        (F.col("doc_id") == F.col("keeper")).alias("is_canonical"),
        F.when(F.col("doc_id") != F.col("keeper"), F.col("keeper")).alias("merged_into_id"),
        (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("first_observed_at"),
        "o_orderdate",
        (1 + F.col("doc_id") % 3).alias("version"),
    )


def whole_id(paper_id: Column, arxiv_id: Column) -> Column:
    """An ``arxiv_id`` with all places of the paper's number, one a paper; the view's own has five, which repeat from 100,000 papers on."""
    number = paper_id.cast("string")
    return F.concat(F.substring(arxiv_id, 1, 5), F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit("0")))


def shown_id(whole: Column) -> Column:
    """The view's ``arxiv_id`` of a whole_id()."""
    return F.substring(whole, 1, 10)


def titled(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """``found`` (few rows with paper_id) with titles: only their texts are normalised."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "text").join(found, "paper_id")
    return texts.withColumn("title", F.substring(normalize_text(F.col("text")), 1, 60)).drop("text")


def versions(papers: DataFrame) -> DataFrame:
    return papers.filter("paper_id % 10 <> 0").select("paper_id", F.lit(1).alias("version_number"), F.col("o_orderdate").alias("submitted_at"))


def publication_date(papers: DataFrame, versions: DataFrame) -> DataFrame:
    """``papers`` with ``published``: the first version's date, else when first observed."""
    first = versions.filter("version_number = 1").select("paper_id", "submitted_at")
    return papers.join(first, "paper_id", "left").withColumn("published", F.coalesce("submitted_at", "first_observed_at")).drop("submitted_at")


def dated(spark: SparkSession, d: str) -> DataFrame:
    """publication_date() of the corpus; a paper has one first version, whose date is the order's, so no join is due."""
    p = papers(spark, d)
    return p.withColumn("published", F.when(F.col("paper_id") % 10 != 0, F.col("o_orderdate")).otherwise(F.col("first_observed_at")))


def canonical(spark: SparkSession, d: str) -> DataFrame:
    return dated(spark, d).filter("is_canonical")


def categories(spark: SparkSession, d: str) -> DataFrame:
    number = F.substring("source", 4, 10).cast("long")
    docs = table(spark, d, "documents").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), "doc_id", "left_semi")
    return docs.select("source").distinct().select(
        F.col("source").alias("code"), F.col("source").alias("category_id"), F.when(number % 2 == 0, F.upper("source")).alias("display_name")
    )


def paper_authors(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("l_orderkey"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    own = lines.join(docs, "l_orderkey", "left_semi").join(orders, "l_orderkey", "left_semi").join(names, "l_suppkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    return own.select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"), F.col("s_name").alias("display_name"),
        F.row_number().over(order).cast("long").alias("author_order"),
    )


def embedded(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    status = F.when(v % 20 == 0, "FAILED").when(v % 21 == 0, "PENDING").otherwise("SUCCEEDED")
    return table(spark, d, "embeddings").select(
        v.alias("paper_id"), "embedding", "label", status.alias("embedding_status"), F.when(v % 23 == 0, "v0").otherwise("v1").alias("model_version")
    )


def active_embeddings(embedded: DataFrame, papers: DataFrame, version: str = MODEL_VERSION) -> DataFrame:
    """Succeeded embeddings of the current version, of canonical papers."""
    current = embedded.filter((F.col("embedding_status") == "SUCCEEDED") & (F.col("model_version") == version))
    return current.select("paper_id", "embedding").join(papers.filter("is_canonical"), "paper_id")


def active(spark: SparkSession, d: str) -> DataFrame:
    return active_embeddings(embedded(spark, d), dated(spark, d))


def assignments(spark: SparkSession, d: str) -> DataFrame:
    noise = F.col("paper_id") % 8 == 0
    return embedded(spark, d).select(
        "paper_id",
        F.when(~noise, F.col("label")).alias("cluster_id"),
        F.when(noise, 0.0).otherwise(1 - (F.col("paper_id") % 10) / 20).alias("membership"),
        noise.alias("is_noise"),
        F.slice("embedding", 1, 5).alias("coords"),
    )


def cluster_labels(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    text = i.cast("string")
    return spark.range(10).select(
        i.cast("int").alias("cluster_id"),
        F.concat(F.lit("Cluster "), text).alias("cluster_name"),
        F.concat(F.lit("Papers of group "), text).alias("short_description"),
        F.concat(F.lit("topic"), text, F.lit(", area"), (i % 3).cast("string")).alias("keywords"),
        F.when(i == 9, "PENDING_REVIEW").otherwise("APPROVED").alias("review_status"),
    )


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of canonical papers with their title, category and date."""
    p = canonical(spark, d).select("paper_id", "title", "abstract", "category_code", "published", "arxiv_id")
    return assignments(spark, d).join(p, "paper_id")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Analysis runs: an event each; its user is the kind of run, its type the outcome."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "FAILED").when(kind == "signup", "RUNNING").otherwise("SUCCEEDED")
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("kind"), F.col("ts").alias("completed_at"), status.alias("status"))


def entity_names(spark: SparkSession, d: str) -> DataFrame:
    """(entity_type, entity_id, entity_name) of categories and labelled clusters."""
    named = categories(spark, d).select(F.lit("category").alias("entity_type"), F.col("code").alias("entity_id"), F.coalesce("display_name", "code").alias("entity_name"))
    return named.unionByName(cluster_labels(spark).select(F.lit("cluster").alias("entity_type"), F.col("cluster_id").cast("string").alias("entity_id"), F.col("cluster_name").alias("entity_name")))


def cohort_papers(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d).filter(F.year("o_orderdate").isin(1995, 2001))


def day(c: Column | str) -> Column:
    """A date as text, the same in every engine."""
    return F.date_format(c, "yyyy-MM-dd")
