"""Queries D5, D7, D14 and A6: encoding, stored embeddings, result rows, published runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuslens.functions import vector as V
from corpuslens.functions.text import canonical_text
from corpuslens.operators import encode as E
from corpuslens.operators import search as S
from corpuslens.plans.registry import query
from corpuslens.plans.search import AXIS, SIM
from corpuslens.sources import io
from corpuslens.sources import views as W
from corpuslens.sources.io import upsert_latest


@query("encode_corpus")
def _(spark, d):
    """Hashes and weights are Spark's, which SQL elsewhere doesn't have."""
    text = canonical_text(F.col("title"), F.col("abstract"), F.col("category_code"))
    rows = W.papers(spark, d).filter("is_canonical").select("paper_id", text.alias("text")).filter("text IS NOT NULL")
    out = E.encode(E.encoder(rows), rows)
    return out.select("paper_id", F.size("embedding").cast("long").alias("dimension"), F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.hash("embedding").alias("fingerprint"))


@query(
    "embedding_upsert",
    """SELECT paper_id, CASE WHEN paper_id % 9 = 0 THEN 'FAILED' WHEN paper_id % 2 = 0 THEN 'SUCCEEDED' ELSE embedding_status END AS embedding_status,
    (CASE WHEN paper_id % 9 = 0 THEN NULL ELSE embedding END) IS NOT NULL AS has_vector FROM embedded""",
)
def _(spark, d):
    """Every second vector is encoded again; every ninth fails and loses its vector."""
    e = W.embedded(spark, d)
    stored = e.select("paper_id", "embedding", "embedding_status", F.lit(0).alias("seq"))
    again = e.filter("paper_id % 2 = 0 OR paper_id % 9 = 0").select("paper_id", F.when(F.col("paper_id") % 9 != 0, F.col("embedding")).alias("embedding"))
    fresh = E.embedding_rows(again, V.check(F.col("embedding"), 64)).withColumn("seq", F.lit(1))
    rows = upsert_latest(stored, fresh.select(stored.columns), ["paper_id"], "seq")
    return rows.select("paper_id", "embedding_status", F.col("embedding").isNotNull().alias("has_vector"))


@query(
    "search_result_rows",
    f"""SELECT a.paper_id, a.arxiv_id, a.title, coalesce(nullif(k.display_name, ''), k.code) AS category, strftime(a.published, '%Y-%m-%d') AS published,
    round(a.similarity, 6) AS similarity FROM (SELECT *, {SIM} AS similarity FROM active ORDER BY similarity DESC, paper_id LIMIT 25) a JOIN categories k ON a.category_code = k.code""",
)
def _(spark, d):
    active = W.active(spark, d).select("paper_id", "arxiv_id", "title", "category_code", "published", "embedding")
    found = S.semantic_search(active, AXIS, 25).join(W.categories(spark, d).withColumnRenamed("code", "category_code"), "category_code")
    return found.select(
        "paper_id", "arxiv_id", "title", F.coalesce(F.nullif("display_name", F.lit("")), "category_code").alias("category"),
        W.day("published").alias("published"), F.round("similarity", 6).alias("similarity"),
    )


@query("append_run", "SELECT 'run-1' AS run_id, paper_id, cluster_id, is_noise FROM assignments")
def _(spark, d):
    """Two runs are written; only the one that succeeded is read back."""
    from corpuslens.operators.components import shared_folder

    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = W.assignments(spark, d).select("paper_id", "cluster_id", "is_noise")
    for run, status in (("run-1", "SUCCEEDED"), ("run-2", "FAILED")):
        io.append_run(spark.range(1).select(F.lit(run).alias("run_id"), F.lit(status).alias("status")), {"assignments": rows.withColumn("run_id", F.lit(run))}, path)
    return io.read_run_children(spark, path, "assignments").select("run_id", "paper_id", "cluster_id", "is_noise")
