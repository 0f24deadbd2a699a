"""Queries D11 and F2: range join, cell index, density clusters and their coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import vector as V
from corpuslens.operators import clusters as C
from corpuslens.operators import density as D
from corpuslens.operators import neighbours as N
from corpuslens.plans.registry import query
from corpuslens.sources import views as W

UNIT = "list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"
EXACT = f"u AS (SELECT paper_id, {UNIT.format(v='v')} AS e FROM (SELECT paper_id, CAST(embedding AS DOUBLE[]) AS v FROM active))"
#: Planted groups: each label adds 2 on an axis of its own.
PLANTED = f"""q AS (SELECT vec_id AS paper_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + CASE WHEN i - 1 = label THEN 2 ELSE 0 END) AS v FROM embeddings),
    u AS (SELECT paper_id, {UNIT.format(v='v')} AS e FROM q),
    pairs AS (SELECT a.paper_id AS u, b.paper_id AS v, list_distance(a.e, b.e) AS distance FROM u a JOIN u b ON a.paper_id < b.paper_id AND list_distance(a.e, b.e) <= 0.8),
    cores AS (SELECT id, distance AS core FROM (SELECT id, distance, row_number() OVER (PARTITION BY id ORDER BY distance) AS r
        FROM (SELECT u AS id, distance FROM pairs UNION ALL SELECT v, distance FROM pairs)) WHERE r = 3)"""


def planted(spark, d):
    pushed = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), 2.0).otherwise(0.0))
    return W.embedded(spark, d).select("paper_id", "label", pushed.alias("embedding"))


@query("range_pairs", f"WITH {EXACT} SELECT a.paper_id AS u, b.paper_id AS v, round(list_distance(a.e, b.e), 6) AS distance FROM u a JOIN u b ON a.paper_id < b.paper_id WHERE list_distance(a.e, b.e) <= 1.1")
def _(spark, d):
    points = W.active(spark, d).select(F.col("paper_id").alias("id"), V.normalized(F.col("embedding")).alias("vector"))
    return N.range_join(points, 1.1).select("u", "v", F.round("distance", 6).alias("distance"))


@query("core_distances", f"WITH {PLANTED} SELECT id, round(core, 6) AS core FROM cores")
def _(spark, d):
    points, _ = D.points_of(planted(spark, d))
    return D.cores_within(points, 0.8, 3).select("id", F.round("core", 6).alias("core"))


@query(
    "reachability_edges",
    f"WITH {PLANTED} SELECT u, v, round(greatest(distance, a.core, b.core), 6) AS weight FROM pairs JOIN cores a ON u = a.id JOIN cores b ON v = b.id",
)
def _(spark, d):
    points, _ = D.points_of(planted(spark, d))
    return D.reachability(points, 0.8, 3)[0].select("u", "v", F.round("weight", 6).alias("weight"))


@query("knn_index")
def _(spark, d):
    """knn_join by cells; approximate, so a test holds its recall."""
    found = N.CellIndex(W.active(spark, d).select("paper_id", "embedding"), 5).neighbours()
    return found.select("id", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("reduced_coordinates")
def _(spark, d):
    return D.reduced(planted(spark, d)).select("paper_id", F.transform("coords", lambda x: F.round(x, 6)).alias("coords"))


@query("density_cluster")
def _(spark, d):
    """Clusters of the planted groups with five coordinates; a test holds them against one machine."""
    own = planted(spark, d)
    rows = D.density_cluster(own).join(D.reduced(own), "paper_id", "left").join(own.select("paper_id", "label"), "paper_id")
    return rows.select("paper_id", "cluster_id", F.round("membership", 6).alias("membership"), "is_noise", "label", F.transform("coords", lambda x: F.round(x, 6)).alias("coords"))


@query("density_representatives")
def _(spark, d):
    """The papers nearest to the centroid of their density cluster, in its coordinates."""
    own = planted(spark, d)
    near = C.representatives(D.density_cluster(own).join(D.reduced(own), "paper_id"))
    return near.select("cluster_id", "paper_id", F.round("distance", 6).alias("distance"), "rank")
