"""Rules on hand-made rows, streams that stop and go on, and what needs no tables."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import trend as T
from corpuslens.operators import clusters, encode, enrich, quality, search, trends
from corpuslens.streaming import jobs


def test_undefined_growth_counts_half(spark):
    df = spark.createDataFrame([(None, None), (1.0, 0.0), (-9.0, -1.0)], "rate double, share double")
    found = df.select(T.growth_normalized(F.col("rate")).alias("g"), T.share_part(F.col("share")).alias("s")).collect()
    assert [(r.g, r.s) for r in found] == [(0.5, 0.5), (0.5, 0.5), (0.0, 0.0)]


def test_average_is_exact_at_halves(spark):
    rows = [(1, x) for x in (0.95, 0.6, 0.7, 0.8551)] + [(2, None)]
    found = spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(clusters.average(F.col("x")).alias("a")).collect()
    assert {r.k: r.a for r in found} == {1: 0.7763, 2: None}


def test_resolve_run(spark):
    rows = [(1, "SUCCEEDED", datetime(2020, 1, 1)), (2, "SUCCEEDED", datetime(2020, 1, 2)), (3, "FAILED", datetime(2020, 1, 3))]
    runs = spark.createDataFrame(rows, "run_id long, status string, completed_at timestamp")
    one = lambda x: [r.run_id for r in x.collect()]
    assert one(trends.resolve_run(runs)) == [2] and one(trends.resolve_run(runs, 3)) == [3] and one(trends.resolve_run(runs, 9)) == []
    assert one(trends.resolve_run(runs.filter("status = 'FAILED'"))) == []


def test_label_upsert_resets_reviews(spark):
    key = "run_id string, cluster_id int, provider string, model string, model_version string, prompt_version string"
    row = lambda cluster, prompt, *rest: ("r", cluster, "p", "m", "1", prompt, *rest)
    stored = spark.createDataFrame([row(1, "a", "old", "APPROVED"), row(2, "a", "old", "APPROVED")], key + ", cluster_name string, review_status string")
    incoming = spark.createDataFrame([row(1, "a", "new"), row(1, "b", "new")], key + ", cluster_name string")
    found = {(r.cluster_id, r.prompt_version): (r.cluster_name, r.review_status) for r in clusters.label_upsert(stored, incoming).collect()}
    assert found == {(1, "a"): ("new", "PENDING_REVIEW"), (1, "b"): ("new", "PENDING_REVIEW"), (2, "a"): ("old", "APPROVED")}


def test_label_inputs_hold_their_parts(spark):
    import json

    from corpuslens.sources import views

    rows = views.clustered(spark, "/root/testdata/sf0.001")
    words, near = clusters.keywords(rows).collect(), clusters.representatives(rows).collect()
    for r in clusters.label_inputs(rows).collect():
        body = json.loads(r.input_json)
        assert body["top_keywords"] == [w.word for w in sorted(words, key=lambda w: w["rank"]) if w.cluster_id == r.cluster_id]
        assert [p["paper_id"] for p in body["representative_papers"]] == [p.paper_id for p in sorted(near, key=lambda p: p["rank"]) if p.cluster_id == r.cluster_id]
        assert body["papers"] == sum(c["n"] for c in body["category_distribution"])


def test_identity_links_on_a_fixed_frame(spark):
    """Ann claims I1 on paper 1; Bob, who comes later, gets what is left; the third finds nothing."""
    authors = spark.createDataFrame([(1, 10, 1, "ann"), (1, 11, 2, "ann"), (2, 11, 1, "ann"), (2, 12, 2, "ann")], "paper_id long, author_id long, position int, name string")
    identities = spark.createDataFrame([(1, "ann", "I1"), (2, "ann", "I1"), (2, "ann", "I2")], "paper_id long, name string, identity string")
    found = {(r.author_id, r.identity) for r in enrich.identity_links(authors, identities).collect()}
    assert found == {(10, "I1"), (11, "I2")}


def test_encoder(spark):
    rows = spark.createDataFrame([(1, "graph neural network"), (2, "graph theory of networks"), (3, "")], "paper_id long, text string")
    made = encode.encode(encode.encoder(rows, 64), rows)
    first, again = ({r.paper_id: r.embedding for r in made.collect()} for _ in range(2))
    assert first == again and all(len(v) == 64 for v in first.values())
    assert sum(x * x for x in first[1]) == pytest.approx(1, abs=1e-5) and not any(first[3])


def test_any_encoder(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(40)], "paper_id long, text string").repartition(2)
    out = encode.encode_with(rows, lambda: lambda texts: [[float(len(t)), float(len(texts) <= 16)] for t in texts])
    assert {r.paper_id: tuple(r.embedding) for r in out.collect()} == {i: (float(i), 1.0) for i in range(40)}


@pytest.mark.parametrize("bad", [{"text": "  "}, {"min_similarity": True}, {"min_similarity": "x"}, {"min_similarity": 1.5}])
def test_search_refuses(bad):
    with pytest.raises(ValueError):
        search.check_search(5, **bad)


def test_knn_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.normal(size=(90, 8))
    data[40:45] = data[3]  # ties
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    similar = np.round(unit @ unit.T, 12)
    np.fill_diagonal(similar, -2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "paper_id long, embedding array<double>")
    for block_rows in (1000, 17):
        found = search.knn_join(df, 4, block_rows).collect()
        assert len(found) == 360
        for r in found:
            assert similar[r.id, r.neighbour] == pytest.approx(r.similarity, abs=1e-9)
        for i in range(90):
            want = sorted(range(90), key=lambda j: (-similar[i, j], j))[:4]
            assert [r.neighbour for r in sorted(found, key=lambda r: r["rank"]) if r.id == i] == want


def test_candidates_are_all_of_moderate_overlap(spark):
    import random

    random.seed(7)
    title = lambda: " ".join(random.sample([f"t{k}" for k in range(14)], random.randint(0, 7)))
    papers, works = [(i, title()) for i in range(60)], [(100 + i, title()) for i in range(60)]
    pairs = enrich.candidate_pairs(
        spark.createDataFrame(papers, "paper_id long, normalized_title string"), spark.createDataFrame(works, "candidate_id long, normalized_title string"), top=60, hot=5
    )

    def overlap(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b) if a and b else 0.0

    want = {(p, c) for p, a in papers for c, b in works if overlap(a, b) >= 0.4995}
    assert {(r.paper_id, r.candidate_id) for r in pairs.collect()} == want and want


def test_violations_name_their_keys(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 2.0), (None, None), (3, 0.1)], "k int, x double")
    found = quality.report([quality.unique("t", rows, ["k"]), quality.holds("t", rows, "x in [0,1]", F.col("x").between(0, 1), ["k"]), quality.refers("t", rows, "k", "p", spark.createDataFrame([(1,)], "id int"), "id")])
    assert Counter((r.rule, r.key, r.n) for r in found.collect()) == Counter([("unique k", "1", 2), ("x in [0,1]", "1", 1), ("x in [0,1]", "null", 1), ("k in p", "3", 1)])


def event(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, reason string").coalesce(1).write.mode("append").parquet(path)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, old = str(tmp_path / "in"), datetime(2000, 1, 1)
    path = f"{source}/*.parquet"
    event(spark, source, [(1, datetime(2024, 1, 5), 7, "PERIODIC_REFRESH"), (2, datetime(2024, 1, 6), 8, "USER_FACING")])
    requests = lambda e: e.select(F.col("user_id").alias("paper_id"), F.lit("s").alias("source"), "reason", F.col("event_id").alias("seq"), F.lit(False).alias("full_detail"))
    ingest = lambda: sorted(r.event_id for r in jobs.ingest_stream(spark, path, ["event_id"], str(tmp_path / "a")).collect())
    queue = lambda: {r.paper_id: (r.priority, r.reason, r.reasons) for r in jobs.queue_stream(spark, path, requests, str(tmp_path / "b")).collect()}
    assert ingest() == [1, 2] and ingest() == [1, 2]
    before = {7: (5, "PERIODIC_REFRESH", ["PERIODIC_REFRESH"]), 8: (4, "USER_FACING", ["USER_FACING"])}
    assert queue() == before and queue() == before
    # a repeat, a record far older than the rest, and a better reason for one paper
    event(spark, source, [(2, datetime(2024, 1, 6), 8, "USER_FACING"), (3, old, 7, "OPENALEX_NOT_FOUND")])
    assert ingest() == [1, 2, 3]
    assert queue() == {7: (1, "OPENALEX_NOT_FOUND", ["PERIODIC_REFRESH", "OPENALEX_NOT_FOUND"]), 8: (4, "USER_FACING", ["USER_FACING"])}
