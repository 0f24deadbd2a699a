"""The match queries meet the whole catalogue: every paper has an entry of its own in it."""

import pytest
from pyspark.sql import functions as F

from corpuslens import plans
from corpuslens.sources import views as W

SF = "/root/testdata/sf0.001"


def third_papers(spark) -> set[int]:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return {r["doc_id"] for r in docs.filter("doc_id % 3 = 0").select("doc_id").collect()}


def own_entries(df) -> set[int]:
    return {r["paper_id"] for r in df.filter(F.col("candidate_id") == F.col("paper_id") + 999_999).select("paper_id").collect()}


def test_candidate_pairs(spark):
    found = own_entries(plans.QUERIES["candidate_pairs"](spark, SF))
    assert len(third_papers(spark) & found) == len(third_papers(spark)) > 0


def test_score_candidates(spark):
    found = own_entries(plans.QUERIES["score_candidates"](spark, SF).filter("exact_title AND title_overlap = 1"))
    assert len(third_papers(spark) & found) == len(third_papers(spark)) > 0


def test_score_candidates_of_any_overlap(spark):
    """A paper has the five nearest works scored, or as many as share a word with its title."""
    rows = plans.QUERIES["score_candidates"](spark, SF).collect()
    titles = {r["paper_id"]: {w for w in r["title"].split(" ") if w} for r in W.papers(spark, SF).select("paper_id", "title").collect()}
    got = {i: {} for i in titles}
    for r in rows:
        got[r["paper_id"]][r["candidate_id"]] = r["title_overlap"]
    for i, own in titles.items():
        near = sorted((-len(own & t) / len(own | t), j + 999_999) for j, t in titles.items() if own & t)[:5]
        assert got[i] == {j: pytest.approx(-o, abs=0.000501) for o, j in near}
    assert any(0 < r["title_overlap"] < 0.1 for r in rows)


def test_match_tiered_a(spark):
    """A paper whose own entry is there has a candidate, so none is without a match or a doubt."""
    rows = plans.QUERIES["match_tiered_a"](spark, SF).collect()
    assert rows and {r["status"] for r in rows} <= {"MATCHED", "AMBIGUOUS"}


def test_match_summary(spark):
    rows = {r["status"]: r["n"] for r in plans.QUERIES["match_summary"](spark, SF).collect()}
    assert "NOT_FOUND" not in rows and sum(rows.values()) == plans.QUERIES["match_tiered_a"](spark, SF).count()


def test_a_family_of_titles_leaves_few_pairs(spark):
    """What leaves the tasks that pair titles are a title's nearest works, not all pairs of a family."""
    from corpuslens.operators.enrich import _best_of_batch

    pairs = spark.range(40_000).selectExpr("unhex(md5(cast(id div 200 AS string))) AS own_key", "id % 200 AS candidate_id", "(id % 7) / 7D AS overlap").coalesce(1)
    left = pairs.mapInArrow(_best_of_batch(3), pairs.schema).collect()
    assert len(left) <= 3 * (200 + 4) and {r["own_key"] for r in left} == {r["own_key"] for r in pairs.select("own_key").distinct().collect()}
    assert {6, 13, 20} <= {r["candidate_id"] for r in left} and all(r["overlap"] == 6 / 7 for r in left)


def test_texts_stay_where_titles_are_asked_for(spark):
    plan = W.papers(spark, SF).select("paper_id", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Join") < plan.find("regexp_replace")
