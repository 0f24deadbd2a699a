"""Formulas and edge cases on small hand-made frames."""

import itertools
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from corpuslens import plans
from corpuslens.functions import text, vector
from corpuslens.functions import trend as T
from corpuslens.operators import clusters, enrich, search, trends
from corpuslens.sources import views


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "recent, previous, expected", [(11, 11, "Stable"), (6, 0, "Emerging"), (0, 14, "Cooling"), (2, 2, "Insufficient Data"), (4, 0, "Insufficient Data")]
)
def test_trend_class(spark, recent, previous, expected):
    r, p = F.lit(recent), F.lit(previous)
    found = T.trend_class(r + p, r, p, T.growth_rate(r, p), F.lit(None).cast("boolean"), F.lit(0.5), steady_from=1.01)
    assert value(spark, found) == expected


@pytest.mark.parametrize("recent, previous, rate", [(11, 11, 0.0), (6, 0, None), (0, 0, 0.0), (0, 14, -1.0), (12, 40, -0.7)])
def test_growth(spark, recent, previous, rate):
    assert value(spark, T.growth_rate(F.lit(recent), F.lit(previous))) == pytest.approx(rate)


@pytest.mark.parametrize(
    "row, expected",
    [
        ((169, 4, 30, 0, 1), "PARTIALLY_CURRENT"), ((29, 0, 30, 30, 30), "INSUFFICIENT_DATA"), ((100, 181, 5, 5, 20), "HISTORICAL_ONLY"),
        ((100, 180, 0, 5, 0), "HISTORICAL_ONLY"), ((100, 10, 50, 5, 8), "PARTIALLY_CURRENT"), ((100, 10, 50, 5, 9), "CURRENT"),
    ],
)
def test_freshness(spark, row, expected):
    assert value(spark, T.freshness(*map(F.lit, row))) == expected


def test_acceleration(spark):
    rates = lambda *x: F.array(*[F.lit(v).cast("double") for v in x])
    assert value(spark, T.acceleration(rates(0.1, 0.2))) is None
    assert value(spark, T.acceleration(rates(9, 0.1, 0.2, 0.3))) is True
    assert value(spark, T.acceleration(rates(0.1, 0.3, 0.2))) is False
    assert value(spark, T.acceleration(rates(0.1, None, 0.2))) is None


def test_score_rounds_half_to_even(spark):
    parts = dict.fromkeys(T.WEIGHTS, F.lit(0.0)) | {"volume": F.lit(0.1)}
    assert value(spark, T.trend_score(parts, F.lit(100))) == 2


def test_cohorts(spark):
    days = [datetime(2016, 1, 1), datetime(2016, 1, 31), datetime(2016, 3, 2), datetime(2026, 7, 1)]
    papers = spark.createDataFrame([(d,) for d in days], "published timestamp_ntz")
    assert trends.cohort_windows(papers) == (date(2016, 1, 1), date(2016, 2, 1), date(2026, 7, 1), date(2026, 7, 2))
    with pytest.raises(ValueError):
        trends.cohort_windows(papers.limit(1))


def test_search_filters_come_before_the_limit(spark):
    e0, e1, mix = [1.0, 0.0], [0.0, 1.0], [0.6, 0.8]
    rows = [(1, e0, "a", datetime(2020, 1, 1)), (2, e1, "a", datetime(2021, 1, 1)), (3, mix, "b", datetime(2022, 1, 1))]
    active = spark.createDataFrame(rows, "paper_id long, embedding array<float>, category_code string, published timestamp_ntz")
    found = search.semantic_search(active, e0, 2).collect()
    assert [(r.paper_id, round(r.similarity, 4)) for r in found] == [(1, 1.0), (3, 0.6)]
    assert [r.paper_id for r in search.semantic_search(active, e0, 1, category="b").collect()] == [3]
    assert [r.paper_id for r in search.similar_papers(active, 1, 1).collect()] == [3]
    assert search.semantic_search(active, e0, 3, min_similarity=0.7).count() == 1
    for bad in (0, 101, True):
        with pytest.raises(ValueError):
            search.semantic_search(active, e0, bad)
    with pytest.raises(ValueError):
        search.similar_papers(active, 99)


def test_vectors(spark):
    assert value(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert value(spark, vector.check(F.array(F.lit(1.0)), 2)) == "wrong length"
    assert value(spark, vector.check(F.array(F.lit(float("nan"))), 1)) == "not a number"


def test_text(spark):
    assert value(spark, text.normalize_text(F.lit("  A b \n C "))) == "a b c"
    assert value(spark, text.id_and_version(F.lit("http://h/abs/1601.00001v2"))).asDict() == {"base_id": "1601.00001", "version": 2}
    assert value(spark, text.id_and_version(F.lit("http://h/abs/1601.00001")))["base_id"] is None
    assert value(spark, text.search_text(F.lit("What? is * this"))) == "What is this"
    assert value(spark, text.canonical_text(F.lit("T "), F.lit(" A  b"), F.lit(None).cast("string"))) == "Title: T\n\nAbstract: A b\n\nPrimary Category: Unknown"
    assert value(spark, text.canonical_text(F.lit(" "), F.lit("A"), F.lit("c"))) is None
    long = "x" * 300 + ". " + "y" * 300
    assert value(spark, text.short_abstract(F.lit(long))) == "x" * 300 + "..."
    assert value(spark, text.short_abstract(F.lit("word " * 120))) == ("word " * 99 + "word")[:499] + "..."
    assert value(spark, text.short_abstract(F.lit("short"))) == "short"


def test_label_validation(spark):
    body = '{"cluster_name":"N","short_description":"d","keywords":["k"],"confidence":%s,"evidence":[{"paper_id":%d,"reason":"r"}]}'
    rows = [(0, "primary", body % (0.5, 1)), (1, "primary", body % (1.5, 1)), (1, "fallback", body % (1, 1)), (2, "primary", body % (1, 9)), (3, "primary", "no json")]
    allowed = spark.createDataFrame([(c, 1) for c in range(4)], "cluster_id int, paper_id long")
    found = clusters.label_validate(spark.createDataFrame(rows, "cluster_id int, provider string, body string"), allowed)
    assert {r.cluster_id: (r.status, r.used) for r in found.collect()} == {0: ("SUCCEEDED", "primary"), 1: ("SUCCEEDED", "fallback"), 2: ("FAILED", None), 3: ("FAILED", None)}
    empty = '{"cluster_name":"N","short_description":"d","keywords":[],"confidence":1,"evidence":[]}'
    cases = [(0, empty), (1, empty.replace('"keywords":[],', "")), (2, empty.replace('"N"', '""')), (3, empty.replace('"evidence":[]', '"evidence":[{"paper_id":1}]')), (4, empty.replace(',"evidence":[]', ""))]
    found = clusters.label_validate(spark.createDataFrame([(c, "primary", b) for c, b in cases], "cluster_id int, provider string, body string"), allowed)
    assert {r.cluster_id: r.status for r in found.collect()} == {0: "SUCCEEDED", 1: "FAILED", 2: "FAILED", 3: "FAILED", 4: "FAILED"}


def test_entries_with_gaps(spark):
    """Authors without a name, categories without a term, a link that is both pdf and alternate, a padded doi."""
    from corpuslens.operators import ingest

    entry = (
        '<entry><id>http://h/abs/1601.00001v2</id><title>T</title><summary>A</summary><published>2016-01-01T00:00:00Z</published><updated>2016-01-02T00:00:00Z</updated>'
        "<author><name>A</name></author><author><name> </name></author><author></author><author><name>B</name></author>"
        '<arxiv:primary_category term="x"/><category term="y"/><category/><category term=""/><category term="x"/><arxiv:doi> 10.1/z </arxiv:doi>'
        '<link rel="alternate" href="a"/><link rel="alternate" title="pdf" href="p"/></entry>'
    )
    row = ingest.parse_entries(spark.createDataFrame([(1, entry)], "n long, entry string")).first()
    assert row.error is None and [(a.author_order, a.name) for a in row.authors] == [(1, "A"), (4, "B")]
    assert (row.secondary_categories, row.doi, row.pdf_url, row.abstract_url) == (["y"], "10.1/z", "p", "a")


def test_identities_are_claimed_once(spark):
    authors = spark.createDataFrame([(1, 10, 1, "a"), (1, 11, 2, "a"), (2, 11, 1, "a")], "paper_id long, author_id long, position long, name string")
    identities = spark.createDataFrame([(1, "a", "I"), (2, "a", "J")], "paper_id long, name string, identity string")
    found = enrich.identity_links(authors, identities)
    assert sorted(map(tuple, found.collect())) == [(10, "I"), (11, "J")]


def test_queue_keeps_matched_rows(spark):
    stored = spark.createDataFrame(
        [(1, "s", 3, "HISTORICAL_CANDIDATE", ["HISTORICAL_CANDIDATE"], False, "MATCHED"), (2, "s", 4, "USER_FACING", ["USER_FACING"], False, "FAILED")],
        "paper_id long, source string, priority int, reason string, reasons array<string>, full_detail boolean, status string",
    )
    asked = spark.createDataFrame([(1, "s", "OPENALEX_NOT_FOUND", 1, True), (2, "s", "HIGH_PRIORITY_PAPER", 2, False)], "paper_id long, source string, reason string, seq long, full_detail boolean")
    found = {r.paper_id: r for r in enrich.enqueue(stored, asked).collect()}
    assert (found[1].status, found[1].priority, found[1].full_detail) == ("MATCHED", 1, True)
    assert (found[2].status, found[2].priority, found[2].reason) == ("PENDING", 4, "USER_FACING")


def test_runs_are_published_whole_and_removed(spark, tmp_path):
    from corpuslens.sources import io

    run = spark.createDataFrame([("r1", "SUCCEEDED")], "run_id string, status string")
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x int")
    io.append_run(run, {"scores": rows}, str(tmp_path))
    kept = io.read_run_children(spark, str(tmp_path), "scores")
    assert [r.x for r in kept.collect()] == [1]
    assert io.delete_run_cascade({"scores": rows}, run)["scores"].collect()[0].run_id == "r2"


def test_titles_of_common_words_find_candidates(spark):
    titles = [" ".join(f"w{k}" for k in c) for c in itertools.combinations(range(11), 5)][:300] + ["same common title"] * 70
    papers = spark.createDataFrame(list(enumerate(titles)), "paper_id long, normalized_title string")
    works = papers.select((F.col("paper_id") + 1000).alias("candidate_id"), "normalized_title")
    got = {}
    for r in enrich.candidate_pairs(papers, works).collect():
        got.setdefault(r.paper_id, set()).add(r.candidate_id - 1000)
    sets = [set(t.split()) for t in titles]
    for i, a in enumerate(sets):
        near = sorted((-len(a & b) / len(a | b), k) for k, b in enumerate(sets) if 2 * len(a & b) >= len(a | b))
        assert got[i] == {k for _, k in near[:5]}, i


def test_quota_and_identities_cover_the_tables(spark):
    d = "/root/testdata/sf0.01"
    errors = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'").toPandas()
    assert plans.QUERIES["quota_split"](spark, d).first().backlog == int((errors.value // 1 - 20).clip(lower=0).sum())
    links = plans.QUERIES["author_identity_link"](spark, d).collect()
    authors = {r.author_id for r in views.paper_authors(spark, d).select("author_id").distinct().collect()}
    assert {r.author_id for r in links} == authors and len(authors) > 60
    assert len({r.identity for r in links}) == len(links) == len(authors)


def test_histories_reach_all_classes_and_qualities(spark):
    from corpuslens import plans

    rows = plans.QUERIES["history_trends"](spark, "/root/testdata/sf0.01").collect()
    assert {r.trend_class for r in rows} == {"Insufficient Data", "Emerging", "Accelerating", "Consistently Active", "Stable", "Cooling"}
    assert {r.data_quality for r in rows} == {"INSUFFICIENT", "LOW", "MEDIUM", "HIGH"}


def test_history_of_few_windows(spark):
    from datetime import date, datetime

    from corpuslens.operators import trends

    rows = [("a", datetime(2024, 1, day)) for day in (1, 2, 11, 12, 13, 21, 22, 22, 23, 24)] + [("b", datetime(2023, 1, 1)), ("b", datetime(2024, 1, 31))]
    members = spark.createDataFrame(rows, "entity string, published timestamp_ntz")
    got = trends.history_trends(members, date(2024, 1, 31), 10, 3, ("entity",)).collect()
    assert [(r.entity, r.counts, r.rates, r.acceleration, r.distinct_days) for r in got] == [("a", [2, 3, 5], [0.5, 2 / 3], None, 4)]
    with pytest.raises(ValueError):
        trends.history_trends(members, date(2024, 1, 31), 10, 1, ("entity",))


def test_windows_of_any_length(spark):
    import random
    from datetime import datetime, timedelta

    from corpuslens.operators import ingest

    rng = random.Random(1)
    t0 = datetime(1969, 12, 1)
    times = [t0 + timedelta(minutes=rng.randrange(90_000)) for _ in range(300)] + [t0 + timedelta(days=9)] * 50 + [None]
    windows = [(i, a, b) for i in range(60) for a, b in [sorted(t0 + timedelta(minutes=rng.randrange(90_000)) for _ in "ab")]]
    windows += [(60, t0, t0), (61, t0 + timedelta(days=2), t0), (62, t0, None), (63, t0 + timedelta(days=9), t0 + timedelta(days=9, seconds=1))]
    rows = spark.createDataFrame([(t,) for t in times], "published timestamp_ntz")
    asked = spark.createDataFrame(windows, "window int, window_start timestamp_ntz, window_end timestamp_ntz")
    found = ingest.count_in_windows(rows, asked)
    want = {i: sum(t is not None and a <= t < b for t in times) if b else 0 for i, a, b in windows}
    assert {r.window: r.n for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_write_counts_itself(spark, tmp_path):
    from corpuslens.operators import ingest

    rows = spark.range(20).selectExpr("id", "CASE WHEN id % 4 = 0 THEN 'failed' WHEN id % 4 = 1 THEN 'created' ELSE 'updated' END AS outcome")
    assert ingest.write_counted(rows, f"{tmp_path}/t") == {"processed": 20, "created": 5, "updated": 10, "failed": 5, "status": "partial"}
    assert spark.read.parquet(f"{tmp_path}/t").count() == 20
    assert ingest.write_counted(rows.filter("id % 4 = 0"), f"{tmp_path}/u")["status"] == "failed"
    assert ingest.write_counted(rows.limit(0), f"{tmp_path}/v") == {"processed": 0, "created": 0, "updated": 0, "failed": 0, "status": "succeeded"}
