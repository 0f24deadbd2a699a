"""The ingest stream: several tables, one commit; stops and replays change nothing."""

import pytest
from pyspark.sql import functions as F

from corpuslens.streaming import ingest

FEED = (
    "<entry><id>http://h/abs/{id}v{v}</id><title>{t}</title><summary>A</summary><published>2016-01-01T00:00:00Z</published><updated>2016-02-0{v}T00:00:00Z</updated>"
    '{authors}<arxiv:primary_category term="{c}"/><category term="{c}"/>{doi}</entry>'
)


def entry(i, v=1, title="T", authors=("A",), category="x", doi=None):
    return FEED.format(id=i, v=v, t=title, c=category, authors="".join(f"<author><name>{a}</name></author>" for a in authors), doi=f"<arxiv:doi>{doi}</arxiv:doi>" if doi else "")


FILES = [
    [entry("1.1", doi="d1"), entry("1.2", authors=("A", "B")), "<entry><id>nothing</id></entry>"],
    [entry("1.1", v=2, title="New", authors=("C", "a", "C"), category="y"), entry("1.3", authors=("b",))],
    [entry("1.2", title="Once", doi="d2"), "no xml", entry("1.4", v=3)],
]


def arrive(spark, folder, upto):
    for i, rows in enumerate(FILES[:upto]):
        path = folder / f"{i}.parquet"
        if not path.exists():
            import pandas as pd

            pd.DataFrame({"entry": rows}).to_parquet(path)


def state(store):
    return {name: sorted(map(str, store.table(name).drop("first_batch").collect())) for name in ingest.TABLES}


def run(spark, tmp_path, job, before=None):
    return ingest.ingest_entries(spark, f"{tmp_path}/in/*.parquet", f"{tmp_path}/{job}", before)


def test_tables_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arrive(spark, tmp_path / "in", 3)
    whole = run(spark, tmp_path, "whole")
    want = state(whole)
    papers = {r.arxiv_id: r for r in whole.table("papers").collect()}
    assert {i: (p.title, p.doi, p.primary_category, p.first_batch) for i, p in papers.items()} == {"1.1": ("New", "d1", "y", 0), "1.2": ("Once", "d2", "x", 0), "1.3": ("T", None, "x", 1), "1.4": ("T", None, "x", 2)}
    links = {(r.arxiv_id, r.normalized, r.author_order) for r in whole.table("paper_authors").collect()}
    assert links == {("1.1", "c", 1), ("1.1", "a", 2), ("1.2", "a", 1), ("1.3", "b", 1), ("1.4", "a", 1)}
    versions = {(r.arxiv_id, r.version_number, r.verified, r.is_latest) for r in whole.table("versions").collect()}
    assert versions == {("1.1", 1, True, False), ("1.1", 2, True, True), ("1.2", 1, True, True), ("1.3", 1, True, True), ("1.4", 1, False, False), ("1.4", 3, True, True)}
    assert {(r.normalized, r.display_name) for r in whole.table("authors").collect()} == {("a", "A"), ("b", "B"), ("c", "C")}
    assert whole.table("failures").count() == 2 and {r.code for r in whole.table("categories").collect()} == {"x", "y"}

    # killed after the tables of the second batch were written, before its commit
    def killed(number):
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, "other", killed)
    half = ingest.EntryStore(spark, f"{tmp_path}/other")
    assert half.committed() == (-1, [0]) and half.table("papers").count() == 2 and half.table("failures").count() == 1
    assert state(run(spark, tmp_path, "other")) == want
    # a snapshot changes nothing, nor does going on after it, nor a batch that runs again
    other = ingest.EntryStore(spark, f"{tmp_path}/other")
    other.compact()
    assert other.committed() == (2, []) and state(other) == want
    more = spark.createDataFrame([(entry("1.2", authors=("Z",)),)], "entry string")
    other.write(more, 3)
    once = state(other)
    other.write(more, 3)
    assert state(other) == once and other.committed() == (2, [3])
    assert [r.normalized for r in other.table("paper_authors").filter("arxiv_id = '1.2'").collect()] == ["z"]
    assert other.table("papers").filter("arxiv_id = '1.2'").select("doi").first().doi == "d2"


def test_store_without_batches(spark, tmp_path):
    store = ingest.EntryStore(spark, f"{tmp_path}/none")
    assert store.table("papers").count() == 0 and store.committed() == (-1, [])
    store.compact()
    assert store.table("failures").count() == 0
    store.write(spark.createDataFrame([], "entry string"), 0)
    assert store.committed() == (-1, [0]) and store.table("versions").agg(F.count("*")).first()[0] == 0
