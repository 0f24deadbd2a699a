"""Queries against their SQL on hand-made tables: blank texts, ids of six places."""

import datetime as dt

import pytest
from oracle import connection, differences

from corpuslens import plans


@pytest.fixture
def tables(spark, tmp_path):
    """Writes documents (doc_id, text, source) with an order each, all of one month."""

    def write(docs: list[tuple]) -> str:
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in docs]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/docs")
        orders = [(i, 1, "O", 1.0, dt.datetime(1995, 1, 1 + k % 28), "1-URGENT") for k, i in enumerate(dict.fromkeys(i for i, *_ in docs))]
        schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
        spark.createDataFrame(orders, schema).coalesce(1).write.parquet(f"{tmp_path}/ordered")
        return as_files(tmp_path, {"documents": "docs", "orders": "ordered"})

    return write


def as_files(folder, names: dict[str, str]) -> str:
    """Each written folder's one file as ``<table>.parquet``, which both engines read."""
    (folder / "sf").mkdir()
    for table, written in names.items():
        (folder / "sf" / f"{table}.parquet").symlink_to(next((folder / written).glob("*.parquet")))
    return str(folder / "sf")


def agrees(spark, name: str, d: str) -> None:
    assert not differences(plans.QUERIES[name](spark, d), plans.SQL[name], connection(d))


def test_canonical_text_of_blank_and_null(spark, tables):
    d = tables([(1, "A text", "src1"), (2, " \n ", "src2"), (3, "", "src0"), (4, None, "src1"), (5, None, "src2"), (6, "Another one", None), (7, "A text", "src1")])
    agrees(spark, "canonical_text", d)


#: Numbers that share their first five places, all of one month.
SIX_PLACES = [(i, f"Text of {i}", f"src{i % 4}") for i in (10000, 100002, 100003, 100004, 100008, 60, 100020)]


def test_paper_upsert_over_100000_papers(spark, tables):
    agrees(spark, "paper_upsert", tables(SIX_PLACES))


def test_stream_entries_over_100000_papers(spark, tables):
    agrees(spark, "stream_entries", tables(SIX_PLACES))


def test_window_counts_of_windows_over_all_time(spark):
    """Ten thousand windows of 200 years each: a copy of each for every day that it touches would be 730 million rows."""
    from corpuslens.operators import ingest

    start = dt.datetime(1900, 1, 1)
    rows = spark.createDataFrame([(start + dt.timedelta(days=100 * k),) for k in range(700) for _ in range(1 + k % 2)], "published timestamp_ntz")
    asked = spark.range(10_000).selectExpr("id AS window", "timestamp_ntz'1900-01-01' + make_dt_interval(cast(id AS int)) AS window_start", "timestamp_ntz'2100-01-01' + make_dt_interval(cast(id AS int)) AS window_end")
    found = {r["window"]: r["n"] for r in ingest.count_in_windows(rows, asked).collect()}
    assert len(found) == 10_000
    for i in (0, 1, 100, 101, 9999):
        low, high = start + dt.timedelta(days=i), dt.datetime(2100, 1, 1) + dt.timedelta(days=i)
        assert found[i] == sum(1 + k % 2 for k in range(700) if low <= start + dt.timedelta(days=100 * k) < high)
