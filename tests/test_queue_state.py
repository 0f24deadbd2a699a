"""The queue as keyed state: restarts, timers, and state of keys."""

import datetime as dt

from corpuslens.streaming import queue as K

T0 = dt.datetime(2024, 1, 1)


def arrivals(spark, folder, name, rows):
    """rows: (paper_id, hours, seq, kind, reason, age_days)."""
    data = [(p, "s2", T0 + dt.timedelta(hours=h), seq, kind, reason, age, False) for p, h, seq, kind, reason, age in rows]
    spark.createDataFrame(data, K.ARRIVING).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.d")
    import glob
    import shutil

    for part in glob.glob(f"{folder}/{name}.d/*.parquet"):
        shutil.copy(part, f"{folder}/{name}.parquet")


def run(spark, tmp_path):
    table, figures = K.run_queue(lambda s: s, f"{tmp_path}/in/*.parquet", f"{tmp_path}/job", spark)
    return {r.paper_id: r for r in table.collect()}, figures


def test_queue_state_restarts_and_timers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ask = ("request", "OPENALEX_NOT_FOUND", None)
    arrivals(spark, folder, "a", [(1, 0, 1, *ask), (2, 0, 2, "request", "USER_FACING", None), (2, 0, 3, *ask), (3, 0, 4, *ask), (4, 0, 5, "start", None, None), (5, 0, 6, *ask)])
    rows, _ = run(spark, tmp_path)
    assert {p: r.status for p, r in rows.items()} == {1: "PENDING", 2: "PENDING", 3: "PENDING", 5: "PENDING"}
    assert (rows[2].priority, rows[2].reason, rows[2].reasons) == (1, "OPENALEX_NOT_FOUND", "USER_FACING,OPENALEX_NOT_FOUND")
    # a second run on the same folder takes the new file only
    arrivals(spark, folder, "b", [(1, 1, 7, "start", None, None), (1, 2, 8, "not_found", None, 3.0), (2, 1, 9, "start", None, None), (2, 2, 10, "temporary", None, None), (3, 1, 11, "start", None, None), (3, 2, 12, "matched", None, None), (3, 3, 13, *ask), (5, 1, 14, "start", None, None), (5, 2, 15, "not_found", None, 400.0)])
    rows, figures = run(spark, tmp_path)
    hours = {p: (r.next_retry_at - T0).total_seconds() / 3600 for p, r in rows.items() if r.next_retry_at}
    assert {p: (r.status, r.attempts) for p, r in rows.items()} == {1: ("RETRY_SCHEDULED", 1), 2: ("RETRY_SCHEDULED", 1), 3: ("MATCHED", 1), 5: ("RETRY_SCHEDULED", 1)}
    assert hours == {1: 2 + 5 * 24, 2: 6, 5: 2 + 30 * 24}
    # time passes: the timers of papers 1 and 2 run out, that of 5 doesn't
    arrivals(spark, folder, "c", [(6, 24 * 10, 16, *ask)])
    rows, figures = run(spark, tmp_path)
    assert {p: r.status for p, r in rows.items()} == {1: "PENDING", 2: "PENDING", 3: "MATCHED", 5: "RETRY_SCHEDULED", 6: "PENDING"}
    assert rows[1].next_retry_at is None and rows[1].attempts == 1
    # many batches over the same keys leave the state as it is
    for i in range(3):
        arrivals(spark, folder, f"d{i}", [(p, 24 * 10 + i, 20 + 10 * i + p, *ask) for p in (1, 2, 3, 6)])
    rows, figures = run(spark, tmp_path)
    assert len(figures) >= 3 and len({f["rows"] for f in figures}) == 1


def test_first_request_of_all_counts(spark, tmp_path):
    """The request numbered 0 comes first and isn't late."""
    from corpuslens import plans

    events = [(0, 1, "error"), (1, 1, "click"), (2, 1, "error"), (40, 2, "view")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/written")
    next(tmp_path.glob("written/*.parquet")).rename(tmp_path / "events.parquet")
    rows = {r.paper_id: r for r in plans.QUERIES["stream_queue_state"](spark, str(tmp_path)).collect()}
    assert rows[1].reasons == "OPENALEX_AMBIGUOUS,USER_FACING" and rows[1].full_detail
    assert rows[2].reasons == "HISTORICAL_CANDIDATE" and rows[2].full_detail


def test_rules_of_one_row():
    new = (None, None, "", False, None, 0, None, None)
    row = K.after(new, "request", "nothing of the kind", None, True, 0, 1)
    assert row == new
    row = K.after(new, "request", "USER_FACING", None, False, 0, 1)
    for i in range(5):
        row = K.after(K.after(row, "start", None, None, False, 0, 2), "temporary", None, None, False, 10, 3)
        assert (row[4], row[6]) == (("RETRY_SCHEDULED", 10 + 4 * K.HOUR_MS) if i < 4 else ("DEFERRED", None))
    row = K.after(row, "request", "HIGH_PRIORITY_PAPER", None, True, 20, 4)
    assert row[3] is True and row[4] == "PENDING" and row[6] is None
    assert K.after(row, "permanent", None, None, False, 0, 5)[4] == "FAILED" and K.after(row, "ambiguous", None, None, False, 0, 5)[4] == "AMBIGUOUS"
