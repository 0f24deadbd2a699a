"""The retry queue as keyed state: one value a (paper, source), and a timer where a retry is due.

State holds a row for each key and nothing for batches gone by; a restart goes on from the checkpoint. Event time is the
stream's clock: a retry falls due when the watermark passes its time, and the row is then pending again without any
reader asking.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuslens.operators.enrich import PRIORITIES

#: Fixed values of the retry rules.
RECENT_AGE_DAYS = 30
RECENT_RETRY_DAYS = 5
OLD_RETRY_DAYS = 30
TEMPORARY_RETRY_HOURS = 4
MOST_ATTEMPTS = 5

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

#: What arrives: kind is request (with a reason), start (an attempt begins), or the outcome of an attempt:
#: matched, ambiguous, not_found (with the paper's age), temporary, permanent.
ARRIVING = "paper_id bigint, source string, ts timestamp, seq bigint, kind string, reason string, age_days double, full_detail boolean"
KEPT = "priority int, reason string, reasons string, full_detail boolean, status string, attempts int, retry_ms bigint, last_seq bigint"
CHANGED = "paper_id bigint, source string, priority int, reason string, reasons string, full_detail boolean, status string, attempts int, next_retry_at timestamp, last_seq bigint, step int"
OUTCOMES = {"matched": "MATCHED", "ambiguous": "AMBIGUOUS", "not_found": "RETRY_SCHEDULED", "permanent": "FAILED"}


def after(row: tuple, kind: str, reason: str | None, age_days: float | None, full: bool, now_ms: int, seq: int) -> tuple:
    """The row (columns of KEPT) after one arrival. Unknown reasons and kinds change nothing."""
    priority, top, reasons, detail, status, attempts, retry, _ = row
    if kind == "request":
        new = PRIORITIES.get(reason)
        if new is None:
            return row
        own = reasons.split(",") if reasons else []
        reasons = ",".join(own if reason in own else [*own, reason])
        if priority is None or new < priority:
            priority, top = new, reason
        detail = detail or full
        if status not in ("MATCHED", "IN_PROGRESS"):
            status, retry = "PENDING", None
    elif status is None:
        return row  # nobody asked for it
    elif kind == "start":
        status, attempts = "IN_PROGRESS", attempts + 1
    elif kind == "temporary":
        deferred = attempts >= MOST_ATTEMPTS
        status, retry = ("DEFERRED", None) if deferred else ("RETRY_SCHEDULED", now_ms + TEMPORARY_RETRY_HOURS * HOUR_MS)
    elif kind in OUTCOMES:
        status, retry = OUTCOMES[kind], None
        if kind == "not_found":
            recent = age_days is not None and age_days <= RECENT_AGE_DAYS
            retry = now_ms + (RECENT_RETRY_DAYS if recent else OLD_RETRY_DAYS) * DAY_MS
    else:
        return row
    return priority, top, reasons, detail, status, attempts, retry, seq


class QueueProcessor(StatefulProcessor):
    """Folds the arrivals of a key, in order of time and number, into its row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", KEPT)

    def _changed(self, key, row: tuple, step: int) -> pd.DataFrame:
        *first, retry, seq = row
        at = None if retry is None else pd.Timestamp(retry, unit="ms")
        names = [c.split()[0] for c in CHANGED.split(", ")]
        out = pd.DataFrame([(*key, *first, at, seq, step)], columns=names)
        out["next_retry_at"] = pd.to_datetime(out["next_retry_at"])
        return out

    def _set_timer(self, old, new) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        row = tuple(self.row.get()) if self.row.exists() else (None, None, "", False, None, 0, None, None)
        before = row
        arrived = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for x in arrived.itertuples():
            now = int(x.ts.value // 1_000_000)
            age = None if pd.isna(x.age_days) else float(x.age_days)
            row = after(row, x.kind, x.reason, age, bool(x.full_detail) if x.full_detail is not None else False, now, int(x.seq))
        if row[4] is None or row == before:
            return
        self._set_timer(before[6], row[6])
        self.row.update(row)
        yield self._changed(key, row, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.row.exists():
            row = tuple(self.row.get())
            if row[4] == "RETRY_SCHEDULED" and row[6] is not None and row[6] <= expiredTimerInfo.getExpiryTimeInMs():
                row = (*row[:4], "PENDING", row[5], None, row[7])
                self.row.update(row)
                yield self._changed(key, row, 1)

    def close(self) -> None:
        pass


def queue_changes(arrivals: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows of the queue as they change (CHANGED), of a stream of ARRIVING rows, whose times are after 1970 began. ``step`` is 1 where a timer made the change."""
    keyed = arrivals.withWatermark("ts", late).groupBy("paper_id", "source")
    return keyed.transformWithStateInPandas(QueueProcessor(), CHANGED, "Update", "EventTime")


def run_queue(arrivals_of, path: str, folder: str, spark: SparkSession, late: str = "1 hour", files: int = 1) -> tuple[DataFrame, list[dict]]:
    """(the queue after all files that match ``path``, the state operator's figures of each batch); resumable on ``folder``.

    ``arrivals_of`` makes ARRIVING rows of the files' rows. Runs in a session of its own, whose state store keeps keys on disk.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    place, _, name = path.rpartition("/")
    stream = own.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(place)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    job = queue_changes(arrivals_of(stream), late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    running = job.trigger(availableNow=True).start()
    running.awaitTermination()
    figures = [{"batch": p["batchId"], "rows": p["stateOperators"][0]["numRowsTotal"] if p["stateOperators"] else 0} for p in running.recentProgress]
    return newest(spark.read.schema(f"{CHANGED}, batch bigint").parquet(f"{folder}/changes")), figures


def newest(changes: DataFrame) -> DataFrame:
    """The last change of each key; within a batch a timer's comes after an arrival's."""
    columns = [c for c in changes.columns if c not in ("paper_id", "source", "batch", "step")]
    last = F.max_by(F.struct(*columns), F.struct("batch", "step"))
    return changes.groupBy("paper_id", "source").agg(last.alias("s")).select("paper_id", "source", "s.*")
