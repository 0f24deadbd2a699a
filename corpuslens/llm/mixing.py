"""Mixing sources to target weights by weighted fair queueing.

The documents of each source stand in a shuffled queue (by a hash of their ids), which may be
walked ``MOST_COPIES`` times. The copy of a document at place p of its source's queue, counted in
words up to its end, has the virtual finish time p / target. All copies in order of
that time are the mix; it is cut where its words would pass the budget, the words of all
documents. Targets share the budget by weight; none is above ``MOST_COPIES`` times its source's
words, and what that leaves is shared again.

Everything is columns of DataFrames. Places are running sums in two steps: over buckets of
leading hash digits, which split a hot source, and within a bucket. The global order is cut the same way: sums over ranges of virtual time first,
then the copies of the one range where the budget ends. The numbers of buckets and ranges grow with the
rows and change no result. Per source there is one row of weights, and only those rows are ordered as one.

Cases: a null text has no words and is never taken, like an empty one; a null source comes last; a
null doc_id counts as an empty one; repeated rows stand side by side in their queue, each with a place of its own; rows with one doc_id and
different texts are ordered by size; an empty table gives no rows; very long texts are taken or left whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import filled, materialise, read

#: Weights of the sources in their order, repeated.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a bucket of a queue or a range of virtual time, and the least number of them.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 512


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, mark): words of each document and the hash that shuffles it. Texts are read here only."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(filled(text_col), F.lit(WORD)).cast("long").alias("size"), key.alias("mark"))
    return materialise(rows, "mix-sized")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_rank, source_size, target) of (source, source_size) rows: the budget shared by weight, no source above ``most`` times its size.

    From the smallest size per weight on: a source is full if its share of what the full ones before it have left is over its cap.
    """
    rank = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("long")
    rows = sources.withColumn("source_rank", rank)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source_rank")
    rows = rows.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    full = wide("left") * wide("weight") > most * wide("source_size") * wide("weights")
    level = F.max(F.when(~full, F.col("left") / F.col("weights"))).over(Window.partitionBy())
    return rows.select("source", "source_rank", "source_size", F.when(full, (most * F.col("source_size")).cast("double")).otherwise(level * F.col("weight")).alias("target"))


def queues(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, bucket_rows: int = BUCKET_ROWS, **named) -> DataFrame:
    """(doc_id, source, size, source_rank, source_size, target, place): each document at its place, in words, of its source's shuffled queue."""
    rows = sized(docs, **named)
    buckets = max(LEAST_BUCKETS, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * F.lit(buckets), 32))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    shares = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    starts = sums.withColumn("start", before).withColumnRenamed("source", "s").join(shares, F.col("s").eqNullSafe(F.col("source")))
    starts = starts.select("s", F.col("bucket").alias("b"), "start", "source_rank", "source_size", "target")
    joined = rows.join(starts, rows["source"].eqNullSafe(starts["s"]) & (rows["bucket"] == starts["b"]))
    own = Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.withColumn("place", F.col("start") + F.sum("size").over(own))
    return materialise(placed.select("doc_id", "source", "size", "source_rank", "source_size", "target", "place"), "mix-queues")


def finish(copy: int) -> Column:
    """Virtual finish time of the copy; null for a source without words."""
    return (F.col("place") + copy * F.col("source_size")) / F.nullif("target", F.lit(0.0))


def copies(queued: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """One row for each copy that may be taken: doc_id, source, size, source_rank, copy, finish."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("copy"), finish(c).alias("finish")) for c in range(most)]))
    return queued.filter("size > 0").select("doc_id", "source", "size", "source_rank", each.alias("x")).select("doc_id", "source", "size", "source_rank", "x.copy", "x.finish")


def cutoff(queued: DataFrame, budget: int | None = None, most: int = MOST_COPIES, range_rows: int = BUCKET_ROWS) -> tuple[float, int]:
    """(finish, source_rank) of the last copy within the budget: the words of all documents unless given.

    Copies of one source have different times, so the pair tells all copies apart. Ranges of
    log(1 + time) hold about as many words each where it matters and are few for late copies.
    """
    rows, total = queued.agg(F.count("*"), F.sum("size")).first()
    budget = (total or 0) if budget is None else budget
    ranges = max(LEAST_BUCKETS, -(-rows // range_rows))
    cut = copies(queued, most).withColumn("range", F.floor(ranges * F.log2(1 + F.col("finish"))))
    sums = cut.groupBy("range").agg(F.sum("size").alias("words"))
    upto = sums.withColumn("upto", F.sum("words").over(Window.orderBy("range")))
    over = upto.filter(F.col("upto") > budget).agg(F.min(F.struct("range", "upto", "words")).alias("x")).first()["x"]
    if over is None:
        return float("inf"), 0
    order = Window.orderBy("finish", "source_rank").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.filter((F.col("range") == over["range"])).withColumn("upto", F.sum("size").over(order) + (over["upto"] - over["words"]))
    found = last.filter(F.col("upto") <= budget).agg(F.max(F.struct("finish", "source_rank")).alias("x")).first()["x"]
    if found is not None:
        return found["finish"], found["source_rank"]
    earlier = cut.filter(F.col("range") < over["range"]).agg(F.max(F.struct("finish", "source_rank")).alias("x")).first()["x"]
    return (earlier["finish"], earlier["source_rank"]) if earlier else (-1.0, 0)


def within(time: Column, cut: tuple[float, int]) -> Column:
    """Whether a copy comes at or before the cut."""
    return F.coalesce((time < F.lit(cut[0])) | ((time == F.lit(cut[0])) & (F.col("source_rank") <= F.lit(cut[1]))), F.lit(False))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, budget: int | None = None, **named) -> DataFrame:
    """(doc_id, source, size, copy, finish): the mix in its order, range-sorted by virtual finish time."""
    queued = queues(docs, weights, most, **named)
    cut = cutoff(queued, budget, most)
    return copies(queued, most).filter(within(F.col("finish"), cut)).orderBy("finish", "source_rank").drop("source_rank")


def op11_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = queues(read(spark, sf_dir, "documents"))
    cut = cutoff(queued)
    times = sum(within(finish(c), cut).cast("long") for c in range(MOST_COPIES))
    return queued.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "source")
