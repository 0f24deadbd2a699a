"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A bin is filled greedily (largest piece that fits, again and again); then its
smallest piece gives way to two unpacked pieces that together fit the expanded
gap more tightly. Bins depend on lengths alone, so the plan is made on the
histogram of lengths, which has ``capacity`` entries however large the corpus:
each distinct filling is planned once with the number of times it is used, and uses up
a length, so there are no more fillings than lengths. Pieces then find their place by
their rank among the pieces of their length. Ranks are counted in hashed lanes, the more
the more pieces have a length, so a length that a third of all pieces have is no single
task's work.

Cases: null text is empty and gives the end id alone; a document over the
capacity is cut, its first piece taking the remainder; repeated rows are packed
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import batches_of, filled, materialise, read
from corpuslens.llm.tokens import units

CAPACITY = 2048
END = b"\0\0\0\0"
#: Rows of a length that are ranked together, about.
LANE_ROWS = 50_000
#: Shares of all tokens that are packed by greedy filling alone, one after the other.
LAST_SHARES = (0, 1 / 256, 1 / 64, 1 / 16, 1 / 4, 1)
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    head = (n - 1) % capacity + 1
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def piece_table(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with the checksum of its ids, written once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = units(tokenizer)
        for batch in batches_of(batches, 1000, 4 << 20, "text"):
            out = []
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                ids = vocabulary.ids(text) + END
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PIECE_TYPES)], [c.split()[0] for c in PIECES.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    return materialise(rows.mapInArrow(encode, PIECES), "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times used, lengths in a bin) that use up ``counts`` exactly.

    Replacing uses up small pieces that the last bins could want. So the plan is also made with
    the last ``share`` of all tokens filled greedily alone, and the one of fewest bins is taken;
    with all of them filled so, that is first fit by decreasing length, which bounds it.
    """
    volume = sum(length * n for length, n in counts.items())
    best: list[tuple[int, list[int]]] = []
    fewest = None
    for share in LAST_SHARES:
        made = _plan(counts, capacity, int(share * volume))
        bins = sum(times for times, _ in made)
        if fewest is None or bins < fewest:
            best, fewest = made, bins
        if fewest * capacity < volume + capacity:  # no plan has fewer
            break
    return best


def _plan(counts: dict[int, int], capacity: int, last: int) -> list[tuple[int, list[int]]]:
    """One plan; with ``last`` tokens left or fewer, bins are filled without replacing."""
    volume = sum(length * n for length, n in counts.items())
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plans: list[tuple[int, list[int]]] = []

    def largest(limit: int, used: dict[int, int]) -> int:
        """The largest length up to ``limit`` of which a piece is left."""
        for length in reversed(np.flatnonzero(left[: limit + 1] > 0)):
            if left[length] > used.get(int(length), 0):
                return int(length)
        return 0

    def best_pair(limit: int, above: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum over ``above`` and up to ``limit``."""
        free = np.flatnonzero(left[: limit + 1] > 0)
        free = np.array([x for x in free if left[x] > used.get(int(x), 0)], np.int64)
        best, pair = above, None
        j = len(free) - 1
        i = 0
        while i <= j and best < limit:
            a, b = int(free[i]), int(free[j])
            if a + b > limit:
                j -= 1
                continue
            if a + b > best and (a != b or left[a] - used.get(a, 0) >= 2):
                best, pair = a + b, (b, a)
            i += 1
        return pair

    while True:
        top = largest(capacity, {})
        if not top:
            return plans
        filled_with, used, gap = [top], {top: 1}, capacity - top
        while gap and (x := largest(gap, used)):
            filled_with.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        if gap and len(filled_with) > 1 and volume > last:
            small = filled_with[-1]
            used[small] -= 1
            if pair := best_pair(gap + small, small, used):
                filled_with[-1:] = pair
                for x in pair:
                    used[x] = used.get(x, 0) + 1
            else:
                used[small] += 1
        times = int(min(left[x] // n for x, n in used.items() if n))
        for x, n in used.items():
            left[x] -= n * times
            volume -= x * n * times
        plans.append((times, sorted(filled_with, reverse=True)))


def place(pieces: DataFrame, capacity: int = CAPACITY, lane_rows: int = LANE_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset. The driver sees one count per length and lane."""
    per_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lanes = [max(1, -(-per_length.get(length, 0) // lane_rows)) for length in range(capacity + 1)]
    own_lanes = F.element_at(F.lit(lanes), F.col("length") + 1)
    laned = pieces.withColumn("__lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), own_lanes).cast("int"))
    counted = laned.groupBy("length", "__lane").agg(F.count("*").alias("n")).collect()
    # From which rank of its length each lane counts: lanes stand end to end, length by length.
    begin = np.cumsum([0, *lanes])
    firsts = np.zeros(begin[-1], np.int64)
    for row in counted:
        firsts[begin[row["length"]] + row["__lane"]] = row["n"]
    ends = np.cumsum(firsts)
    firsts = ends - firsts - np.repeat(np.r_[0, ends][begin[:-1]], lanes)
    # Per length: from which rank a filling takes pieces, how many at a time, its first sequence and offset.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, lengths in plan(per_length, capacity):
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            slots.setdefault(length, []).append((taken.get(length, 0), each, sequence, offset))
            taken[length] = taken.get(length, 0) + each * times
            offset += each * length
        sequence += times
    tables = {length: np.array(rows, np.int64) for length, rows in slots.items()}

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = firsts[begin[length] + batch["__lane"].to_numpy()] + batch["__rank"].to_numpy() - 1
            order = np.argsort(length, kind="stable")
            sequence_id, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    table = tables[int(length[own[0]])]
                    row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                    within = rank[own] - row[:, 0]
                    sequence_id[own] = row[:, 2] + within // row[:, 1]
                    offset[own] = row[:, 3] + within % row[:, 1] * length[own]
            columns = [batch[c] for c in ("doc_id", "piece", "start")]
            columns += [pa.array(length.astype(np.int64)), batch["ids_crc32"], pa.array(sequence_id), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PLACED.split(", ")])

    lane = Window.partitionBy("length", "__lane").orderBy("doc_id", "piece", "ids_crc32")
    return laned.withColumn("__rank", F.row_number().over(lane)).mapInArrow(locate, PLACED)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    return place(piece_table(docs, capacity, tokenizer), capacity)


def op1_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
