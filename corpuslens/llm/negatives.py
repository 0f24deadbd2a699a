"""Hard negatives by rotated one-bit codes with deterministic error intervals.

A vector is made whole numbers, brought to unit length, padded to a power of two and rotated by fixed sign
flips and Hadamard transforms. Its code keeps the signs of the rotated
coordinates, one bit each, and the alignment of the vector with its code vector (signs
over the root of the dimension). What the code leaves over is coded again, ``LEVELS``
times; the length of the last rest is kept too. An anchor is rounded to ``PLANES`` bits a coordinate, so
its product with a code vector is a sum of popcounts, and

    score = |v| |a| (sum of alignment * <code vector, rounded anchor> + sum of alignment * <code vector, rounding> + <rest, anchor>)

where Cauchy-Schwarz bounds the products of the last two terms by the lengths of rounding and rest: an interval that
surely holds the score. Only rows whose interval reaches the best lower bounds (positives) or a wanted band
(negatives) have their whole-number products worked out; so results are exact and the codes only save work.

Anchors and rows are dealt into blocks by a hash of their ids; each pair of blocks is one
task, which returns the few best of each anchor, and Spark ranks those. No more than
``5`` positives and ``3`` negatives for each of them leave a block, so what is shuffled grows with anchors times blocks.

Cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; rows
equal in id, label and whole numbers count once; rows that share an id with an anchor are never its positives or negatives;
shorter vectors count as padded with zeros; equal vectors tie and go by vec_id; an empty table gives no rows; other columns are ignored. Scores
beyond 2**53 cannot be told apart in doubles and raise an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import materialise, read

LEVELS = 6
PLANES = 7
POSITIVES = 5
NEGATIVES = 3
#: Band of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows in a block of vectors, and in a block of anchors.
BLOCK_ROWS = 16_384
ANCHOR_ROWS = 1_024
SEED = 20_011

CODED = "vec_id long, label int, size double, ints binary, code binary, alignment array<double>, rest double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The rows turned by three rounds of fixed sign flips and Hadamard transforms."""
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def width(size: int) -> int:
    """The power of two, 64 at least, that holds so many components."""
    return max(64, 1 << max(0, size - 1).bit_length())


def units(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit vectors and lengths of whole-number rows; a zero row stays zero."""
    size = np.sqrt((ints.astype(float) ** 2).sum(axis=1))
    return rotated(ints / np.where(size > 0, size, 1)[:, None]), size


def encode(unit: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits as 64-bit words by level, alignments by level, length of the last rest) of rotated unit vectors."""
    n, d = unit.shape
    rest, codes, alignments = unit.copy(), [], []
    for level in range(levels):
        turned = rest if not level else rotated(rest, SEED + level)
        sign = turned >= 0
        along = np.abs(turned).sum(axis=1) / np.sqrt(d)
        codes.append(np.packbits(sign, axis=1, bitorder="little").view(np.uint64).reshape(n, d // 64))
        alignments.append(along)
        rest = turned - along[:, None] * np.where(sign, 1.0, -1.0) / np.sqrt(d)
    return np.stack(codes, axis=1), np.stack(alignments, axis=1), np.sqrt((rest**2).sum(axis=1))


class Anchor:
    """An anchor's rotated unit vector, rounded to PLANES bits a coordinate, one set of bit planes a level."""

    def __init__(self, unit: np.ndarray, planes: int = PLANES, levels: int = LEVELS):
        self.scale, self.words, self.sums, self.loss = [], [], [], []
        turned = unit[None]
        for level in range(levels):
            turned = turned if not level else rotated(turned, SEED + level)
            step = max(float(np.abs(turned).max()), 1e-12) / (2 ** (planes - 1) - 1)
            whole = np.rint(turned[0] / step).astype(np.int64)
            shifted = whole + 2 ** (planes - 1)  # so that all planes count up
            bits = (shifted[None] >> np.arange(planes)[:, None]) & 1
            self.words.append(np.packbits(bits.astype(bool), axis=1, bitorder="little").view(np.uint64))
            self.sums.append(int(shifted.sum()))
            self.scale.append(step)
            self.loss.append(float(np.sqrt(((turned[0] - step * whole) ** 2).sum())))

    def estimate(self, block: Block, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, error bound) of the unit products with rows of a block."""
        error = block.rest[rows] + 1e-9  # the anchor has length 1
        middle = np.zeros(len(error))
        for level, planes in enumerate(self.words):
            own = block.words[level][:, rows]
            hits = np.zeros(len(error), np.int32)
            for p, plane in enumerate(planes):
                for word, bits in zip(own, plane, strict=True):
                    hits += np.bitwise_count(word & bits).astype(np.int32) << p
            # sum of signs * whole = 2 * (shifted over set bits) - (shifted over all) - offset * (set - unset)
            offset, d = 2 ** (len(planes) - 1), 64 * len(own)
            whole = 2 * hits - offset * (2 * block.ones[level][rows] - d) - self.sums[level]
            along = block.along[level][rows]
            middle += (self.scale[level] / np.sqrt(d)) * along * whole
            error += self.loss[level] * along
        return middle, error

    def interval(self, block: Block, rows: slice, size: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of rows of a block."""
        middle, error = self.estimate(block, rows)
        length = block.size[rows] * size
        return (middle - error) * length - 0.5, (middle + error) * length + 0.5


class Block:
    """Columns of coded rows as arrays, ordered by label and id; codes by level and word."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        n = self.n = table.num_rows
        column = lambda c: table[c].to_numpy()
        flat = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind).reshape(n, -1)
        self.ids, self.labels, self.size, self.rest = (column(c) for c in ("vec_id", "label", "size", "rest"))
        self.ints = flat("ints", np.float64)
        self.along = np.ascontiguousarray(table["alignment"].combine_chunks().flatten().to_numpy().reshape(n, -1).T)
        levels = len(self.along)
        self.words = np.ascontiguousarray(flat("code", np.uint64).reshape(n, levels, -1).transpose(1, 2, 0))
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int32)

    def of(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right")))


def whole(c: str = "embedding") -> Column:
    """Whole numbers of a vector's components."""
    return F.transform(c, lambda x: F.floor(256 * x.cast("double")).cast("double"))


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, ints) of the rows that take part, repeated ones once."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), whole(vector_col).alias("ints")).distinct()


def code(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Coded rows, written: whole numbers, length, code bits and alignments by level, and the length of the last rest."""
    size = rows.agg(F.max(F.size("ints"))).first()[0] or 0

    def coded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ints = np.zeros((part.num_rows, width(size)))
                for i, v in enumerate(part["ints"]):
                    ints[i, : len(v)] = v.values.to_numpy(zero_copy_only=False)
                unit, length = units(ints)
                if len(length) and float(length.max()) ** 2 >= 2.0**53:
                    raise ValueError("scores would pass 2**53")
                bits, along, rest = encode(unit, levels)
                columns = [part["vec_id"], part["label"], pa.array(length), pa.array([v.tobytes() for v in ints], pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(list(along), pa.list_(pa.float64())), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CODED.split(", ")])

    return materialise(rows.mapInArrow(coded, CODED), "negatives-coded")


def met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, task: Callable, schema: str) -> DataFrame:
    """``task`` over every pair of a block of anchors and a block of rows."""
    high, wide = max(1, -(-n_anchors // ANCHOR_ROWS)), max(1, -(-n_rows // BLOCK_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("i", dealt(high)).withColumn("j", every(wide))
    right = rows.withColumn("j", dealt(wide)).withColumn("i", every(high))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(task, schema)


def best_first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


def _positives(n: int):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            block = Block(right)
            for anchor in anchors_of(left):
                own = block.of(anchor["label"])
                other = block.ids[own] != anchor["vec_id"]
                if other.sum() > n:
                    low, high = anchor["codes"].interval(block, own, anchor["size"])
                    other &= high >= np.partition(low[other], -n)[-n]
                at = own.start + np.flatnonzero(other)
                scores = block.ints[at] @ anchor["ints"]
                top = best_first(scores, block.ids[at], n)
                for column, values in zip(out, ([anchor["vec_id"]] * len(top), block.ids[at][top], scores[top].astype(np.int64)), strict=True):
                    column.extend(values)
        return pa.table({"anchor_id": pa.array(out[0], pa.int64()), "positive_id": pa.array(out[1], pa.int64()), "positive_score": pa.array(out[2], pa.int64())})

    return task


def anchors_of(left: pa.Table):
    block = Block(left)
    unit, _ = units(block.ints)
    more = {c: left.sort_by([("label", "ascending"), ("vec_id", "ascending")])[c].to_pylist() for c in left.column_names if c == "positives"}
    for k in range(block.n):
        yield {"vec_id": int(block.ids[k]), "label": block.labels[k], "size": block.size[k], "ints": block.ints[k], "codes": Anchor(unit[k])} | {c: v[k] for c, v in more.items()}


def _negatives(n: int, low_share: int, high_share: int):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            block = Block(right)
            for anchor in anchors_of(left):
                other = block.ids != anchor["vec_id"]
                other[block.of(anchor["label"])] = False
                low, high = anchor["codes"].interval(block, slice(None), anchor["size"])
                bands, near = [], np.zeros(block.n, bool)
                for p in anchor["positives"]:
                    score = p["positive_score"]
                    least, most = -(-low_share * score // 100), high_share * score // 100
                    may = (high >= least) & (low <= most) & other
                    sure = low[may & (low >= least) & (high <= most)]
                    if len(sure) > n:
                        may &= high >= np.partition(sure, -n)[-n]
                    bands.append((p["positive_id"], score, least, most))
                    near |= may
                at = np.flatnonzero(near)
                scores = (block.ints[at] @ anchor["ints"]).astype(np.int64)
                for positive, score, least, most in bands:
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    top = inside[best_first(scores[inside], block.ids[at][inside], n)]
                    for column, values in zip(out, ([anchor["vec_id"]] * len(top), [positive] * len(top), [score] * len(top), block.ids[at][top], scores[top]), strict=True):
                        column.extend(values)
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, out, strict=True)})

    return task


def mine(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **named
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hardest negatives of each anchor and positive.

    ``anchors``: a condition on vec_id and label. Positives are the best other rows of the anchor's
    label; negatives the best rows of other labels with a score in the band of ``low`` to ``high`` hundredths of the positive's.
    """
    rows = code(valid(vectors, **named))
    own = rows.filter(anchors)
    n_rows, n_anchors = rows.count(), own.count()
    near = met(own, rows, n_anchors, n_rows, _positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives)
    lists = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # so few of each
    asked = materialise(own.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "negatives-asked")
    far = met(asked, rows, n_anchors, n_rows, _negatives(negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_one_bit_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)
