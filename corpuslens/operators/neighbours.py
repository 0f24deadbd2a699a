"""Neighbours by cells: an exact metric range join, and an inverted-file index for nearest neighbours.

Vectors are dealt into the cells of a bounded number of centres, each to its nearest one. A vector meets the
cells that may hold partners (range join) or the nearest few (index). Cells are cut into blocks
by a hash of the id, so one that holds a third of all vectors is as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import vector as V
from corpuslens.operators.components import kept

#: Centres at most, rows that k-means is fitted on at most, and rows whose true neighbours set the number of probed cells.
MOST_CENTRES = 1024
FIT_ROWS = 20_000
TRIAL_ROWS = 200
BLOCK_ROWS = 4096
VISITOR_ROWS = 65_536
#: Owners and visitors of a task of a range join at most, and those of one that holds all pairs it finds; and the number of groups and parts at least.
GROUP_ROWS = 65_536
PAIR_ROWS = 8192
FEWEST = 6
#: Distances that a task of a range join holds at a time.
SLICE_CELLS = 1 << 21


def matrix(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    """A list column as rows of doubles."""
    own = table[column].combine_chunks() if isinstance(table, pa.Table) else table[column]
    return own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b``, by a matrix product; small ones are off by rounding."""
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)))


def first_rows(points: DataFrame, n: int) -> np.ndarray:
    """The vectors of the ``n`` ids with the smallest hashes."""
    rows = points.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(n).collect()
    return np.array([r["vector"] for r in rows], float)


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``points`` (id, vector, and a number ``extra`` where there is one) with their nearest centre (``cell``) and ``gap`` to it, written."""
    given = ["id", "vector", *(["extra"] if "extra" in points.columns else [])]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                far = gaps(matrix(part, "vector"), centres)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in given), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], [*given, "cell", "gap"])

    return kept(points.select(*given).mapInArrow(assign, "id long, vector array<double>, " + ("extra double, " if len(given) > 2 else "") + "cell int, gap double"))


def visiting(rows: DataFrame, centres: np.ndarray, cells: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, vector, cell): a row for each cell that a vector visits. ``cells``: distances to all centres -> boolean matrix."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                i, c = np.nonzero(cells(gaps(matrix(part, "vector"), centres)))
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(i)), part["vector"].take(pa.array(i)), pa.array(c.astype(np.int32))], ["id", "vector", "cell"])

    return rows.select("id", "vector").mapInArrow(visit, "id long, vector array<double>, cell int")


def met(owners: DataFrame, visitors: DataFrame, task: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int = BLOCK_ROWS, visitor_rows: int = VISITOR_ROWS) -> DataFrame:
    """``task`` over every block of a cell's owners and the visitors of that cell."""
    spark = owners.sparkSession
    sizes = {r["cell"]: -(-r["count"] // block_rows) for r in owners.groupBy("cell").count().collect()}  # one number a centre
    parts = max(1, -(-owners.count() // visitor_rows))
    blocks = spark.createDataFrame(list(sizes.items()) or [(0, 1)], "cell int, blocks int")
    one = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = owners.join(F.broadcast(blocks), "cell").withColumn("block", one(F.col("blocks"))).withColumn("part", every(F.lit(parts))).drop("blocks")
    right = visitors.join(F.broadcast(blocks), "cell").withColumn("block", every(F.col("blocks"))).withColumn("part", one(F.lit(parts))).drop("blocks")
    keys = ["cell", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, schema)


def chained(pivots: np.ndarray) -> np.ndarray:
    """An order of the pivots in which each is followed by the nearest of those left."""
    far, order = gaps(pivots, pivots), [0]
    far[:, 0] = np.inf
    for _ in range(len(pivots) - 1):
        order.append(int(far[order[-1]].argmin()))
        far[:, order[-1]] = np.inf
    return np.array(order)


def ranged(points: DataFrame, eps: float, task: Callable[[Iterator[tuple]], pa.Table], schema: str, centres: int | None = None, most: int = GROUP_ROWS) -> DataFrame:
    """``task`` over all pairs of (id, vector, extra) rows within Euclidean distance ``eps``, exact, both ways and without a row's own.

    A task gets its pairs as slices (id, other, distance, extra, other's extra) of arrays; all of one id in a task come in runs, a run for each slice of others.

    Centres are pivots: the vectors of the ids with the smallest hashes, some root of their number. A partner in cell c
    lies within the radius of c, so the vector is no farther than radius + eps from the pivot; and as
    the partner is nearer to its own pivot than to the vector's, no farther than its own gap + 2 eps. Cells near to one another
    are one group of ``most`` rows at most (a larger cell is cut), and a vector visits a group once,
    whatever the number of its cells that may hold partners; the task tells them apart again.
    """
    n = points.count()
    pivots = first_rows(points, centres or int(min(MOST_CENTRES, max(1, np.sqrt(n)))))
    if not len(pivots):
        return points.sparkSession.createDataFrame([], schema)
    rows = assigned(points, pivots)
    radius, held = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in rows.groupBy("cell").agg(F.max("gap").alias("r"), F.count("*").alias("n")).collect():  # a row a centre
        radius[r["cell"]], held[r["cell"]] = r["r"], r["n"]
    slack = 1e-6 * (1 + float(np.abs(pivots).max()))
    side = min(most, max(1, -(-n // FEWEST)))
    group_of, group, size = np.zeros(len(pivots), np.int32), 0, 0
    for c in chained(pivots):
        if size and size + held[c] > side:
            group, size = group + 1, 0
        group_of[c], size = group, size + held[c]
    member = np.zeros((len(pivots), group + 1))
    member[np.arange(len(pivots)), group_of] = 1

    def near(far: np.ndarray, gap: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return (far <= radius[cells] + eps + slack) & (far <= gap[:, None] + 2 * eps + slack)

    def place(own: bool):
        every = np.arange(len(pivots))

        def to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    if own:
                        i, g = np.arange(part.num_rows), group_of[part["cell"].to_numpy()]
                    else:
                        i, g = np.nonzero(near(gaps(matrix(part, "vector"), pivots), part["gap"].to_numpy(), every) @ member)
                    yield pa.RecordBatch.from_arrays([*(part[c].take(pa.array(i)) for c in ("id", "vector", "cell", "gap", "extra")), pa.array(g.astype(np.int32))], names)

        return to

    names = ["id", "vector", "own", "gap", "extra", "cell"]
    placed = "id long, vector array<double>, own int, gap double, extra double, cell int"
    def slices(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        own, x, ids, others = left["own"].to_numpy(), left["extra"].to_numpy(), left["id"].to_numpy(), right["id"].to_numpy()
        a, b, y, gap = matrix(left, "vector"), matrix(right, "vector"), right["extra"].to_numpy(), right["gap"].to_numpy()
        for c in np.unique(own):
            mine, cell = np.flatnonzero(own == c), np.array([c])
            theirs = np.flatnonzero(near(gaps(b, pivots[cell]), gap, cell)[:, 0])
            step = max(1, SLICE_CELLS // max(1, len(theirs)))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                i, j = np.nonzero((gaps(a[some], b[theirs]) <= eps + slack) & (ids[some, None] != others[theirs]))
                i, j = some[i], theirs[j]
                for k in range(0, len(i), 50_000):
                    p, q = i[k : k + 50_000], j[k : k + 50_000]
                    far = np.sqrt(((a[p] - b[q]) ** 2).sum(axis=1))
                    p, q, far = p[far <= eps], q[far <= eps], far[far <= eps]
                    yield ids[p], others[q], far, x[p], y[q]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return task(slices(left, right) if left.num_rows and right.num_rows else iter(()))

    return met(rows.mapInArrow(place(True), placed), rows.mapInArrow(place(False), placed), run, schema, side, side)


def range_join(points: DataFrame, eps: float, centres: int | None = None) -> DataFrame:
    """(u, v, distance): all pairs u < v of (id, vector) rows within Euclidean distance ``eps``, exact; see ranged().

    Rows with a null id or vector have no partners. Equal vectors give all their pairs: collapse them first.
    """

    def pairs(found: Iterator[tuple]) -> pa.Table:
        parts = [(u[u < v], v[u < v], far[u < v]) for u, v, far, _, _ in found]
        u, v, far = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 3
        return pa.table({"u": u.astype(np.int64), "v": v.astype(np.int64), "distance": far.astype(float)})

    rows = points.filter("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector", F.lit(0.0).alias("extra"))
    return ranged(rows, eps, pairs, "u long, v long, distance double", centres, PAIR_ROWS)


class CellIndex:
    """An inverted-file index of unit vectors: k-means cells, every vector in one, ``probes`` nearest cells asked.

    Cells are fitted on at most ``FIT_ROWS`` vectors (those with the smallest id hashes). The number of
    probes is the least that finds ``recall`` of the true neighbours of ``TRIAL_ROWS`` vectors, held
    against all vectors when the index is built; vectors without structure need many probes, clustered ones few.
    """

    def __init__(self, vectors: DataFrame, k: int = 5, recall: float = 0.95, cells: int | None = None, id_col: str = "paper_id", seed: int = 11):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.k = k
        unit = V.normalized(F.col("embedding"))
        self.points = kept(vectors.select(F.col(id_col).cast("long").alias("id"), unit.alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL"))
        self.n = self.points.count()
        cells = cells or int(min(MOST_CENTRES, max(1, np.sqrt(self.n))))
        hashed = F.xxhash64("id")
        share = FIT_ROWS / max(1, self.n)
        sample = self.points if share >= 1 else self.points.filter(F.pmod(hashed, F.lit(1_000_000)) < int(share * 1_000_000))
        if min(cells, self.n) > 1:
            model = KMeans(k=min(cells, self.n), maxIter=10, seed=seed, featuresCol="features").fit(sample.select(array_to_vector("vector").alias("features")))
            self.centres = np.array(model.clusterCenters())
        else:
            self.centres = first_rows(self.points, 1)
        self.rows = assigned(self.points, self.centres) if self.n else None
        self.probes = self._probes(recall) if self.n > 1 else 1

    def _probes(self, recall: float) -> int:
        """The number of cells, nearest first, that hold ``recall`` of the true neighbours of the trial rows."""
        trial = [(r["id"], r["vector"]) for r in self.points.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIAL_ROWS).collect()]
        ids, asked, k = np.array([i for i, _ in trial]), np.array([v for _, v in trial], float), self.k

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    own, cell = part["id"].to_numpy(), part["cell"].to_numpy()
                    similar = asked @ matrix(part, "vector").T
                    similar[ids[:, None] == own] = -np.inf
                    top = np.argsort(-similar, axis=1, kind="stable")[:, :k]
                    i = np.repeat(np.arange(len(ids)), top.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(cell[top.ravel()]), pa.array(own[top.ravel()]), pa.array(similar[i, top.ravel()])], ["trial", "cell", "id", "similarity"])

        found = self.rows.select("id", "vector", "cell").mapInArrow(best, "trial long, cell int, id long, similarity double").filter("similarity > double('-infinity')")
        order = Window.partitionBy("trial").orderBy(F.desc("similarity"), "id")
        true = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("trial", "cell").collect()  # k a trial row
        place = gaps(asked, self.centres).argsort(axis=1).argsort(axis=1)
        needed = np.sort([place[r["trial"], r["cell"]] for r in true])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1

    def neighbours(self) -> DataFrame:
        """(id, neighbour, similarity, rank): up to k nearest others of every vector.

        Rows whose probed cells hold fewer than k others are searched exactly against all vectors.
        """
        k, n = self.k, self.n
        if n < 2:
            return self.points.sparkSession.createDataFrame([], "id long, neighbour long, similarity double, rank int")
        probes, schema = min(self.probes, len(self.centres)), "id long, neighbour long, similarity double"

        def nearest_cells(far: np.ndarray) -> np.ndarray:
            out = np.zeros(far.shape, bool)
            np.put_along_axis(out, np.argpartition(far, probes - 1, axis=1)[:, :probes], True, axis=1)
            return out

        found = met(self.rows, visiting(self.rows, self.centres, nearest_cells), _nearest(k), schema)
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "neighbour"))
        found = kept(found.withColumn("rank", rank).filter(F.col("rank") <= k))
        enough = found.groupBy("id").count().filter(F.col("count") >= min(k, n - 1)).select("id")
        short = kept(self.points.join(enough, "id", "left_anti"))
        n_short = short.count()
        if not n_short:
            return found
        asked = short.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_short // BLOCK_ROWS)))).cast("int")).withColumnRenamed("block", "cell")
        blocks = [r["cell"] for r in asked.select("cell").distinct().collect()]
        every = self.points.withColumn("cell", F.explode(F.array(*[F.lit(b) for b in blocks])))
        exact = met(every, asked, _nearest(k), schema).withColumn("rank", rank).filter(F.col("rank") <= k)
        return found.join(enough, "id", "left_semi").select(*exact.columns).unionByName(exact)


def _nearest(k: int):
    """The k owners of a block most similar to each visitor."""

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            own, ids, a, b = left["id"].to_numpy(), right["id"].to_numpy(), matrix(left, "vector"), matrix(right, "vector")
            for at in range(0, len(ids), 512):
                similar = np.round(b[at : at + 512] @ a.T, 12)
                similar[ids[at : at + 512, None] == own] = -np.inf
                top = np.argsort(-similar, axis=1, kind="stable")[:, :k]  # of equal ones the smaller id
                value = np.take_along_axis(similar, top, 1)
                good = value > -np.inf
                for column, values in zip(out, (np.repeat(ids[at : at + 512], good.sum(axis=1)), own[top[good]], value[good]), strict=True):
                    column.append(values)
        whole = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"id": whole[0].astype(np.int64), "neighbour": whole[1].astype(np.int64), "similarity": whole[2].astype(float)})

    return nearest


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that ``found`` has."""
    hits = exact.join(found.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count()
    return hits / max(1, exact.count())
