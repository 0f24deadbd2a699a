"""Hierarchical density clustering: core distances, minimum spanning forest, condensed tree, most stable clusters.

Equal vectors are one point with a weight. Points within ``eps`` of one another come from an exact range join.
The core distance of a point is that to its ``core``-th other (copies count); the mutual reachability of two points
is the largest of their distance and core distances. A task sends on the minimum spanning forest of the pairs that meet in it, and
Boruvka rounds over DataFrames give the minimum spanning forest of reachabilities up to ``eps``. Each tree of the forest is then cut
at falling distances: a part of ``min_size`` papers and more is a cluster of its own, a smaller one falls
out of its cluster. A cluster's stability is the sum, over its papers, of 1 / distance where they leave less 1 / distance where it
began; clusters are kept where they are at least as stable as those within them.

What is whole in one task is one tree of the forest, as 24 bytes a distinct point (no vectors).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import vector as V
from corpuslens.operators.components import components, kept
from corpuslens.operators.neighbours import GROUP_ROWS, PAIR_ROWS, ranged

#: Distances below this count as this, so that 1 / distance stays finite.
CLOSEST = 1e-6


def points_of(vectors: DataFrame, id_col: str = "paper_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((id, vector, weight) of distinct unit vectors, (paper_id, id) of all rows). Zero and null vectors have no point."""
    unit = kept(vectors.select(F.col(id_col).alias("paper_id"), V.normalized(F.col(vector_col)).alias("vector")).filter("paper_id IS NOT NULL AND vector IS NOT NULL"))
    hashed = unit.select("paper_id", "vector", F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256).alias("key"))
    firsts = hashed.groupBy("key").agg(F.min("paper_id").alias("id"), F.count("*").alias("weight"))
    members = kept(hashed.select("paper_id", "key").join(firsts.select("key", "id"), "key").select("paper_id", "id"))
    weights = firsts.select("id", "weight")
    return kept(unit.withColumnRenamed("paper_id", "id").dropDuplicates(["id"]).join(weights, "id")), members


def core_distances(points: DataFrame, pairs: DataFrame, core: int) -> DataFrame:
    """(id, core): distance to the ``core``-th other paper; points with fewer within the pairs have no row."""
    ways = pairs.select(F.col("u").alias("id"), F.col("v").alias("other"), "distance").unionByName(pairs.select(F.col("v").alias("id"), F.col("u").alias("other"), "distance"))
    return _cores(points, ways.join(points.select(F.col("id").alias("other"), F.col("weight").alias("n")), "other"), core)


def _cores(points: DataFrame, ways: DataFrame, core: int) -> DataFrame:
    """Core distances of (id, other, distance, n: papers of the other) rows."""
    own = points.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"), (F.col("weight") - 1).alias("n"))
    each = ways.select("id", "other", "distance", "n").unionByName(own)
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("distance", "other").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("upto", upto).filter(F.col("upto") >= core).groupBy("id").agg(F.min("distance").alias("core"))


def _gathered(found: Iterator[tuple], reduce: Callable[..., list[np.ndarray]], most: int = 1 << 20) -> list[np.ndarray]:
    """The slices of arrays as one, reduced whenever they are twice what the last reduction left and ``most`` more."""
    held, rows, left = [], 0, 0
    for part in found:
        held.append(part)
        rows += len(part[0])
        if rows > 2 * left + most:
            held = [tuple(reduce(*(np.concatenate(c) for c in zip(*held, strict=True))))]
            rows = left = len(held[0][0])
    return list(reduce(*(np.concatenate(c) for c in zip(*held, strict=True)))) if held else []


def cores_within(points: DataFrame, eps: float, core: int) -> DataFrame:
    """core_distances() of the pairs within ``eps``, which are not written: a task sends on the ``core`` nearest others of each point."""

    def nearest(ids: np.ndarray, others: np.ndarray, far: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((others, far, ids))
        at, new = np.arange(len(order)), np.append(True, np.diff(ids[order]) != 0)
        best = order[at - np.maximum.accumulate(np.where(new, at, 0)) < core]
        return [c[best] for c in (ids, others, far, n)]

    def task(found: Iterator[tuple]) -> pa.Table:
        ids, others, far, n = _gathered(((i, j, d, n) for i, j, d, _, n in found), nearest) or (np.zeros(0),) * 4
        return pa.table({"id": ids.astype(np.int64), "other": others.astype(np.int64), "distance": far.astype(float), "n": n.astype(np.int64)})

    rows = points.select("id", "vector", F.col("weight").cast("double").alias("extra"))
    return _cores(points, ranged(rows, eps, task, "id long, other long, distance double, n long"), core)


def least_edges(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """The minimum spanning forest, by (weight, u, v), of edges in arrays: what no cycle of theirs rules out."""
    order = np.lexsort((v, u, weight))
    u, v, weight = u[order], v[order], weight[order]
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    name, left, chosen = np.arange(len(nodes)), np.arange(len(u)), np.zeros(len(u), bool)
    while True:
        left = left[name[a[left]] != name[b[left]]]
        if not len(left):
            return [u[chosen], v[chosen], weight[chosen]]
        least = np.full(len(nodes), len(u))
        for side in (a, b):  # the last of equal places written is the least edge of the side
            mine = np.full(len(nodes), len(u))
            mine[name[side[left[::-1]]]] = left[::-1]
            least = np.minimum(least, mine)
        has = np.flatnonzero(least < len(u))
        edge = least[has]
        chosen[edge] = True
        to = np.arange(len(nodes))
        to[has] = np.where(name[a[edge]] == has, name[b[edge]], name[a[edge]])
        both = (to[to] == np.arange(len(nodes))) & (np.arange(len(nodes)) < to)
        to[both] = np.flatnonzero(both)
        while (to[to] != to).any():
            to = to[to]
        name = to[name]


def reachability(points: DataFrame, eps: float, core: int, forest: bool = False) -> tuple[DataFrame, DataFrame]:
    """((u, v, weight) mutual reachabilities of dense points within ``eps``, their core distances).

    ``forest``: of the pairs that meet in a task only their minimum spanning forest, which holds the whole one's part of them.
    """
    cores = kept(cores_within(points, eps, core))
    dense = kept(points.select("id", "vector").join(cores.withColumnRenamed("core", "extra"), "id"))

    def task(found: Iterator[tuple]) -> pa.Table:
        edges = ((i[i < j], j[i < j], np.maximum(far, np.maximum(x, y))[i < j]) for i, j, far, x, y in found)
        u, v, weight = _gathered(edges, least_edges if forest else lambda *c: c) or (np.zeros(0),) * 3
        return pa.table({"u": u.astype(np.int64), "v": v.astype(np.int64), "weight": weight.astype(float)})

    return ranged(dense, eps, task, "u long, v long, weight double", most=GROUP_ROWS if forest else PAIR_ROWS), cores


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """((u, v, weight) of the minimum spanning forest, (node, component), rounds) of (u, v, weight) edges with u < v.

    Boruvka: every component takes its least edge by (weight, u, v), an order without ties, so no cycle arises; what these tie is
    one component from then on. Components at least halve in number a round. Parallel edges between two components give way to the least one.
    """
    left = kept(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("weight", "u", "v").alias("e")))
    names = kept(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")))
    chosen, rounds = [], 0
    while not left.isEmpty():
        rounds += 1
        ways = left.select(F.explode(F.array("a", "b")).alias("c"), "a", "b", "e")
        least = kept(ways.groupBy("c").agg(F.min(F.struct("e", "a", "b")).alias("x")).select("x.e", "x.a", "x.b").distinct())
        chosen.append(least.select("e.u", "e.v", "e.weight"))
        moved = kept(components(least.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        for side in ("a", "b"):
            to = moved.select(F.col("node").alias(side), F.col("component").alias("to"))
            left = left.join(to, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        ends = left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e")
        left = kept(ends.groupBy("a", "b").agg(F.min("e").alias("e")))
        names = kept(names.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    forest = chosen[0] if chosen else edges.select("u", "v", "weight").limit(0)
    for more in chosen[1:]:
        forest = forest.unionByName(more)
    return forest, names, rounds


def condensed(u: np.ndarray, v: np.ndarray, weight: np.ndarray, sizes: dict[int, int], eps: float, min_size: int) -> list[tuple[int, int, float]]:
    """(point, cluster, membership) of the clustered points of one tree; a cluster is named by its smallest point.

    ``u``, ``v``, ``weight``: its edges. ``sizes``: papers of each point.
    """
    nodes = np.array(sorted(sizes))
    if sum(sizes.values()) < min_size:
        return []
    n, order = len(nodes), np.lexsort((v, u, weight))
    # merge by rising distance: child lists of a binary tree whose leaves are the points
    parent = np.arange(2 * n - 1)
    size = np.zeros(2 * n - 1, np.int64)
    size[:n] = [sizes[x] for x in nodes.tolist()]
    left, right, level = (np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64), np.full(2 * n - 1, 1 / CLOSEST))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, e in enumerate(order):
        a, b, new = root(int(np.searchsorted(nodes, u[e]))), root(int(np.searchsorted(nodes, v[e]))), n + i
        left[new], right[new], size[new], level[new] = a, b, size[a] + size[b], 1 / max(weight[e], CLOSEST)
        parent[a] = parent[b] = new
    # from the top: clusters with their birth, stability, clusters within, and where each point leaves
    birth, stable, within, leaves = [1 / eps], [0.0], [[]], [{}]

    def points(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += [left[y], right[y]]
        return out

    todo = [(2 * n - 2, 0)]
    while todo:
        x, c = todo.pop()
        if x < n:  # a point alone that is a cluster: copies of one vector
            stable[c] += size[x] * (level[x] - birth[c])
            leaves[c][x] = level[x]
            continue
        parts, at = (int(left[x]), int(right[x])), level[x]
        if min(size[list(parts)]) >= min_size:
            stable[c] += size[x] * (at - birth[c])
            for y in parts:
                birth.append(at)
                stable.append(0.0)
                within.append([])
                leaves.append({})
                within[c].append(len(birth) - 1)
                todo.append((y, len(birth) - 1))
            continue
        for y in parts:
            if size[y] >= min_size:
                todo.append((y, c))
            else:
                stable[c] += size[y] * (at - birth[c])
                leaves[c].update(dict.fromkeys(points(y), at))
    best, kept_ = list(stable), [True] * len(stable)
    for c in range(len(stable) - 1, -1, -1):  # those within come later
        inner = sum(best[d] for d in within[c])
        if within[c] and inner > stable[c]:
            best[c], kept_[c] = inner, False
    out, todo_ = [], [0]
    while todo_:
        c = todo_.pop()
        if not kept_[c]:
            todo_ += within[c]
            continue
        own, more = {}, [c]
        while more:
            d = more.pop()
            own |= leaves[d]
            more += within[d]
        most, name = max(own.values()), int(nodes[min(own)])
        out += [(int(nodes[p]), name, float(at / most)) for p, at in own.items()]
    return out


def density_cluster(vectors: DataFrame, min_size: int = 5, core: int = 3, eps: float = 0.8, id_col: str = "paper_id", vector_col: str = "embedding") -> DataFrame:
    """(paper_id, cluster_id, membership, is_noise) of all rows; clusters are numbered by size, ties to the smaller id.

    ``eps``: Euclidean distance of unit vectors beyond which nothing is tied. Rows without a vector, or with a zero one, are noise.
    """
    points, members = points_of(vectors, id_col, vector_col)
    reach, cores = reachability(points, eps, core, forest=True)
    forest, names, _ = spanning_forest(reach)
    # points with copies enough to be dense but without partners are trees of their own
    names = cores.select(F.col("id").alias("node")).join(names, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    nodes = names.join(points.select(F.col("id").alias("node"), "weight"), "node").select("component", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), F.col("weight").cast("double").alias("x"))
    tied = forest.join(names.toDF("u", "component"), "u").select("component", "u", "v", F.col("weight").alias("x"))

    def cut(table: pa.Table) -> pa.Table:
        v = table["v"].to_numpy(zero_copy_only=False)
        point = np.isnan(v.astype(float))
        u, x = table["u"].to_numpy(), table["x"].to_numpy()
        sizes = dict(zip(u[point].tolist(), x[point].astype(int).tolist(), strict=True))
        rows = condensed(u[~point], v[~point].astype(np.int64), x[~point], sizes, eps, min_size)
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({"id": pa.array(columns[0], pa.int64()), "name": pa.array(columns[1], pa.int64()), "membership": pa.array(columns[2], pa.float64())})

    found = kept(nodes.unionByName(tied).groupBy("component").applyInArrow(cut, "id long, name long, membership double"))
    papers = vectors.select(F.col(id_col).alias("paper_id")).join(members, "paper_id", "left").join(found, "id", "left")
    sizes = members.join(found, "id").groupBy("name").agg(F.count("*").alias("papers"))
    numbered = sizes.withColumn("cluster_id", (F.row_number().over(Window.orderBy(F.desc("papers"), "name")) - 1).cast("int")).select("name", "cluster_id")  # one row a cluster
    rows = papers.join(numbered, "name", "left")
    return rows.select("paper_id", "cluster_id", F.coalesce("membership", F.lit(0.0)).alias("membership"), F.col("cluster_id").isNull().alias("is_noise"))


def reduced(vectors: DataFrame, size: int = 5, id_col: str = "paper_id", vector_col: str = "embedding") -> DataFrame:
    """(paper_id, coords): the first principal coordinates, about the mean.

    Spark sums the covariance over partitions; the driver decomposes one matrix. The largest loading of an axis is positive. Raises
    ValueError where a coordinate is not finite, so that no run is stored with it. Null vectors have no row.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = kept(vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("paper_id"), array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))).alias("v")))
    if rows.isEmpty():
        return rows.select("paper_id", F.array().cast("array<double>").alias("coords"))
    model = PCA(k=size, inputCol="v", outputCol="p").fit(rows)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    shift = rows.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray() @ axes
    numbers = [F.array(*[F.lit(float(x)) for x in c]) for c in (shift, signs)]
    moved = F.zip_with(vector_to_array("p"), numbers[0], lambda a, b: a - b)
    coords = kept(model.transform(rows).select("paper_id", F.zip_with(moved, numbers[1], lambda a, b: a * b).alias("coords")))
    odd = coords.filter(F.exists("coords", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).limit(1).count()
    if odd:
        raise ValueError("coordinates are not finite")
    return coords
