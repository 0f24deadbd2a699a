"""Range join, cell index and density clusters against one machine."""

import numpy as np
import pytest

from corpuslens import plans
from corpuslens.operators import density, neighbours, search

SF = "/root/testdata/sf0.001"


def points(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)], "id long, vector array<double>")


def plain_pairs(vectors, eps):
    far = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1))
    return {(i, j): far[i, j] for i in range(len(vectors)) for j in range(i + 1, len(vectors)) if far[i, j] <= eps}


@pytest.mark.parametrize(("spread", "eps", "centres"), [(0.2, 0.5, None), (1.0, 1.5, 3), (0.05, 0.1, 40), (1.0, 9.0, 10)])
def test_range_join_is_exact(spark, monkeypatch, spread, eps, centres):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 30)
    monkeypatch.setattr(neighbours, "VISITOR_ROWS", 70)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(6, 4))[rng.choice(6, 200, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1])] + spread * rng.normal(size=(200, 4))
    vectors[10:20] = vectors[10]
    rows = neighbours.range_join(points(spark, vectors), eps, centres).collect()
    got = {(r.u, r.v): r.distance for r in rows}
    assert len(rows) == len(got) and got == pytest.approx(plain_pairs(vectors, eps))


def test_range_join_cases(spark):
    none = spark.createDataFrame([(1, None), (None, [1.0])], "id long, vector array<double>")
    assert neighbours.range_join(none, 1.0).count() == 0
    assert neighbours.range_join(points(spark, [[1.0, 0.0]]), 1.0).count() == 0


def test_index_recall_at_its_defaults(spark):
    """The corpus vectors have no structure: the worst case for cells."""
    from corpuslens.sources import views

    vectors = views.active(spark, "/root/testdata/sf0.01").select("paper_id", "embedding")
    exact = search.knn_join(vectors, 5).select("id", "neighbour")
    index = neighbours.CellIndex(vectors)
    found = index.neighbours()
    assert found.groupBy("id").count().filter("count = 5").count() == vectors.count()
    assert neighbours.recall_of(found, exact) >= 0.9


def test_index_of_groups_needs_few_probes(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    vectors = centres[rng.integers(0, 30, 900)] + 0.1 * rng.normal(size=(900, 16))
    df = points(spark, vectors).toDF("paper_id", "embedding")
    index = neighbours.CellIndex(df)
    assert index.probes <= 5
    exact = search.knn_join(df, 5).select("id", "neighbour")
    assert neighbours.recall_of(index.neighbours(), exact) >= 0.9


def test_index_falls_back_where_cells_hold_too_few(spark):
    """Cells of one or two vectors each, one probe: the rest is searched exactly."""
    rng = np.random.default_rng(5)
    df = points(spark, rng.normal(size=(40, 8))).toDF("paper_id", "embedding")
    index = neighbours.CellIndex(df, k=5, cells=25)
    index.probes = 1
    found = index.neighbours()
    assert found.count() == 200 and found.select("id", "neighbour").distinct().count() == 200
    short = {r.id for r in index.rows.join(index.rows.groupBy("cell").count().filter("count <= 5"), "cell").collect()}
    exact = {(r.id, r.neighbour) for r in search.knn_join(df, 5).collect() if r.id in short}
    assert short and exact <= {(r.id, r.neighbour) for r in found.collect()}
    for n in (0, 1, 2):
        assert neighbours.CellIndex(df.filter(f"paper_id < {n}")).neighbours().count() == n * (n - 1)


# clusters


def plain_clusters(vectors, min_size, core, eps):
    """{row: (cluster, membership)} by Kruskal's tree and plain recursion over its parts."""
    n = len(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    far = np.sqrt(((unit[:, None] - unit[None]) ** 2).sum(-1))
    far[far < 1e-7] = 0
    cores = np.sort(far + np.where(np.eye(n) > 0, np.inf, 0), axis=1)[:, core - 1]
    edges = sorted((max(far[i, j], cores[i], cores[j]), i, j) for i in range(n) for j in range(i + 1, n) if max(far[i, j], cores[i], cores[j]) <= eps)
    name, tree = list(range(n)), []
    for w, i, j in edges:
        if name[i] != name[j]:
            tree.append((max(w, density.CLOSEST), i, j))
            old = name[j]
            name = [name[i] if x == old else x for x in name]

    def parts(members, own):
        todo, out = set(members), []
        while todo:
            grown, more = set(), {todo.pop()}
            while more:
                grown |= more
                more = {y for _, a, b in own for x, y in ((a, b), (b, a)) if x in more} - grown
            todo -= grown
            out.append(grown)
        return out

    def cluster(members, birth):
        """(stability, clusters as {row: level}) of the best choice at or within this one."""
        own, leaves, stable = [e for e in tree if e[1] in members and e[2] in members], {}, 0.0
        while True:
            if not own:
                for x in members:
                    leaves[x] = 1 / density.CLOSEST
                    stable += 1 / density.CLOSEST - birth
                return stable, [leaves], leaves
            level = 1 / own[-1][0]
            own = own[:-1]
            halves = parts(members, own)
            if all(len(h) >= min_size for h in halves):
                stable += len(members) * (level - birth)
                inner = [cluster(h, level) for h in halves]
                every = leaves | inner[0][2] | inner[1][2]
                within = inner[0][0] + inner[1][0]
                return (within, inner[0][1] + inner[1][1], every) if within > stable else (stable, [every], every)
            for h in halves:
                if len(h) < min_size:
                    for x in h:
                        leaves[x] = level
                        stable += level - birth
            left = [h for h in halves if len(h) >= min_size]
            if not left:
                return stable, [leaves], leaves
            members, own = left[0], [e for e in own if e[1] in left[0] and e[2] in left[0]]

    out = {}
    for members in parts(range(n), tree):
        if len(members) >= min_size:
            for chosen in cluster(members, 1 / eps)[1]:
                for x, level in chosen.items():
                    out[x] = (min(chosen), level / max(chosen.values()))
    return out


def compared(spark, vectors, **how):
    rows = density.density_cluster(points(spark, vectors).toDF("paper_id", "embedding"), **how).collect()
    want = plain_clusters(vectors, how["min_size"], how["core"], how["eps"])
    groups = {}
    for r in rows:
        assert r.is_noise == (r.paper_id not in want) == (r.cluster_id is None)
        if not r.is_noise:
            groups.setdefault(r.cluster_id, set()).add(r.paper_id)
            assert r.membership == pytest.approx(want[r.paper_id][1])
    plain = {}
    for x, (c, _) in want.items():
        plain.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))
    assert [len(groups[c]) for c in sorted(groups)] == sorted(map(len, groups.values()), reverse=True)
    return groups


def test_clusters_of_unequal_density(spark):
    """A tight pair of groups inside a loose one: no single distance finds all."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4, 12))
    base /= np.linalg.norm(base, axis=1)[:, None]
    base[1] = base[0] + 0.25 * base[1]
    vectors = np.concatenate([c + s * rng.normal(size=(n, 12)) for c, s, n in zip(base, (0.02, 0.02, 0.12, 0.1), (30, 30, 40, 25))] + [rng.normal(size=(15, 12))])
    groups = compared(spark, vectors, min_size=8, core=3, eps=0.9)
    assert len(groups) == 4


@pytest.mark.parametrize("seed", range(2))
def test_clusters_of_random_points(spark, seed):
    rng = np.random.default_rng(seed)
    compared(spark, rng.normal(size=(5, 3))[rng.integers(0, 5, 90)] + 0.25 * rng.normal(size=(90, 3)), min_size=4, core=2, eps=0.6)


def test_copies_stay_in_one_cluster(spark):
    rng = np.random.default_rng(8)
    one, other = rng.normal(size=8), rng.normal(size=8)
    vectors = np.concatenate([one + 1e-3 * rng.normal(size=(20, 8)), np.repeat(other[None], 9, axis=0), rng.normal(size=(3, 8))])
    rows = density.density_cluster(points(spark, vectors).toDF("paper_id", "embedding"), min_size=5, core=3, eps=0.3).collect()
    of = {r.paper_id: r.cluster_id for r in rows}
    assert {of[i] for i in range(20)} == {0} and {of[i] for i in range(20, 29)} == {1} and {of[i] for i in range(29, 32)} == {None}


def test_planted_groups_equal_one_machine(spark):
    own = plans.neighbours.planted(spark, SF).orderBy("paper_id").collect()
    vectors, ids = np.array([r.embedding for r in own]), [r.paper_id for r in own]
    rows = plans.QUERIES["density_cluster"](spark, SF).collect()
    want = plain_clusters(vectors, 5, 3, 0.8)
    of = {r.paper_id: r for r in rows}
    assert {i for i in ids if not of[i].is_noise} == {ids[x] for x in want}
    assert len({(of[ids[x]].cluster_id, c) for x, (c, _) in want.items()}) == len({c for c, _ in want.values()}) == len({of[ids[x]].cluster_id for x in want})
    assert all(of[ids[x]].membership == pytest.approx(m, abs=1e-5) for x, (_, m) in want.items())
    assert sum(r.is_noise for r in rows) < 0.3 * len(rows) and {r.label for r in rows if not r.is_noise} == set(range(10))
    centred = vectors - vectors.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    coords = np.array([of[i].coords for i in ids])
    assert np.allclose(np.abs(coords), np.abs(centred @ axes[:5].T), atol=1e-4)


def test_forest_in_logarithmic_rounds(spark):
    """A chain of falling weights, the slow case of growing from one end."""
    n = 300
    edges = spark.createDataFrame([(i, i + 1, float(n - i)) for i in range(n)] + [(0, i, 1000.0 + i) for i in range(2, n)], "u long, v long, weight double")
    forest, names, rounds = density.spanning_forest(edges)
    assert sorted((r.u, r.v) for r in forest.collect()) == [(i, i + 1) for i in range(n)]
    assert rounds <= 9 and names.select("component").distinct().count() == 1


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "paper_id long, embedding array<double>")
    assert [(r.cluster_id, r.membership, r.is_noise) for r in density.density_cluster(none).collect()] == [(None, 0.0, True)] * 2
    assert density.density_cluster(none.limit(0)).count() == 0 and density.reduced(none.limit(0)).count() == 0


def test_coordinates_that_are_not_finite_fail_the_run(spark):
    with pytest.raises(Exception):
        density.reduced(spark.createDataFrame([(1, [1.0, float("nan"), 0.0, 0.0, 0.0]), (2, [0.0] * 5), (3, [1.0] * 5)], "paper_id long, embedding array<double>")).count()


def test_knn_join_moves_each_vector_a_few_times(spark, monkeypatch):
    """20,000 vectors meet in 6 times 6 blocks, a row each here; not in 5 times 5 that grow by one every 4096 vectors."""
    import pyarrow as pa

    from corpuslens.operators import search

    one = lambda left, right: pa.table({"id": [left["id"][0].as_py()], "neighbour": [right["other"][0].as_py()], "similarity": [0.0]})
    monkeypatch.setattr(search, "_nearest", lambda k: one)
    met = lambda n, **rows: search.knn_join(spark.range(n).selectExpr("id AS paper_id", "array(cast(id + 1 AS double), 1D) AS embedding"), 1000, **rows).count()
    assert met(40_000) == met(20_000) == 36
    assert met(2_000, block_rows=100) == 400


def test_a_range_join_sends_a_vector_to_each_group_once(spark, monkeypatch):
    """All are partners, so each vector reaches all of the 31 cells; they are a few groups."""
    from corpuslens.operators import neighbours as N

    sent, met = [], N.met
    monkeypatch.setattr(N, "met", lambda owners, visitors, *rest: (sent.append(visitors.count()), met(owners, visitors, *rest))[1])
    points = spark.range(1000).selectExpr("id", "array(sin(id), cos(id), sin(id * id)) AS vector")
    assert N.range_join(points, 9.0).count() == 1000 * 999 // 2
    assert 1000 <= sent[0] <= 12_000


def test_least_edges_are_the_forest_whatever_the_slices():
    from corpuslens.operators.density import _gathered, least_edges

    rng = np.random.default_rng(3)
    i, j = np.triu_indices(40, 1)
    weight = np.round(rng.random(len(i)), 1)  # many ties
    name, want = list(range(40)), set()
    for w, a, b in sorted(zip(weight.tolist(), i.tolist(), j.tolist(), strict=True)):
        if name[a] != name[b]:
            want.add((a, b, w))
            name = [name[a] if x == name[b] else x for x in name]
    mixed = rng.permutation(len(i))
    slices = [(i[p], j[p], weight[p]) for p in np.array_split(mixed, 9)]
    for most in (1, 100, 1 << 20):
        assert set(zip(*(c.tolist() for c in _gathered(iter(slices), least_edges, most)), strict=True)) == want


def test_core_distances_within_equal_those_of_all_pairs(spark):
    from corpuslens.operators import density as D
    from corpuslens.operators import neighbours as N

    points = spark.range(60).selectExpr("id", "array(sin(id), cos(id), 0.1D * (id % 7)) AS vector", "1 + id % 2 AS weight")
    want = D.core_distances(points, N.range_join(points, 0.5), 3).collect()
    got = {r["id"]: r["core"] for r in D.cores_within(points, 0.5, 3).collect()}
    assert got == {r["id"]: pytest.approx(r["core"]) for r in want} and got
