"""Mixing, phrase mining and hard negatives against plain versions, and their cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import mixing, negatives, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string, mark long, bucket int, size string"


def documents(spark, rows):
    """(doc_id, text, lang, source) rows, with columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "p", 2, 3, "s") for r in rows], DOCS)


# mixing


def shares(sizes, weights):
    """Targets by sharing again and again what is over three times a source's size."""
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        own = {s: left * weights[s] / sum(weights[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s for s, t in own.items() if t > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in full else own[s] for s in sizes}
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_mix_is_fair_and_whole(spark, seed):
    rng = random.Random(seed)
    names = [None, "a", "b", "ü", "z", "B"]
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.9) % 300)), "en", rng.choices(names, [30, 5, 3, 2, 1, 1])[0]) for i in range(400)]
    queued = mixing.queues(documents(spark, rows), bucket_rows=20)
    cut = mixing.cutoff(queued, range_rows=20)
    times = sum(mixing.within(mixing.finish(c), cut).cast("long") for c in range(3))
    got = queued.withColumn("times", times).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = shares(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.size * r.times
        longest[r.source] = max(longest[r.source], r.size)
    assert len(got) == len(rows) and sum(taken.values()) <= sum(sizes.values())
    assert sum(sizes.values()) - sum(taken.values()) <= max(longest.values())
    slack = sum(longest.values()) / sum(sizes.values())  # the cut may lie as much past 1
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] + slack * want[s]
    # the same copies, one by one
    copies = sorted(((r.place + c * r.source_size) / r.target, r.source_rank, r.size) for r in got if r.size for c in range(3))
    total, last = 0, None
    for t, rank, size in copies:
        if total + size > sum(sizes.values()):
            break
        total, last = total + size, (t, rank)
    assert last == cut and total == sum(taken.values())
    coarse = mixing.cutoff(mixing.queues(documents(spark, rows)))
    assert coarse == cut  # buckets and ranges change nothing


def test_mix_in_order(spark):
    rows = [(i, "w " * (i % 7), "en", "ab"[i % 2]) for i in range(50)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    assert got == mixing.mix(documents(spark, rows)).collect()
    assert max(Counter(r.doc_id for r in got).values()) <= 3 and all(r.size for r in got)


def test_mix_cases(spark):
    rows = [(None, "a b", "en", "x"), (1, None, "en", None), (1, "", "en", "x"), (2, "a b c", "en", "y"), (2, "a b c", "en", "y"), (2, "a", "en", "y"), (3, "é b \x1c", "en", "x")]
    queued = mixing.queues(documents(spark, rows))
    assert sorted(r.size for r in queued.collect()) == [0, 0, 1, 2, 2, 3, 3]
    assert mixing.mix(documents(spark, rows)).count() > 0
    none = documents(spark, [])
    assert mixing.queues(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(documents(spark, [(1, None, None, None), (2, "", "en", "x")])).count() == 0


def test_mix_reads_no_python(spark):
    plan = mixing.queues(documents(spark, [(1, "a", "en", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# phrases


def plain_collocations(rows, least, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(100 * b >= 80 * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_phrases_equal_plain_counts(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "ü", "日本", "e\x1cf", "Ä", "und", "x\x00y"]
    rows = []
    for i in range(150):
        text = "".join(rng.choices(words, [9, 5, 4, 3, 2, 1, 1, 1, 1])[0] + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "?", ",,"]) for _ in range(rng.randrange(80)))
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"]), "s"))
    rows += [(1, None, "en", "s"), (2, "", None, None), (3, " . \n", "fr", "s"), rows[0]]
    got = phrases.collocations(documents(spark, rows), least=5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 5)
    few = phrases.collocations(documents(spark, rows), least=5, top=7, shard_phrases=20)
    assert sorted(map(tuple, few.collect())) == plain_collocations(rows, 5, 7)


def test_phrases_of_one_long_text_and_none(spark):
    text = "ab cd ef " * 40_000
    got = phrases.collocations(documents(spark, [(1, text, "en", None)])).collect()
    assert [tuple(r) for r in got] == plain_collocations([(1, text, "en", None)], 30)
    assert phrases.collocations(documents(spark, [])).count() == 0


def test_cells_of_many_tasks_are_summed_up_to_the_least(spark):
    for least in (5, 300):
        rows = spark.range(0, 2000, 1, 6).selectExpr("CAST(least(id % 40, id % 7 * 90) AS INT) AS cell")

        def counts(batches, least=least):
            own = phrases.Counts(least)
            for batch in batches:
                own.add(batch["cell"].to_numpy().astype("uint32") << 13)
            yield from own.rows()

        bits = phrases.block_sums(rows.mapInArrow(counts, phrases.BLOCKS), least)
        found = {r.cell for r in rows.groupBy("cell").count().filter(f"count >= {least}").collect()}
        got = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
        assert set(got) == {c << 13 for c in found} and len(found) > 0


def test_exact_scores(spark):
    """Counts whose products pass 64 bits."""
    one = 4_000_000_000_000_000_001
    score = spark.sql(f"SELECT (CAST(2000000 AS DECIMAL(8,0)) * CAST({one} AS DECIMAL(19,0))) DIV (CAST({one + 1} AS DECIMAL(19,0)) + CAST({one} AS DECIMAL(19,0))) AS s").first().s
    assert score == 2_000_000 * one // (2 * one + 1)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_trie_finds_all_and_only_its_keys(k):
    rng = np.random.default_rng(k)
    keys = np.unique(np.minimum(rng.zipf(1.4, (3000, k)), 900), axis=0)
    keys = np.column_stack([np.ones(len(keys), np.int64), keys[rng.permutation(len(keys))]])
    trie = phrases.Trie(keys)
    own = {tuple(r): i for i, r in enumerate(keys[:, 1:].tolist())}
    sequence = np.minimum(rng.zipf(1.4, 20_000), 1000)
    sequence[rng.random(len(sequence)) < 0.1] = 0
    want = Counter(own[t] for i in range(len(sequence) - k + 1) if (t := tuple(sequence[i : i + k].tolist())) in own)
    got = np.bincount(trie.walk(trie.step(0, 1), np.minimum(sequence, 900), k), minlength=len(keys))
    want900 = Counter(own[t] for i in range(len(sequence) - k + 1) if (t := tuple(np.minimum(sequence[i : i + k], 900).tolist())) in own)
    assert {i: n for i, n in enumerate(got) if n} == dict(want900) and sum(want.values()) <= sum(want900.values())


# hard negatives


def plain_negatives(rows, anchors, n_positive=5, n_negative=3):
    good = {(i, y, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)}
    d = max((len(v) for _, _, v in good), default=0)
    good = [(i, y, v + (0,) * (d - len(v))) for i, y, v in good]
    out = []
    for i, y, v in good:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:n_positive]:
            band = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_negative]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize(("size", "n", "spread"), [(64, 400, 0.6), (10, 300, 0.3), (130, 150, 0.5), (3, 200, 2.0)])
def test_negatives_equal_plain_search(spark, size, n, spread):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(8, size))
    vectors = centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, size))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[20:40] = vectors[20]  # ties
    rows = [(i, [float(x) for x in np.float32(v)], int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = negatives.mine(df, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=16) / 4 + 0.3)], int(i % 3)) for i in range(260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 5 == 0).collect())) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (5, [0.4, 0.5], 1), (6, [0.3, 0.3], 2), (7, [0.3, 0.3], 2), (8, None, 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 2), (11, [None, 1.0], 2), (12, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(15, [], 1), (16, [0.25], 2), (20, [0.0, 0.0], 3), (25, [-0.5, -0.5], 3)]
    schema = "vec_id long, embedding array<float>, label int, code string, size string, rest int, i int, j int"
    df = spark.createDataFrame([(*r, "c", "s", 1, 2, 3) for r in rows], schema)
    got = negatives.mine(df, F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda i: i % 5 == 0) and got
    assert negatives.mine(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert negatives.mine(df, F.col("vec_id") < 0).count() == 0


def test_intervals_hold_scores():
    rng = np.random.default_rng(1)
    ints = np.zeros((300, 64))
    ints[:, :50] = rng.integers(-256, 257, (300, 50))
    ints[7] = 0
    unit, length = negatives.units(ints)
    assert np.allclose((unit**2).sum(axis=1)[length > 0], 1) and np.allclose(unit @ unit.T * np.outer(length, length), ints @ ints.T)
    bits, along, rest = negatives.encode(unit)
    import pyarrow as pa

    block = negatives.Block(pa.table({"vec_id": range(300), "label": [0] * 300, "size": length, "ints": [v.tobytes() for v in ints], "code": [b.tobytes() for b in bits], "alignment": list(along), "rest": rest}))
    wide = []
    for k in range(0, 300, 10):
        low, high = negatives.Anchor(unit[k]).interval(block, slice(None), length[k])
        scores = ints @ ints[k]
        assert (low <= scores).all() and (scores <= high).all()
        wide.append(((high - low) / np.maximum(length * length[k], 1)).mean())
    assert np.mean(wide) < 0.3  # the codes tell something
