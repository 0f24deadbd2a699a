"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of a whole text (shares of symbols, cases, digits, repeats, lengths)
are standardised and mapped to random cosine features, which approximate a
Gaussian kernel. Each partition sums its normal equations; the sums of partitions
are added and solved for ridge weights. Isotonic regression, on another part of
the training rows, turns raw scores into probabilities.

The driver holds sums only: one (features + 1)^2 matrix and one count for each of
``BINS`` raw-score bins. Training uses all labelled rows whose crc32(doc_id) mod 3
isn't 1: remainder 0 fits the weights and remainder 2 the calibration.

Cases: null text is empty and gets a score; a repeated label counts by its mean;
without any labels all scores are 0.5; repeated rows get equal scores; labels,
lang, source and doc_id never enter a score; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import batches_of, filled, materialise, read

FEATURES = 256
RIDGE = 1.0
#: Kernel width, in standard deviations per statistic.
WIDTH = 1.5
SEED = 7
BINS = 2000
SYMBOLS = b"#*$%&|<>"
FOLDS = 3

STATISTICS = (
    "log_words", "word_length", "longest_word", "symbols", "upper", "digits", "marks", "exclamations", "ascii",
    "short_words", "distinct", "top_word", "dup_lines", "line_words", "repeat_pairs", "upper_words", "symbol_words", "links",
)


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    size = len(data)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(np.log(lengths.max())),
        sum(int(counts[b]) for b in SYMBOLS) / size * 10,
        int(counts[65:91].sum()) / letters,
        int(counts[48:58].sum()) / size * 10,
        sum(int(counts[b]) for b in b".,;:?") / size * 10,
        int(counts[33]) / n,
        int(counts[:128].sum()) / size,
        float((lengths <= 3).mean()),
        len(seen) / n**0.85,
        seen.most_common(1)[0][1] / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        1 - pairs / max(1, n - 1),
        sum(w.isupper() for w in words) / n,
        sum(w[-1] in SYMBOLS for w in words) / n,
        data.count(b"http") / n,
    ]


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of every document, written once."""
    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1000, 4 << 20, "text"):
            rows = [statistics(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rows, pa.list_(pa.float64()))], ["id", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    return materialise(rows.mapInArrow(stats, "id long, stats array<double>"), "quality-stats")


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


class Model:
    """What scoring needs; small whatever the corpus."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) / (WIDTH * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.w + self.b
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z), np.ones(len(stats))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # A thousandth of the raw order separates documents on one isotonic step.
        score = 0.999 * np.interp(raw, *self.knots) + 0.001 * np.clip(raw, 0, 1)
        return np.round(np.clip(score, 0, 1), 9)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the mean x of each pool."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, n):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def _stats_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    spread = [f(F.col("stats")[k]).alias(f"{name}{k}") for k in range(len(STATISTICS)) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = stats.agg(*spread).first()
    mean = np.array([row[f"m{k}"] or 0.0 for k in range(len(STATISTICS))])
    scale = np.array([row[f"s{k}"] or 1.0 for k in range(len(STATISTICS))])
    model = Model(mean, scale)
    truth = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("y"))
    rows = stats.dropDuplicates(["id"]).join(truth, "id").withColumn("fold", fold(F.col("id"))).filter("fold <> 1")
    rows = materialise(rows, "quality-train")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.weights)
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.features(_stats_matrix(batch))
            a += z.T @ z
            b += z.T @ batch["y"].to_numpy()
        columns = [pa.array(range(size), pa.int32()), pa.array(list(np.column_stack([a, b])), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, i = 0.0, None
        for batch in batches:
            i = batch["i"][0].as_py()
            total = total + batch["row"].flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        if i is not None:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["i", "row"])

    fit = rows.filter("fold = 0").select("stats", "y").mapInArrow(sums, "i int, row array<double>")
    equations = {r["i"]: r["row"] for r in fit.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()}
    if not equations:
        return model
    table = np.array([equations[i] for i in range(len(model.weights))])
    if not table[-1, -2]:  # no training rows
        return model
    model.weights = np.linalg.solve(table[:, :-1] + RIDGE * np.eye(len(table)), table[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_stats_matrix(batch))), batch["y"]], ["raw", "y"])

    held = rows.filter("fold = 2").select("stats", "y").mapInArrow(raw, "raw double, y double")
    bins = held.groupBy(F.round(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) * (BINS / 2)).alias("bin"))
    steps = sorted((r["x"], r["y"], r["n"]) for r in bins.agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    model.knots = isotonic(*np.array(steps).T) if steps else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(model.score(_stats_matrix(batch)))], ["id", "score"])

    return stats.mapInArrow(scored, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = featurise(docs)
    scores = score(stats, train(stats, labels))
    return scores.select(
        F.col("id").alias("doc_id"), (fold(F.col("id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
