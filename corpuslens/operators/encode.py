"""Text to unit vectors: hashed term frequencies weighed by IDF, or any encoder per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encoder(texts: DataFrame, dimension: int = 256, text_col: str = "text") -> PipelineModel:
    """Document frequencies are counted over all of ``texts``; the rest is fixed."""
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="__words", pattern=r"\W+", minTokenLength=2),
        HashingTF(inputCol="__words", outputCol="__counts", numFeatures=dimension),
        IDF(inputCol="__counts", outputCol="__weights"),
        Normalizer(inputCol="__weights", outputCol="__unit"),
    ]
    return Pipeline(stages=stages).fit(texts)


def encode(model: PipelineModel, texts: DataFrame) -> DataFrame:
    """``texts`` with ``embedding``, an array of floats; a text without words has a zero vector."""
    rows = model.transform(texts)
    return rows.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__words", "__counts", "__weights", "__unit")


def encode_with(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], id_col: str = "paper_id", text_col: str = "text", batch: int = 16) -> DataFrame:
    """(id, embedding) by any encoder; ``load`` runs once in each Python worker's task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_batch = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({id_col: part[id_col], "embedding": encode_batch(part[text_col].tolist())})

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")


def embedding_rows(encoded: DataFrame, problem) -> DataFrame:
    """Status rows: a vector with a problem is FAILED and stored as null."""
    return encoded.select(
        "*", F.when(problem.isNull(), "SUCCEEDED").otherwise("FAILED").alias("embedding_status")
    ).withColumn("embedding", F.when(F.col("embedding_status") == "SUCCEEDED", F.col("embedding")))
