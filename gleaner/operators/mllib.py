"""What is trained with MLlib. Kept apart: Python workers need none of these imports."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.cells import MAX_CELLS, Cells
from gleaner.operators.embed import EMBED_DIM, WORD_BREAK


def mllib_tfidf(dim: int = EMBED_DIM, text_col: str = "text") -> Pipeline:
    """The same idea as an MLlib pipeline that stays in the JVM (other hash function)."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=WORD_BREAK),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_vector"),
    ])


def mllib_embed(model, df: DataFrame, out_col: str = "embedding") -> DataFrame:
    """Apply a fitted ``mllib_tfidf`` pipeline."""
    vector = vector_to_array("_vector", "float32")
    return model.transform(df).withColumn(out_col, vector).drop("_words", "_counts", "_weighted", "_vector")


def fit_cells(
    index: DataFrame, n_cells: int, vec_col: str = "embedding", train_share: float | None = None, seed: int = 7
) -> Cells:
    """KMeans centres, trained on all rows of the index.

    A caller may ask for a random ``train_share`` of the rows instead; it only places the
    centres, and every row is assigned to a cell.
    """
    if not 1 <= n_cells <= MAX_CELLS:
        raise ValueError(f"n_cells must be between 1 and {MAX_CELLS}")
    vectors = index.where(F.col(vec_col).isNotNull()).select(
        array_to_vector(F.col(vec_col).cast("array<double>")).alias("features")
    )
    if train_share is not None:
        vectors = vectors.sample(fraction=train_share, seed=seed)
    model = KMeans(k=n_cells, seed=seed, maxIter=10).fit(vectors)
    return Cells(np.array(model.clusterCenters()))
