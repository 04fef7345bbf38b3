"""Vector expressions and the default text embedder (M3, M4, U4)."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskframe import constants as C


def dot(left: Column, right: Column) -> Column:
    """Inner product in doubles."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def similarity_score(left: Column, right: Column) -> Column:
    """M3: ``1 - distance / 2`` with cosine distance, that is ``(1 + cos) / 2``."""
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    cosine = F.when(norms > 0, dot(left, right) / norms).otherwise(F.lit(0.0))
    return (F.lit(1.0) + cosine) / F.lit(2.0)


def similarity_percent(similarity: Column) -> Column:
    """M4: percent with one decimal, half-even."""
    return F.bround(similarity * F.lit(100.0), 1)


class HashedTextEmbedder:
    """Hashed term frequencies, weighted by inverse document frequency, unit length.

    ``fit`` makes one distributed pass for the document frequencies.  Any other
    embedder can be used in its place: an object with ``fit`` and ``embed``.
    """

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions
        self._idf: IDFModel | None = None

    def _frequencies(self, df: DataFrame, text: str) -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(C.WORD_PATTERN), F.lit(0))
        tf = HashingTF(
            numFeatures=self.dimensions, inputCol="__words", outputCol="__counts"
        )
        return tf.transform(df.withColumn("__words", F.coalesce(words, F.array()))).drop("__words")

    def fit(self, df: DataFrame, text: str) -> HashedTextEmbedder:
        counts = self._frequencies(df.select(text), text)
        self._idf = IDF(inputCol="__counts", outputCol="__weighted").fit(counts)
        return self

    def embed(self, df: DataFrame, text: str, into: str) -> DataFrame:
        if self._idf is None:
            raise ValueError("fit the embedder first")
        weighted = self._idf.transform(self._frequencies(df, text))
        unit = Normalizer(p=2.0, inputCol="__weighted", outputCol="__unit").transform(weighted)
        return unit.withColumn(into, vector_to_array("__unit", dtype="float32")).drop(
            "__counts", "__weighted", "__unit"
        )
