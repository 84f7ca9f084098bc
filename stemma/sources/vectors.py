"""Vectors of texts that were encoded before, and what similarity a comparison may use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import n3
from stemma.operators.joins import dot
from stemma.operators.kernels import cosine_matrix


def vector_key(model: str, text: Column) -> Column:
    """Key of a text's vector: a digest of the model and the text in normal form."""
    return F.concat(F.lit("h"), F.sha1(F.concat(F.lit(model), F.lit("\x00"), n3(text)).cast("binary")))


class VectorCache:
    """Vectors (key, vec) by key; equal texts share one, and only missing ones are encoded."""

    def __init__(self, vectors: DataFrame, model: str):
        self.vectors, self.model = vectors, model

    def keyed(self, texts: DataFrame, text: str = "text") -> DataFrame:
        return texts.withColumn("key", vector_key(self.model, F.col(text)))

    def missing(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """One row per text without a vector: key and text."""
        lost = self.keyed(texts, text).join(self.vectors.select("key"), "key", "left_anti")
        return lost.groupBy("key").agg(F.min(text).alias("text"))

    def with_vectors(self, texts: DataFrame, text: str = "text") -> DataFrame:
        return self.keyed(texts, text).join(self.vectors, "key", "left").drop("key")

    def added(self, encoded: DataFrame) -> VectorCache:
        """The cache with newly encoded (key, vec) rows."""
        return VectorCache(self.vectors.unionByName(encoded.join(self.vectors.select("key"), "key", "left_anti")), self.model)


def best_pairs(old: DataFrame, new: DataFrame, by: list[str], least: float) -> DataFrame:
    """(by..., old_id, new_id, score, best_of_old, best_of_new) of (by..., id, vec) rows, of one group of residuals."""
    pairs = old.select(*by, F.col("id").alias("old_id"), F.col("vec").alias("a")).join(new.select(*by, F.col("id").alias("new_id"), F.col("vec").alias("b")), by)
    scored = pairs.select(*by, "old_id", "new_id", F.round(dot("a", "b"), 3).alias("score"))
    of = lambda side, other: F.first(other).over(Window.partitionBy(*by, side).orderBy(F.desc("score"), other))
    return scored.withColumns({"best_of_old": of("old_id", "new_id"), "best_of_new": of("new_id", "old_id")}).filter(F.col("score") >= least)


#: Similarities of two lists of texts by name; an encoder can be added.
SIMILARITIES: dict[str, Callable] = {"tfidf": cosine_matrix}


def similarity(name: str) -> Callable:
    if name not in SIMILARITIES:
        raise ValueError(f"unknown similarity {name}; known are {', '.join(sorted(SIMILARITIES))}")
    return SIMILARITIES[name]
