"""Neighbour lists from vectors, co-ratings and attributes."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.functions.scalar import round_to, unit
from tastelake.operators.ordering import top_n
from tastelake.operators.scoring import sparse_top_k, vector_top_k


def weighted_mean_vectors(ratings: DataFrame, item_vectors: DataFrame, key: str = "user_id") -> DataFrame:
    """Rating-weighted mean of item vectors per key; partial sums are combined before the shuffle."""
    rated = ratings.join(item_vectors.select("item_id", array_to_vector("vector").alias("vector")), "item_id")
    mean = Summarizer.mean(F.col("vector"), F.col("rating"))
    return rated.groupBy(key).agg(vector_to_array(mean).alias("vector"))


def cosine_neighbors(vectors: DataFrame, k: int = 20) -> DataFrame:
    """Exact k nearest items by cosine (item_id, rank, neighbor_id, score), self excluded by id."""
    units = vectors.select("item_id", unit("vector").alias("vector"))
    queries = units.withColumnRenamed("item_id", "key")
    found = vector_top_k(queries, units, k, exclude_self=True)
    return found.select(
        F.col("key").alias("item_id"), "rank", F.col("item_id").alias("neighbor_id"), F.round("score", 4).alias("score")
    )


def sparse_neighbors(weights: DataFrame, column: str, feature: str, weight: str, k: int = 20) -> DataFrame:
    """Exact k nearest ids by cosine of sparse vectors (item_id, rank, neighbor_id, score); only positive scores."""
    # summed in the order of the weights, so that equal vectors get equal units
    squares = F.aggregate(F.array_sort(F.collect_list(weight)), F.lit(0.0), lambda a, x: a + x * x)
    lengths = weights.groupBy(column).agg(F.sqrt(squares).alias("_len"))
    safe = F.when(F.col("_len") == 0, F.lit(1.0)).otherwise(F.col("_len"))
    units = weights.join(lengths, column).select(
        F.col(column).alias("id"), F.col(feature).alias("feature"), (F.col(weight) / safe).alias("weight")
    )
    found = sparse_top_k(units, units, k, exclude_self=True)
    return found.select(
        F.col("key").alias("item_id"), "rank", F.col("item_id").alias("neighbor_id"), F.round("score", 4).alias("score")
    )


def fuse_neighbors(lists: list[tuple[DataFrame, float]], k: int = 20) -> DataFrame:
    """Weighted sum of neighbour lists; a missing neighbour counts 0, only positive sums stay."""
    parts = [df.select("item_id", "neighbor_id", (F.lit(w) * F.col("score")).alias("part")) for df, w in lists]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    fused = merged.groupBy("item_id", "neighbor_id").agg(F.sum("part").alias("raw")).filter("raw > 0")
    scored = fused.select("item_id", "neighbor_id", round_to("raw", 4).alias("score"))
    return top_n(scored, ["item_id"], [F.col("score").desc(), F.col("neighbor_id")], k)
