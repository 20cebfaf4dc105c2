"""Item popularity scores, for all time and by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(ratings: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """average rating x log(1 + count) per item, over all ratings of known items."""
    rated = ratings if items is None else ratings.join(items.select("item_id"), "item_id", "left_semi")
    per_item = rated.groupBy("item_id").agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("n_ratings"))
    return per_item.select(
        "item_id", "n_ratings", F.round(F.col("avg_rating") * F.log1p(F.col("n_ratings").cast("double")), 4).alias("score")
    )


def top(scored: DataFrame, n: int = 500) -> DataFrame:
    """Best n items with their rank. The rank window sees n rows at most."""
    from pyspark.sql import Window

    best = scored.orderBy(F.col("score").desc(), "item_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "item_id")))


def ranked(scored: DataFrame) -> DataFrame:
    """All items with their rank; ranges of scores are ordered apart from each other."""
    from tastelake.operators.ordering import position, ranged

    order = [F.col("score").desc(), F.col("item_id")]
    return position(ranged(scored, order), [], "_range", order, "rank").drop("_range")


def in_window(ratings: DataFrame, as_of: str, days: int) -> DataFrame:
    """Ratings of the last ``days`` before ``as_of``; the filter reaches the scan of the order dates."""
    end = F.lit(as_of).cast("timestamp")
    return ratings.filter((F.col("ts") >= end - F.make_dt_interval(F.lit(days))) & (F.col("ts") < end))


def decayed(ratings: DataFrame, as_of: str, half_life_days: float) -> DataFrame:
    """Sum of ratings, each weighted by half-life decay of its age."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("ts").cast("date"))
    weight = F.exp(-F.log(F.lit(2.0)) * age / half_life_days)
    return ratings.groupBy("item_id").agg(F.round(F.sum(F.col("rating") * weight), 4).alias("score"))
