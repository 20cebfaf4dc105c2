"""User and item profiles, features, outliers and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastelake.operators.ordering import (
    carry_forward,
    exact_quantiles,
    one_row,
    position,
    ranged,
    top_n,
    value_ranks,
)


def user_summary(users: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rating count and mean of every user, 0 where there is none."""
    stats = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"))
    return users.join(stats, "user_id", "left").select(
        "user_id",
        F.coalesce("n", F.lit(0)).alias("n_ratings"),
        F.coalesce("mean", F.lit(0.0)).alias("avg_rating"),
    )


def genre_preferences(ratings: DataFrame, item_genres: DataFrame, limit: int | None = 10) -> DataFrame:
    """Share of each genre in the sum of ratings of a user; a user has at most as many rows as there are genres."""
    per_genre = ratings.join(item_genres, "item_id").groupBy("user_id", "genre").agg(F.sum("rating").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("user_id"))
    shares = per_genre.select(
        "user_id", "genre", (F.col("weight") / F.when(total == 0, F.lit(1.0)).otherwise(total)).alias("share")
    )
    if limit is None:
        return shares
    return top_n(shares, ["user_id"], [F.col("share").desc(), F.col("genre")], limit)


def favourite_genre(preferences: DataFrame) -> DataFrame:
    """Highest-ranked genre and the number of listed preferences."""
    return preferences.groupBy("user_id").agg(
        F.min_by("genre", "rank").alias("favourite"), F.count(F.lit(1)).alias("n_genres")
    )


def star_histogram(ratings: DataFrame) -> DataFrame:
    """Ratings per user and whole star 5..1, zeros included; ratings below 1 are not shown."""
    counts = ratings.groupBy("user_id").agg(
        *[F.count_if(F.floor("rating") == star).alias(f"s{star}") for star in range(1, 6)]
    )
    stars = F.array(*[F.struct(F.lit(n).alias("star"), F.col(f"s{n}").alias("n")) for n in range(1, 6)])
    return counts.select("user_id", F.explode(stars).alias("e")).select("user_id", "e.star", "e.n")


def user_features(ratings: DataFrame, as_of: str) -> DataFrame:
    """Count, mean, variance, recency and frequency per user in one aggregate."""
    days = F.datediff(F.max("ts"), F.min("ts"))
    return ratings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.avg("rating").alias("avg_rating"),
        F.round(F.var_samp("rating"), 6).alias("rating_variance"),
        F.datediff(F.lit(as_of).cast("date"), F.max("ts")).alias("recency_days"),
        F.round(F.count(F.lit(1)) / F.greatest(days, F.lit(1)), 6).alias("ratings_per_day"),
    )


def item_features(items: DataFrame, ratings: DataFrame) -> DataFrame:
    stats = ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"))
    n = F.coalesce("n", F.lit(0))
    return items.join(stats, "item_id", "left").select(
        "item_id",
        "year",
        n.alias("n_ratings"),
        F.coalesce("mean", F.lit(0.0)).alias("avg_rating"),
        F.round(F.coalesce(F.col("mean") * F.log1p(n.cast("double")), F.lit(0.0)), 4).alias("trending"),
    )


def iqr_bounds(df: DataFrame, value: str) -> DataFrame:
    q = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - 1.5 * spread).alias("low"), (F.col("q3") + 1.5 * spread).alias("high"))


def within_iqr(df: DataFrame, value: str) -> DataFrame:
    """Rows inside the 1.5 IQR fences; the fences enter the filter as one scalar row."""
    fences = one_row(iqr_bounds(df, value).select("low", "high"))
    return df.filter(F.col(value).between(fences["low"], fences["high"]))


def moments(df: DataFrame, value: str) -> Column:
    return one_row(df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")))


def z_score(df: DataFrame, value: str) -> Column:
    m = moments(df, value)
    return (F.col(value) - m["mean"]) / m["sd"]


def min_max(df: DataFrame, value: str) -> Column:
    m = moments(df, value)
    span = m["high"] - m["low"]
    return F.when(span > 0, (F.col(value) - m["low"]) / span).otherwise(F.lit(0.0))


def deciles(df: DataFrame, value: str) -> DataFrame:
    """percent_rank and decile per value. Equal values share both, so ranks come from the table of values."""
    ranks = value_ranks(df, value)
    total = ranks.agg(F.sum("n").cast("double").alias("total")).scalar()
    return ranks.select(
        value,
        "n",
        (F.col("before") / F.greatest(total - 1, F.lit(1.0))).alias("percent_rank"),
        (F.floor(F.col("before") * 10 / total) + 1).cast("int").alias("decile"),
    )


def moving_activity(ratings: DataFrame, days: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing count and mean per item and day. Rows are summed per day first, so the window holds one row per day."""
    daily = ratings.groupBy("item_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total")
    )
    day_no = F.datediff("day", F.lit("1970-01-01").cast("date"))
    daily = daily.withColumn("day_no", day_no)
    out = daily
    for d in days:
        span = Window.partitionBy("item_id").orderBy("day_no").rangeBetween(-(d - 1), 0)
        out = out.withColumn(f"n_{d}d", F.sum("n").over(span)).withColumn(
            f"mean_{d}d", F.sum("total").over(span) / F.sum("n").over(span)
        )
    return out.drop("day_no", "total")


def like_state(interactions: DataFrame, on: str = "like", off: str = "unlike") -> DataFrame:
    """Current state per (user, item): the latest of the two event types."""
    return (
        interactions.filter(F.col("interaction_type").isin(on, off))
        .groupBy("user_id", "item_id")
        .agg((F.max_by("interaction_type", F.struct("ts", "event_id")) == on).alias("liked"))
    )


def as_of_features(
    facts: DataFrame, features: DataFrame, key: str, value: str, fact_columns: Sequence[str]
) -> DataFrame:
    """Latest feature at or before each fact's time, per key: facts and features are merged in time order.

    ``facts`` and ``features`` carry (key, ts). A feature at the same time counts as known. No pair of a fact with all
    its earlier features is ever built.
    """
    left = facts.select(key, "ts", F.lit(1).alias("_kind"), F.struct(*fact_columns).alias("_fact"), F.lit(None).cast("double").alias(value))
    right = features.select(
        key, "ts", F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), F.col(value)
    )
    order = [F.col("ts"), F.col("_kind")]
    merged = ranged(left.unionByName(right), [F.col(key), *order], "merged")
    filled = carry_forward(merged, [key], "_range", order, value, "_known")
    return filled.filter("_kind = 1").select(key, "ts", "_fact.*", F.col("_known").alias(value))


def numbered_split(ratings: DataFrame, share: float = 0.8) -> DataFrame:
    """Ratings with the column ``part``: 'train' for the first ``share`` of every user in time order, else 'test'."""
    order = [F.col("ts"), F.col("item_id")]
    numbered = position(ranged(ratings, [F.col("user_id"), *order], "in-time"), ["user_id"], "_range", order, "pos")
    sizes = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("pos") <= F.floor(F.lit(share) * F.col("n"))
    return numbered.join(sizes, "user_id").select(*ratings.columns, F.when(first, "train").otherwise("test").alias("part"))


def temporal_split(ratings: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``numbered_split``."""
    marked = numbered_split(ratings, share)
    return marked.filter("part = 'train'").drop("part"), marked.filter("part = 'test'").drop("part")


def last_holdout(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All but the last rating of every user, and the last one."""
    newest = ratings.groupBy("user_id").agg(F.max_by("item_id", F.struct("ts", "item_id")).alias("item_id"))
    test = ratings.join(newest, ["user_id", "item_id"], "left_semi")
    return ratings.join(newest, ["user_id", "item_id"], "left_anti"), test
