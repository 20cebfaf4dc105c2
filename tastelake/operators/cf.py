"""Neighbourhood, sequence, sampling and bandit operators over ratings and interactions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastelake.functions.scalar import draw
from tastelake.operators.blocks import COSINE, JACCARD, PEARSON, SUPPORT, PairScore, shared_row_top
from tastelake.operators.ordering import following, position, ranged, running_total, top_n
from tastelake.session import stored

# Cumulative Poisson(1) probabilities for 0, 1, 2, ... events.
POISSON_ONE = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.9999167588507119,
    0.9999897508033253,
)


def bought_together(ratings: DataFrame, n: int) -> DataFrame:
    found = shared_row_top(ratings, "user_id", "item_id", "rating", SUPPORT, n, pairs=True)
    best = found.orderBy(F.col("score").desc(), "key", "item_id").limit(n)
    return best.select(F.col("key").alias("a"), F.col("item_id").alias("b"), F.col("score").cast("bigint").alias("support"))


def _neighbors(entries: DataFrame, row: str, column: str, value: str, score: PairScore, k: int, min_support: int) -> DataFrame:
    found = shared_row_top(entries, row, column, value, score, k, min_support=min_support)
    best = top_n(found, ["key"], [F.round("score", 10).desc(), F.col("item_id")], k)
    return best.select(F.col("key").alias(column), "rank", F.col("item_id").alias("neighbor_id"), "score")


def item_neighbors(ratings: DataFrame, measure: str, k: int = 20, min_support: int = 3) -> DataFrame:
    """Item neighbours by cosine, adjusted cosine (user means removed) or Pearson over co-raters."""
    entries = ratings
    if measure == "adjusted":
        means = ratings.groupBy("user_id").agg(F.avg("rating").alias("mean"))
        entries = stored(ratings.join(means, "user_id").select("user_id", "item_id", (F.col("rating") - F.col("mean")).alias("rating")), "centred")
    return _neighbors(entries, "user_id", "item_id", "rating", PEARSON if measure == "pearson" else COSINE, k, min_support)


def user_neighbors(ratings: DataFrame, measure: str, k: int = 10, min_support: int = 2) -> DataFrame:
    """User neighbours (user_id, rank, neighbor_id, score) by overlap of items, Pearson or cosine."""
    score = {"jaccard": JACCARD, "pearson": PEARSON}.get(measure, COSINE)
    return _neighbors(ratings, "item_id", "user_id", "rating", score, k, min_support)


def predict_from_neighbors(neighbors: DataFrame, ratings: DataFrame, n: int = 10) -> DataFrame:
    """Unseen items by the similarity-weighted mean rating of the neighbours."""
    rated = ratings.select(F.col("user_id").alias("neighbor_id"), "item_id", "rating")
    votes = neighbors.select("user_id", "neighbor_id", "score").join(rated, "neighbor_id")
    means = votes.groupBy("user_id", "item_id").agg(
        F.sum("score").alias("w"), F.sum(F.col("score") * F.col("rating")).alias("wr"), F.count(F.lit(1)).alias("n_votes")
    )
    fresh = means.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").filter("w > 0")
    scored = fresh.select("user_id", "item_id", "n_votes", (F.col("wr") / F.col("w")).alias("raw"))
    best = top_n(scored, ["user_id"], [F.col("n_votes").desc(), F.round("raw", 10).desc(), F.col("item_id")], n)
    return best.select("user_id", "rank", "item_id", "n_votes", F.round("raw", 6).alias("score"))


def bias_baseline(ratings: DataFrame, shrink: float = 10.0) -> DataFrame:
    """Global mean plus shrunken item and user offsets, for every rating."""
    mean = ratings.agg(F.avg("rating").alias("m")).scalar()
    based = ratings.select("user_id", "item_id", "rating", mean.alias("mu"))
    per_item = based.groupBy("item_id").agg((F.sum(F.col("rating") - F.col("mu")) / (F.count(F.lit(1)) + shrink)).alias("b_item"))
    with_item = based.join(per_item, "item_id")
    rest = F.col("rating") - F.col("mu") - F.col("b_item")
    per_user = with_item.groupBy("user_id").agg((F.sum(rest) / (F.count(F.lit(1)) + shrink)).alias("b_user"))
    return with_item.join(per_user, "user_id").select(
        "user_id", "item_id", F.round(F.col("mu") + F.col("b_item") + F.col("b_user"), 6).alias("predicted")
    )


def transitions(events: DataFrame, state: str, order: int = 1) -> DataFrame:
    """Probability of the next state given the last one (or two) states of the same user."""
    rows = events.select("user_id", "ts", "event_id", F.col(state).alias("state"))
    in_time = [F.col("ts"), F.col("event_id")]
    rows = ranged(rows, [F.col("user_id"), *in_time], "events")
    steps = following(rows, ["user_id"], "_range", in_time, {"state": "next"})
    keys = ["state"]
    if order == 2:
        steps = following(steps.withColumnRenamed("next", "second"), ["user_id"], "_range", in_time, {"second": "next"})
        keys = ["state", "second"]
    counts = steps.filter(F.col("next").isNotNull()).groupBy(*keys, "next").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, keys).select(*keys, "next", "n", (F.col("n") / F.col("total")).alias("probability"))


def numbered_items(items: DataFrame) -> DataFrame:
    """Items with a dense index from 0."""
    chunked = items.select("item_id", F.floor(F.col("item_id") / 4096).alias("_part"))
    return position(chunked, [], "_part", [F.col("item_id")], "_n").select("item_id", (F.col("_n") - 1).alias("index"))


def unseen_items(keys: DataFrame, seen: DataFrame, items: DataFrame, per_key: int, salt: str) -> DataFrame:
    """``per_key`` different unseen items per row of ``keys`` (all of them where there are fewer): draw, drawn_item.

    ``keys`` has a user_id. The draws are places among the user's unseen items: a start from the md5 of the key columns, then
    equal steps, so none repeats. A place becomes an item by adding the seen items that lie before it, counted by a running
    total over the user's seen items and places, value range by value range.
    """
    table = numbered_items(items)
    total = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    known = seen.select("user_id", "item_id").distinct().join(table, "item_id").withColumn("_part", F.floor(F.col("index") / 4096))
    known = position(known, ["user_id"], "_part", [F.col("index")], "_n").select(
        "user_id", (F.col("index") - F.col("_n") + 1).alias("place")
    )
    sizes = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("_seen"))
    columns = [F.col(c) for c in keys.columns]
    free = keys.join(sizes, "user_id", "left").withColumn("_free", total - F.coalesce("_seen", F.lit(0)))
    some = free.filter("_free > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.least(F.lit(per_key), F.col("_free")).cast("int"))))
    step = F.greatest(F.lit(1), F.floor(F.col("_free") / per_key))
    drawn = some.select(
        *columns, "draw", F.pmod(draw(F.lit(salt), *columns) + (F.col("draw") - 1) * step, F.col("_free")).cast("bigint").alias("place")
    )
    marked = drawn.withColumn("_own", F.lit(1)).unionByName(known.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    marked = marked.withColumn("_part", F.floor(F.col("place") / 4096))
    before = 1 - F.col("_own")
    counted = running_total(marked, ["user_id"], "_part", [F.col("place"), F.col("_own")], before.cast("bigint"), "_before")
    found = counted.filter("_own = 1").withColumn("index", F.col("place") + F.col("_before"))
    return found.join(table.withColumnRenamed("item_id", "drawn_item"), "index").select(*keys.columns, "draw", "drawn_item")


def negatives(positives: DataFrame, ratings: DataFrame, items: DataFrame, draws: int = 4) -> DataFrame:
    """``draws`` different unseen items per positive."""
    sampled = unseen_items(positives.select("user_id", "item_id"), ratings, items, draws, "neg")
    return sampled.select("user_id", "item_id", "draw", F.col("drawn_item").alias("negative"))


def arm_statistics(pulls: DataFrame, epsilon: float = 0.1, half_life_days: float = 7.0, as_of: str = "2024-02-01") -> DataFrame:
    """Per arm (arm, ts, reward): mean, UCB1 bound, Beta parameters, decayed mean and epsilon-greedy share."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("ts"))
    weight = F.exp(-F.log(F.lit(2.0)) * age / half_life_days)
    arms = pulls.groupBy("arm").agg(
        F.count(F.lit(1)).alias("pulls"),
        F.sum("reward").alias("wins"),
        (F.sum(weight * F.col("reward")) / F.sum(weight)).alias("decayed"),
    )
    total = arms.agg(
        F.struct(
            F.sum("pulls").alias("pulls"),
            F.count(F.lit(1)).alias("arms"),
            F.max_by("arm", F.struct(F.col("wins") / F.col("pulls"), -F.col("arm"))).alias("best"),
        )
    ).scalar()
    mean = F.col("wins") / F.col("pulls")
    return arms.select(
        "arm",
        "pulls",
        "wins",
        F.round(mean + F.sqrt(2 * F.log(total["pulls"].cast("double")) / F.col("pulls")), 6).alias("ucb1"),
        (F.col("wins") + 1).alias("alpha"),
        (F.col("pulls") - F.col("wins") + 1).alias("beta"),
        F.round("decayed", 6).alias("decayed_mean"),
        F.round(epsilon / total["arms"] + F.when(F.col("arm") == total["best"], 1 - epsilon).otherwise(0.0), 6).alias("greedy_share"),
    )


def linear_arms(rows: DataFrame, features: Sequence[str], reward: str, context: Sequence[float], alpha: float) -> DataFrame:
    """LinUCB score per arm for one context. The d x d sums are plain aggregates; only the solve runs in Python."""
    d = len(features)
    cells = [(i, j) for i in range(d) for j in range(d)]
    sums = rows.groupBy("arm").agg(
        F.array(*[F.sum(F.col(features[i]) * F.col(features[j])) + (1.0 if i == j else 0.0) for i, j in cells]).alias("a"),
        F.array(*[F.sum(F.col(features[i]) * F.col(reward)) for i in range(d)]).alias("b"),
    )
    x = np.array(context, dtype=float)

    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        if a.empty:
            return pd.Series([], dtype="float64")
        inverse = np.linalg.inv(np.stack(a.to_list()).reshape(-1, d, d))
        theta = np.einsum("nij,nj->ni", inverse, np.stack(b.to_list()))
        return pd.Series(theta @ x + alpha * np.sqrt(np.einsum("i,nij,j->n", x, inverse, x)))

    scored = F.pandas_udf(bound, "double")
    return sums.select("arm", F.round(scored("a", "b"), 6).alias("score"))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count for a uniform draw."""
    w = F.lit(len(POISSON_ONE))
    for count in reversed(range(len(POISSON_ONE))):
        w = F.when(u < POISSON_ONE[count], F.lit(count)).otherwise(w)
    return w


def resampled(df: DataFrame, keys: Sequence[str], bags: int) -> DataFrame:
    """Every row with its weight in each of ``bags`` bootstrap samples (zero weights dropped)."""
    spread = df.withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(bags))))
    u = draw(F.col("bag"), *[F.col(k) for k in keys]) / F.lit(4294967296.0)
    return spread.withColumn("w", poisson_weight(u)).filter("w > 0")


def bagged_item_means(ratings: DataFrame, bags: int = 10) -> DataFrame:
    """Item mean rating averaged over bootstrap samples."""
    per_bag = resampled(ratings, ["user_id", "item_id"], bags).groupBy("item_id", "bag").agg(
        (F.sum(F.col("w") * F.col("rating")) / F.sum("w")).alias("mean")
    )
    return per_bag.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_bags"), F.round(F.avg("mean"), 6).alias("bagged_mean"))


def quantised(vectors: DataFrame, codebook: Column, key: str = "item_id") -> DataFrame:
    """Code of every component: the number of codebook values below it, found by eight halving steps."""
    steps = F.array(*[F.lit(2**b) for b in reversed(range(8))])

    def code(x: Column) -> Column:
        return F.aggregate(
            F.col("_steps"),
            F.lit(0),
            lambda at, step: F.when(F.get(F.col("_book"), at + step - 1) < x, at + step).otherwise(at),
        )

    ready = vectors.select(key, "vector").withColumn("_book", codebook).withColumn("_steps", steps)
    return ready.select(key, F.transform("vector", code).alias("codes"))


def feature_table(
    ratings: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, alignment: DataFrame, history: DataFrame | None = None
) -> DataFrame:
    """Factor score, genre alignment and history features of every rating whose user and item have a vector and a history.

    ``history``: the ratings that means and counts come from, where a model is judged on ratings it must not know; all by default.
    """
    from tastelake.functions.scalar import dot

    known = ratings if history is None else history
    per_user = known.groupBy("user_id").agg(F.avg("rating").alias("user_mean"), F.count(F.lit(1)).alias("user_n"))
    per_item = known.groupBy("item_id").agg(F.avg("rating").alias("item_mean"), F.count(F.lit(1)).alias("item_n"))
    left = user_vectors.withColumnRenamed("vector", "user_vector")
    right = item_vectors.select("item_id", F.col("vector").alias("item_vector"))
    # the product is taken where both vectors meet: they are in no later shuffle
    paired = ratings.select("user_id", "item_id", "rating").join(right, "item_id").join(left, "user_id")
    scored = paired.select("user_id", "item_id", "rating", F.round(dot("user_vector", "item_vector"), 6).alias("cf_score"))
    joined = scored.join(per_user, "user_id").join(per_item, "item_id")
    return joined.join(alignment, ["user_id", "item_id"]).select(
        "user_id", "item_id", "rating", "cf_score", "alignment", "user_mean", "user_n", "item_mean", "item_n",
    )
