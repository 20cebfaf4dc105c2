"""Offline ranking quality, list quality and split operators.

Inputs: recs(user_id, rank, item_id), short lists; relevant(user_id, item_id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastelake.functions.scalar import draw, ratio
from tastelake.operators import cf
from tastelake.operators.ordering import value_ranks
from tastelake.session import stored


def _ideal(n: Column) -> Column:
    """Largest possible discounted gain with n relevant items."""
    gains = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: 1.0 / F.log2(i + 1.0))
    return F.when(n > 0, F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def hits(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    """recs with hit 0/1 and the running number of hits; the window covers one short list."""
    flagged = recs.select("user_id", "rank", "item_id").join(
        relevant.select("user_id", "item_id", F.lit(1).alias("_rel")), ["user_id", "item_id"], "left"
    )
    marked = flagged.withColumn("hit", F.coalesce("_rel", F.lit(0))).drop("_rel")
    return marked.withColumn("hits_so_far", F.sum("hit").over(Window.partitionBy("user_id").orderBy("rank")))


def per_user(recs: DataFrame, relevant: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Precision, recall, NDCG, average precision and reciprocal rank per user and k."""
    marked = hits(recs, relevant).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    sizes = relevant.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n_rel"))
    inside = F.col("rank") <= F.col("k")
    gain = F.when(inside, F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    exact = F.when(inside & (F.col("hit") == 1), F.col("hits_so_far") / F.col("rank")).otherwise(0.0)
    first = F.min(F.when(inside & (F.col("hit") == 1), F.col("rank")))
    sums = marked.groupBy("user_id", "k").agg(
        F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias("n_hits"),
        F.sum(gain).alias("dcg"),
        F.sum(exact).alias("ap_sum"),
        first.alias("first_hit"),
    )
    n_rel = F.coalesce("n_rel", F.lit(0))
    ideal = _ideal(F.least(n_rel, F.col("k")))
    return sums.join(sizes, "user_id", "left").select(
        "user_id",
        "k",
        (F.col("n_hits") / F.col("k")).alias("precision"),
        ratio(F.col("n_hits"), n_rel).alias("recall"),
        ratio(F.col("dcg"), ideal).alias("ndcg"),
        ratio(F.col("ap_sum"), n_rel).alias("ap"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr"),
    )


def report(recs: DataFrame, relevant: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Means over users with a list, one row per k."""
    return per_user(recs, relevant, ks).groupBy("k").agg(
        F.count(F.lit(1)).alias("n_users"),
        *[
            F.round(F.avg(c), 6).alias(name)
            for c, name in (("precision", "precision"), ("recall", "recall"), ("ndcg", "ndcg"), ("ap", "map"), ("rr", "mrr"))
        ],
    )


def coverage(recs: DataFrame, items: DataFrame) -> DataFrame:
    """Share of the catalogue that is ever recommended."""
    shown = recs.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return items.agg(F.count(F.lit(1)).alias("n_items")).select(
        shown.alias("n_shown"), "n_items", ratio(shown, F.col("n_items")).alias("coverage")
    )


def intra_list_diversity(recs: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """Mean pairwise 1 - cosine per user, without building pairs: the sum of all pair products of unit vectors is
    (|sum|^2 - n) / 2. Vectors are added whole; items without one do not count."""
    from tastelake.functions.scalar import unit

    def square(u: Column) -> Column:
        return F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x)

    units = item_vectors.filter("vector IS NOT NULL").select("item_id", unit("vector").alias("u"))
    rows = recs.select("user_id", "item_id").join(units, "item_id")
    sums = rows.groupBy("user_id").agg(
        Summarizer.sum(array_to_vector("u")).alias("s"), F.sum(square(F.col("u"))).alias("qq"), F.count(F.lit(1)).alias("n")
    )
    total = sums.withColumn("ss", square(vector_to_array("s")))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return total.select(
        "user_id", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(1 - (F.col("ss") - F.col("qq")) / 2 / F.greatest(pairs, F.lit(1.0))).alias("diversity")
    )


def novelty(recs: DataFrame, popularity: DataFrame) -> DataFrame:
    """Mean -log2 of the popularity share per user; items without popularity do not count.

    Lists of a few popular items make a tiny file of many rows, which Spark would broadcast by its size. So the lists stay the left side of a left
    join, and only the popularity of the shown items, stored apart, may travel; means are taken in the same pass.
    """
    total = popularity.agg(F.sum("pop").cast("double").alias("t")).scalar()
    shown = popularity.filter("pop > 0").join(recs.select("item_id").distinct(), "item_id", "left_semi")
    shown = stored(shown.select("item_id", (-F.log2(F.col("pop") / total)).alias("_info")), "shown")
    rows = recs.select("user_id", "item_id").join(shown, "item_id", "left")
    return rows.groupBy("user_id").agg(F.coalesce(F.avg("_info"), F.lit(0.0)).alias("novelty"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve as a rank statistic; ties count half."""
    counts = df.groupBy(score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("all"))
    counts = counts.withColumn("neg", F.col("all") - F.col("pos"))
    ranked = value_ranks(counts, score, weight=F.col("neg")).join(counts.select(score, "pos", "neg"), score)
    return ranked.agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2)).alias("wins"),
    ).select("n_pos", "n_neg", ratio(F.col("wins"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def exposure(recs: DataFrame, items: DataFrame) -> DataFrame:
    """Times shown per catalogue item, zeros included."""
    shown = recs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id").join(shown, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("shown"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini index from the table of values: equal values occupy consecutive ranks."""
    ranks = value_ranks(df, value)
    total = ranks.agg(F.sum("n").alias("total")).scalar()
    n, before, x = F.col("n"), F.col("before"), F.col(value)
    rank_sum = n * before + n * (n + 1) / 2
    return ranks.withColumn("_total", total).agg(
        F.sum(x * (2 * rank_sum - n * (F.col("_total") + 1))).alias("top"), F.sum(x * n).alias("sum"), F.max("_total").alias("n_items")
    ).select("n_items", ratio(F.col("top"), F.col("n_items") * F.col("sum")).alias("gini"))


def long_tail(recs: DataFrame, popularity: DataFrame, deciles: DataFrame, head_from: float = 0.8) -> DataFrame:
    """Share of tail items (percent rank below the head) that are shown at all."""
    tail = popularity.join(deciles, "pop").filter(F.col("percent_rank") < head_from).select("item_id")
    shown = tail.join(recs.select("item_id").distinct(), "item_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
    return tail.agg(F.count(F.lit(1)).alias("n_tail")).select("n_tail", shown.alias("n_shown"), ratio(shown, F.col("n_tail")).alias("share"))


def global_split(ratings: DataFrame, train_end: str, validation_end: str) -> DataFrame:
    """Part by two cut-off dates."""
    a, b = F.lit(train_end).cast("timestamp"), F.lit(validation_end).cast("timestamp")
    part = F.when(F.col("ts") < a, "train").when(F.col("ts") < b, "validation").otherwise("test")
    return ratings.withColumn("part", part)


def folds(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Reproducible fold number 0..k-1 of every row from an md5 of its key."""
    return df.withColumn("fold", (draw(*[F.col(c) for c in keys]) % k).cast("int"))


def random_baseline(users: DataFrame, items: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """``n`` different random unseen items per user."""
    drawn = cf.unseen_items(users.select("user_id"), seen, items, n, "base")
    return drawn.select("user_id", F.col("draw").alias("rank"), F.col("drawn_item").alias("item_id"))
