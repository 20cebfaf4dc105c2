"""Bias, fairness and experiment read-outs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastelake.functions.scalar import bucket100, draw, ratio
from tastelake.functions.stats import student_p, two_sided_p
from tastelake.operators.ordering import exact_quantiles, value_ranks


def popularity_bias(recs: DataFrame, popularity: DataFrame, keys: Sequence[str] = (), share: float = 0.8) -> DataFrame:
    """Share of recommended items at or above the popularity quantile."""
    threshold = exact_quantiles(popularity, "pop", {"threshold": share}).scalar()
    known = recs.join(popularity, "item_id", "left").withColumn("_t", threshold)
    popular = (F.coalesce("pop", F.lit(0)) >= F.col("_t")).cast("int")
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(popular).alias("popular_share"))


def group_parity(values: DataFrame, groups: DataFrame, metric: str) -> DataFrame:
    """min / max of group means; users without a group count as 'unknown'; fewer than two groups give 1."""
    joined = values.join(groups, "user_id", "left").withColumn("group", F.coalesce("group", F.lit("unknown")))
    means = joined.groupBy("group").agg(F.avg(metric).alias("mean"))
    low, high, n = F.min("mean"), F.max("mean"), F.count(F.lit(1))
    return means.agg(n.alias("n_groups"), F.when(n < 2, F.lit(1.0)).otherwise(low / high).alias("parity"))


def assign(users: DataFrame, split: float = 0.5) -> DataFrame:
    """Stable treatment / control by md5 bucket."""
    bucket = bucket100("user_id")
    return users.withColumn("bucket", bucket).withColumn("group", F.when(F.col("bucket") < split * 100, "treatment").otherwise("control"))


def _side(group: str, metric: str) -> list[Column]:
    x = F.when(F.col("group") == group, F.col(metric).cast("double"))
    return [
        F.count(x).alias(f"n_{group}"),
        F.avg(x).alias(f"{group}_mean"),
        F.var_samp(x).alias(f"{group}_var"),
    ]


def ab_readout(values: DataFrame, metric: str, level: float = 0.05) -> DataFrame:
    """Means, lift, pooled t statistic and p-values of treatment against control."""
    sums = values.agg(*_side("control", metric), *_side("treatment", metric))
    nc, nt = F.col("n_control"), F.col("n_treatment")
    df = (nc + nt - 2).cast("double")
    pooled = ((nc - 1) * F.col("control_var") + (nt - 1) * F.col("treatment_var")) / df
    t = (F.col("control_mean") - F.col("treatment_mean")) / F.sqrt(pooled * (1.0 / nc + 1.0 / nt))
    out = sums.select("*", t.alias("t"), df.alias("df")).withColumn("p_value", student_p(F.col("t"), F.col("df")))
    lift = F.when(F.col("control_mean") > 0, F.col("treatment_mean") / F.col("control_mean") - 1).otherwise(0.0)
    return out.select(
        "n_control", "n_treatment", "control_mean", "treatment_mean", lift.alias("lift"), "t",
        two_sided_p(F.col("t")).alias("p_normal"), "p_value", (F.col("p_value") < level).alias("significant"),
    )


def interval(values: DataFrame, keys: Sequence[str], metric: str, z: float = 1.96) -> DataFrame:
    """Mean and normal confidence interval per group."""
    stats = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd")
    )
    half = z * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return stats.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def inverse_propensity(impressions: DataFrame) -> DataFrame:
    """Click rate per rank, the examination propensity relative to rank 1, and propensity-weighted clicks per item.

    impressions(user_id, rank, item_id, click).
    """
    by_rank = impressions.groupBy("rank").agg(F.avg("click").alias("rate"))
    first = by_rank.filter("rank = 1").select("rate").scalar()
    propensity = by_rank.select("rank", ratio(F.col("rate"), first).alias("propensity"))
    weighted = impressions.join(propensity, "rank")
    gain = F.when(F.col("propensity") > 0, F.col("click") / F.col("propensity")).otherwise(0.0)
    return weighted.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("click").alias("clicks"), F.sum(gain).alias("weighted_clicks")
    )


def bootstrap_means(values: DataFrame, keys: Sequence[str], metric: str, bags: int) -> DataFrame:
    """Mean of every bootstrap sample."""
    from tastelake.operators.cf import resampled

    return resampled(values, keys, bags).groupBy("bag").agg((F.sum(F.col("w") * F.col(metric)) / F.sum("w")).alias("mean"))


def rank_sum(values: DataFrame, metric: str) -> DataFrame:
    """Wilcoxon rank-sum of treatment against control with average ranks; normal approximation, corrected for ties."""
    treated = F.sum((F.col("group") == "treatment").cast("bigint"))
    counts = values.groupBy(metric).agg(treated.alias("t"), F.count(F.lit(1)).alias("all"))
    ranks = value_ranks(counts, metric, weight=F.col("all")).join(counts.select(metric, "t"), metric)
    sums = ranks.agg(
        F.sum("t").alias("n_treatment"),
        F.sum("n").alias("n_all"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"),
        F.sum(F.col("t") * (F.col("before") + (F.col("n") + 1) / 2)).alias("w"),
    )
    nt = F.col("n_treatment").cast("double")
    n = F.col("n_all").cast("double")
    centre, spread = nt * (n + 1) / 2, F.sqrt(nt * (n - nt) / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    out = sums.select("n_treatment", "n_all", F.col("w").alias("rank_sum"), ((F.col("w") - centre) / spread).alias("z"))
    return out.withColumn("p_normal", two_sided_p(F.col("z")))


def interleave(first: DataFrame, second: DataFrame, clicks: DataFrame, n: int = 10) -> DataFrame:
    """Merge two lists by rank, a coin per user and rank deciding who goes first, and credit clicks to the team."""
    from tastelake.operators.ordering import top_n

    a = first.select("user_id", "rank", "item_id", F.lit("a").alias("team"))
    b = second.select("user_id", "rank", "item_id", F.lit("b").alias("team"))
    coin = draw(F.lit("coin"), F.col("user_id"), F.col("rank")) % 2
    turn = F.when(F.col("team") == "a", coin).otherwise(1 - coin)
    both = a.unionByName(b).withColumn("turn", turn)
    unique = both.groupBy("user_id", "item_id").agg(F.min(F.struct("rank", "turn", "team")).alias("m"))
    merged = top_n(unique.select("user_id", "item_id", "m.*").withColumnRenamed("rank", "place"), ["user_id"], [F.col("place"), F.col("turn")], n)
    credited = merged.join(clicks.select("user_id", "item_id", F.lit(1).alias("c")), ["user_id", "item_id"], "left")
    return credited.groupBy("team").agg(F.count(F.lit(1)).alias("shown"), F.sum(F.coalesce("c", F.lit(0))).alias("credit"))


def propensity_weighted_mean(ratings: DataFrame, deciles: DataFrame, popularity: DataFrame, items: DataFrame) -> DataFrame:
    """Mean rating with every popularity decile weighted by its share of items instead of its share of ratings."""
    placed = popularity.join(deciles, "pop")
    item_share = placed.groupBy("decile").agg(F.count(F.lit(1)).alias("n_items"))
    rated = ratings.join(placed.select("item_id", "decile"), "item_id").groupBy("decile").agg(
        F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n_ratings")
    )
    return rated.join(item_share, "decile").agg(
        F.sum("n_ratings").alias("n_ratings"),
        (F.sum(F.col("mean") * F.col("n_ratings")) / F.sum("n_ratings")).alias("naive_mean"),
        (F.sum(F.col("mean") * F.col("n_items")) / F.sum("n_items")).alias("weighted_mean"),
    )


def sequential(values: DataFrame, metric: str) -> DataFrame:
    """Cumulative z of treatment minus control by day; one row per day enters the window."""
    x = F.col(metric).cast("double")
    parts = []
    for g in ("treatment", "control"):
        mine = F.when(F.col("group") == g, x)
        parts += [F.count(mine).alias(f"n_{g}"), F.coalesce(F.sum(mine), F.lit(0.0)).alias(f"s_{g}"), F.coalesce(F.sum(mine * mine), F.lit(0.0)).alias(f"q_{g}")]
    daily = values.groupBy("day").agg(*parts)
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = daily.select("day", *[F.sum(f"{m}_{g}").over(upto).alias(f"{m}_{g}") for g in ("treatment", "control") for m in "nsq"])

    def mean(g):
        return F.col(f"s_{g}") / F.col(f"n_{g}")

    def var(g):
        return F.col(f"q_{g}") / F.col(f"n_{g}") - mean(g) * mean(g)

    ready = running.filter("n_treatment > 1 AND n_control > 1")
    se = F.sqrt(var("treatment") / F.col("n_treatment") + var("control") / F.col("n_control"))
    return ready.select("day", "n_treatment", "n_control", F.when(se > 0, (mean("treatment") - mean("control")) / se).alias("z"))


def regret(pulls: DataFrame) -> DataFrame:
    """Cumulative regret per day against the best arm's mean; the window holds one row per day."""
    arms = pulls.groupBy("arm").agg(F.avg("reward").alias("mean"))
    best = arms.agg(F.max("mean").alias("m")).scalar()
    daily = pulls.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("pulls"), F.sum("reward").alias("wins"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.col("pulls") * F.col("best") - F.col("wins")
    return daily.withColumn("best", best).select("day", "pulls", F.sum(lost).over(upto).alias("regret"))
