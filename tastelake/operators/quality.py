"""Data quality, drift, retention and privacy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastelake.functions.scalar import ratio
from tastelake.operators.ordering import exact_quantiles, ranged, running_total
from tastelake.sources.tables import keep_first

# Limits of the drift and degradation rules.
PSI_LIMIT = 0.25
KS_LIMIT = 0.01
DROP_WARN, DROP_PAGE, PROMOTE_SLACK = 0.03, 0.07, 0.02
HOT_DAYS, WARM_DAYS = 30, 90


def clean_ratings(raw: DataFrame, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """First row per (user, item), missing ratings filled with the median of the item, then the range filter."""
    first = keep_first(raw, ["user_id", "item_id"], "seq")
    medians = exact_quantiles(first, "rating", {"median": 0.5}, ["item_id"])
    filled = first.join(medians, "item_id", "left").withColumn("rating", F.coalesce("rating", "median"))
    return filled.filter(F.col("rating").between(low, high)).select("user_id", "item_id", "rating")


def most_common(df: DataFrame, column: str) -> Column:
    """Mode of a column as a scalar; ties go to the smallest value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("m")).scalar()


def rule_rows(df: DataFrame, rules: Mapping[str, Column], limit: float = 0.0) -> DataFrame:
    """(rule, total, bad, rate, passed) for row rules, all in one pass over the data."""
    total = F.count(F.lit(1)).alias("total")
    sums = df.agg(total, *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    long = sums.unpivot(["total"], list(rules), "rule", "bad")
    return graded(long, limit)


def graded(counts: DataFrame, limit: float = 0.0) -> DataFrame:
    rate = ratio(F.col("bad"), F.col("total"))
    return counts.select("rule", "total", "bad", rate.alias("rate"), (rate <= limit).alias("passed"))


def duplicate_row(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """(rule, total, bad) where bad counts rows beyond the first of their key."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("bad")).select(F.lit(rule).alias("rule"), "total", "bad")


def missing_key_row(df: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    orphans = df.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("bad"))
    return orphans.select(F.lit(rule).alias("rule"), total.alias("total"), "bad")


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null values per column."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    return shares.unpivot([], list(columns), "column", "completeness")


def psi(base: DataFrame, current: DataFrame, value: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index over equal-count bins of the baseline; empty bins count ``floor``."""
    edges = exact_quantiles(base, value, {f"e{i}": i / bins for i in range(1, bins)})
    array = edges.select(F.array(*[F.col(f"e{i}") for i in range(1, bins)]).alias("edges")).scalar()

    def counts(df: DataFrame, name: str) -> DataFrame:
        ready = df.select(F.col(value), array.alias("_edges"))
        bin_no = F.size(F.filter("_edges", lambda e: e < F.col(value)))
        return ready.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias(name))

    both = counts(base, "n_base").join(counts(current, "n_current"), "bin", "full")
    n_base = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_current = current.agg(F.count(F.lit(1)).alias("n")).scalar()
    p = F.greatest(F.coalesce("n_base", F.lit(0)) / n_base, F.lit(floor))
    q = F.greatest(F.coalesce("n_current", F.lit(0)) / n_current, F.lit(floor))
    parts = both.select(((q - p) * F.log(q / p)).alias("part"))
    return parts.agg(F.sum("part").alias("psi")).select("psi", (F.col("psi") > PSI_LIMIT).alias("alert"))


def ks_test(base: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and asymptotic p-value, from cumulative counts per distinct value."""
    counts = (
        base.select(value, F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(current.select(value, F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(value)
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    counts = ranged(counts, [F.col(value)], "values")
    totals = counts.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    upto_a = running_total(counts, [], "_range", [F.col(value)], F.col("a"), "cum_a")
    upto_b = running_total(upto_a, [], "_range", [F.col(value)], F.col("b"), "cum_b")
    gap = F.abs(F.col("cum_a") / totals["a"] - F.col("cum_b") / totals["b"])
    size = (totals["a"].cast("double") * totals["b"]) / (totals["a"] + totals["b"])
    distance = upto_b.agg(F.max(gap).alias("d")).withColumn("_l", F.sqrt(size) * F.col("d"))
    series = F.lit(0.0)
    for k in range(1, 101):
        series = series + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * F.col("_l") * F.col("_l"))
    p = F.when(F.col("_l") < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    return distance.select("d", p.alias("p_value")).withColumn("alert", F.col("p_value") < KS_LIMIT)


def compare_runs(champion: DataFrame, challenger: DataFrame, metric: str = "ndcg") -> DataFrame:
    """Metric of two runs per k, relative drop and verdict."""
    joined = champion.select("k", F.col(metric).alias("champion")).join(challenger.select("k", F.col(metric).alias("challenger")), "k")
    drop = F.when(F.col("champion") > 0, (F.col("champion") - F.col("challenger")) / F.col("champion")).otherwise(F.lit(0.0))
    level = F.when(drop >= DROP_PAGE, "page").when(drop >= DROP_WARN, "warn").otherwise("ok")
    return joined.select("k", "champion", "challenger", drop.alias("relative_drop"), level.alias("level"), (drop <= PROMOTE_SLACK).alias("promote"))


def retention_tier(age_days: Column, delete_after: int) -> Column:
    return (
        F.when(age_days > delete_after, "delete").when(age_days < HOT_DAYS, "hot").when(age_days <= WARM_DAYS, "warm").otherwise("cold")
    )


def k_anonymous(df: DataFrame, quasi: Sequence[str], k: int = 5) -> DataFrame:
    """Rows whose quasi-identifier group has at least k rows; group sizes are an aggregate, not a window."""
    big = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
    return df.join(big, list(quasi), "left_semi")


def l_diverse(df: DataFrame, quasi: Sequence[str], sensitive: str, minimum: int) -> DataFrame:
    """Rows whose group shows at least ``minimum`` different sensitive values."""
    kinds = df.select(*quasi, sensitive).distinct().groupBy(*quasi).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(kinds.filter(F.col("_n") >= minimum), list(quasi), "left_semi")


def busy_users(access: DataFrame, limit: int, window: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Users with more than ``limit`` accesses in a sliding window."""
    counts = access.groupBy("user_id", F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > limit).select("user_id", F.unix_timestamp("w.start").alias("window_start"), "n")


def inputs_of(df: DataFrame, folder: str) -> list[str]:
    """Tables below a folder that the plan of a frame reads, as Spark resolves its files."""
    below = [path.split(folder.rstrip("/") + "/", 1) for path in df.inputFiles()]
    return sorted({parts[1].split("/")[0].split(".")[0] for parts in below if len(parts) == 2})


def catalog(datasets: Mapping[str, tuple[DataFrame, str, str, int | None, str]], folder: str) -> DataFrame:
    """name, owner, sensitivity, retention_days, freshness, inputs, n_rows, n_columns of each (frame, owner, sensitivity, days, freshness)."""
    out = None
    for name, (df, owner, level, days, freshness) in datasets.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("name"), F.lit(owner).alias("owner"), F.lit(level).alias("sensitivity"), F.lit(days).cast("int").alias("retention_days"),
            F.lit(freshness).alias("freshness"), F.lit(",".join(inputs_of(df, folder))).alias("inputs"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        )
        out = row if out is None else out.unionByName(row)
    return out
