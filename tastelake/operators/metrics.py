"""Online and business metrics from interaction, request and order tables.

Window functions over time slots see one row per slot (five minutes, an hour or a day), never the raw events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastelake.functions.scalar import ratio
from tastelake.operators.ordering import exact_quantiles, previous, ranged, running_total


def funnel(interactions: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Views, clicks, purchases, click-through and conversion rate per group."""
    kind = F.col("interaction_type")
    counts = interactions.groupBy(*keys).agg(
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "purchase").alias("purchases"),
    )
    return counts.withColumn("ctr", ratio(F.col("clicks"), F.col("views"))).withColumn(
        "conversion", ratio(F.col("purchases"), F.col("clicks"))
    )


def sessions(interactions: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions per user: a pause longer than the gap starts a new one."""
    rows = interactions.select("user_id", "event_id", "ts", "item_id", F.unix_micros("ts").alias("at"))
    order = [F.col("ts"), F.col("event_id")]
    rows = ranged(rows, [F.col("user_id"), *order], "events")
    spaced = previous(rows, ["user_id"], "_range", order, {"at": "before"})
    pause = F.col("at") - F.col("before")
    starts = F.when(F.col("before").isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0).cast("bigint")
    numbered = running_total(spaced, ["user_id"], "_range", order, starts, "session_no")
    return numbered.groupBy("user_id", "session_no").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.floor((F.max("at") - F.min("at")) / 1_000_000).alias("duration_seconds"),
    )


def retention(interactions: DataFrame, days: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """Users active again n days after their first day, per cohort day."""
    active = interactions.select("user_id", F.to_date("ts").alias("day")).distinct()
    first = active.groupBy("user_id").agg(F.min("day").alias("cohort"))
    aged = active.join(first, "user_id").withColumn("age", F.datediff("day", "cohort"))
    per_user = aged.groupBy("cohort", "user_id").agg(*[F.max((F.col("age") == d).cast("int")).alias(f"d{d}") for d in days])
    return per_user.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n_users"), *[F.avg(f"d{d}").alias(f"retention_d{d}") for d in days]
    )


def revenue(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders, average order value and revenue per customer, by segment."""
    per_user = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    return per_user.join(users, "user_id").groupBy("segment").agg(
        F.sum("n").alias("n_orders"),
        F.round(F.sum("total") / F.sum("n"), 4).alias("average_order"),
        F.round(F.sum("total") / F.count(F.lit(1)), 4).alias("revenue_per_user"),
    )


def slot(ts: str, minutes: int) -> Column:
    """Start of the time slot as epoch seconds."""
    size = minutes * 60
    return F.unix_timestamp(ts) - F.pmod(F.unix_timestamp(ts), F.lit(size))


def request_rate(requests: DataFrame, minutes: int = 5) -> DataFrame:
    """Requests per second by slot and endpoint."""
    return requests.groupBy(slot("ts", minutes).alias("slot"), "endpoint").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / (minutes * 60)).alias("rate")
    )


def error_ratio(requests: DataFrame, minutes: int = 5) -> DataFrame:
    errors, n = F.count_if("is_error"), F.count(F.lit(1))
    return requests.groupBy(slot("ts", minutes).alias("slot")).agg(
        n.alias("n"), errors.alias("errors"), (errors / F.greatest(n.cast("double"), F.lit(1e-9))).alias("ratio")
    )


def latency(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact p50 / p95 / p99 per group."""
    return exact_quantiles(requests, "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys)


def latency_sketches(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mergeable quantile sketches per group, for roll-ups over stored windows."""
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.expr("kll_sketch_agg_double(latency_ms)").alias("sketch"))


def alert_runs(slots: DataFrame, breach: Column, hold: int, minutes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of at least ``hold`` consecutive slots in breach (slot = epoch seconds of a slot start)."""
    bad = slots.filter(breach)
    spec = Window.partitionBy(*keys).orderBy("slot")
    island = F.col("slot") - F.row_number().over(spec) * (minutes * 60)
    runs = bad.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min("slot").alias("from_slot"), F.max("slot").alias("to_slot"), F.count(F.lit(1)).alias("n_slots")
    )
    return runs.filter(F.col("n_slots") >= hold).drop("_island")


def error_budget(requests: DataFrame, objective: float) -> DataFrame:
    """Share of the error budget used up to each day."""
    daily = requests.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors")
    )
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum("errors").over(upto) / (F.sum("n").over(upto) * (1 - objective))
    return daily.select("day", "n", "errors", used.alias("budget_used"))


def peak_factors(requests: DataFrame) -> DataFrame:
    """Traffic of each hour of day and weekday relative to the overall mean of these groups."""
    def factors(kind: str, value: Column) -> DataFrame:
        counts = requests.groupBy(value.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        mean = counts.agg(F.avg("n").alias("m")).scalar()
        return counts.select(F.lit(kind).alias("kind"), "slot", (F.col("n") / mean).alias("factor"))

    return factors("hour", F.hour("ts")).unionByName(factors("weekday", F.dayofweek("ts")))


def capacity(requests: DataFrame, growth: float, per_unit: float, headroom: float = 1.3, minutes: int = 60) -> DataFrame:
    """Units needed for the forecast peak: peak rate x growth / capacity per unit x headroom."""
    rates = request_rate(requests, minutes).groupBy("slot").agg(F.sum("rate").alias("rate"))
    peak = rates.agg(F.max("rate").alias("peak_rate"))
    need = F.col("peak_rate") * growth / per_unit * headroom
    return peak.select("peak_rate", (F.col("peak_rate") * growth).alias("forecast"), F.ceil(need).alias("units"))


def hit_share(requests: DataFrame, hit: Column, minutes: int, low: float = 0.5) -> DataFrame:
    """Share of requests served from prepared results per slot, and whether it is too low."""
    shares = requests.groupBy(slot("ts", minutes).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("int")).alias("share"))
    return shares.withColumn("too_low", F.col("share") < low)


def against_baseline(daily: DataFrame, value: str, days: int = 7) -> DataFrame:
    """Value of each day beside the mean of the previous days (one row per day)."""
    before = Window.orderBy("day").rowsBetween(-days, -1)
    base = daily.withColumn("baseline", F.avg(value).over(before))
    return base.withColumn("below", F.coalesce(F.col(value) < F.col("baseline"), F.lit(False)))
