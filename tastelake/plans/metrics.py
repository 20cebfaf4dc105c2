"""Online and business metrics."""

from pyspark.sql import functions as F

from tastelake.operators import metrics
from tastelake.plans.oracle import sql
from tastelake.plans.recommend import cf_lists
from tastelake.plans.registry import query
from tastelake.sources import tables

_FUNNEL = """count(*) FILTER (WHERE interaction_type = 'view') AS views, count(*) FILTER (WHERE interaction_type = 'click') AS clicks,
             count(*) FILTER (WHERE interaction_type = 'purchase') AS purchases"""
_RATES = """CASE WHEN views > 0 THEN clicks / views::DOUBLE ELSE 0 END AS ctr, CASE WHEN clicks > 0 THEN purchases / clicks::DOUBLE ELSE 0 END AS conversion"""


@query(
    "ctr_conversion",
    "M1 M2",
    sql(f"SELECT *, {_RATES} FROM (SELECT item_id, {_FUNNEL} FROM interactions GROUP BY item_id)"),
)
def ctr_conversion(v):
    return metrics.funnel(v.interactions, ["item_id"])


@query(
    "ctr_against_baseline",
    "W14 M1",
    sql(f"""SELECT strftime(day, '%Y-%m-%d') AS day, round(ctr, 6) AS ctr, round(base, 6) AS baseline, coalesce(ctr < base, false) AS below FROM (
              SELECT *, avg(ctr) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base FROM (
                SELECT *, {_RATES} FROM (SELECT ts::DATE AS day, {_FUNNEL} FROM interactions GROUP BY day)))"""),
)
def ctr_against_baseline(v):
    daily = metrics.funnel(v.interactions, [F.to_date("ts").alias("day")])
    out = metrics.against_baseline(daily, "ctr")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("ctr", 6).alias("ctr"), F.round("baseline", 6).alias("baseline"), "below")


_SESSIONS = {
    "sess": """SELECT user_id, session_no, count(*) AS n_events, ((max(at_us) - min(at_us)) // 1000000)::BIGINT AS duration_seconds FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM (
        SELECT user_id, event_id, ts, epoch_us(ts) AS at_us,
               CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 THEN 1 ELSE 0 END AS new
        FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session_no"""
        .replace("sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT", "CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT)")
}


@query("sessions", "W8 M3", sql("SELECT * FROM sess", _SESSIONS))
def sessions(v):
    return metrics.sessions(v.interactions)


@query(
    "session_depth",
    "M3",
    sql("""SELECT count(*) AS n_sessions, round(avg(duration_seconds), 6) AS mean_duration, round(avg(n_events), 6) AS mean_depth, max(n_events) AS max_depth
           FROM sess""", _SESSIONS),
)
def session_depth(v):
    return metrics.sessions(v.interactions).agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.round(F.avg("duration_seconds"), 6).alias("mean_duration"),
        F.round(F.avg("n_events"), 6).alias("mean_depth"),
        F.max("n_events").alias("max_depth"),
    )


@query(
    "retention",
    "M4",
    sql("""SELECT strftime(cohort, '%Y-%m-%d') AS cohort, count(*) AS n_users, avg(d1) AS retention_d1, avg(d7) AS retention_d7, avg(d30) AS retention_d30 FROM (
             SELECT cohort, user_id, max((age = 1)::INT) AS d1, max((age = 7)::INT) AS d7, max((age = 30)::INT) AS d30 FROM (
               SELECT user_id, cohort, date_diff('day', cohort, day) AS age FROM (
                 SELECT DISTINCT user_id, ts::DATE AS day, min(ts::DATE) OVER (PARTITION BY user_id) AS cohort FROM interactions))
             GROUP BY cohort, user_id) GROUP BY cohort"""),
)
def retention(v):
    return metrics.retention(v.interactions).withColumn("cohort", F.date_format("cohort", "yyyy-MM-dd"))


@query(
    "revenue_by_segment",
    "M5",
    sql("""SELECT segment, count(*) AS n_orders, round(sum(o_totalprice) / count(*), 4) AS average_order,
             round(sum(o_totalprice) / count(DISTINCT user_id), 4) AS revenue_per_user
           FROM orders JOIN users ON o_custkey = user_id GROUP BY segment"""),
)
def revenue_by_segment(v):
    return metrics.revenue(v.table("orders"), v.users)


@query(
    "request_rate",
    "M6",
    sql("""SELECT (epoch_us(ts) // 300000000 * 300)::BIGINT AS slot, endpoint, count(*) AS n, count(*) / 300::DOUBLE AS rate FROM requests GROUP BY slot, endpoint"""),
)
def request_rate(v):
    return metrics.request_rate(v.requests)


_ERRORS = {
    "slots": """SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS slot, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors,
                  count(*) FILTER (WHERE is_error) / greatest(count(*)::DOUBLE, 1e-9) AS ratio FROM requests GROUP BY slot"""
}


@query("error_ratio", "M7", sql("SELECT * FROM slots", _ERRORS))
def error_ratio(v):
    return metrics.error_ratio(v.requests, 60)


@query(
    "latency_percentiles",
    "M8",
    sql("""SELECT endpoint, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99
           FROM requests GROUP BY endpoint""".replace("quantile_cont(latency_ms, 0.5)", "round(quantile_cont(latency_ms, 0.5), 6)")
        .replace("quantile_cont(latency_ms, 0.95)", "round(quantile_cont(latency_ms, 0.95), 6)")
        .replace("quantile_cont(latency_ms, 0.99)", "round(quantile_cont(latency_ms, 0.99), 6)")),
)
def latency_percentiles(v):
    out = metrics.latency(v.requests, ["endpoint"])
    return out.select("endpoint", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query(
    "latency_by_hour",
    "M8",
    sql("""SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS slot, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
             round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM requests GROUP BY slot"""),
)
def latency_by_hour(v):
    out = metrics.latency(v.requests.withColumn("slot", metrics.slot("ts", 60)), ["slot"])
    return out.select("slot", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("latency_sketch_rollup", "M8 A13", sql("SELECT endpoint, count(*) AS n, true AS rank_within FROM requests GROUP BY endpoint"))
def latency_sketch_rollup(v):
    """Hourly sketches merged to one 95 % quantile per endpoint, and whether its true rank is within two percent of that."""
    hourly = metrics.latency_sketches(v.requests.withColumn("slot", metrics.slot("ts", 60)), ["slot", "endpoint"])
    merged = hourly.groupBy("endpoint").agg(F.sum("n").alias("n"), F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
    merged = merged.select("endpoint", "n", F.expr("kll_sketch_get_quantile_double(sketch, 0.95D)").alias("p95"))
    ranks = v.requests.join(merged, "endpoint").groupBy("endpoint", "n").agg(
        F.count_if(F.col("latency_ms") <= F.col("p95")).alias("upto"), F.count_if(F.col("latency_ms") < F.col("p95")).alias("below")
    )
    within = (F.col("upto") / F.col("n") >= 0.93) & (F.col("below") / F.col("n") <= 0.97)
    return ranks.select("endpoint", "n", within.alias("rank_within"))


@query(
    "alert_runs",
    "M9",
    sql("""SELECT min(slot) AS from_slot, max(slot) AS to_slot, count(*) AS n_slots FROM (
             SELECT slot, slot - row_number() OVER (ORDER BY slot) * 3600 AS island FROM slots WHERE ratio > 0.2)
           GROUP BY island HAVING count(*) >= 3""", _ERRORS),
)
def alert_runs(v):
    return metrics.alert_runs(metrics.error_ratio(v.requests, 60), F.col("ratio") > 0.2, 3, 60)


@query(
    "error_budget",
    "M10",
    sql("""SELECT strftime(day, '%Y-%m-%d') AS day, n, errors, round(sum(errors) OVER w / (sum(n) OVER w * (1 - 0.75::DOUBLE)), 6) AS budget_used FROM (
             SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors FROM requests GROUP BY day)
           WINDOW w AS (ORDER BY day)"""),
)
def error_budget(v):
    out = metrics.error_budget(v.requests, 0.75)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "errors", F.round("budget_used", 6).alias("budget_used"))


@query(
    "peak_factors",
    "M11",
    sql("""SELECT 'hour' AS kind, slot::INTEGER AS slot, round(n / avg(n) OVER (), 6) AS factor FROM (SELECT hour(ts) AS slot, count(*) AS n FROM requests GROUP BY slot)
           UNION ALL SELECT 'weekday', (slot + 1)::INTEGER, round(n / avg(n) OVER (), 6) FROM (SELECT dayofweek(ts) AS slot, count(*) AS n FROM requests GROUP BY slot)"""),
)
def peak_factors(v):
    return metrics.peak_factors(v.requests).withColumn("factor", F.round("factor", 6))


@query(
    "capacity_forecast",
    "M12",
    sql("""SELECT round(peak_rate, 6) AS peak_rate, round(peak_rate * 2.0::DOUBLE, 6) AS forecast, ceil(peak_rate * 2.0::DOUBLE / 0.0021::DOUBLE * 1.3::DOUBLE)::BIGINT AS units
           FROM (SELECT max(n) / 3600::DOUBLE AS peak_rate FROM slots)""", _ERRORS),
)
def capacity_forecast(v):
    out = metrics.capacity(v.requests, 2.0, 0.0021)
    return out.select(F.round("peak_rate", 6).alias("peak_rate"), F.round("forecast", 6).alias("forecast"), "units")


@query(
    "cache_hit_share",
    "M13",
    sql("""SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS slot, count(*) AS n, avg((latency_ms < 50)::INT) AS share, avg((latency_ms < 50)::INT) < 0.5 AS too_low
           FROM requests GROUP BY slot"""),
)
def cache_hit_share(v):
    return metrics.hit_share(v.requests, F.col("latency_ms") < 50, 60)


@query(
    "log_exposures",
    "M14 P23",
    sql("""SELECT 'collaborative' AS algorithm, item_id, count(*) AS exposures, round(avg(rank), 6) AS mean_rank FROM cf_recs WHERE rank <= 10 GROUP BY item_id"""),
)
def log_exposures(v):
    log = tables.log_rows(cf_lists(v).filter("rank <= 10"), "collaborative")
    shown = tables.explode_log(log)
    return shown.groupBy("algorithm", "item_id").agg(F.count(F.lit(1)).alias("exposures"), F.round(F.avg("rank"), 6).alias("mean_rank"))
