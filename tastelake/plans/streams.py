"""Streaming queries: the event table is read as a file stream, and what the stream delivers is checked."""

from pyspark.sql import functions as F

from tastelake.plans.oracle import sql
from tastelake.plans.registry import query
from tastelake.session import work_path
from tastelake.streaming import jobs


def event_stream(v):
    schema = v.table("events").schema
    raw = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.col("event_type").alias("interaction_type"),
        F.col("value").alias("intensity"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
    )


def request_stream(v):
    return event_stream(v).select("ts", (F.col("interaction_type") == "error").alias("is_error"))


@query(
    "stream_validated_ingest",
    "T1 S10",
    sql("""SELECT broken, count(*) AS n FROM (SELECT CASE WHEN intensity <= 300 THEN '' ELSE 'intensity_range' END AS broken FROM interactions) GROUP BY broken"""),
)
def stream_validated_ingest(v):
    step = jobs.ingest_step({"intensity_range": F.col("intensity") <= 300, "user_present": F.col("user_id").isNotNull()})
    rows = jobs.delivered(v.spark, event_stream(v), "append", "ingest", step)
    return rows.groupBy(F.concat_ws(",", "broken_rules").alias("broken")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_dedup",
    "T2",
    sql("SELECT interaction_type, count(*) AS n, round(sum(intensity), 4) AS intensity_sum FROM interactions GROUP BY interaction_type"),
)
def stream_dedup(v):
    """Every event arrives twice and is counted once."""
    twice = event_stream(v).unionByName(event_stream(v))
    rows = jobs.delivered(v.spark, jobs.without_duplicates(twice), "append", "dedup")
    return rows.groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("intensity"), 4).alias("intensity_sum"))


@query(
    "tumbling_trending",
    "T3",
    sql("""SELECT window_start, CAST(rank AS INTEGER) AS rank, item_id, score FROM (
             SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY score DESC, item_id) AS rank FROM (
               SELECT (epoch_us(ts) // 86400000000 * 86400)::BIGINT AS window_start, item_id, round(sum(intensity) / count(*) * ln(1 + count(*)), 4) AS score
               FROM interactions GROUP BY window_start, item_id)) WHERE rank <= 10"""),
)
def tumbling_trending(v):
    from tastelake.operators.ordering import top_n

    rows = jobs.delivered(v.spark, jobs.window_scores(event_stream(v), "1 day"), "update", "tumbling")
    counts = jobs.latest(rows, ["window_start", "item_id"])
    scored = counts.select("window_start", "item_id", F.round(F.col("total") / F.col("n") * F.log1p(F.col("n").cast("double")), 4).alias("score"))
    best = top_n(scored, ["window_start"], [F.col("score").desc(), F.col("item_id")], 10)
    return best.select("window_start", "rank", "item_id", "score")


@query(
    "sliding_rate",
    "T4 M6",
    sql("""SELECT window_start, count(*) AS n FROM (
             SELECT unnest(range((epoch_us(ts) // 300000000 * 300 - 3300)::BIGINT, (epoch_us(ts) // 300000000 * 300 + 1)::BIGINT, 300)) AS window_start FROM interactions)
           GROUP BY window_start"""),
)
def sliding_rate(v):
    rows = jobs.delivered(v.spark, jobs.rates(event_stream(v)), "update", "sliding")
    return jobs.latest(rows, ["window_start"])


@query(
    "session_stream",
    "T5 T6",
    sql("""SELECT user_id, min(at_us) AS start_us, max(at_us) + 1800000000 AS end_us, count(*) AS n_events,
             max(at_us) + 1800000000 > (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM interactions) - 3600000000 AS is_open FROM (
             SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS session_no FROM (
               SELECT user_id, event_id, epoch_us(ts) AS at_us, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000
                      THEN 1 ELSE 0 END AS new FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
           GROUP BY user_id, session_no"""),
)
def session_stream(v):
    return jobs.all_sessions(v.spark, event_stream(v))


@query(
    "stream_static_join",
    "T7",
    sql("SELECT genre, count(*) AS n, round(sum(intensity), 4) AS intensity_sum FROM interactions JOIN item_genres USING (item_id) GROUP BY genre"),
)
def stream_static_join(v):
    counts = jobs.enriched(event_stream(v), v.items).select(F.explode(F.split("genres", r"\|")).alias("genre"), "intensity")
    counts = counts.groupBy("genre").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("total"))
    rows = jobs.latest(jobs.delivered(v.spark, counts, "update", "static-join"), ["genre"])
    return rows.select("genre", "n", F.round("total", 4).alias("intensity_sum"))


@query(
    "attributed_clicks",
    "T8 M1",
    sql("""SELECT v.event_id AS view_id, c.event_id AS click_id, c.user_id, c.item_id FROM interactions v JOIN interactions c
             ON v.user_id = c.user_id AND v.item_id = c.item_id AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 1 DAY
           WHERE v.interaction_type = 'view' AND c.interaction_type = 'click'"""),
)
def attributed_clicks(v):
    views = event_stream(v).filter("interaction_type = 'view'")
    clicks = event_stream(v).filter("interaction_type = 'click'")
    rows = jobs.delivered(v.spark, jobs.attributed_clicks(views, clicks, "1 day"), "append", "attributed")
    return rows.drop("batch_id")


@query(
    "late_rows",
    "T6",
    sql("""SELECT window_start, count(*) FILTER (WHERE NOT late) AS n_counted, count(*) FILTER (WHERE late) AS n_late FROM (
             SELECT day * 86400 AS window_start, event_id % 10 = 0 AND (day + 1) * 86400000000 <= top - 86400000000 AS late FROM (
               SELECT event_id, (epoch_us(ts) // 86400000000)::BIGINT AS day,
                      (SELECT max(epoch_us(ts)) FROM interactions WHERE event_id % 10 <> 0) AS top FROM interactions)) GROUP BY window_start"""),
)
def late_rows(v):
    """Every tenth event arrives after all others: rows a day behind the watermark are left out of the daily counts, and counted apart."""
    feed, counted, split = (work_path(v.spark, x) for x in ("feed", "counted", "split"))
    events = v.table("events")
    for part in (events.filter("event_id % 10 <> 0"), events.filter("event_id % 10 = 0")):
        part.write.mode("append").parquet(feed)
        stream = v.spark.readStream.schema(events.schema).parquet(feed).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
        jobs.deliver(jobs.rates(stream, "1 day", "1 day", "1 day"), "update", counted, f"{counted}-state")
        jobs.split_late(stream, split, f"{split}-state", "1 day", "1 day")
    on_time = jobs.latest(v.spark.read.option("basePath", counted).parquet(counted), ["window_start"])
    late = v.spark.read.option("basePath", f"{split}/late").parquet(f"{split}/late")
    late = late.groupBy(F.unix_timestamp("window_start").alias("window_start")).agg(F.count(F.lit(1)).alias("late"))
    both = on_time.join(late, "window_start", "full")
    return both.select("window_start", F.coalesce("n", F.lit(0)).alias("n_counted"), F.coalesce("late", F.lit(0)).alias("n_late"))


@query(
    "online_profile",
    "T9",
    sql("""SELECT user_id, n_events, n_purchases, last_seen, favourite_genre, genre_weight FROM (
             SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE interaction_type = 'purchase') AS n_purchases,
                    max(epoch_us(ts) // 1000000)::BIGINT AS last_seen FROM interactions GROUP BY user_id)
           LEFT JOIN (SELECT user_id, genre AS favourite_genre, w AS genre_weight FROM (
             SELECT user_id, genre, round(sum(intensity), 4) AS w FROM interactions JOIN item_genres USING (item_id) GROUP BY user_id, genre)
             QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, genre) = 1) USING (user_id)"""),
)
def online_profile(v):
    """Activity and the genre with the largest weight of every user, from two running aggregations of the stream."""
    from tastelake.operators.ordering import top_n

    seen = jobs.latest(jobs.delivered(v.spark, jobs.running_profiles(event_stream(v)), "update", "profile"), ["user_id"])
    weights = jobs.delivered(v.spark, jobs.running_genre_weights(event_stream(v), v.items), "update", "genre-weights")
    weights = jobs.latest(weights, ["user_id", "genre"]).select("user_id", F.col("genre").alias("favourite_genre"), F.round("weight", 4).alias("genre_weight"))
    best = top_n(weights, ["user_id"], [F.col("genre_weight").desc(), F.col("favourite_genre")], 1).drop("rank")
    return seen.join(best, "user_id", "left")


@query(
    "expiring_profile",
    "T9 state",
    sql("""SELECT user_id, n_events, last_seen, closed FROM (
        WITH cut AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS middle FROM interactions),
        e AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) < middle AS early FROM interactions, cut),
        marks AS (SELECT max(us) FILTER (WHERE early) // 1000 - 86400000 AS one, max(us) // 1000 - 86400000 AS two FROM e),
        firsts AS (SELECT user_id, count(*) AS n, max(us // 1000000)::BIGINT AS last_seen FROM e WHERE early GROUP BY user_id),
        ended AS (SELECT user_id, n, last_seen FROM firsts, marks WHERE last_seen * 1000 + 43200000 < one),
        rest AS (SELECT user_id, count(*) AS n, max(us // 1000000)::BIGINT AS last_seen FROM e
                 WHERE NOT early OR user_id NOT IN (SELECT user_id FROM ended) GROUP BY user_id)
        SELECT user_id, n AS n_events, last_seen, true AS closed FROM ended
        UNION ALL SELECT user_id, n, last_seen, last_seen * 1000 + 43200000 < two FROM rest, marks)"""),
)
def expiring_profile(v):
    """Profiles that end after half a day without events, over two arrivals of the events, split at the middle of their time.

    A user who comes back after the end has a second profile. Profiles that the watermark has not passed are open.
    """
    feed, path = work_path(v.spark, "feed"), work_path(v.spark, "expiring")
    events = v.table("events")
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    early = F.unix_micros(F.col("ts").cast("timestamp")) < low + (high - low) // 2
    for part in (events.filter(early), events.filter(~early)):
        part.write.mode("append").parquet(feed)
        stream = v.spark.readStream.schema(events.schema).parquet(feed).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
        jobs.deliver(jobs.expiring_profiles(stream, "12 hours"), "update", path, f"{path}-state")
    rows = v.spark.read.option("basePath", path).parquet(path)
    open_ = jobs.latest(rows, ["user_id"]).filter("NOT closed")
    return rows.filter("closed").select(*open_.columns).unionByName(open_).select("user_id", "n_events", "last_seen", "closed")


@query(
    "stream_rating_upsert",
    "T10 S7",
    sql("""SELECT user_id, item_id, arg_max(intensity, (ts, event_id)) AS rating, min(epoch_us(ts) // 1000000)::BIGINT AS first_seconds
           FROM interactions WHERE interaction_type = 'purchase' GROUP BY user_id, item_id"""),
)
def stream_rating_upsert(v):
    bought = event_stream(v).filter("interaction_type = 'purchase'").select(
        "user_id", "item_id", F.col("intensity").alias("rating"), "ts", F.struct("ts", "event_id").alias("seq")
    )
    deltas = jobs.delivered(v.spark, bought, "append", "upsert", jobs.rating_deltas)
    return jobs.merged_ratings(deltas).select("user_id", "item_id", "rating", F.unix_timestamp("ts").alias("first_seconds"))


@query(
    "exactly_once_counts",
    "T11",
    sql("SELECT interaction_type, count(*) AS n FROM interactions GROUP BY interaction_type"),
)
def exactly_once_counts(v):
    """The same job started twice on one checkpoint: the second start finds nothing new."""
    path, state = work_path(v.spark, "counted"), work_path(v.spark, "counted-state")
    for _ in range(2):
        jobs.deliver(event_stream(v), "append", path, state)
    rows = v.spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_alerts",
    "T12 M9",
    sql("""SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS window_start, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors FROM requests
           GROUP BY window_start HAVING count(*) FILTER (WHERE is_error) / count(*)::DOUBLE > 0.3"""),
)
def stream_alerts(v):
    rows = jobs.latest(jobs.delivered(v.spark, jobs.error_windows(request_stream(v)), "update", "alerts"), ["window_start"])
    return rows.filter(F.col("errors") / F.col("n") > 0.3)
