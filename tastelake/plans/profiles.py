"""User and item profiles, aggregates, windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tastelake.operators import incremental, profile
from tastelake.operators.ordering import previous, ranged, top_n
from tastelake.plans.oracle import sql
from tastelake.plans.registry import query
from tastelake.session import stored


@query(
    "user_summary",
    "A4 A5 J1",
    sql("""SELECT user_id, coalesce(n, 0) AS n_ratings, coalesce(mean, 0) AS avg_rating FROM users
           LEFT JOIN (SELECT user_id, count(*) AS n, avg(rating) AS mean FROM ratings GROUP BY user_id) USING (user_id)"""),
)
def user_summary(v):
    return profile.user_summary(v.users, v.ratings)


_PREFS = {
    "prefs": """
        SELECT user_id, genre, share, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, genre) AS rank FROM (
          SELECT user_id, genre, w / (CASE WHEN t = 0 THEN 1 ELSE t END) AS share FROM (
            SELECT *, sum(w) OVER (PARTITION BY user_id) AS t FROM (
              SELECT user_id, genre, sum(rating) AS w FROM ratings JOIN item_genres USING (item_id) GROUP BY user_id, genre)))"""
}


@query(
    "genre_preference",
    "A6 W4 P3",
    sql("SELECT user_id, CAST(rank AS INTEGER) AS rank, genre, share FROM prefs WHERE rank <= 10", _PREFS),
)
def genre_preference(v):
    return profile.genre_preferences(v.ratings, v.item_genres).select("user_id", "rank", "genre", "share")


@query(
    "favourite_genre",
    "A19",
    sql("""SELECT user_id, max(CASE WHEN rank = 1 THEN genre END) AS favourite, count(*) AS n_genres
           FROM prefs WHERE rank <= 10 GROUP BY user_id""", _PREFS),
)
def favourite_genre(v):
    return profile.favourite_genre(profile.genre_preferences(v.ratings, v.item_genres))


@query(
    "rating_histogram",
    "A7 A20 P14",
    sql("""SELECT user_id, star::INTEGER AS star, count(*) FILTER (WHERE floor(rating) = star) AS n
           FROM ratings, range(1, 6) AS stars(star) GROUP BY user_id, star"""),
)
def rating_histogram(v):
    return profile.star_histogram(v.ratings)


@query(
    "recent_items",
    "W3 J1",
    sql("""SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, title, rating FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS rank FROM ratings)
           JOIN items USING (item_id) WHERE rank <= 20"""),
)
def recent_items(v):
    recent = top_n(v.ratings, ["user_id"], [F.col("ts").desc(), F.col("item_id")], 20)
    return recent.join(v.items.select("item_id", "title"), "item_id").select("user_id", "rank", "item_id", "title", "rating")


@query(
    "matrix_density",
    "A9",
    sql("""SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
             1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id))::DOUBLE AS sparsity FROM ratings"""),
)
def matrix_density(v):
    r = v.stored_ratings
    return r.agg(F.count(F.lit(1)).alias("n_ratings")).select(
        "n_ratings",
        r.select("user_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_users"),
        r.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_items"),
    ).withColumn("sparsity", 1 - F.col("n_ratings") / (F.col("n_users") * F.col("n_items")))


@query("seen_items", "A10", sql("SELECT DISTINCT user_id, item_id FROM ratings_raw"))
def seen_items(v):
    return v.ratings_raw.select("user_id", "item_id").distinct()


@query(
    "user_features",
    "A11",
    sql("""SELECT user_id, count(*) AS n_ratings, avg(rating) AS avg_rating, round(var_samp(rating), 6) AS rating_variance,
             date_diff('day', max(ts)::DATE, DATE '2001-08-02')::INTEGER AS recency_days,
             round(count(*) / greatest(date_diff('day', min(ts)::DATE, max(ts)::DATE), 1)::DOUBLE, 6) AS ratings_per_day
           FROM ratings GROUP BY user_id"""),
)
def user_features(v):
    return profile.user_features(v.ratings, "2001-08-02")


@query(
    "item_features",
    "A12",
    sql("""SELECT item_id, year, coalesce(n, 0) AS n_ratings, coalesce(mean, 0) AS avg_rating,
             round(coalesce(mean * ln(1 + n), 0), 4) AS trending
           FROM items LEFT JOIN (SELECT item_id, count(*) AS n, avg(rating) AS mean FROM ratings GROUP BY item_id)
           USING (item_id)"""),
)
def item_features(v):
    return profile.item_features(v.items, v.ratings)


@query(
    "approx_distinct_items",
    "A13",
    sql("""SELECT count(DISTINCT user_id) AS n_users, true AS users_within, count(DISTINCT item_id) AS n_items, true AS items_within
           FROM ratings_raw"""),
)
def approx_distinct_items(v):
    """Sketches per year merged to one estimate: exact counts, and whether the merged estimates are within five percent of them."""
    yearly = v.ratings_raw.groupBy(F.year("ts").alias("year")).agg(
        F.hll_sketch_agg("user_id", 12).alias("users"), F.hll_sketch_agg("item_id", 12).alias("items")
    )
    merged = yearly.agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.hll_sketch_estimate(F.hll_union_agg("items")).alias("items")
    ).agg(F.first(F.struct("users", "items"))).scalar()
    exact = v.ratings_raw.select("user_id", "item_id")
    users = exact.select("user_id").distinct().agg(F.count(F.lit(1)).alias("n_users"))
    n_items = exact.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    both = users.withColumn("n_items", n_items).withColumn("_e", merged)
    within = [(F.abs(F.col(f"_e.{c}") - F.col(f"n_{c}")) <= 0.05 * F.col(f"n_{c}")).alias(f"{c}_within") for c in ("users", "items")]
    return both.select("n_users", within[0], "n_items", within[1])


@query(
    "seen_membership",
    "A14 J5",
    sql("""SELECT event_id, EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = i.user_id AND r.item_id = i.item_id) AS seen
           FROM interactions i"""),
)
def seen_membership(v):
    """Has the user rated the item? Exact; Spark itself puts a runtime Bloom filter before large joins."""
    known = v.ratings.select("user_id", "item_id", F.lit(True).alias("known"))
    return v.interactions.join(known, ["user_id", "item_id"], "left").select(
        "event_id", F.coalesce("known", F.lit(False)).alias("seen")
    )


@query(
    "catalog_rollup",
    "A15",
    sql("""SELECT p_type AS type, p_brand AS brand, count(*) AS n, grouping(p_type, p_brand)::INTEGER AS level
           FROM part GROUP BY ROLLUP (p_type, p_brand)"""),
)
def catalog_rollup(v):
    return (
        v.table("part")
        .rollup(F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
    )


@query(
    "popularity_threshold",
    "A16",
    sql("""SELECT quantile_cont(n, 0.8) AS p80 FROM (SELECT count(*)::DOUBLE AS n FROM ratings GROUP BY item_id)"""),
)
def popularity_threshold(v):
    counts = v.ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))
    return profile.exact_quantiles(counts, "pop", {"p80": 0.8})


@query(
    "interaction_pivot",
    "A17",
    sql("""SELECT user_id, item_id, count(*) FILTER (WHERE interaction_type = 'view') AS n_view,
             count(*) FILTER (WHERE interaction_type = 'click') AS n_click,
             count(*) FILTER (WHERE interaction_type = 'purchase') AS n_purchase,
             round(coalesce(sum(intensity) FILTER (WHERE interaction_type = 'view'), 0), 4) AS view_intensity
           FROM interactions GROUP BY user_id, item_id"""),
)
def interaction_pivot(v):
    kind = F.col("interaction_type")
    return v.interactions.groupBy("user_id", "item_id").agg(
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("view", "click", "purchase")],
        F.round(F.coalesce(F.sum(F.when(kind == "view", F.col("intensity"))), F.lit(0.0)), 4).alias("view_intensity"),
    )


@query(
    "interaction_counts",
    "A17",
    sql("""SELECT user_id, item_id, interaction_type, count(*) AS n, round(sum(intensity), 4) AS intensity_sum
           FROM interactions GROUP BY user_id, item_id, interaction_type"""),
)
def interaction_counts(v):
    """Count and intensity per user, item and type, for every type that occurs."""
    return v.interactions.groupBy("user_id", "item_id", "interaction_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("intensity"), 4).alias("intensity_sum")
    )


@query(
    "heavy_hitters",
    "A18",
    sql("SELECT item_id, count(*) AS n FROM ratings_raw GROUP BY item_id ORDER BY n DESC, item_id LIMIT 25"),
)
def heavy_hitters(v):
    counts = v.ratings_raw.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "item_id").limit(25)


_DAILY, _MERGED = 40, 50


@query(
    "frequent_items",
    "A18 A13",
    sql(f"""SELECT item_id, lower, upper, bound FROM (
        WITH counts AS (SELECT ts::DATE AS day, item_id, count(*) AS n FROM interactions GROUP BY ALL),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, item_id) AS r FROM counts),
        days AS (SELECT day, coalesce(max(n) FILTER (WHERE r = {_DAILY + 1}), 0) AS b FROM ranks GROUP BY day),
        kept AS (SELECT item_id, sum(n)::BIGINT AS lower, sum(b)::BIGINT AS met FROM ranks JOIN days USING (day) WHERE r <= {_DAILY} GROUP BY item_id),
        sized AS (SELECT item_id, lower, (lower + (SELECT sum(b) FROM days) - met)::BIGINT AS upper,
                         row_number() OVER (ORDER BY lower DESC, item_id) AS r FROM kept)
        SELECT item_id, lower, upper,
               greatest((SELECT sum(b) FROM days), (SELECT coalesce(max(upper), 0) FROM sized WHERE r > {_MERGED}))::BIGINT AS bound
        FROM sized WHERE r <= {_MERGED})"""),
)
def frequent_items(v):
    """Daily summaries of bounded size merged to one: sure count, most it can be, and most that an unlisted item can have."""
    daily = incremental.frequent_items(v.interactions.withColumn("day", F.to_date("ts")), "day", "item_id", _DAILY)
    return incremental.merged_frequent_items(stored(daily, "daily"), "day", "item_id", _MERGED)


@query(
    "iqr_outliers",
    "F10",
    sql("""SELECT event_id, intensity FROM interactions,
             (SELECT quantile_cont(intensity, 0.25) AS q1, quantile_cont(intensity, 0.75) AS q3 FROM interactions)
           WHERE intensity BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)"""),
)
def iqr_outliers(v):
    return profile.within_iqr(v.interactions.select("event_id", "intensity"), "intensity")


@query(
    "zscore_outliers",
    "F11",
    sql("""SELECT event_id, round((intensity - m) / sd, 6) AS z FROM interactions,
             (SELECT avg(intensity) AS m, stddev_samp(intensity) AS sd FROM interactions)
           WHERE abs((intensity - m) / sd) > 3"""),
)
def zscore_outliers(v):
    df = v.interactions.select("event_id", "intensity")
    return df.withColumn("z", profile.z_score(df, "intensity")).filter(F.abs("z") > 3).select("event_id", F.round("z", 6).alias("z"))


@query(
    "scaled_features",
    "W12 W13",
    sql("""SELECT user_id, round((balance - lo) / (hi - lo), 6) AS scaled, round((balance - m) / sd, 6) AS standard FROM users,
             (SELECT min(balance) AS lo, max(balance) AS hi, avg(balance) AS m, stddev_samp(balance) AS sd FROM users)"""),
)
def scaled_features(v):
    df = v.users.select("user_id", "balance")
    return df.select(
        "user_id",
        F.round(profile.min_max(df, "balance"), 6).alias("scaled"),
        F.round(profile.z_score(df, "balance"), 6).alias("standard"),
    )


@query(
    "popularity_deciles",
    "W15",
    sql("""SELECT item_id, pop, percent_rank() OVER (ORDER BY pop) AS percent_rank,
             (floor((rank() OVER (ORDER BY pop) - 1) * 10 / (count(*) OVER ())::DOUBLE) + 1)::INTEGER AS decile FROM popularity"""),
)
def popularity_deciles(v):
    train, _ = profile.temporal_split(v.stored_ratings)
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))
    return pop.join(profile.deciles(pop, "pop"), "pop").select("item_id", "pop", "percent_rank", "decile")


@query(
    "moving_activity",
    "W11",
    sql("""SELECT item_id, day, n, sum(n) OVER w7 ::BIGINT AS n_7d, sum(total) OVER w7 / sum(n) OVER w7 AS mean_7d,
             sum(n) OVER w30 ::BIGINT AS n_30d, sum(total) OVER w30 / sum(n) OVER w30 AS mean_30d FROM (
             SELECT item_id, ts::DATE AS day, count(*) AS n, sum(rating) AS total FROM ratings_raw GROUP BY item_id, day)
           WINDOW w7 AS (PARTITION BY item_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
                  w30 AS (PARTITION BY item_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)"""
        .replace("sum(n) OVER w7 ::BIGINT", "CAST(sum(n) OVER w7 AS BIGINT)")
        .replace("sum(n) OVER w30 ::BIGINT", "CAST(sum(n) OVER w30 AS BIGINT)")),
)
def moving_activity(v):
    return profile.moving_activity(v.ratings_raw)


@query(
    "like_state",
    "W16",
    sql("""SELECT user_id, item_id, arg_max(interaction_type, (ts, event_id)) = 'click' AS liked
           FROM interactions WHERE interaction_type IN ('click', 'view') GROUP BY user_id, item_id"""),
)
def like_state(v):
    return profile.like_state(v.interactions, on="click", off="view")


@query(
    "time_since_previous",
    "W10",
    sql("""SELECT event_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id)
             AS gap_seconds, round(exp(-ln(2::DOUBLE) * date_diff('day', ts::DATE, DATE '2024-02-01') / 7.0::DOUBLE), 6) AS recency_weight
           FROM interactions"""),
)
def time_since_previous(v):
    rows = v.interactions.select("event_id", "user_id", "ts", F.unix_timestamp("ts").alias("at"), F.to_date("ts").alias("day"))
    order = [F.col("ts"), F.col("event_id")]
    spaced = previous(ranged(rows, [F.col("user_id"), *order], "events"), ["user_id"], "_range", order, {"at": "before"})
    age = F.datediff(F.lit("2024-02-01").cast("date"), "day")
    return spaced.select(
        "event_id",
        (F.col("at") - F.col("before")).alias("gap_seconds"),
        F.round(F.exp(-F.log(F.lit(2.0)) * age / 7.0), 6).alias("recency_weight"),
    )


@query(
    "as_of_features",
    "J11",
    sql("""SELECT f.user_id, f.item_id, epoch(f.ts)::BIGINT AS seconds, f.rating, g.mean AS known_mean
           FROM ratings f ASOF LEFT JOIN (
             SELECT item_id, month + INTERVAL 1 MONTH AS ts, mean FROM (
               SELECT item_id, date_trunc('month', ts) AS month,
                      sum(sum(rating)) OVER w / sum(count(*)) OVER w AS mean
               FROM ratings_raw GROUP BY item_id, date_trunc('month', ts)
               WINDOW w AS (PARTITION BY item_id ORDER BY date_trunc('month', ts)))) g
           ON f.item_id = g.item_id AND f.ts >= g.ts"""),
)
def as_of_features(v):
    monthly = v.ratings_raw.groupBy("item_id", F.date_trunc("month", "ts").alias("month")).agg(
        F.sum("rating").alias("total"), F.count(F.lit(1)).alias("n")
    )
    upto = Window.partitionBy("item_id").orderBy("month")
    features = monthly.select(
        "item_id",
        F.add_months("month", 1).cast("timestamp").alias("ts"),
        (F.sum("total").over(upto) / F.sum("n").over(upto)).alias("known_mean"),
    )
    joined = profile.as_of_features(v.ratings, features, "item_id", "known_mean", ["user_id", "rating"])
    return joined.select("user_id", "item_id", F.unix_timestamp("ts").alias("seconds"), "rating", "known_mean")


@query(
    "valid_ratings",
    "F5 F6 F9 J5",
    sql("""SELECT user_id, item_id, rating FROM ratings WHERE rating BETWEEN 0.5 AND 5.0 AND rating >= 4.0
             AND user_id IN (SELECT user_id FROM users) AND item_id IN (SELECT item_id FROM items)"""),
)
def valid_ratings(v):
    relevant = v.ratings.filter(F.col("rating").between(0.5, 5.0) & (F.col("rating") >= 4.0))
    known = relevant.join(v.users, "user_id", "left_semi").join(v.items, "item_id", "left_semi")
    return known.select("user_id", "item_id", "rating")


@query(
    "foreign_key_check",
    "J9",
    sql("""SELECT 'item_id' AS key, count(*) AS n_missing FROM interactions i
             WHERE NOT EXISTS (SELECT 1 FROM item_vectors x WHERE x.item_id = i.item_id)
           UNION ALL SELECT 'user_id', count(*) FROM users u WHERE NOT EXISTS (SELECT 1 FROM interactions x WHERE x.user_id = u.user_id)"""),
)
def foreign_key_check(v):
    orphan_items = v.interactions.join(v.item_vectors, "item_id", "left_anti")
    silent_users = v.users.join(v.interactions, "user_id", "left_anti")
    count = F.count(F.lit(1)).alias("n_missing")
    return orphan_items.agg(count).select(F.lit("item_id").alias("key"), "n_missing").unionByName(
        silent_users.agg(count).select(F.lit("user_id").alias("key"), "n_missing")
    )


@query(
    "set_operations",
    "U3 U4 J3",
    sql("""SELECT 'both' AS part, count(*) AS n FROM (SELECT user_id, item_id FROM ratings INTERSECT SELECT user_id, item_id FROM interactions)
           UNION ALL SELECT 'interacted_only', count(*) FROM (SELECT user_id, item_id FROM interactions EXCEPT SELECT user_id, item_id FROM ratings)"""),
)
def set_operations(v):
    rated, touched = v.ratings.select("user_id", "item_id"), v.interactions.select("user_id", "item_id")
    count = F.count(F.lit(1)).alias("n")
    return rated.intersect(touched).agg(count).select(F.lit("both").alias("part"), "n").unionByName(
        touched.subtract(rated).agg(count).select(F.lit("interacted_only").alias("part"), "n")
    )


@query(
    "temporal_user_split",
    "W6 X13",
    sql("SELECT 'train' AS part, user_id, item_id, rating FROM train UNION ALL SELECT 'test', user_id, item_id, rating FROM test"),
)
def temporal_user_split(v):
    return profile.numbered_split(v.stored_ratings).select("part", "user_id", "item_id", "rating")


@query(
    "last_item_holdout",
    "W7",
    sql("""SELECT user_id, item_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn
           FROM ratings) WHERE rn = 1"""),
)
def last_item_holdout(v):
    return profile.last_holdout(v.stored_ratings)[1].select("user_id", "item_id", "rating")


@query(
    "genre_alignment",
    "R31",
    sql("""SELECT user_id, item_id, sum(share) AS alignment FROM ratings JOIN item_genres USING (item_id)
           JOIN prefs USING (user_id, genre) GROUP BY user_id, item_id""", _PREFS).replace("sum(share) AS", "round(sum(share), 6) AS"),
)
def genre_alignment(v):
    shares = profile.genre_preferences(v.stored_ratings, v.item_genres, None)
    pairs = v.stored_ratings.select("user_id", "item_id").join(v.item_genres, "item_id")
    return pairs.join(shares, ["user_id", "genre"]).groupBy("user_id", "item_id").agg(F.round(F.sum("share"), 6).alias("alignment"))
