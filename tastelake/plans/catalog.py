"""Catalogue: trending lists, search, paging, scalar projections."""

from pyspark.sql import functions as F

from tastelake.functions import scalar as s
from tastelake.operators import catalog, trending
from tastelake.plans.oracle import sql
from tastelake.plans.registry import query

_CARD = "title, genres, year, poster_url, vote_average"


@query(
    "trending_topk",
    "A1 A2 O1 W5 J2 F5",
    sql(f"SELECT CAST(rank AS INTEGER) AS rank, t.item_id, score, {_CARD} FROM trending_top t JOIN items USING (item_id)"),
)
def trending_topk(v):
    best = trending.top(trending.scores(v.ratings_raw, v.items))
    return best.join(v.items, "item_id").select("rank", "item_id", "score", *s.card())


@query(
    "trending_page",
    "O4 J2 P1",
    sql(f"""SELECT item_id, score, {_CARD} FROM trending_top JOIN items USING (item_id) WHERE rank <= 20"""),
)
def trending_page(v):
    best = trending.top(trending.scores(v.ratings_raw), 500).filter("rank <= 20")
    return best.join(v.items, "item_id").select("item_id", "score", *s.card())


@query(
    "trending_30d",
    "A2 X2",
    sql("""SELECT item_id, score FROM (SELECT item_id, round(avg(rating) * ln(1 + count(*)), 4) AS score FROM ratings_raw
           WHERE ts >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY AND ts < TIMESTAMP '2001-08-02' GROUP BY item_id)
           ORDER BY score DESC, item_id LIMIT 500"""),
)
def trending_30d(v):
    recent = trending.in_window(v.ratings_raw, "2001-08-02", 30)
    return trending.top(trending.scores(recent)).select("item_id", "score")


@query(
    "trending_decayed",
    "W10 X2",
    sql("""SELECT item_id, round(sum(rating * exp(-ln(2.0::DOUBLE) * date_diff('day', ts::DATE, DATE '2001-08-02')
                  / 180.0::DOUBLE)), 4) AS score FROM ratings_raw GROUP BY item_id"""),
)
def trending_decayed(v):
    return trending.decayed(v.ratings_raw, "2001-08-02", 180.0)


@query(
    "table_counts",
    "A3",
    sql("""SELECT 'items' AS name, count(*) AS n FROM items UNION ALL SELECT 'ratings', count(*) FROM ratings_raw
           UNION ALL SELECT 'users', count(*) FROM users"""),
)
def table_counts(v):
    parts = [("items", v.items), ("ratings", v.ratings_raw), ("users", v.users)]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "item_scalars",
    "P1 P2 P3 P4 P6 P12",
    sql("""SELECT item_id,
             CASE WHEN suffix(title, ')') AND contains(title, '(')
                  THEN TRY_CAST(trim(replace(string_split(title, '(')[-1], ')', '')) AS INTEGER) END AS parsed_year,
             len(list_filter(string_split(genres, '|'), lambda x: trim(x) <> ''))::INTEGER AS n_genres,
             string_split(genres, '|')[1] AS first_genre, nullif(overview, '') AS overview,
             coalesce(floor(vote_average / 2 + 0.5), 0)::INTEGER AS stars
           FROM items"""),
)
def item_scalars(v):
    found = s.split_values("genres")
    return v.items.select(
        "item_id",
        s.year_from_title("title").alias("parsed_year"),
        F.size(found).alias("n_genres"),
        F.get(F.slice(found, 1, 3), F.lit(0)).alias("first_genre"),
        F.nullif(F.col("overview"), F.lit("")).alias("overview"),
        s.stars("vote_average").alias("stars"),
    )


@query(
    "user_scalars",
    "P8 P15 P16 P17 P18",
    sql("""SELECT regexp_replace('user-' || CAST(user_id AS VARCHAR), '^user-', '') AS user_key,
             sha256(username) AS name_hash, sha256(lower(username) || '@example.org') || '@anonymized.com' AS email,
             CASE WHEN age < 18 THEN 'under_18' WHEN age < 30 THEN '18-29' WHEN age < 50 THEN '30-49' ELSE '50+' END AS age_band,
             regexp_replace('10.' || CAST(nation_id AS VARCHAR) || '.7.' || CAST(age AS VARCHAR), '\\.\\d+$', '.0') AS ip
           FROM (SELECT *, floor((balance + 1000) / 125)::INTEGER AS age FROM users)"""),
)
def user_scalars(v):
    shaped = v.users.select(
        F.concat(F.lit(s.USER_PREFIX), F.col("user_id").cast("string")).alias("raw_key"),
        "username",
        F.concat(F.lower("username"), F.lit("@example.org")).alias("email"),
        F.floor((F.col("balance") + 1000) / 125).cast("int").alias("age"),
        "nation_id",
    ).withColumn("ip", F.concat_ws(".", F.lit("10"), "nation_id", F.lit("7"), "age"))
    return shaped.select(
        s.user_key("raw_key").alias("user_key"),
        F.sha2("username", 256).alias("name_hash"),
        s.email_pseudonym("email").alias("email"),
        s.age_band("age").alias("age_band"),
        s.mask_ip("ip").alias("ip"),
    )


@query(
    "event_scalars",
    "P7 P9 P10 P14 P19 P20",
    sql("""SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning'
                  WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS day_part,
             dayofweek(ts) IN (0, 6) AS weekend, (dayofweek(ts) + 1)::INTEGER AS day_of_week,
             least(intensity / 100, 1.0) AS score, least(intensity / 100 * 1.2::DOUBLE, 1.0) AS confidence,
             floor(intensity)::BIGINT AS bucket,
             CASE WHEN item_id > 0 THEN intensity / item_id ELSE 0 END AS ratio
           FROM interactions"""),
)
def event_scalars(v):
    shaped = v.interactions.withColumn("raw", F.col("intensity") / 100)
    return shaped.select(
        "event_id",
        s.day_part("ts").alias("day_part"),
        s.is_weekend("ts").alias("weekend"),
        F.dayofweek("ts").alias("day_of_week"),
        s.clamp_score("raw").alias("score"),
        s.confidence("raw").alias("confidence"),
        F.floor("intensity").alias("bucket"),
        s.ratio(F.col("intensity"), F.col("item_id")).alias("ratio"),
    )


@query(
    "vector_scalars",
    "P21 P22",
    sql("""SELECT item_id, round(sqrt(list_dot_product(vector, vector)), 6) AS norm,
             round(list_dot_product(vector, list_reverse(vector)), 6) AS mirror_dot,
             round(list_dot_product(vector, vector) / (CASE WHEN list_dot_product(vector, vector) = 0 THEN 1
                   ELSE sqrt(list_dot_product(vector, vector)) END), 6) AS unit_dot FROM item_vectors"""),
)
def vector_scalars(v):
    return v.item_vectors.select(
        "item_id",
        F.round(s.norm("vector"), 6).alias("norm"),
        F.round(s.dot("vector", F.reverse("vector")), 6).alias("mirror_dot"),
        F.round(s.dot("vector", s.unit("vector")), 6).alias("unit_dot"),
    )


@query("genre_list", "A8 F7", sql("SELECT DISTINCT genre FROM item_genres WHERE genre <> '(no genres listed)' AND trim(genre) <> ''"))
def genre_list(v):
    return catalog.genres(v.items)


_SEARCH = """lower(title) LIKE '%ring%' OR lower(genres) LIKE '%ring%' OR lower(overview) LIKE '%ring%'"""


@query(
    "search_filtered",
    "F1 F2 F3 F4 P5",
    sql(f"""SELECT item_id, {_CARD} FROM items WHERE ({_SEARCH}) AND list_contains(string_split(genres, '|'), 'PROMO')
            AND year >= 1970 AND year <= 2000 AND vote_average >= 9.2"""),
)
def search_filtered(v):
    return catalog.search(v.items, "RING", "PROMO", 1970, 2000, 9.2).select("item_id", *s.card())


@query(
    "search_page",
    "F4 O2",
    sql(f"""SELECT item_id, title, count(*) OVER () AS total, CAST(2 AS INTEGER) AS page,
              CAST(ceil(count(*) OVER () / CAST(20 AS DOUBLE)) AS BIGINT) AS total_pages
            FROM items WHERE {_SEARCH} ORDER BY item_id LIMIT 20 OFFSET 20"""),
)
def search_page(v):
    return catalog.page(catalog.search(v.items, "ring").select("item_id", "title"), "item_id", 2, 20)


@query(
    "list_page",
    "F1 O2 P1",
    sql(f"""SELECT item_id, {_CARD}, count(*) OVER () AS total, CAST(3 AS INTEGER) AS page,
              CAST(ceil(count(*) OVER () / CAST(20 AS DOUBLE)) AS BIGINT) AS total_pages
            FROM items WHERE list_contains(string_split(genres, '|'), 'ECONOMY') ORDER BY item_id LIMIT 20 OFFSET 40"""),
)
def list_page(v):
    return catalog.page(catalog.by_genre(v.items, "ECONOMY").select("item_id", *s.card()), "item_id", 3, 20)


@query(
    "keyed_lookup",
    "J12",
    sql(f"""SELECT event_id, item_id, {_CARD} FROM interactions JOIN items USING (item_id) WHERE interaction_type = 'view'"""),
)
def keyed_lookup(v):
    wanted = v.interactions.filter(F.col("interaction_type") == "view").select("event_id", "item_id")
    return wanted.join(v.items, "item_id").select("event_id", "item_id", *s.card())
