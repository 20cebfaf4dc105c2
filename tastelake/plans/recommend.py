"""Recommendation core: scoring, similar items, hybrid lists, fusion."""

from pyspark.sql import functions as F

from tastelake.functions.scalar import round_to
from tastelake.operators import hybrid, similarity, text, trending
from tastelake.plans.oracle import rounded, sql
from tastelake.plans.registry import query
from tastelake.session import stored, work_path
from tastelake.sources import files, tables

_CONTENT = {
    "item_feats": "SELECT item_id, unnest(string_split(genres, '|') || string_split(overview, ' ')) AS term FROM items",
    "item_tf": "SELECT item_id, term, count(*) AS tf FROM item_feats GROUP BY item_id, term",
    "item_w": """SELECT item_id, term, tf * ln((SELECT count(DISTINCT item_id) + 1 FROM item_tf) / (df + 1)::DOUBLE) AS w
                 FROM item_tf JOIN (SELECT term, count(*) AS df FROM item_tf GROUP BY term) USING (term)""",
    "item_len": "SELECT item_id, sqrt(sum(w * w)) AS len FROM item_w GROUP BY item_id",
    "content_pairs": """SELECT a.item_id, b.item_id AS neighbor_id, sum(a.w / la.len * b.w / lb.len) AS s
                        FROM item_w a JOIN item_w b ON a.term = b.term AND a.item_id <> b.item_id
                        JOIN item_len la ON la.item_id = a.item_id JOIN item_len lb ON lb.item_id = b.item_id GROUP BY ALL""",
    "content_similar": """SELECT item_id, rank, neighbor_id, score FROM (
          SELECT item_id, neighbor_id, round(s, 4) AS score, row_number() OVER (PARTITION BY item_id
                 ORDER BY round(s, 10) DESC, neighbor_id) AS rank FROM content_pairs WHERE round(s, 10) > 0) WHERE rank <= 20""",
}
_GENRE = {
    "genre_w": "SELECT user_id, genre, sum(rating) AS w FROM ratings JOIN item_genres USING (item_id) GROUP BY user_id, genre",
    "genre_len": "SELECT user_id, sqrt(sum(w * w)) AS len FROM genre_w GROUP BY user_id",
    "genre_scores": """SELECT user_id, item_id, sum(w / len) / sqrt(2::DOUBLE) AS s FROM genre_w JOIN genre_len USING (user_id)
                       JOIN item_genres USING (genre) GROUP BY user_id, item_id""",
    "content_all": """SELECT u.user_id, i.item_id, coalesce(s, 0) AS s FROM (SELECT user_id FROM genre_len WHERE len > 0) u
                      CROSS JOIN items i LEFT JOIN genre_scores g ON g.user_id = u.user_id AND g.item_id = i.item_id""",
    "content_recs": """SELECT user_id, rank, item_id, score FROM (
          SELECT user_id, item_id, round(s, 4) AS score,
                 row_number() OVER (PARTITION BY user_id ORDER BY round(s, 10) DESC, item_id) AS rank
          FROM content_all g WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = g.user_id AND r.item_id = g.item_id))
        WHERE rank <= 50""",
    "signals": """SELECT user_id, 'cf' AS signal, item_id, score FROM cf_recs
                  UNION ALL SELECT user_id, 'content', item_id, score FROM content_recs
                  UNION ALL SELECT user_id, 'trending', item_id, score FROM (
                    SELECT u.user_id, t.item_id, t.score, row_number() OVER (PARTITION BY u.user_id ORDER BY t.rank) AS rn
                    FROM (SELECT DISTINCT user_id FROM ratings) u, trending_top t
                    WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = u.user_id AND r.item_id = t.item_id)) WHERE rn <= 50""",
    "normal": """SELECT user_id, signal, item_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS score FROM (
                   SELECT *, min(score) OVER (PARTITION BY user_id, signal) AS lo, max(score) OVER (PARTITION BY user_id, signal) AS hi
                   FROM signals)""",
    "weights": """SELECT * FROM (VALUES ('cf', 0.30::DOUBLE), ('content', 0.25::DOUBLE), ('ncf', 0.20::DOUBLE),
                  ('trending', 0.15::DOUBLE), ('diversity', 0.10::DOUBLE)) AS w(signal, weight)""",
    "fused": """SELECT user_id, rank, item_id, s FROM (
                  SELECT user_id, item_id, s, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 10) DESC, item_id) AS rank
                  FROM (SELECT user_id, item_id, sum(weight * score) AS s FROM normal JOIN weights USING (signal)
                        GROUP BY user_id, item_id)) WHERE rank <= 20""",
}


def cf_lists(v):
    return stored(hybrid.score_unseen(v.user_vectors, v.item_vectors, v.vector_ratings, 50), "cf-lists")


def trending_top(v):
    return stored(trending.top(trending.scores(v.ratings_raw, v.items)), "trending")


def cf_neighbors(v):
    return similarity.cosine_neighbors(v.item_vectors)


def content_weights(v):
    features = F.concat(F.split("genres", r"\|"), F.split("overview", " "))
    counts = v.items.select("item_id", F.explode(features).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return stored(text.tfidf(counts, "item_id"), "content-weights")


def content_neighbors(v):
    return similarity.sparse_neighbors(content_weights(v), "item_id", "term", "weight")


def content_lists(v):
    return stored(hybrid.content_recs(v.stored_ratings, v.item_genres, 50, once=True), "content-lists")


def hybrid_lists(v, trend=None):
    """Lists of vectors with the trending pool; of the ratings only those of the pool are asked for."""
    trend = trending_top(v) if trend is None else trend
    return hybrid.with_trending(cf_lists(v), trend, v.ratings_of(trend))


_LIST = "user_id, CAST(rank AS INTEGER) AS rank, item_id, score"


@query("user_scores_top50", "R2 J3 J7 W1 P13", sql(f"SELECT {_LIST} FROM cf_recs"))
def user_scores_top50(v):
    return cf_lists(v)


_SIM = "item_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score"


@query("item_neighbors_cosine", "R3 J8 W2 P21 P22", sql(f"SELECT {_SIM} FROM cf_similar"))
def item_neighbors_cosine(v):
    return cf_neighbors(v)


@query("content_neighbors_tfidf", "R4 V1 V2 V5", sql(f"SELECT {_SIM} FROM content_similar", _CONTENT))
def content_neighbors_tfidf(v):
    return content_neighbors(v)


@query(
    "hybrid_similar",
    "R5 J6 F8 U1 X6",
    sql(f"""SELECT item_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM (
             SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbor_id) AS rank FROM (
               SELECT item_id, neighbor_id, {rounded('sum(p)', 4)} AS score FROM (
                 SELECT item_id, neighbor_id, 0.45::DOUBLE * score AS p FROM cf_similar
                 UNION ALL SELECT item_id, neighbor_id, 0.30::DOUBLE * score FROM content_similar)
               GROUP BY item_id, neighbor_id HAVING sum(p) > 0)) WHERE rank <= 20""", _CONTENT),
)
def hybrid_similar(v):
    w = hybrid.SIMILAR_WEIGHTS
    fused = similarity.fuse_neighbors([(cf_neighbors(v), w["cf"]), (content_neighbors(v), w["content"])])
    return fused.select("item_id", "rank", "neighbor_id", "score")


@query(
    "similar_cards",
    "O4 P11 J2",
    sql("""SELECT s.item_id, CAST(rank AS INTEGER) AS rank, neighbor_id, i.title, score,
             'Similar movies you might enjoy' AS explanation FROM cf_similar s JOIN items i ON i.item_id = s.neighbor_id WHERE rank <= 10"""),
)
def similar_cards(v):
    from tastelake.functions.scalar import EXPLAIN_SIMILAR

    first = cf_neighbors(v).filter("rank <= 10")
    cards = v.items.select(F.col("item_id").alias("neighbor_id"), "title")
    return first.join(cards, "neighbor_id").select(
        "item_id", "rank", "neighbor_id", "title", "score", F.lit(EXPLAIN_SIMILAR).alias("explanation")
    )


@query("hybrid_user_recs", "R6 U2 X4", sql(f"SELECT {_LIST} FROM hybrid_recs"))
def hybrid_user_recs(v):
    return hybrid_lists(v)


def _cards_sql(source: str, algorithm: str, text_: str) -> str:
    return f"""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INTEGER) AS rank, item_id, title,
                 least(score, 1.0) AS score, '{algorithm}' AS algorithm, '{text_}' AS explanation,
                 least(score * 1.2::DOUBLE, 1.0) AS confidence
               FROM {source} c JOIN items USING (item_id)
               WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = c.user_id AND r.item_id = c.item_id)
               QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) <= 10"""


@query(
    "recommend_cards",
    "R7 J2 J4 O3 P9 P10 P11",
    sql(_cards_sql("cf_recs", "collaborative", "Users with similar taste enjoyed this")),
)
def recommend_cards(v):
    trend = trending.top(trending.scores(v.ratings_raw, v.items))  # never run: no list falls back on it
    return hybrid.recommend(
        v.users, "collaborative", lists={"collaborative": cf_lists(v)}, trending_top=trend, items=v.items, seen=v.vector_ratings
    )


@query(
    "recommend_hybrid",
    "R7 O3 J4",
    sql(_cards_sql("hybrid_recs", "hybrid", "Matches your taste and is popular in the community")),
)
def recommend_hybrid(v):
    trend = trending_top(v)
    listed = v.item_vectors.select("item_id").unionByName(trend.select("item_id"))
    return hybrid.recommend(
        v.users, "hybrid", lists={"hybrid": hybrid_lists(v, trend)}, trending_top=trend, items=v.items, seen=v.ratings_of(listed)
    )


_TREND_USERS = {"trend_lists": "SELECT u.user_id, t.item_id, t.score, t.rank FROM users u, trending_top t"}


@query(
    "recommend_trending",
    "R7 O3 J4",
    sql(_cards_sql("trend_lists", "trending", "Currently trending in the community"), _TREND_USERS),
)
def recommend_trending(v):
    return hybrid.recommend(v.users, "trending", lists={}, trending_top=trending_top(v), items=v.items, seen=v.stored_ratings)


@query(
    "recommendation_log",
    "S9 P23",
    sql("""SELECT user_id, 'collaborative' AS algorithm, '[' || string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) || ']' AS recommended_ids, any_value(l.latency_ms) AS latency_ms
           FROM cf_recs LEFT JOIN (SELECT user_id, round(avg(latency_ms), 4) AS latency_ms FROM
             (SELECT user_id, intensity AS latency_ms FROM interactions) GROUP BY user_id) l USING (user_id) WHERE rank <= 10 GROUP BY user_id"""),
)
def recommendation_log(v):
    """One log row per served list, with the mean latency of the user's requests."""
    rows = tables.log_rows(cf_lists(v).filter("rank <= 10"), "collaborative").drop("latency_ms")
    latency = v.interactions.groupBy("user_id").agg(F.round(F.avg("intensity"), 4).alias("latency_ms"))
    return rows.join(latency, "user_id", "left").select("user_id", "algorithm", "recommended_ids", "latency_ms")


@query(
    "cold_start_fallback",
    "R13 X7",
    sql("""SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM users u, trending_top
           WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = u.user_id)"""),
)
def cold_start_fallback(v):
    newcomers = v.users.join(v.interactions, "user_id", "left_anti")
    return hybrid.trending_lists(newcomers, trending_top(v), None, 10).select("user_id", "rank", "item_id", "score")


@query("content_user_recs", "R32", sql(f"SELECT {_LIST} FROM content_recs", _GENRE))
def content_user_recs(v):
    return content_lists(v)


@query(
    "cold_item_recs",
    "R33",
    sql("""SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM (
             SELECT user_id, item_id, round(s, 4) AS score,
                    row_number() OVER (PARTITION BY user_id ORDER BY round(s, 10) DESC, item_id) AS rank
             FROM (SELECT u.user_id, i.item_id, coalesce(g.s, 0) AS s FROM click_len u CROSS JOIN items i
                   LEFT JOIN click_scores g ON g.user_id = u.user_id AND g.item_id = i.item_id
                   WHERE i.item_id NOT IN (SELECT item_id FROM interactions))) WHERE rank <= 10""",
        {"click_w": """SELECT user_id, genre, count(*)::DOUBLE AS w FROM interactions JOIN item_genres USING (item_id)
                       WHERE interaction_type IN ('click', 'purchase') GROUP BY user_id, genre""",
         "click_len": "SELECT user_id, sqrt(sum(w * w)) AS len FROM click_w GROUP BY user_id",
         "click_scores": """SELECT user_id, item_id, sum(w / len) / sqrt(2::DOUBLE) AS s FROM click_w JOIN click_len USING (user_id)
                            JOIN item_genres USING (genre) GROUP BY user_id, item_id"""}),
)
def cold_item_recs(v):
    """Items nobody has touched yet, ranked by the genres of what a user clicked or bought."""
    liked = v.interactions.filter(F.col("interaction_type").isin("click", "purchase")).withColumn("rating", F.lit(1.0))
    cold = hybrid.cold_items(v.items, v.interactions)
    return hybrid.content_recs(liked, v.item_genres, 10, candidates=cold)


def signals(v):
    seen = v.stored_ratings
    trend = hybrid.trending_lists(seen, trending_top(v), seen, 50, most=50)
    return hybrid.stack_signals({"cf": cf_lists(v), "content": content_lists(v), "trending": trend})


@query(
    "late_fusion",
    "R9 R10 R14",
    sql(f"SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, {rounded('s', 6)} AS score FROM fused", _GENRE),
)
def late_fusion(v):
    return hybrid.fuse(hybrid.normalised(signals(v)), hybrid.weight_of(hybrid.LATE_FUSION_WEIGHTS))


_DIVERSE = {
    **{name: text_ for name, text_ in _GENRE.items() if name != "fused"},
    "pool": "SELECT DISTINCT user_id, item_id FROM signals",
    "pool_genres": "SELECT user_id, genre, count(*) AS c FROM pool JOIN item_genres USING (item_id) GROUP BY user_id, genre",
    "pool_sizes": "SELECT user_id, count(*) AS n FROM pool GROUP BY user_id",
    "rarity": """SELECT user_id, item_id, avg(1 - coalesce(c, 0) / n::DOUBLE) AS score FROM pool JOIN item_genres USING (item_id)
                 JOIN pool_genres USING (user_id, genre) JOIN pool_sizes USING (user_id) GROUP BY user_id, item_id""",
    "five": """SELECT user_id, signal, item_id, score FROM normal UNION ALL
               SELECT user_id, 'diversity', item_id, CASE WHEN round(hi - lo, 12) > 0 THEN (score - lo) / (hi - lo) ELSE 1 END FROM (
                 SELECT *, min(score) OVER (PARTITION BY user_id) AS lo, max(score) OVER (PARTITION BY user_id) AS hi FROM rarity)""",
    "fused": _GENRE["fused"].replace("FROM normal JOIN", "FROM five JOIN"),
}


@query(
    "late_fusion_diversity",
    "R9 R15",
    sql(f"SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, {rounded('s', 6)} AS score FROM fused", _DIVERSE),
)
def late_fusion_diversity(v):
    """Late fusion with its fifth signal: how rare an item's genres are among what the other signals offer the user."""
    four = stored(signals(v), "signals")
    rare = hybrid.rare_genres(four, v.item_genres)
    both = hybrid.normalised(four).unionByName(hybrid.normalised(hybrid.stack_signals({"diversity": rare}), digits=12))
    return hybrid.fuse(both, hybrid.weight_of(hybrid.LATE_FUSION_WEIGHTS))


@query(
    "fusion_without_cf",
    "R14 ablation",
    sql(f"SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, {rounded('s', 6)} AS score FROM fused",
        {**_GENRE, "weights": _GENRE["weights"].replace("0.30::DOUBLE", "0.0::DOUBLE")}),
)
def fusion_without_cf(v):
    return hybrid.fuse(hybrid.normalised(signals(v)), hybrid.weight_of({**hybrid.LATE_FUSION_WEIGHTS, "cf": 0.0}))


@query(
    "adaptive_fusion",
    "R11",
    sql(f"SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, {rounded('s', 6)} AS score FROM fused_by_depth",
        {**_GENRE, "fused_by_depth": """SELECT user_id, rank, item_id, s FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 10) DESC, item_id) AS rank FROM (
             SELECT user_id, item_id, sum(score * CASE WHEN n < 30 THEN CASE signal WHEN 'cf' THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END
                    ELSE CASE signal WHEN 'cf' THEN 0.6::DOUBLE WHEN 'content' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END END) AS s
             FROM normal JOIN (SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id) USING (user_id)
             GROUP BY user_id, item_id)) WHERE rank <= 20"""}),
)
def adaptive_fusion(v):
    deep = hybrid.history_depth(v.stored_ratings)
    weight = F.when(F.col("n") < 30, hybrid.weight_of({"cf": 0.2, "content": 0.4, "trending": 0.4})).otherwise(
        hybrid.weight_of({"cf": 0.6, "content": 0.3, "trending": 0.1})
    )
    return hybrid.fuse(hybrid.normalised(signals(v)).join(deep, "user_id"), weight)


@query(
    "signal_contribution",
    "R16",
    sql("""SELECT signal, round(sum(weight * score) / (SELECT sum(weight * score) FROM normal JOIN weights USING (signal)
                    WHERE (user_id, item_id) IN (SELECT (user_id, item_id) FROM fused)), 6) AS share
           FROM normal JOIN weights USING (signal) WHERE (user_id, item_id) IN (SELECT (user_id, item_id) FROM fused)
           GROUP BY signal""", _GENRE),
)
def signal_contribution(v):
    return hybrid.shares(hybrid.normalised(signals(v)), ("cf", "content", "trending"), hybrid.weight_of(hybrid.LATE_FUSION_WEIGHTS))


@query(
    "switching_hybrid",
    "R8",
    sql("""SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, score, source FROM (
             SELECT *, 'collaborative' AS source FROM cf_recs WHERE user_id IN (SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= 30)
             UNION ALL SELECT *, 'content' FROM content_recs WHERE user_id IN (SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) < 30))""",
        _GENRE),
)
def switching_hybrid(v):
    return hybrid.switch(cf_lists(v), content_lists(v), hybrid.history_depth(v.stored_ratings), 30)


@query(
    "two_stage_rerank",
    "R12",
    sql(f"""SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, {rounded('s', 6)} AS score FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 10) DESC, item_id) AS rank FROM (
               SELECT u.user_id, i.item_id, 0.7::DOUBLE * round(list_dot_product(u.vector, i.vector), 4) + 0.3::DOUBLE * coalesce(g.share, 0) AS s
               FROM user_vectors u CROSS JOIN item_vectors i
               LEFT JOIN (SELECT user_id, item_id, sum(w / t) AS share FROM (
                            SELECT user_id, genre, w, sum(w) OVER (PARTITION BY user_id) AS t FROM genre_w)
                          JOIN item_genres USING (genre) GROUP BY user_id, item_id) g ON g.user_id = u.user_id AND g.item_id = i.item_id
               WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = u.user_id AND r.item_id = i.item_id)
               QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY round(list_dot_product(u.vector, i.vector), 10) DESC, i.item_id) <= 500))
           WHERE rank <= 20""", _GENRE),
)
def two_stage_rerank(v):
    """Candidates by factors, then a re-rank that adds genre alignment for the candidates only."""
    ratings = v.stored_ratings
    candidates = stored(hybrid.score_unseen(v.user_vectors, v.item_vectors, v.vector_ratings, 500).drop("rank"), "candidates")
    return hybrid.genre_reranked(candidates, ratings, v.item_genres, (0.7, 0.3), 20)


def _mmr_sql(n: int) -> str:
    """The greedy choice unrolled: each step takes the best remaining candidate given those chosen before."""
    steps = [
        """p1 AS MATERIALIZED (SELECT user_id, item_id, score, 1 AS rank FROM cf_recs
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) = 1)"""
    ]
    for k in range(2, n + 1):
        steps.append(
            f"""p{k} AS MATERIALIZED (SELECT * FROM p{k - 1} UNION ALL SELECT user_id, item_id, score, {k} FROM (
              SELECT c.user_id, c.item_id, any_value(c.score) AS score, 0.7::DOUBLE * any_value(c.score) - 0.3::DOUBLE * max(s.sim) AS value
              FROM cf_recs c JOIN p{k - 1} p ON p.user_id = c.user_id JOIN sims s ON s.a = c.item_id AND s.b = p.item_id
              WHERE NOT EXISTS (SELECT 1 FROM p{k - 1} q WHERE q.user_id = c.user_id AND q.item_id = c.item_id)
              GROUP BY c.user_id, c.item_id)
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value, 10) DESC, score DESC, item_id) = 1)"""
        )
    sims = """sims AS MATERIALIZED (SELECT x.item_id AS a, y.item_id AS b, list_cosine_similarity(x.vector, y.vector) AS sim
              FROM item_vectors x, item_vectors y)"""
    return f"SELECT user_id, rank::INTEGER AS rank, item_id, score FROM (WITH {sims}, {', '.join(steps)} SELECT * FROM p{n})"


@query("diversity_rerank", "R15 X5", sql(_mmr_sql(10)))
def diversity_rerank(v):
    return hybrid.diversify(cf_lists(v), v.item_vectors)


_BECAUSE = """SELECT * FROM (
    WITH lists AS MATERIALIZED (SELECT user_id, item_id FROM cf_recs),
    history AS MATERIALIZED (SELECT user_id, item_id AS rated_id, rating FROM ratings WHERE item_id IN (SELECT item_id FROM item_vectors)),
    sims AS MATERIALIZED (SELECT x.item_id, y.item_id AS rated_id, list_cosine_similarity(x.vector, y.vector) AS sim FROM item_vectors x, item_vectors y),
    reasons AS (SELECT user_id, item_id, rated_id, sim * rating AS s FROM lists JOIN history USING (user_id) JOIN sims USING (item_id, rated_id)),
    best AS (SELECT user_id, item_id, arg_max(rated_id, {'s': round(s, 8), 'least': -rated_id}) AS because_item, round(max(s), 6) AS strength
             FROM reasons GROUP BY user_id, item_id)
    SELECT user_id, item_id, because_item, strength FROM lists LEFT JOIN best USING (user_id, item_id))"""


@query("because_you_rated", "R17", sql(_BECAUSE))
def because_you_rated(v):
    return hybrid.explain_by_item(cf_lists(v), v.stored_ratings, v.item_vectors)


@query(
    "batch_scoring",
    "R36 S4",
    sql(f"SELECT item_id, count(*) AS n_lists, {rounded('avg(score)', 6)} AS avg_score FROM hybrid_recs GROUP BY item_id"),
)
def batch_scoring(v):
    """All users scored, lists kept as Parquet, and read back for an exposure report."""
    path = work_path(v.spark, "hybrid-lists")
    files.write_parquet(hybrid_lists(v), path)
    stored = v.spark.read.schema("user_id bigint, rank int, item_id bigint, score double").parquet(path)
    return stored.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_lists"), round_to(F.avg("score"), 6).alias("avg_score"))
