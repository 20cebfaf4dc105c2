"""Neighbourhood methods, sequences, sampling, bandits."""

from pyspark.sql import functions as F

from tastelake.operators import cf, dictionary, hybrid, similarity
from tastelake.operators.ordering import quantile_codebook
from tastelake.plans.oracle import sql, unseen_draws
from tastelake.plans.profiles import genre_alignment
from tastelake.plans.registry import query
from tastelake.session import stored, work_path


@query(
    "bought_together",
    "J10 R18",
    sql("""SELECT x.item_id AS a, y.item_id AS b, count(*) AS support FROM ratings x JOIN ratings y
           ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY x.item_id, y.item_id ORDER BY support DESC, a, b LIMIT 500"""),
)
def bought_together(v):
    return cf.bought_together(v.stored_ratings, 500)


_PAIR = """SELECT x.{c} AS a, y.{c} AS b, count(*) AS n, sum(x.r * y.r) AS sxy, sum(x.r) AS sx, sum(y.r) AS sy,
             sum(x.r * x.r) AS sxx, sum(y.r * y.r) AS syy
           FROM src x JOIN src y ON x.{r} = y.{r} AND x.{c} <> y.{c} GROUP BY x.{c}, y.{c} HAVING count(*) >= {m}"""


def _pairs(column: str, row: str, support: int, source: str = "SELECT user_id, item_id, rating AS r FROM ratings") -> dict:
    return {
        "src": source,
        "lens": f"SELECT {column} AS id, sqrt(sum(r * r)) AS len, count(*) AS size FROM src GROUP BY {column}",
        "pairs": _PAIR.format(c=column, r=row, m=support),
    }


def _neighbors(score: str, k: int, key: str = "item_id", where: str = "true") -> str:
    return f"""SELECT a AS {key}, CAST(rank AS INTEGER) AS rank, b AS neighbor_id, round(score, 6) AS score FROM (
        SELECT a, b, {score} AS score, row_number() OVER (PARTITION BY a ORDER BY round({score}, 10) DESC, b) AS rank
        FROM pairs JOIN lens la ON la.id = a JOIN lens lb ON lb.id = b WHERE {where}) WHERE rank <= {k}"""


_COS, _COS_OK = "sxy / (la.len * lb.len)", "la.len > 1e-9 AND lb.len > 1e-9"
_PEARSON = "(n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))"
_PEARSON_OK = "n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9"


def _shown(df):
    return df.withColumn("score", F.round("score", 6))


@query("item_cf", "R19 J10", sql(_neighbors(_COS, 20, where=_COS_OK), _pairs("item_id", "user_id", 3)))
def item_cf(v):
    return _shown(cf.item_neighbors(v.stored_ratings, "cosine"))


_CENTRED = "SELECT user_id, item_id, rating - avg(rating) OVER (PARTITION BY user_id) AS r FROM ratings"


@query("item_cf_adjusted", "R19", sql(_neighbors(_COS, 20, where=_COS_OK), _pairs("item_id", "user_id", 3, _CENTRED)))
def item_cf_adjusted(v):
    return _shown(cf.item_neighbors(v.stored_ratings, "adjusted"))


@query("item_cf_pearson", "R19", sql(_neighbors(_PEARSON, 20, where=_PEARSON_OK), _pairs("item_id", "user_id", 3)))
def item_cf_pearson(v):
    return _shown(cf.item_neighbors(v.stored_ratings, "pearson"))


_UPAIRS = _pairs("user_id", "item_id", 2)


@query(
    "user_cf",
    "R20",
    sql("""SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, n_votes, round(raw, 6) AS score FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_votes DESC, round(raw, 10) DESC, item_id) AS rank FROM (
               SELECT k.user_id, r.item_id, count(*) AS n_votes, sum(s * r.rating) / sum(s) AS raw
               FROM (SELECT a AS user_id, b, sxy / (la.len * lb.len) AS s,
                            row_number() OVER (PARTITION BY a ORDER BY round(sxy / (la.len * lb.len), 10) DESC, b) AS rn
                     FROM pairs JOIN lens la ON la.id = a JOIN lens lb ON lb.id = b) k
               JOIN ratings r ON r.user_id = k.b
               WHERE rn <= 10 AND NOT EXISTS (SELECT 1 FROM ratings z WHERE z.user_id = k.user_id AND z.item_id = r.item_id)
               GROUP BY k.user_id, r.item_id)) WHERE rank <= 10""", _UPAIRS),
)
def user_cf(v):
    return cf.predict_from_neighbors(cf.user_neighbors(v.stored_ratings, "cosine"), v.stored_ratings)


def _named(v, ratings):
    """Ratings of users with names instead of numbers, and a dictionary of these names."""
    rated = stored(ratings.withColumn("user_id", F.concat(F.lit("user-"), F.col("user_id"))), "named")
    path = work_path(v.spark, "user-names")
    # in two steps, as users come in over time
    dictionary.extend(path, rated.filter(F.col("item_id") % 7 == 0), "user_id")
    return rated, dictionary.extend(path, rated, "user_id")


@query(
    "user_cf_named",
    "R20 S7",
    sql("""SELECT 'user-' || user_id AS user_id, count(*) AS n_neighbors, round(sum(s), 6) AS score_sum, bool_and(rn <= 10) AS ranked FROM (
             SELECT a AS user_id, sxy / (la.len * lb.len) AS s, row_number() OVER (PARTITION BY a ORDER BY round(sxy / (la.len * lb.len), 10) DESC) AS rn
             FROM pairs JOIN lens la ON la.id = a JOIN lens lb ON lb.id = b) WHERE rn <= 10 GROUP BY user_id""", _UPAIRS),
)
def user_cf_named(v):
    """Neighbours of users with string ids; equal scores may be in another order than among numbers, so their sum is compared."""
    rated, words = _named(v, v.stored_ratings)
    found = cf.user_neighbors(stored(dictionary.encoded(rated, "user_id", words), "encoded"), "cosine")
    found = dictionary.decoded(dictionary.decoded(found, "user_id", words), "neighbor_id", words)
    known = found.join(rated.select(F.col("user_id").alias("neighbor_id")).distinct(), "neighbor_id", "left_semi")
    return known.groupBy("user_id").agg(
        F.count("neighbor_id").alias("n_neighbors"), F.round(F.sum("score"), 6).alias("score_sum"), (F.max("rank") <= 10).alias("ranked")
    )


@query(
    "user_scores_named",
    "R2 R6",
    sql("SELECT 'user-' || user_id AS user_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM cf_recs"),
)
def user_scores_named(v):
    """Top 50 of users with string ids: the items of a user do not depend on the number that the dictionary gives."""
    rated, words = _named(v, v.vector_ratings)
    ratings = stored(dictionary.encoded(rated, "user_id", words), "encoded")
    users = stored(similarity.weighted_mean_vectors(ratings, v.item_vectors), "user-vectors")
    return dictionary.decoded(hybrid.score_unseen(users, v.item_vectors, ratings, 50), "user_id", words)


@query("user_neighbors_jaccard", "R20", sql(_neighbors("n / (la.size + lb.size - n)::DOUBLE", 10, "user_id"), _UPAIRS))
def user_neighbors_jaccard(v):
    return _shown(cf.user_neighbors(v.stored_ratings, "jaccard"))


@query(
    "user_neighbors_pearson",
    "R20",
    sql(_neighbors(_PEARSON, 10, "user_id", _PEARSON_OK), _UPAIRS),
)
def user_neighbors_pearson(v):
    return _shown(cf.user_neighbors(v.stored_ratings, "pearson"))


@query(
    "bias_baseline",
    "R21",
    sql("""SELECT user_id, item_id, round(mu + b_item + b_user, 6) AS predicted FROM with_item JOIN (
             SELECT user_id, sum(rating - mu - b_item) / (count(*) + 10) AS b_user FROM with_item GROUP BY user_id) USING (user_id)""",
        {"based": "SELECT *, (SELECT avg(rating) FROM ratings) AS mu FROM ratings",
         "with_item": """SELECT * FROM based JOIN (SELECT item_id, sum(rating - mu) / (count(*) + 10) AS b_item FROM based GROUP BY item_id)
                         USING (item_id)"""}),
)
def bias_baseline(v):
    return cf.bias_baseline(v.stored_ratings)


@query(
    "markov_next",
    "R23 W9",
    sql("""SELECT state, next, n, n / (sum(n) OVER (PARTITION BY state))::DOUBLE AS probability FROM (
             SELECT item_id AS state, nxt AS next, count(*) AS n FROM (
               SELECT item_id, lead(item_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM interactions)
             WHERE nxt IS NOT NULL GROUP BY item_id, nxt)"""),
)
def markov_next(v):
    return cf.transitions(v.interactions, "item_id")


@query(
    "markov_second_order",
    "R23",
    sql("""SELECT state, second, next, n, n / (sum(n) OVER (PARTITION BY state, second))::DOUBLE AS probability FROM (
             SELECT s1 AS state, s2 AS second, s3 AS next, count(*) AS n FROM (
               SELECT interaction_type AS s1, lead(interaction_type, 1) OVER w AS s2, lead(interaction_type, 2) OVER w AS s3
               FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
             WHERE s3 IS NOT NULL GROUP BY ALL)"""),
)
def markov_second_order(v):
    return cf.transitions(v.interactions, "interaction_type", 2)


@query(
    "negative_samples",
    "R24",
    sql("SELECT user_id, positive AS item_id, d::INTEGER AS draw, item_id AS negative FROM drawn",
        {"drawn": unseen_draws("SELECT user_id, item_id AS positive FROM ratings WHERE rating >= 4", "ratings", 4, "'neg:' || k.user_id || ':' || k.positive")}),
)
def negative_samples(v):
    return cf.negatives(v.stored_ratings.filter("rating >= 4"), v.stored_ratings, v.items)


@query(
    "bandit_arms",
    "R25",
    sql("""SELECT arm, pulls, wins, round(wins / pulls + sqrt(2 * ln((SELECT sum(pulls) FROM arms)) / pulls), 6) AS ucb1,
             wins + 1 AS alpha, pulls - wins + 1 AS beta, round(decayed, 6) AS decayed_mean,
             round(0.1::DOUBLE / (SELECT count(*) FROM arms) + CASE WHEN arm = (SELECT arm FROM arms ORDER BY wins / pulls DESC, arm LIMIT 1)
                   THEN 1 - 0.1::DOUBLE ELSE 0 END, 6) AS greedy_share FROM arms""",
        {"arms": """SELECT item_id AS arm, count(*) AS pulls, CAST(count(*) FILTER (WHERE interaction_type = 'click') AS BIGINT) AS wins,
                      sum(w * (interaction_type = 'click')::INT) / sum(w) AS decayed
                    FROM (SELECT *, exp(-ln(2::DOUBLE) * date_diff('day', ts::DATE, DATE '2024-02-01') / 7.0::DOUBLE) AS w
                          FROM interactions WHERE interaction_type IN ('view', 'click')) GROUP BY item_id"""}),
)
def bandit_arms(v):
    return cf.arm_statistics(_pulls(v))


def _pulls(v):
    rows = v.interactions.filter(F.col("interaction_type").isin("view", "click"))
    return rows.select(
        F.col("item_id").alias("arm"), "ts", "event_id", "user_id", (F.col("interaction_type") == "click").cast("bigint").alias("reward")
    )


@query(
    "contextual_bandit",
    "R34",
    sql("""SELECT arm, round((q * b0 - s * b1) / det + 0.5::DOUBLE * (n * b1 - s * b0) / det
                    + sqrt((q - 2 * 0.5::DOUBLE * s + 0.25::DOUBLE * n) / det), 6) AS score
           FROM (SELECT *, n * q - s * s AS det FROM (
             SELECT item_id AS arm, 1 + count(*) AS n, sum(x) AS s, 1 + sum(x * x) AS q, sum(y) AS b0, sum(x * y) AS b1
             FROM (SELECT item_id, hour(ts) / 24::DOUBLE AS x, (interaction_type = 'click')::INT AS y
                   FROM interactions WHERE interaction_type IN ('view', 'click')) GROUP BY item_id))"""),
)
def contextual_bandit(v):
    rows = _pulls(v).withColumn("one", F.lit(1.0)).withColumn("hour", F.hour("ts") / 24.0)
    return cf.linear_arms(rows, ["one", "hour"], "reward", [1.0, 0.5], 1.0)


_POISSON = " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(cf.POISSON_ONE))


@query(
    "bagged_means",
    "R28",
    sql(f"""SELECT item_id, count(*) AS n_bags, round(avg(mean), 6) AS bagged_mean FROM (
              SELECT item_id, bag, sum(w * rating) / sum(w) AS mean FROM (
                SELECT *, CASE {_POISSON} ELSE {len(cf.POISSON_ONE)} END AS w FROM (
                  SELECT item_id, bag, rating, ('0x' || substr(md5(bag || ':' || user_id || ':' || item_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
                  FROM ratings, range(1, 11) AS t(bag))) WHERE w > 0 GROUP BY item_id, bag) GROUP BY item_id"""),
)
def bagged_means(v):
    return cf.bagged_item_means(v.ratings)


@query(
    "quantised_vectors",
    "R30",
    sql("""SELECT item_id, d::INTEGER AS dimension, count(*) FILTER (WHERE c < x)::INTEGER AS code FROM (
             SELECT item_id, unnest(vector) AS x, unnest(range(0, 64)) AS d FROM item_vectors), (
             SELECT unnest(quantile_cont(x, [k / 255::DOUBLE FOR k IN range(0, 256)])) AS c FROM (SELECT unnest(vector) AS x FROM item_vectors))
           GROUP BY item_id, d"""),
)
def quantised_vectors(v):
    flat = v.item_vectors.select(F.explode("vector").alias("x"))
    codes = cf.quantised(v.item_vectors, quantile_codebook(flat, "x"))
    return codes.select("item_id", F.posexplode("codes").alias("dimension", "code"))


@query(
    "feature_table",
    "R31 R35",
    sql("""SELECT r.user_id, r.item_id, r.rating, round(list_dot_product(u.vector, i.vector), 6) AS cf_score, alignment,
             user_mean, user_n, item_mean, item_n
           FROM ratings r JOIN item_vectors i USING (item_id) JOIN user_vectors u USING (user_id)
           JOIN (SELECT user_id, avg(rating) AS user_mean, count(*) AS user_n FROM ratings GROUP BY user_id) USING (user_id)
           JOIN (SELECT item_id, avg(rating) AS item_mean, count(*) AS item_n FROM ratings GROUP BY item_id) USING (item_id)
           JOIN (SELECT user_id, item_id, round(sum(share), 6) AS alignment FROM ratings JOIN item_genres USING (item_id)
                 JOIN (SELECT user_id, genre, w / sum(w) OVER (PARTITION BY user_id) AS share FROM (
                       SELECT user_id, genre, sum(rating) AS w FROM ratings JOIN item_genres USING (item_id) GROUP BY user_id, genre))
                 USING (user_id, genre) GROUP BY user_id, item_id) USING (user_id, item_id)"""),
)
def feature_table(v):
    return cf.feature_table(v.stored_ratings, v.user_vectors, v.item_vectors, genre_alignment(v))
