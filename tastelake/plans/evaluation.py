"""Offline evaluation of recommendation lists on a per-user temporal split."""

from pyspark.sql import functions as F

from tastelake.operators import evaluate, hybrid, profile, trending
from tastelake.operators.ordering import top_n
from tastelake.plans.oracle import sql, unseen_draws
from tastelake.plans.recommend import cf_lists
from tastelake.plans.registry import query
from tastelake.session import stored


def split(v):
    """Train and test parts, numbered once and stored; later reads filter the stored part column."""
    both = stored(profile.numbered_split(v.stored_ratings), "split")
    return both.filter("part = 'train'").drop("part"), both.filter("part = 'test'").drop("part")


def relevant_of(test):
    return test.filter("rating >= 4").select("user_id", "item_id")


def popularity_of(train):
    return train.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))


def popular_lists(train, n=20):
    """Trending items of the training part a user has not seen there, best n."""
    scored = train.groupBy("item_id").agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n_ratings"))
    scored = scored.select("item_id", F.round(F.col("mean") * F.log1p(F.col("n_ratings").cast("double")), 4).alias("score"))
    pool = trending.top(scored, 500)
    lists = hybrid.trending_lists(train, pool, train, n, trending.ranked(scored))
    return stored(top_n(lists.withColumnRenamed("rank", "place"), ["user_id"], [F.col("place")], n), "popular-lists")


_HITS = {
    "rec_hits": """SELECT user_id, rank, item_id, hit, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS so_far FROM (
                     SELECT r.user_id, r.rank, r.item_id, (v.item_id IS NOT NULL)::INT AS hit FROM recs r
                     LEFT JOIN relevant v ON v.user_id = r.user_id AND v.item_id = r.item_id)""",
    "n_relevant": "SELECT user_id, count(*) AS n_rel FROM relevant GROUP BY user_id",
    "user_metrics": """
        SELECT user_id, k, n_hits / k::DOUBLE AS precision, CASE WHEN n_rel > 0 THEN n_hits / n_rel::DOUBLE ELSE 0 END AS recall,
          CASE WHEN n_rel > 0 THEN dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n_rel, k) + 1)]) ELSE 0 END AS ndcg,
          CASE WHEN n_rel > 0 THEN ap_sum / n_rel ELSE 0 END AS ap, coalesce(1.0::DOUBLE / first_hit, 0) AS rr
        FROM (SELECT user_id, k, sum(hit) FILTER (WHERE rank <= k) AS n_hits,
                sum(CASE WHEN rank <= k THEN hit / log2(rank + 1) ELSE 0 END) AS dcg,
                sum(CASE WHEN rank <= k AND hit = 1 THEN so_far / rank::DOUBLE ELSE 0 END) AS ap_sum,
                min(CASE WHEN rank <= k AND hit = 1 THEN rank END) AS first_hit
              FROM rec_hits, (VALUES (5), (10), (20)) AS t(k) GROUP BY user_id, k)
        LEFT JOIN (SELECT user_id, n_rel FROM n_relevant) USING (user_id)""",
}


@query(
    "user_ranking_metrics",
    "E1 E2 E3 E4 E9 U3",
    sql("""SELECT user_id, k::INTEGER AS k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg,
             round(ap, 6) AS ap, round(rr, 6) AS rr FROM user_metrics""", _HITS),
)
def user_ranking_metrics(v):
    train, test = split(v)
    found = evaluate.per_user(popular_lists(train), relevant_of(test), (5, 10, 20))
    return found.select("user_id", "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "ap", "rr")])


@query(
    "ranking_report",
    "E1 E2 E3 E4 E8 E9",
    sql("""SELECT k::INTEGER AS k, count(*) AS n_users, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
             round(avg(ndcg), 6) AS ndcg, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM user_metrics GROUP BY k""", _HITS),
)
def ranking_report(v):
    train, test = split(v)
    return evaluate.report(popular_lists(train), relevant_of(test))


@query(
    "holdout_report",
    "E8 W7 X13",
    sql("""SELECT k::INTEGER AS k, count(*) AS n_users, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
             round(avg(ndcg), 6) AS ndcg, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM user_metrics GROUP BY k""",
        {**_HITS,
         "train": """SELECT user_id, item_id, rating, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn
                     FROM ratings) WHERE rn > 1""",
         "relevant": """SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn
                        FROM ratings) WHERE rn = 1"""}),
)
def holdout_report(v):
    train, last = profile.last_holdout(v.stored_ratings)
    return evaluate.report(popular_lists(train), last.select("user_id", "item_id"))


@query(
    "list_coverage",
    "E5",
    sql("""SELECT count(DISTINCT item_id) AS n_shown, (SELECT count(*) FROM items) AS n_items,
             count(DISTINCT item_id) / (SELECT count(*) FROM items)::DOUBLE AS coverage FROM recs"""),
)
def list_coverage(v):
    return evaluate.coverage(popular_lists(split(v)[0]), v.items)


@query(
    "list_diversity",
    "E6",
    sql("""SELECT user_id, round(avg(1 - list_cosine_similarity(x.vector, y.vector)), 6) AS diversity
           FROM cf_recs a JOIN cf_recs b USING (user_id) JOIN item_vectors x ON x.item_id = a.item_id
           JOIN item_vectors y ON y.item_id = b.item_id WHERE a.rank < b.rank AND b.rank <= 10 GROUP BY user_id"""),
)
def list_diversity(v):
    lists = cf_lists(v).filter("rank <= 10")
    return evaluate.intra_list_diversity(lists, v.item_vectors).select("user_id", F.round("diversity", 6).alias("diversity"))


@query(
    "list_novelty",
    "E7",
    sql("""SELECT user_id, round(avg(-log2(pop / (SELECT sum(pop) FROM popularity)::DOUBLE)), 6) AS novelty
           FROM recs JOIN popularity USING (item_id) GROUP BY user_id"""),
)
def list_novelty(v):
    train, _ = split(v)
    return evaluate.novelty(popular_lists(train), popularity_of(train)).select("user_id", F.round("novelty", 6).alias("novelty"))


_LABELLED = {"scored": "SELECT quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)"}


def _auc_sql(label):
    return f"""SELECT '{label}' AS label, sum({label})::BIGINT AS n_pos, sum(1 - {label})::BIGINT AS n_neg,
      round((sum(CASE WHEN {label} = 1 THEN r END) - sum({label}) * (sum({label}) + 1) / 2::DOUBLE) / (sum({label}) * sum(1 - {label})), 6) AS auc
      FROM (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2::DOUBLE AS r FROM scored)"""


@query("auc", "E10", sql(f"{_auc_sql('quality')} UNION ALL {_auc_sql('toxic')}", _LABELLED))
def auc(v):
    rows = v.table("labels").join(v.table("documents").select("doc_id", "n_chars"), "doc_id")
    out = [
        evaluate.auc(rows, label, "n_chars").select(F.lit(label).alias("label"), "n_pos", "n_neg", F.round("auc", 6).alias("auc"))
        for label in ("quality", "toxic")
    ]
    return out[0].unionByName(out[1])


@query(
    "gini_exposure",
    "E12",
    sql("""SELECT count(*) AS n_items, round(sum((2 * i - n - 1) * shown) / (any_value(n) * sum(shown))::DOUBLE, 6) AS gini FROM (
             SELECT shown, row_number() OVER (ORDER BY shown) AS i, count(*) OVER () AS n FROM (
               SELECT item_id, count(r.user_id) AS shown FROM items LEFT JOIN recs r USING (item_id) GROUP BY item_id))"""),
)
def gini_exposure(v):
    shown = evaluate.exposure(popular_lists(split(v)[0]), v.items)
    return evaluate.gini(shown, "shown").select("n_items", F.round("gini", 6).alias("gini"))


@query(
    "long_tail_coverage",
    "E11 W15",
    sql("""SELECT count(*) AS n_tail, count(*) FILTER (WHERE item_id IN (SELECT item_id FROM recs)) AS n_shown,
             count(*) FILTER (WHERE item_id IN (SELECT item_id FROM recs)) / count(*)::DOUBLE AS share
           FROM (SELECT item_id, percent_rank() OVER (ORDER BY pop) AS pr FROM popularity) WHERE pr < 0.8"""),
)
def long_tail_coverage(v):
    train, _ = split(v)
    pop = popularity_of(train)
    return evaluate.long_tail(popular_lists(train), pop, profile.deciles(pop, "pop").select("pop", "percent_rank"))


@query(
    "global_time_split",
    "E13",
    sql("""SELECT CASE WHEN ts < TIMESTAMP '2000-01-01' THEN 'train' WHEN ts < TIMESTAMP '2001-01-01' THEN 'validation' ELSE 'test' END AS part,
             count(*) AS n, count(DISTINCT user_id) AS n_users FROM ratings GROUP BY part"""),
)
def global_time_split(v):
    parts = evaluate.global_split(v.ratings, "2000-01-01", "2001-01-01")
    per_user = parts.groupBy("part", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_users"))


@query(
    "fold_assignment",
    "E14",
    sql("""SELECT user_id, item_id, (('0x' || substr(md5(user_id || ':' || item_id), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM ratings"""),
)
def fold_assignment(v):
    return evaluate.folds(v.ratings, ["user_id", "item_id"], 5).select("user_id", "item_id", "fold")


@query(
    "baseline_comparison",
    "E15 E8",
    sql("""SELECT 'popular' AS baseline, k::INTEGER AS k, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg FROM user_metrics
           WHERE k = 10 GROUP BY k
           UNION ALL SELECT 'random', 10, round(avg(h / 10::DOUBLE), 6), round(avg(CASE WHEN n_rel > 0 THEN
             dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n_rel, 10) + 1)]) ELSE 0 END), 6)
           FROM (SELECT b.user_id, count(v.item_id) AS h, sum(CASE WHEN v.item_id IS NULL THEN 0 ELSE 1 / log2(b.d + 1) END) AS dcg
                 FROM random_recs b LEFT JOIN relevant v ON v.user_id = b.user_id AND v.item_id = b.item_id GROUP BY b.user_id)
           LEFT JOIN n_relevant USING (user_id)""",
        {**_HITS,
         "random_recs": unseen_draws("SELECT DISTINCT user_id FROM train", "train", 10, "'base:' || k.user_id")}),
)
def baseline_comparison(v):
    train, test = split(v)
    relevant = relevant_of(test)
    users = train.select("user_id").distinct()
    lists = {"popular": popular_lists(train), "random": evaluate.random_baseline(users, v.items, train, 10)}
    out = None
    for name, recs in lists.items():
        row = evaluate.report(recs, relevant, (10,)).select(F.lit(name).alias("baseline"), "k", "precision", "ndcg")
        out = row if out is None else out.unionByName(row)
    return out
