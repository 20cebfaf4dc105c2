"""Bias, fairness, A/B and bandit read-outs."""

from pyspark.sql import functions as F

from tastelake.functions.stats import student_p_sql, two_sided_p_sql
from tastelake.operators import evaluate, experiment, hybrid, profile
from tastelake.operators.cf import POISSON_ONE
from tastelake.plans.collaborative import _POISSON, _pulls
from tastelake.plans.evaluation import _HITS, popular_lists, popularity_of, relevant_of, split
from tastelake.plans.oracle import rounded, sql
from tastelake.plans.recommend import cf_lists
from tastelake.plans.registry import query


@query(
    "popularity_bias",
    "B1 A16",
    sql("""SELECT count(*) AS n, avg((pop >= (SELECT quantile_cont(pop::DOUBLE, 0.8) FROM popularity))::INT) AS popular_share
           FROM recs LEFT JOIN popularity USING (item_id)"""),
)
def popularity_bias(v):
    train, _ = split(v)
    return experiment.popularity_bias(popular_lists(train), popularity_of(train))


@query(
    "group_parity",
    "B2",
    sql("""SELECT count(*) AS n_groups, CASE WHEN count(*) < 2 THEN 1 ELSE min(m) / max(m) END AS parity FROM (
             SELECT coalesce(segment, 'unknown') AS g, avg(n) AS m FROM (SELECT user_id, count(*) AS n FROM relevant GROUP BY user_id)
             LEFT JOIN users USING (user_id) GROUP BY g)"""),
)
def group_parity(v):
    _, test = split(v)
    lengths = relevant_of(test).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return experiment.group_parity(lengths, v.users.select("user_id", F.col("segment").alias("group")), "n")


@query(
    "ab_assignment",
    "B4",
    sql("""SELECT user_id, bucket, CASE WHEN bucket < 50 THEN 'treatment' ELSE 'control' END AS "group" FROM (
             SELECT user_id, ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 100 AS bucket FROM users)"""),
)
def ab_assignment(v):
    return experiment.assign(v.users).select("user_id", "bucket", "group")


_AB = {
    "assigned": """SELECT user_id, CASE WHEN ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 100 < 50 THEN 'treatment' ELSE 'control' END AS grp
                   FROM users""",
    "ab_values": "SELECT user_id, item_id, ts, rating, grp FROM ratings JOIN assigned USING (user_id)",
}


def _values(v):
    return v.ratings.join(experiment.assign(v.users).select("user_id", "group"), "user_id")


@query(
    "ab_readout",
    "B5",
    sql(f"""SELECT n_control, n_treatment, control_mean, treatment_mean, round(lift, 6) AS lift, round(t, 6) AS t,
              round({two_sided_p_sql('t')}, 6) AS p_normal, round({student_p_sql('t', '(n_control + n_treatment - 2)')}, 6) AS p_value,
              {student_p_sql('t', '(n_control + n_treatment - 2)')} < 0.05 AS significant FROM (
              SELECT *, treatment_mean / control_mean - 1 AS lift, (control_mean - treatment_mean) / sqrt(
                ((n_control - 1) * vc + (n_treatment - 1) * vt) / (n_control + n_treatment - 2) * (1 / n_control::DOUBLE + 1 / n_treatment::DOUBLE)) AS t FROM (
              SELECT count(*) FILTER (WHERE grp = 'control') AS n_control, count(*) FILTER (WHERE grp = 'treatment') AS n_treatment,
                avg(rating) FILTER (WHERE grp = 'control') AS control_mean, avg(rating) FILTER (WHERE grp = 'treatment') AS treatment_mean,
                var_samp(rating) FILTER (WHERE grp = 'control') AS vc, var_samp(rating) FILTER (WHERE grp = 'treatment') AS vt FROM ab_values))""", _AB),
)
def ab_readout(v):
    out = experiment.ab_readout(_values(v), "rating")
    rounded_ = [F.round(c, 6).alias(c) for c in ("lift", "t", "p_normal", "p_value")]
    return out.select("n_control", "n_treatment", "control_mean", "treatment_mean", *rounded_, "significant")


@query(
    "confidence_intervals",
    "B6",
    sql("""SELECT grp AS "group", count(*) AS n, avg(rating) AS mean, round(avg(rating) - 1.96::DOUBLE * stddev_samp(rating) / sqrt(count(*)), 6) AS low,
             round(avg(rating) + 1.96::DOUBLE * stddev_samp(rating) / sqrt(count(*)), 6) AS high,
             avg(rating) - 1.96::DOUBLE * stddev_samp(rating) / sqrt(count(*)) >= 2.5 AS guardrail_ok FROM ab_values GROUP BY grp""", _AB),
)
def confidence_intervals(v):
    out = experiment.interval(_values(v), ["group"], "rating")
    return out.select(
        "group", "n", "mean", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), (F.col("low") >= 2.5).alias("guardrail_ok")
    )


@query(
    "position_bias",
    "B3",
    sql("""SELECT h.item_id, count(*) AS impressions, sum(hit)::BIGINT AS clicks,
             round(sum(CASE WHEN p > 0 THEN hit / p ELSE 0 END), 6) AS weighted_clicks
           FROM rec_hits h JOIN (SELECT rank, avg(hit) / (SELECT avg(hit) FROM rec_hits WHERE rank = 1) AS p FROM rec_hits GROUP BY rank) USING (rank)
           GROUP BY h.item_id""", _HITS),
)
def position_bias(v):
    train, test = split(v)
    marked = evaluate.hits(popular_lists(train), relevant_of(test))
    shown = marked.select("user_id", "rank", "item_id", F.col("hit").alias("click"))
    return experiment.inverse_propensity(shown).withColumn("weighted_clicks", F.round("weighted_clicks", 6))


@query(
    "bootstrap_means",
    "B7",
    sql(f"""SELECT bag::INTEGER AS bag, round(sum(w * rating) / sum(w), 6) AS mean FROM (
              SELECT *, CASE {_POISSON} ELSE {len(POISSON_ONE)} END AS w FROM (
                SELECT rating, bag, ('0x' || substr(md5(bag || ':' || user_id || ':' || item_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u
                FROM ratings, range(1, 21) AS t(bag))) WHERE w > 0 GROUP BY bag"""),
)
def bootstrap_means(v):
    return experiment.bootstrap_means(v.ratings, ["user_id", "item_id"], "rating", 20).select("bag", F.round("mean", 6).alias("mean"))


@query(
    "rank_sum_test",
    "B7",
    sql(f"""SELECT n_treatment, n_all, rank_sum, round(z, 6) AS z, round({two_sided_p_sql('z')}, 6) AS p_normal FROM (
              SELECT *, (rank_sum - n_treatment * (n_all + 1) / 2::DOUBLE)
                        / sqrt(n_treatment::DOUBLE * (n_all - n_treatment) / 12 * (n_all + 1 - ties / (n_all::DOUBLE * (n_all - 1)))) AS z FROM (
                SELECT count(*) FILTER (WHERE grp = 'treatment') AS n_treatment, count(*) AS n_all,
                       sum(r) FILTER (WHERE grp = 'treatment') AS rank_sum, sum(m::DOUBLE * m - 1) AS ties FROM (
                  SELECT grp, count(*) OVER (PARTITION BY rating) AS m, rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2::DOUBLE AS r FROM ab_values)))""", _AB),
)
def rank_sum_test(v):
    out = experiment.rank_sum(_values(v), "rating")
    return out.select("n_treatment", "n_all", "rank_sum", F.round("z", 6).alias("z"), F.round("p_normal", 6).alias("p_normal"))


@query(
    "interleaving",
    "B8",
    sql("""SELECT team, count(*) AS shown, sum(CASE WHEN (user_id, item_id) IN (SELECT (user_id, item_id) FROM relevant) THEN 1 ELSE 0 END)::BIGINT AS credit
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank, turn) AS place FROM (
             SELECT user_id, item_id, rank, turn, team FROM (
               SELECT user_id, item_id, rank, team, CASE WHEN team = 'a' THEN coin ELSE 1 - coin END AS turn FROM (
                 SELECT *, ('0x' || substr(md5('coin:' || user_id || ':' || rank), 1, 8))::BIGINT % 2 AS coin FROM (
                   SELECT user_id, rank, item_id, 'a' AS team FROM recs UNION ALL SELECT user_id, rank, item_id, 'b' FROM count_recs)))
             QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY rank, turn, team) = 1))
           WHERE place <= 10 GROUP BY team""",
        {"count_recs": """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM (
            SELECT u.user_id, t.item_id, t.place FROM (SELECT DISTINCT user_id FROM train) u,
              (SELECT item_id, row_number() OVER (ORDER BY pop DESC, item_id) AS place FROM popularity) t
            WHERE NOT EXISTS (SELECT 1 FROM train r WHERE r.user_id = u.user_id AND r.item_id = t.item_id)) QUALIFY rank <= 20"""}),
)
def interleaving(v):
    from tastelake.operators import trending
    from tastelake.operators.ordering import top_n

    train, test = split(v)
    counts = popularity_of(train).select("item_id", F.col("pop").cast("double").alias("score"))
    counted = hybrid.trending_lists(train, trending.top(counts, 500), train, 20, trending.ranked(counts)).withColumnRenamed("rank", "place")
    counted = top_n(counted, ["user_id"], [F.col("place")], 20)
    return experiment.interleave(popular_lists(train), counted, relevant_of(test))


@query(
    "exposure_aware_rerank",
    "B10",
    sql(f"""SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, {rounded('raw', 6)} AS score FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(raw, 10) DESC, item_id) AS rank FROM (
               SELECT c.user_id, c.item_id, c.score - 0.1::DOUBLE * coalesce(pr, 0) AS raw FROM cf_recs c
               LEFT JOIN (SELECT item_id, percent_rank() OVER (ORDER BY pop) AS pr FROM popularity) USING (item_id))) WHERE rank <= 10"""),
)
def exposure_aware_rerank(v):
    train, _ = split(v)
    pop = popularity_of(train)
    placed = pop.join(profile.deciles(pop, "pop").select("pop", "percent_rank"), "pop")
    return hybrid.shift_popular(cf_lists(v), placed, 0.1, 10)


@query(
    "propensity_weighted",
    "B11",
    sql("""SELECT sum(n_ratings)::BIGINT AS n_ratings, round(sum(mean * n_ratings) / sum(n_ratings), 6) AS naive_mean,
             round(sum(mean * n_items) / sum(n_items), 6) AS weighted_mean FROM (
             SELECT decile, avg(rating) AS mean, count(*) AS n_ratings, count(DISTINCT item_id) AS n_items FROM ratings JOIN (
               SELECT item_id, floor((rank() OVER (ORDER BY pop) - 1) * 10 / (count(*) OVER ())::DOUBLE) + 1 AS decile FROM popularity) USING (item_id)
             GROUP BY decile)"""),
)
def propensity_weighted(v):
    train, _ = split(v)
    pop = popularity_of(train)
    out = experiment.propensity_weighted_mean(v.stored_ratings, profile.deciles(pop, "pop").select("pop", "decile"), pop, v.items)
    return out.select("n_ratings", F.round("naive_mean", 6).alias("naive_mean"), F.round("weighted_mean", 6).alias("weighted_mean"))


@query(
    "sequential_readout",
    "B12",
    sql("""SELECT strftime(day, '%Y-%m-%d') AS day, n_treatment, n_control, round((st / n_treatment - sc / n_control) / sqrt(
             (qt / n_treatment - (st / n_treatment) ** 2) / n_treatment + (qc / n_control - (sc / n_control) ** 2) / n_control), 5) AS z FROM (
             SELECT day, CAST(sum(nt) OVER w AS BIGINT) AS n_treatment, CAST(sum(nc) OVER w AS BIGINT) AS n_control, sum(st) OVER w AS st, sum(sc) OVER w AS sc,
                    sum(qt) OVER w AS qt, sum(qc) OVER w AS qc FROM (
               SELECT ts::DATE AS day, count(*) FILTER (WHERE grp = 'treatment') AS nt, count(*) FILTER (WHERE grp = 'control') AS nc,
                 coalesce(sum(rating) FILTER (WHERE grp = 'treatment'), 0) AS st, coalesce(sum(rating) FILTER (WHERE grp = 'control'), 0) AS sc,
                 coalesce(sum(rating * rating) FILTER (WHERE grp = 'treatment'), 0) AS qt,
                 coalesce(sum(rating * rating) FILTER (WHERE grp = 'control'), 0) AS qc FROM ab_values GROUP BY day)
             WINDOW w AS (ORDER BY day)) WHERE n_treatment > 1 AND n_control > 1""", _AB),
)
def sequential_readout(v):
    out = experiment.sequential(_values(v).withColumn("day", F.to_date("ts")), "rating")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_treatment", "n_control", F.round("z", 5).alias("z"))


@query(
    "bias_over_time",
    "B13",
    sql("""SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n,
             avg((pop >= (SELECT quantile_cont(pop::DOUBLE, 0.8) FROM pops))::INT) AS popular_share
           FROM ratings_raw JOIN pops USING (item_id) GROUP BY month""",
        {"pops": "SELECT item_id, count(*) AS pop FROM ratings_raw GROUP BY item_id"}),
)
def bias_over_time(v):
    """Popularity bias of what was consumed in every month."""
    rows = v.ratings_raw.select("item_id", F.date_format("ts", "yyyy-MM").alias("month"))
    return experiment.popularity_bias(rows, popularity_of(v.ratings_raw), ["month"])


@query(
    "bandit_regret",
    "B9",
    sql("""SELECT strftime(day, '%Y-%m-%d') AS day, pulls, round(sum(pulls * best - wins) OVER (ORDER BY day), 6) AS regret FROM (
             SELECT ts::DATE AS day, count(*) AS pulls, count(*) FILTER (WHERE interaction_type = 'click') AS wins FROM p GROUP BY day), (
             SELECT max(m) AS best FROM (SELECT avg((interaction_type = 'click')::INT) AS m FROM p GROUP BY item_id))""",
        {"p": "SELECT * FROM interactions WHERE interaction_type IN ('view', 'click')"}),
)
def bandit_regret(v):
    out = experiment.regret(_pulls(v))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "pulls", F.round("regret", 6).alias("regret"))
