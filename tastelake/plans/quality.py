"""Data quality, drift, retention and privacy reports."""

from pyspark.sql import functions as F

from tastelake.operators import evaluate, hybrid, incremental, quality, trending
from tastelake.operators.ordering import top_n
from tastelake.plans.evaluation import _HITS, popular_lists, popularity_of, relevant_of, split
from tastelake.plans.oracle import sql
from tastelake.plans.registry import query
from tastelake.session import work_path


def _with_gaps(v):
    """Order lines where returned goods have no rating."""
    lines = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_returnflag") != "R", F.ceil(F.col("l_quantity") / 5).cast("double") / F.lit(2.0)).alias("rating"),
        F.when(F.col("l_linestatus") != "F", F.col("l_shipdate").cast("timestamp")).alias("shipped"),
        F.col("l_returnflag").alias("flag"),
        F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("seq"),
    )


_GAPS = {
    "gaps": """SELECT o_custkey AS user_id, l_partkey AS item_id,
                 CASE WHEN l_returnflag <> 'R' THEN CAST(ceil(l_quantity / 5::DOUBLE) AS DOUBLE) / 2::DOUBLE END AS rating,
                 CASE WHEN l_linestatus <> 'F' THEN l_shipdate END AS shipped, l_returnflag AS flag,
                 o_orderdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
}


@query(
    "cleaning_chain",
    "Q1 Q2 F6 U5 X12",
    sql("""SELECT user_id, item_id, coalesce(rating, median) AS rating FROM f
           LEFT JOIN (SELECT item_id, quantile_cont(rating, 0.5) AS median FROM f GROUP BY item_id) USING (item_id)
           WHERE coalesce(rating, median) BETWEEN 0.5 AND 5.0""",
        {**_GAPS, "f": """SELECT user_id, item_id, rating FROM gaps QUALIFY row_number() OVER (PARTITION BY user_id, item_id
                          ORDER BY o_orderdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) = 1"""}),
)
def cleaning_chain(v):
    return quality.clean_ratings(_with_gaps(v).select("user_id", "item_id", "rating", "seq"))


@query(
    "imputation",
    "Q2",
    sql("""SELECT user_id, coalesce(seg, 'Unknown') AS segment, coalesce(nation, (SELECT nation FROM u WHERE nation IS NOT NULL
             GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 1)) AS nation_id FROM u""",
        {"u": """SELECT user_id, CASE WHEN balance >= 0 THEN segment END AS seg, CASE WHEN balance < 9000 THEN nation_id END AS nation FROM users"""}),
)
def imputation(v):
    gaps = v.users.select(
        "user_id",
        F.when(F.col("balance") >= 0, F.col("segment")).alias("segment"),
        F.when(F.col("balance") < 9000, F.col("nation_id")).alias("nation_id"),
    )
    return gaps.select(
        "user_id", F.coalesce("segment", F.lit("Unknown")).alias("segment"), F.coalesce("nation_id", quality.most_common(gaps, "nation_id")).alias("nation_id")
    )


@query(
    "quality_report",
    "Q3 S12",
    sql("""SELECT rule, total, bad, CASE WHEN total > 0 THEN bad / total::DOUBLE ELSE 0 END AS rate, CASE WHEN total > 0 THEN bad / total::DOUBLE ELSE 0 END <= lim AS passed FROM (
             SELECT 'rating_range' AS rule, count(*) AS total, count(*) FILTER (WHERE NOT coalesce(rating BETWEEN 0.5 AND 5.0, false)) AS bad, 0.0 AS lim FROM gaps
             UNION ALL SELECT 'timestamp_valid', count(*), count(*) FILTER (WHERE NOT coalesce(shipped <= TIMESTAMP '2001-06-01', false)), 0.0 FROM gaps
             UNION ALL SELECT 'completeness', count(*), count(*) FILTER (WHERE rating IS NULL), 0.05 FROM gaps
             UNION ALL SELECT 'no_duplicates', sum(n)::BIGINT, sum(n - 1)::BIGINT, 0.0 FROM (SELECT count(*) AS n FROM gaps GROUP BY user_id, item_id)
             UNION ALL SELECT 'item_id_exists', count(*), count(*) FILTER (WHERE item_id NOT IN (SELECT item_id FROM items)), 0.0 FROM gaps
             UNION ALL SELECT 'user_id_exists', count(*), count(*) FILTER (WHERE user_id NOT IN (SELECT user_id FROM users)), 0.0 FROM gaps
             UNION ALL SELECT 'user_id_unique', sum(n)::BIGINT, sum(n - 1)::BIGINT, 0.0 FROM (SELECT count(*) AS n FROM users GROUP BY user_id)
             UNION ALL SELECT 'age_range', count(*), count(*) FILTER (WHERE NOT (balance / 60 BETWEEN 0 AND 150)), 0.0 FROM users
             UNION ALL SELECT 'segment_valid', count(*), count(*) FILTER (WHERE segment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')), 0.0 FROM users)""", _GAPS),
)
def quality_report(v):
    rows = _with_gaps(v)
    strict = {
        "rating_range": F.col("rating").between(0.5, 5.0),
        "timestamp_valid": F.col("shipped") <= F.lit("2001-06-01").cast("timestamp"),
    }
    counted = [
        quality.rule_rows(rows, strict),
        quality.rule_rows(rows, {"completeness": F.col("rating").isNotNull()}, 0.05),
        quality.graded(quality.duplicate_row(rows, ["user_id", "item_id"], "no_duplicates")),
        quality.graded(quality.missing_key_row(rows, v.items, "item_id", "item_id_exists")),
        quality.graded(quality.missing_key_row(rows, v.users, "user_id", "user_id_exists")),
        quality.graded(quality.duplicate_row(v.users, ["user_id"], "user_id_unique")),
        quality.rule_rows(
            v.users,
            {"age_range": (F.col("balance") / 60).between(0, 150), "segment_valid": F.col("segment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")},
        ),
    ]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


@query(
    "completeness",
    "Q4",
    sql("""SELECT 'rating' AS "column", avg((rating IS NOT NULL)::INT) AS completeness FROM gaps
           UNION ALL SELECT 'shipped', avg((shipped IS NOT NULL)::INT) FROM gaps
           UNION ALL SELECT 'user_id', avg((user_id IS NOT NULL)::INT) FROM gaps""", _GAPS),
)
def completeness(v):
    return quality.completeness(_with_gaps(v), ["rating", "shipped", "user_id"])


@query(
    "freshness_volume",
    "Q5 Q6 Q16",
    sql("""SELECT 'events' AS name, count(*) AS n_rows, (epoch(TIMESTAMP '2024-02-01') - epoch_us(max(ts)) // 1000000)::BIGINT // 3600 AS stale_hours, count(*) >= 1000 AS volume_ok FROM events
           UNION ALL SELECT 'orders', count(*), (epoch(TIMESTAMP '2024-02-01') - epoch_us(max(o_orderdate)) // 1000000)::BIGINT // 3600, count(*) >= 1000 FROM orders
           UNION ALL SELECT 'lineitem', count(*), (epoch(TIMESTAMP '2024-02-01') - epoch_us(max(l_shipdate)) // 1000000)::BIGINT // 3600, count(*) >= 1000 FROM lineitem"""),
)
def freshness_volume(v):
    as_of = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp"))
    out = None
    for name, column in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        newest = F.unix_timestamp(F.max(F.col(column).cast("timestamp")))
        row = v.table(name).agg(F.count(F.lit(1)).alias("n_rows"), newest.alias("_newest")).select(
            F.lit(name).alias("name"), "n_rows", F.floor((as_of - F.col("_newest")) / 3600).alias("stale_hours"), (F.col("n_rows") >= 1000).alias("volume_ok")
        )
        out = row if out is None else out.unionByName(row)
    return out


# Dataset, owner, sensitivity, days kept (null: without limit), freshness.
_REGISTERED = (
    ("users", "Data Team", "confidential", 365, "real-time"),
    ("ratings", "Data Team", "internal", 365, "real-time"),
    ("items", "Content Team", "public", None, "daily"),
    ("interactions", "Data Team", "internal", 365, "real-time"),
)


@query("dataset_catalog", "Q16 lineage", sql("""
    SELECT 'users' AS name, 'Data Team' AS owner, 'confidential' AS sensitivity, 365 AS retention_days, 'real-time' AS freshness,
           'customer' AS inputs, (SELECT count(*) FROM users) AS n_rows, 5 AS n_columns
    UNION ALL SELECT 'ratings', 'Data Team', 'internal', 365, 'real-time', 'lineitem,orders', (SELECT count(*) FROM ratings), 4
    UNION ALL SELECT 'items', 'Content Team', 'public', NULL, 'daily', 'part', (SELECT count(*) FROM items), 7
    UNION ALL SELECT 'interactions', 'Data Team', 'internal', 365, 'real-time', 'events', (SELECT count(*) FROM interactions), 6"""))
def dataset_catalog(v):
    """One row per dataset; its inputs are the tables that its plan reads."""
    return quality.catalog({row[0]: (getattr(v, row[0]), *row[1:]) for row in _REGISTERED}, v.folder)


def _halves(v):
    cut = F.lit("2024-01-16").cast("timestamp")
    return v.interactions.filter(F.col("ts") < cut), v.interactions.filter(F.col("ts") >= cut)


_HALVES = {
    "a": "SELECT intensity AS x FROM interactions WHERE ts < TIMESTAMP '2024-01-16'",
    "b": "SELECT intensity AS x FROM interactions WHERE ts >= TIMESTAMP '2024-01-16'",
}
_PSI = """SELECT sum((q - p) * ln(q / p)) AS psi FROM (
            SELECT bin, greatest(count(*) FILTER (WHERE s = 'a') / (SELECT count(*) FROM a)::DOUBLE, 1e-4) AS p,
                   greatest(count(*) FILTER (WHERE s = 'b') / (SELECT count(*) FROM b)::DOUBLE, 1e-4) AS q FROM (
              SELECT s, len(list_filter(edges, lambda e: e < x)) AS bin FROM (SELECT 'a' AS s, x FROM a UNION ALL SELECT 'b', x FROM b),
                (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM a)) GROUP BY bin)"""
_SERIES = " + ".join(f"({'' if k % 2 else '-'}2.0::DOUBLE * exp(-2.0::DOUBLE * {k * k} * l * l))" for k in range(1, 101))
_KS = f"""SELECT d, CASE WHEN l < 0.2 THEN 1 ELSE least(greatest({_SERIES}, 0), 1) END AS p FROM (
            SELECT d, sqrt((SELECT count(*) FROM a)::DOUBLE * (SELECT count(*) FROM b) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b))) * d AS l FROM (
              SELECT max(abs(ca / (SELECT count(*) FROM a)::DOUBLE - cb / (SELECT count(*) FROM b)::DOUBLE)) AS d FROM (
                SELECT x, sum(na) OVER (ORDER BY x) AS ca, sum(nb) OVER (ORDER BY x) AS cb FROM (
                  SELECT x, sum(ia) AS na, sum(ib) AS nb FROM (SELECT x, 1 AS ia, 0 AS ib FROM a UNION ALL SELECT x, 0, 1 FROM b) GROUP BY x))))"""


@query("psi_drift", "Q7", sql(f"SELECT round(psi, 6) AS psi, psi > 0.25 AS alert FROM ({_PSI})", _HALVES))
def psi_drift(v):
    return quality.psi(*_halves(v), "intensity").withColumn("psi", F.round("psi", 6))


@query("ks_drift", "Q8", sql(f"SELECT round(d, 6) AS d, round(p, 6) AS p_value, p < 0.01 AS alert FROM ({_KS})", _HALVES))
def ks_drift(v):
    out = quality.ks_test(*_halves(v), "intensity")
    return out.select(F.round("d", 6).alias("d"), F.round("p_value", 6).alias("p_value"), "alert")


_RUNS = {
    **_HITS,
    "champ": "SELECT k, round(avg(ndcg), 6) AS champion FROM user_metrics GROUP BY k",
    "count_recs": """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM (
        SELECT u.user_id, t.item_id, t.place FROM (SELECT DISTINCT user_id FROM train) u,
          (SELECT item_id, row_number() OVER (ORDER BY pop DESC, item_id) AS place FROM popularity) t
        WHERE NOT EXISTS (SELECT 1 FROM train r WHERE r.user_id = u.user_id AND r.item_id = t.item_id)) QUALIFY rank <= 20""",
    "chall": """SELECT k, round(avg(CASE WHEN n_rel > 0 THEN dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n_rel, k) + 1)]) ELSE 0 END), 6) AS challenger
        FROM (SELECT c.user_id, k, sum(CASE WHEN c.rank <= k AND v.item_id IS NOT NULL THEN 1 / log2(c.rank + 1) ELSE 0 END) AS dcg
              FROM (SELECT * FROM count_recs, (VALUES (5), (10), (20)) AS t(k)) c
              LEFT JOIN relevant v ON v.user_id = c.user_id AND v.item_id = c.item_id GROUP BY c.user_id, k)
        LEFT JOIN n_relevant USING (user_id) GROUP BY k""",
    "runs": """SELECT k::INTEGER AS k, champion, challenger, CASE WHEN champion > 0 THEN (champion - challenger) / champion ELSE 0 END AS drop_
               FROM champ JOIN chall USING (k)""",
}


def _runs(v):
    train, test = split(v)
    relevant = relevant_of(test)
    counts = popularity_of(train).select("item_id", F.col("pop").cast("double").alias("score"))
    counted = hybrid.trending_lists(train, trending.top(counts, 500), train, 20, trending.ranked(counts)).withColumnRenamed("rank", "place")
    counted = top_n(counted, ["user_id"], [F.col("place")], 20)
    return quality.compare_runs(evaluate.report(popular_lists(train), relevant), evaluate.report(counted, relevant))


@query(
    "champion_challenger",
    "Q9 Q19",
    sql("""SELECT k, champion, challenger, round(drop_, 4) AS relative_drop, CASE WHEN drop_ >= 0.07 THEN 'page' WHEN drop_ >= 0.03 THEN 'warn' ELSE 'ok' END AS level,
             drop_ <= 0.02 AS promote FROM runs""", _RUNS),
)
def champion_challenger(v):
    return _runs(v).withColumn("relative_drop", F.round("relative_drop", 4))


@query(
    "retrain_trigger",
    "Q10",
    sql(f"""SELECT 'psi' AS signal, psi > 0.25 AS fired FROM ({_PSI}) UNION ALL SELECT 'ks', p < 0.01 FROM ({_KS})
            UNION ALL SELECT 'ndcg_drop', bool_or(drop_ >= 0.07) FROM runs""", {**_RUNS, **_HALVES}),
)
def retrain_trigger(v):
    psi = quality.psi(*_halves(v), "intensity").select(F.lit("psi").alias("signal"), F.col("alert").alias("fired"))
    ks = quality.ks_test(*_halves(v), "intensity").select(F.lit("ks").alias("signal"), F.col("alert").alias("fired"))
    drop = _runs(v).agg(F.bool_or(F.col("level") == "page").alias("fired")).select(F.lit("ndcg_drop").alias("signal"), "fired")
    return psi.unionByName(ks).unionByName(drop)


@query(
    "retention_tiers",
    "Q11",
    sql("""SELECT CASE WHEN age > 1095 THEN 'delete' WHEN age < 30 THEN 'hot' WHEN age <= 90 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n
           FROM (SELECT date_diff('day', ts::DATE, DATE '2001-08-02') AS age FROM ratings_raw) GROUP BY tier"""),
)
def retention_tiers(v):
    age = F.datediff(F.lit("2001-08-02").cast("date"), F.to_date("ts"))
    return v.ratings_raw.groupBy(quality.retention_tier(age, 1095).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_QUASI = {"q": """SELECT user_id, nation_id, segment, CASE WHEN balance < 0 THEN 'low' WHEN balance < 5000 THEN 'mid' ELSE 'high' END AS band FROM users"""}


def _people(v):
    band = F.when(F.col("balance") < 0, "low").when(F.col("balance") < 5000, "mid").otherwise("high")
    return v.users.select("user_id", "nation_id", "segment", band.alias("band"))


@query(
    "k_anonymity",
    "Q12",
    sql("SELECT user_id, nation_id, segment FROM q QUALIFY count(*) OVER (PARTITION BY nation_id, segment) >= 12", _QUASI),
)
def k_anonymity(v):
    return quality.k_anonymous(_people(v), ["nation_id", "segment"], 12).select("user_id", "nation_id", "segment")


@query(
    "l_diversity",
    "Q13",
    sql("""SELECT user_id, nation_id, segment, band FROM q WHERE (nation_id, segment) IN (
             SELECT (nation_id, segment) FROM q GROUP BY nation_id, segment HAVING count(DISTINCT band) >= 3)""", _QUASI),
)
def l_diversity(v):
    return quality.l_diverse(_people(v), ["nation_id", "segment"], "band", 3).select("user_id", "nation_id", "segment", "band")


@query(
    "erasure",
    "Q14",
    sql("SELECT user_id, item_id, rating FROM ratings WHERE user_id NOT IN (SELECT user_id FROM users WHERE balance < 0)"),
)
def erasure(v):
    leaving = v.users.filter("balance < 0").select("user_id")
    return v.ratings.join(leaving, "user_id", "left_anti").select("user_id", "item_id", "rating")


@query(
    "masked_export",
    "Q14 P16",
    sql("""SELECT sha256(username) AS user_hash, count(*) AS n_ratings, sum(rating) AS rating_sum FROM ratings JOIN users USING (user_id)
           WHERE balance < 0 GROUP BY user_hash"""),
)
def masked_export(v):
    asked = v.users.filter("balance < 0").select("user_id", F.sha2("username", 256).alias("user_hash"))
    return v.ratings.join(asked, "user_id").groupBy("user_hash").agg(F.count(F.lit(1)).alias("n_ratings"), F.sum("rating").alias("rating_sum"))


@query(
    "access_anomalies",
    "Q15",
    sql("""SELECT user_id, window_start, count(*) AS n FROM (
             SELECT user_id, unnest(range((epoch_us(ts) // 21600000000 * 21600 - 64800)::BIGINT, (epoch_us(ts) // 21600000000 * 21600 + 1)::BIGINT, 21600)) AS window_start FROM requests)
           GROUP BY user_id, window_start HAVING count(*) > 6"""),
)
def access_anomalies(v):
    return quality.busy_users(v.requests, 6, "1 day", "6 hours")


@query(
    "incremental_recompute",
    "Q17",
    sql("SELECT item_id, score, n_ratings FROM trending"),
)
def incremental_recompute(v):
    """Scores from stored sums and counts: ratings before a date are folded in once, those since as a second batch of their own."""
    path = work_path(v.spark, "item-totals")
    cut = F.lit("2001-06-01").cast("timestamp")
    sums = {"total": F.col("rating"), "n_ratings": F.lit(1)}
    for number, part in enumerate((v.ratings_raw.filter(F.col("ts") < cut), v.ratings_raw.filter(F.col("ts") >= cut))):
        incremental.fold_in(path, part.join(v.items.select("item_id"), "item_id", "left_semi"), ["item_id"], sums, number)
    score = F.col("total") / F.col("n_ratings") * F.log1p(F.col("n_ratings").cast("double"))
    return incremental.totals(v.spark, path).select("item_id", F.round(score, 4).alias("score"), "n_ratings")


@query(
    "missing_profile",
    "Q18",
    sql("""SELECT flag, count(*) AS n, avg((rating IS NULL)::INT) AS rating_missing, avg((shipped IS NULL)::INT) AS shipped_missing,
             round(corr((rating IS NULL)::INT, (shipped IS NULL)::INT) OVER_ALL, 6) AS x FROM gaps GROUP BY flag""".replace(
        "round(corr((rating IS NULL)::INT, (shipped IS NULL)::INT) OVER_ALL, 6) AS x",
        "(SELECT round(corr((rating IS NULL)::INT, (shipped IS NULL)::INT), 6) FROM gaps) AS joint_correlation"), _GAPS),
)
def missing_profile(v):
    rows = _with_gaps(v).select("flag", F.col("rating").isNull().cast("int").alias("r"), F.col("shipped").isNull().cast("int").alias("s"))
    joint = rows.agg(F.round(F.corr("r", "s"), 6).alias("c")).scalar()
    return rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("rating_missing"), F.avg("s").alias("shipped_missing")).select(
        "*", joint.alias("joint_correlation")
    )
