"""Hand-made frames: scalar rules, search, list metrics, fusion, upserts, drift."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastelake.functions import scalar as s
from tastelake.functions import stats
from tastelake.operators import catalog, evaluate, experiment, hybrid, profile, quality, similarity, text
from tastelake.session import stored
from tastelake.sources import files, tables


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_years(spark):
    titles = ["A (b) (1999)", "X (2006–2007)", "No year", "Trailing (1999) ", "(1988)"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    assert column(df, s.year_from_title("title")) == [1999, None, None, None, 1988]


def test_genres(spark):
    df = spark.createDataFrame([("A| B |",), (s.NO_GENRE,), (None,), ("",)], "genres string")
    assert column(df, s.split_values("genres")) == [["A", "B"], [s.NO_GENRE], None, []]
    assert [r[0] for r in catalog.genres(df).collect()] == ["A", "B"]


def test_search_is_literal(spark):
    items = spark.createDataFrame(
        [(1, "100% Wool", "A|B", 1990, None, 8.0), (2, "a_b", "B", None, "x", None), (3, "Plain", "B", 0, "wool", 9.0)],
        "item_id int, title string, genres string, year int, overview string, vote_average double",
    )

    def ids(*args, **kw):
        return sorted(r["item_id"] for r in catalog.search(items, *args, **kw).collect())

    assert ids("%") == [1] and ids("_") == [2] and ids("WOOL") == [1, 3]
    assert ids("b", genre="B") == [1, 2, 3] and ids("b", genre="b") == []
    assert ids("wool", year_from=1980) == [1] and ids("wool", year_from=0) == [1, 3]
    assert ids("b", min_vote=8.5) == [3] and ids("b", min_vote=0) == ids("b")


def test_paging_past_the_end(spark):
    df = spark.range(7).withColumnRenamed("id", "n")
    last = catalog.page(df, "n", 3, 3).collect()
    assert [(r["n"], r["total"], r["total_pages"]) for r in last] == [(6, 7, 3)]
    assert catalog.page(df, "n", 4, 3).count() == 0


def test_ranking_metrics(spark):
    recs = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)], "user_id bigint, rank int, item_id bigint")
    relevant = spark.createDataFrame([(1, 10), (1, 12), (1, 99)], "user_id bigint, item_id bigint")
    got = {r["user_id"]: r for r in evaluate.per_user(recs, relevant, (3,)).collect()}
    one = got[1]
    assert one["precision"] == pytest.approx(2 / 3) and one["recall"] == pytest.approx(2 / 3)
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert one["ndcg"] == pytest.approx((1 + 1 / 2) / ideal)
    assert one["ap"] == pytest.approx((1 + 2 / 3) / 3) and one["rr"] == 1.0
    assert (got[2]["recall"], got[2]["ndcg"], got[2]["ap"], got[2]["rr"]) == (0.0, 0.0, 0.0, 0.0)


def test_single_item_list_has_no_diversity(spark):
    recs = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (2, 2, 11)], "user_id bigint, rank int, item_id bigint")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 2.0])], "item_id bigint, vector array<double>")
    got = {r["user_id"]: r["diversity"] for r in evaluate.intra_list_diversity(recs, vectors).collect()}
    assert got == {1: 0.0, 2: pytest.approx(1.0)}


def test_fused_neighbors(spark):
    cf = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.0), (1, 4, -0.2)], "item_id bigint, neighbor_id bigint, score double")
    content = spark.createDataFrame([(1, 2, 1.0), (1, 5, 0.4)], "item_id bigint, neighbor_id bigint, score double")
    got = [(r["rank"], r["neighbor_id"], r["score"]) for r in similarity.fuse_neighbors([(cf, 0.45), (content, 0.30)]).orderBy("rank").collect()]
    assert got == [(1, 2, 0.525), (2, 5, 0.12)]


def test_trending_overlay(spark):
    cf = spark.createDataFrame([(1, 1, 10, 0.5)], "user_id bigint, rank int, item_id bigint, score double")
    trending = spark.createDataFrame([(10, 1, 9.0), (11, 2, 8.0), (12, 3, 7.0)], "item_id bigint, rank int, score double")
    seen = spark.createDataFrame([(1, 11)], "user_id bigint, item_id bigint")
    got = [(r["item_id"], r["score"]) for r in hybrid.with_trending(cf, trending, seen).orderBy("rank").collect()]
    assert got == [(10, 0.3), (12, 0.05)]


def test_unknown_user_gets_nothing_or_the_fallback(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    lists = {"hybrid": spark.createDataFrame([(1, 1, 10, 1.5)], "user_id bigint, rank int, item_id bigint, score double")}
    top = spark.createDataFrame([(11, 1, 0.9)], "item_id bigint, rank int, score double")
    items = spark.createDataFrame([(10, "t", "g", 1, None, 1.0), (11, "u", "g", 1, None, 1.0)], "item_id bigint, title string, genres string, year int, poster_url string, vote_average double")
    seen = spark.createDataFrame([], "user_id bigint, item_id bigint")
    args = dict(lists=lists, trending_top=top, items=items, seen=seen)
    plain = hybrid.recommend(users, "hybrid", **args).collect()
    assert [(r["user_id"], r["score"], r["confidence"]) for r in plain] == [(1, 1.0, 1.0)]
    filled = hybrid.recommend(users, "hybrid", fallback_trending=True, **args).orderBy("user_id").collect()
    assert [(r["user_id"], r["item_id"], r["algorithm"]) for r in filled] == [(1, 10, "hybrid"), (2, 11, "trending")]


def test_upsert_keeps_first_time_and_last_rating(spark):
    schema = "user_id bigint, item_id bigint, rating double, ts int, seq int"
    base = spark.createDataFrame([(1, 1, 3.0, 100, 1)], schema)
    delta = spark.createDataFrame([(1, 1, 4.0, 200, 2), (1, 1, 5.0, 300, 3), (2, 1, 1.0, 150, 4)], schema)
    got = sorted((r["user_id"], r["rating"], r["ts"]) for r in tables.upsert_ratings(base, delta).collect())
    assert got == [(1, 5.0, 100), (2, 1.0, 150)]


def test_insert_skips_known_keys(spark):
    target = spark.createDataFrame([(1,)], "k int")
    batch = spark.createDataFrame([(1, "x", 1), (2, "late", 3), (2, "early", 2)], "k int, v string, seq int")
    assert [(r["k"], r["v"]) for r in tables.insert_new(target, batch, ["k"], "seq").collect()] == [(2, "early")]


def test_json_array_and_relational_options(spark, tmp_path):
    (tmp_path / "items.json").write_text('[{"id": 1, "title": "A", "genres": "X|Y"}, {"id": 2, "title": "B"}]')
    got = files.read_json_array(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["id"], r["title"], r["genres"]) for r in got] == [(1, "A", "X|Y"), (2, "B", None)]
    options = files.relational_options("jdbc:x", "ratings", column="id", lower=0, upper=100, partitions=4)
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "id"


def test_drift(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    same = quality.psi(df, df, "x").first()
    assert same["psi"] == pytest.approx(0.0) and not same["alert"]
    far = quality.psi(df, df.withColumn("x", F.col("x") + 1000), "x").first()
    assert far["alert"]
    ks = quality.ks_test(df, df.withColumn("x", F.col("x") + 1000), "x").first()
    assert ks["d"] == pytest.approx(1.0) and ks["alert"]
    assert quality.ks_test(df, df, "x").first()["p_value"] == 1.0


def test_student_tail(spark):
    # T table, two-sided 5% points.
    df = spark.createDataFrame([(12.706, 1.0), (2.228, 10.0), (1.984, 100.0)], "t double, df double")
    assert column(df, stats.student_p(F.col("t"), F.col("df"))) == pytest.approx([0.05, 0.05, 0.05], abs=2e-4)
    z = spark.createDataFrame([(1.959964,)], "z double")
    assert column(z, stats.two_sided_p(F.col("z"))) == pytest.approx([0.05], abs=1e-6)


def test_parity_of_one_group(spark):
    values = spark.createDataFrame([(1, 3), (2, 5)], "user_id bigint, n int")
    groups = spark.createDataFrame([], "user_id bigint, group string")
    assert experiment.group_parity(values, groups, "n").first()["parity"] == 1.0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    assert evaluate.auc(df, "y", "p").first()["auc"] == pytest.approx(0.625)


def test_gini_of_equal_and_single_exposure(spark):
    equal = spark.createDataFrame([(2,)] * 5, "x int")
    assert evaluate.gini(equal, "x").first()["gini"] == pytest.approx(0.0)
    single = spark.createDataFrame([(0,)] * 4 + [(9,)], "x int")
    assert evaluate.gini(single, "x").first()["gini"] == pytest.approx(0.8)


def test_scaling_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 3, "x double")
    assert column(df, profile.min_max(df, "x")) == [0.0, 0.0, 0.0]


def test_bm25_matches_formula(spark):
    docs = ["the ring the king", "a ring", "nothing here at all", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    got = {r["id"]: r["score"] for r in text.bm25(df, "id", "text", ["ring", "the"]).collect()}
    tokens = [d.split() for d in docs if d]
    mean = np.mean([len(t) for t in tokens])

    def score(t):
        total = 0.0
        for q in ("ring", "the"):
            n, tf = sum(q in x for x in tokens), t.count(q)
            idf = math.log((len(tokens) - n + 0.5) / (n + 0.5) + 1)
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        return total

    assert got == {0: pytest.approx(score(tokens[0])), 1: pytest.approx(score(tokens[1]))}


def test_fuzzy_titles_equal_brute_force(spark):
    words = ["ring", "rings", "king", "wring", "bring", "thing", "string", "sing", "r", "", "ri", "gnir", "ringring"]
    df = spark.createDataFrame([(w,) for w in words], "title string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for limit in (1, 2):
        got = {(r["title"], r["other"]) for r in text.fuzzy_titles(df, df, limit).collect()}
        assert got == {(a, b) for a in words for b in words if a < b and distance(a, b) <= limit}


def test_novelty_keeps_long_lists_off_the_driver(spark):
    """Lists of few items are a small file of many rows: no join may broadcast them."""
    lists = spark.range(300_000).select((F.col("id") % 60_000).alias("user_id"), F.floor(F.col("id") / 60_000).alias("item_id"))
    lists = stored(lists, "lists")
    popularity = spark.createDataFrame([(i, 2 ** i) for i in range(4)], "item_id bigint, pop bigint")
    found = evaluate.novelty(lists, popularity)
    n, mean = found.agg(F.count(F.lit(1)), F.avg("novelty")).first()
    assert n == 60_000 and mean == pytest.approx(math.log2(15) - 1.5)
    plan = found._jdf.queryExecution().toString()
    assert "BuildLeft" not in plan and plan.split("== Physical Plan ==")[1].count("BroadcastExchange") <= 1


def test_feature_vectors_are_in_no_late_shuffle(spark):
    """The factor score is taken where both vectors meet, so no shuffle carries both."""
    from tastelake.operators import cf

    rated = stored(spark.createDataFrame([(u, i, 1.0 + (u + i) % 5) for u in range(4) for i in range(3)], "user_id bigint, item_id bigint, rating double"), "rated")
    users = stored(spark.createDataFrame([(u, [1.0, float(u)]) for u in range(4)], "user_id bigint, vector array<double>"), "users")
    items = stored(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(3)], "item_id bigint, vector array<double>"), "items")
    alignment = stored(rated.select("user_id", "item_id", F.lit(0.5).alias("alignment")), "alignment")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = cf.feature_table(rated, users, items, alignment)
        plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        rows = {(r["user_id"], r["item_id"]): r["cf_score"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {(u, i): float(i + 2 * u) for u in range(4) for i in range(3)}
    moved = [part for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert moved and not any("user_vector" in part and "item_vector" in part for part in moved)
