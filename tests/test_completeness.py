"""Nothing is cut: hot users, texts in any script, open sessions, complete explanations."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastelake.operators import cf, evaluate, graph, hybrid, learned, quality, similarity, text, trending
from tastelake.session import shared_dir, work_path
from tastelake.streaming import jobs


def test_words_of_any_script(spark):
    df = spark.createDataFrame([(1, "Été, Größe 42! 東京 Ελλάδα"), (2, None), (3, "")], "id int, t string")
    got = {r["id"]: r["w"] for r in df.select("id", text.words("t").alias("w")).collect()}
    assert got[1] == ["été", "größe", "42", "東京", "ελλάδα"] and not got[2] and got[3] == []


def test_unseen_items_for_a_user_who_has_seen_nearly_all(spark):
    items = spark.range(5000).select((F.col("id") * 3).alias("item_id"))
    seen = spark.range(4993).select(F.lit(1).cast("bigint").alias("user_id"), (F.col("id") * 3).alias("item_id"))
    seen = seen.union(spark.createDataFrame([(2, 6), (2, 6), (2, 9)], "user_id bigint, item_id bigint"))
    keys = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10)], "user_id bigint, item_id bigint")
    known = {(r["user_id"], r["item_id"]) for r in seen.collect()}
    got = {}
    for r in cf.unseen_items(keys, seen, items, 10, "x").collect():
        got.setdefault((r["user_id"], r["item_id"]), []).append(r["drawn_item"])
    assert {k: len(v) for k, v in got.items()} == {(1, 10): 7, (1, 11): 7, (2, 10): 10, (3, 10): 10}
    for (user, _), drawn in got.items():
        assert len(set(drawn)) == len(drawn) and not {(user, i) for i in drawn} & known
    full = seen.filter("user_id = 1").union(spark.range(4993, 5000).select(F.lit(1).cast("bigint"), F.col("id") * 3))
    assert cf.unseen_items(keys.filter("user_id = 1"), full, items, 3, "x").count() == 0
    lists = evaluate.random_baseline(keys.select("user_id").distinct(), items, seen, 10).groupBy("user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in lists} == {1: 7, 2: 10, 3: 10}


def test_lists_beyond_the_trending_pool(spark):
    scored = spark.range(1, 61).select(F.col("id").alias("item_id"), (100.0 - F.floor(F.col("id") / 2)).alias("score"))
    whole = trending.ranked(scored)
    assert [(r["rank"], r["item_id"]) for r in whole.orderBy("rank").collect()] == [(i, i) for i in range(1, 61)]
    seen = spark.createDataFrame([(1, i) for i in [*range(1, 10), 12, 13]] + [(2, 1)] + [(3, i) for i in range(1, 60)], "user_id bigint, item_id bigint")
    lists = hybrid.trending_lists(seen, trending.top(scored, 10), seen, 3, whole)
    got = {}
    for r in lists.orderBy("rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    assert got[1] == [10, 11, 14] and got[2][:3] == [2, 3, 4] and got[3] == [60]


def test_every_recommendation_is_explained(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0])], "item_id bigint, vector array<double>")
    ratings = spark.createDataFrame([(7, 1, 5.0), (7, 2, 1.0), (8, 9, 5.0)], "user_id bigint, item_id bigint, rating double")
    recs = spark.createDataFrame([(7, 3), (7, 4), (8, 3)], "user_id bigint, item_id bigint")
    got = {(r["user_id"], r["item_id"]): (r["because_item"], r["strength"]) for r in hybrid.explain_by_item(recs, ratings, vectors).collect()}
    assert got == {(7, 3): (1, pytest.approx(5 / 2**0.5, abs=1e-6)), (7, 4): (1, 0.0), (8, 3): (None, None)}


def test_diversify_reads_whole_lists(spark):
    recs = spark.createDataFrame([(1, r, r, 1.0 - r / 1000) for r in range(1, 121)], "user_id bigint, rank int, item_id bigint, score double")
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i < 100 else [0.0, 1.0]) for i in range(1, 121)], "item_id bigint, vector array<double>")
    picked = [r["item_id"] for r in hybrid.diversify(recs, vectors, 2, 0.9).orderBy("rank").collect()]
    assert picked == [1, 100]
    assert [r["item_id"] for r in hybrid.diversify(recs, vectors, 2, 0.9, candidates=50).orderBy("rank").collect()] == [1, 2]


def test_open_sessions_are_delivered(spark):
    path = work_path(spark, "feed")
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=m), u) for i, (m, u) in enumerate([(0, 1), (10, 1), (300, 1), (295, 2), (310, 2)])]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint").parquet(path)
    got = sorted((r["user_id"], r["n_events"], r["is_open"]) for r in jobs.all_sessions(spark, stream).collect())
    assert got == [(1, 1, True), (1, 2, False), (2, 2, True)]


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_fold_in_reads_only_its_own_rows(spark):
    """The rows of the first batch are gone when the second comes, only touched partitions change, and a batch counts once."""
    from pathlib import Path

    from tastelake.operators import incremental

    path, source = work_path(spark, "totals"), work_path(spark, "source")
    sums = {"total": F.col("x"), "n": F.lit(1)}
    spark.createDataFrame([(i % 20, float(i)) for i in range(200)], "id bigint, x double").write.parquet(f"{source}/one")
    assert len(incremental.fold_in(path, spark.read.parquet(f"{source}/one"), ["id"], sums, 0, buckets=8)) > 2
    for file in Path(f"{source}/one").glob("*.parquet"):
        file.write_bytes(b"gone")
    before = {p: p.stat().st_mtime_ns for p in Path(path).glob("bucket=*/*.parquet")}
    delta = spark.createDataFrame([(3, 1000.0), (3, 1.0), (99, 5.0)], "id bigint, x double")
    written = incremental.fold_in(path, delta, ["id"], sums, 1, buckets=8)
    assert 1 <= len(written) <= 2 and incremental.fold_in(path, delta, ["id"], sums, 1, buckets=8) == []
    kept = {p for p in before if int(p.parent.name.split("=")[1]) not in written}
    assert kept and all(p.stat().st_mtime_ns == before[p] for p in kept)
    got = {r["id"]: (r["total"], r["n"]) for r in incremental.totals(spark, path).collect()}
    want = {i: (float(sum(range(i, 200, 20))), 10) for i in range(20)}
    want[3], want[99] = (want[3][0] + 1001.0, 12), (5.0, 1)
    assert got == want


def test_frequent_items_keep_their_bounds(spark):
    import random
    from collections import Counter

    from tastelake.operators import incremental

    r = random.Random(4)
    rows = [(day, min(int(r.expovariate(0.05)), 150) if r.random() < 0.7 else 7) for day in range(12) for _ in range(300)]
    df = spark.createDataFrame(rows, "day int, item_id bigint")
    daily = incremental.frequent_items(df, "day", "item_id", 20)
    assert daily.groupBy("day").count().agg(F.max("count")).first()[0] <= 20
    found = incremental.merged_frequent_items(daily, "day", "item_id", 15).collect()
    true = Counter(i for _, i in rows)
    bound = found[0]["bound"]
    assert len(found) == 15 and all(x["lower"] <= true[x["item_id"]] <= x["upper"] for x in found)
    listed = {x["item_id"] for x in found}
    assert all(n <= bound for i, n in true.items() if i not in listed) and 7 in listed


def test_dictionary_only_grows(spark):
    from tastelake.operators import dictionary

    path = work_path(spark, "words")
    one = {r["id"]: r["number"] for r in dictionary.extend(path, spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "u string"), "u").collect()}
    two = dictionary.extend(path, spark.createDataFrame([("c",), ("a",), ("0",)], "u string"), "u")
    both = {r["id"]: r["number"] for r in two.collect()}
    assert one == {"a": 0, "b": 1} and one.items() <= both.items() and sorted(both.values()) == [0, 1, 2, 3]
    rows = spark.createDataFrame([("c", 1), ("a", 2), ("zz", 3), (None, 4)], "u string, x int")
    coded = dictionary.encoded(rows, "u", two)
    assert sorted((r["u"], r["x"]) for r in dictionary.decoded(coded, "u", two).collect()) == [("a", 2), ("c", 1)]


def test_cold_items_below_a_count(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "item_id bigint")
    seen = spark.createDataFrame([(1,)] * 3 + [(2,)] * 2 + [(3,), (None,)], "item_id bigint")
    assert sorted(r[0] for r in hybrid.cold_items(items, seen).collect()) == [4, 5]
    assert sorted(r[0] for r in hybrid.cold_items(items, seen, fewer_than=3).collect()) == [2, 3, 4, 5]
    assert hybrid.cold_items(items, seen.limit(0), fewer_than=3).count() == 5


def test_rare_genres_of_candidates(spark):
    lists = spark.createDataFrame([(1, "cf", 10, 1.0), (1, "trending", 10, 0.5), (1, "cf", 11, 0.9), (1, "content", 12, 0.1), (2, "cf", 10, 1.0)],
                                  "user_id bigint, signal string, item_id bigint, score double")
    genres = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (12, "a"), (13, "b")], "item_id bigint, genre string")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in hybrid.rare_genres(lists, genres).collect()}
    assert got == pytest.approx({(1, 10): 0.0, (1, 11): 0.0, (1, 12): (2 / 3 + 0) / 2, (2, 10): 0.0})


def test_select_features_passes_over_repeats_and_constants(spark):
    r = random.Random(4)
    rows = []
    for _ in range(400):
        x, y = r.random(), r.random()
        rows.append((2 * x + y + 0.1 * r.random(), x, -3 * x + 1, y, 7.0, r.random()))
    df = spark.createDataFrame(rows, "target double, x double, again double, y double, same double, noise double")
    got = learned.select_features(df, ["x", "again", "y", "same", "noise"], "target", keep=2)
    assert [g[0] for g in got if g[3]] == ["again", "y"] and got[1][0] == "x"
    assert got[-1][:2] == ("same", None) and [g[2] for g in got] == [1, 2, 3, 4, 5]


def test_category_counts_take_the_categories_of_the_data(spark):
    df = spark.createDataFrame([("k", "Red"), ("k", "Red"), ("l", "blue"), ("l", None)], "key string, kind string")
    got = {r["key"]: r.asDict() for r in learned.category_counts(df, "key", "kind").collect()}
    assert got == {"k": {"key": "k", "is_blue": 0, "is_red": 2}, "l": {"key": "l", "is_blue": 1, "is_red": 0}}


def test_catalog_reads_inputs_from_the_plan(spark):
    from tastelake.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    assert quality.inputs_of(v.ratings, v.folder) == ["lineitem", "orders"]
    row = quality.catalog({"users": (v.users, "Data Team", "confidential", None, "daily")}, v.folder).first()
    assert (row["inputs"], row["retention_days"], row["n_rows"]) == ("customer", None, v.users.count())


def test_list_quality_with_whole_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [3.0, 0.0])], "item_id bigint, vector array<double>")
    lists = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 4), (8, 1)], "user_id bigint, item_id bigint")
    got = dict(evaluate.intra_list_diversity(lists, vectors).collect())
    assert got == pytest.approx({7: 2 / 3, 8: 0.0})
    spread = {(r["item_id"], r["d"]): r["x"] for r in graph.propagated_vectors(lists, vectors).collect()}
    mean = (4 / 3, 2 / 3)
    assert spread[(2, 0)] == pytest.approx(mean[0]) and spread[(3, 1)] == pytest.approx(mean[1])
    assert spread[(1, 0)] == pytest.approx((mean[0] + 1) / 2)


def test_propagation_packs_links_in_parts(spark, monkeypatch):
    """Several parts, groups and slices, ids of any size, repeated links and vectors, ids without a partner: means as by hand, and no plan joins a vector to a link."""
    from tastelake.operators import means

    r = random.Random(8)
    users, items = [-5, 0, 3, 2**62, *range(100, 130)], [-(2**62), -1, 0, *range(7, 60)]
    links = [(u, i) for u in users for i in r.sample(items, r.randint(1, 12))] + [(users[0], items[3])] * 2 + [(None, 7), (3, None)]
    vectors = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in items[:30]] + [(items[3], [1.0, 2.0, 3.0, 4.0, 5.0]), (10**9, [0.5] * 5), (59, None)]

    def step(pairs, have):
        got = {}
        for a, b in pairs:
            got.setdefault(b, []).extend(have.get(a, []))
        return {b: [tuple(np.mean(x, axis=0))] for b, x in got.items() if x}

    known = {}
    for i, x in vectors:
        known.setdefault(i, []).extend([x] if x else [])
    whole = [(u, i) for u, i in links if u is not None and i is not None]
    want = step(whole, step([(i, u) for u, i in whole], known))
    frames = spark.createDataFrame(links, "user_id bigint, item_id bigint"), spark.createDataFrame(vectors, "item_id bigint, vector array<double>")
    for part_links, least, targets in ((means.PART_LINKS, means.LEAST_LINKS, means.GROUP_TARGETS), (40, 20, 10), (15, 1000, 7)):
        for name, value in (("PART_LINKS", part_links), ("LEAST_LINKS", least), ("GROUP_TARGETS", targets)):
            monkeypatch.setattr(means, name, value)
        found = graph.propagated_vectors(*frames)
        assert "vector" not in " ".join(found.columns) and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(x["item_id"], x["d"]): x["x"] for x in found.collect()}
        assert got == pytest.approx({(i, d): x[0][d] for i, x in want.items() for d in range(5)})


def test_explanations_of_a_history_in_parts(spark, monkeypatch):
    r = random.Random(6)
    vectors = {i: [r.uniform(-1, 1) for _ in range(4)] for i in range(60)}
    seen = [(u, i, float(r.randint(1, 5))) for u in (1, 2, 3) for i in r.sample(range(60), (40, 3, 1)[u - 1])] + [(4, 99, 5.0)]
    lists = [(u, i) for u in (1, 2, 3, 4, 5) for i in r.sample(range(60), 4)]
    frames = (
        spark.createDataFrame(lists, "user_id bigint, item_id bigint"),
        spark.createDataFrame(seen, "user_id bigint, item_id bigint, rating double"),
        spark.createDataFrame(list(vectors.items()), "item_id bigint, vector array<double>"),
    )

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = {}
    for u, i in lists:
        known = [(cosine(vectors[i], vectors[j]) * x, -j) for v, j, x in seen if v == u and j in vectors]
        want[u, i] = (-max(known)[1], round(max(known)[0], 6)) if known else (None, None)
    for rows in (hybrid.HISTORY_ROWS, 7):
        monkeypatch.setattr(hybrid, "HISTORY_ROWS", rows)
        got = {(x["user_id"], x["item_id"]): (x["because_item"], x["strength"]) for x in hybrid.explain_by_item(*frames).collect()}
        assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
        assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-6) if want[k][1] is not None else got[k][1] is None for k in want)


@pytest.mark.parametrize("implicit", [True, False])
def test_als_in_blocks_against_whole_systems(spark, monkeypatch, implicit):
    from tastelake.operators import als

    monkeypatch.setattr(als, "LEAST_RATINGS", 100)
    monkeypatch.setattr(als, "CHAIN", 4)
    rng = np.random.default_rng(3)
    n, m, f, reg, rounds = 37, 23, 5, 0.03, 3
    rated = {(u, i): float(rng.integers(1, 11)) / 2 for u in range(n) for i in range(m) if rng.random() < (0.9 if u == 4 else 0.4) or (u, i) in ((n - 1, 0), (0, m - 1))}
    held = {p for p in rated if sum(p) % 7 == 3}
    df = spark.createDataFrame([(u, i, x, (u, i) in held) for (u, i), x in rated.items()], "user_index int, item_index int, rating double, held boolean")
    model = als.Model(df)
    assert model.users.blocks > 2
    users, items, error = model.fit(f, reg, rounds, implicit, seed=7)

    x = np.zeros((n, f))
    starts = als._starts(n, model.users.blocks)
    for b in range(model.users.blocks):
        own = np.random.default_rng([7, b]).normal(size=(starts[b + 1] - starts[b], f))
        x[starts[b] : starts[b + 1]] = own / np.linalg.norm(own, axis=1)[:, None]

    def solve(y, side, count):
        out = np.zeros((count, f))
        for a in range(count):
            mine = [(p[1 - side], r) for p, r in rated.items() if p[side] == a and p not in held]
            system, right = (y.T @ y if implicit else np.zeros((f, f))) + reg * len(mine) * np.eye(f), np.zeros(f)
            for b, r in mine:
                system += (r if implicit else 1) * np.outer(y[b], y[b])
                right += (1 + r if implicit else r) * y[b]
            out[a] = np.linalg.solve(system, right)
        return out

    for _ in range(rounds):
        y = solve(x, 1, m)
        x = solve(y, 0, n)
    for got, want in ((users, x), (items, y)):
        rows = {r[0]: r["vector"] for r in got.collect()}
        assert len(rows) == len(want)
        np.testing.assert_allclose([rows[a] for a in range(len(want))], want, rtol=2e-3, atol=2e-4)
    assert error == pytest.approx(np.sqrt(np.mean([(x[u] @ y[i] - rated[u, i]) ** 2 for u, i in held])), rel=1e-3)


def test_collaborative_lists_read_ratings_of_vectors_only(spark):
    from tastelake.plans import collaborative, recommend
    from tastelake.sources.views import Views

    whole = Views(spark, "/root/testdata/sf0.001")
    ratings = whole.stored_ratings
    users = similarity.weighted_mean_vectors(ratings, whole.item_vectors)
    want = hybrid.score_unseen(users, whole.item_vectors, ratings, 50)
    trend = recommend.trending_top(whole)
    cards = dict(lists={"collaborative": want, "hybrid": hybrid.with_trending(want, trend, ratings)}, trending_top=trend, items=whole.items, seen=ratings)
    named = want.withColumn("user_id", F.concat(F.lit("user-"), "user_id"))
    for query, asked in (
        (recommend.user_scores_top50, want), (recommend.hybrid_user_recs, cards["lists"]["hybrid"]), (collaborative.user_scores_named, named),
        (recommend.recommend_cards, hybrid.recommend(whole.users, "collaborative", **cards)),
        (recommend.recommend_hybrid, hybrid.recommend(whole.users, "hybrid", **cards)),
    ):
        v = Views(spark, whole.folder)
        got = query(v)
        assert sorted(got.collect()) == sorted(asked.select(*got.columns).collect())
        assert "stored_ratings" not in v.__dict__
