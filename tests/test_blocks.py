"""Block grid results against brute force; small blocks force many cells, and one row or column is hot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastelake.operators import blocks, graph, hybrid, learned, scoring, similarity


def rated_cells():
    rng = np.random.default_rng(5)
    cells = {(int(r), int(c)): float(rng.integers(1, 10)) / 2 for r, c in zip(rng.integers(0, 40, 500), rng.integers(0, 30, 500))}
    cells |= {(3, c): 1.5 for c in range(30)}  # a row with every column
    return cells | {(r, 7): float(1 + r % 4) for r in range(40)}  # a column with every row


def direct_scores(cells, measure, support):
    """Score of every ordered column pair."""
    own = {c: {r: v for (r, k), v in cells.items() if k == c} for c in {c for _, c in cells}}
    out = {}
    for a in own:
        for b in own:
            rows = own[a].keys() & own[b].keys()
            if a == b or len(rows) < support:
                continue
            x, y = (np.array([own[i][r] for r in sorted(rows)]) for i in (a, b))
            if measure == "cosine":
                out[a, b] = float(x @ y / np.sqrt(sum(v * v for v in own[a].values()) * sum(v * v for v in own[b].values())))
            elif measure == "jaccard":
                out[a, b] = len(rows) / (len(own[a]) + len(own[b]) - len(rows))
            elif (n := len(rows)) * (x @ x) - x.sum() ** 2 > 1e-9 and n * (y @ y) - y.sum() ** 2 > 1e-9:
                out[a, b] = float((n * (x @ y) - x.sum() * y.sum()) / np.sqrt((n * (x @ x) - x.sum() ** 2) * (n * (y @ y) - y.sum() ** 2)))
    return out


@pytest.mark.parametrize("block", [8, 2048])
@pytest.mark.parametrize("measure", ["cosine", "pearson", "jaccard"])
def test_shared_row_top(spark, measure, block):
    """The best k of every column are among the candidates, with their final scores, and a cell hands on no more than k per id and direction."""
    cells, k, support = rated_cells(), 4, 3
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "r bigint, c bigint, v double")
    score = {"cosine": blocks.COSINE, "pearson": blocks.PEARSON, "jaccard": blocks.JACCARD}[measure]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)  # rows that go on in the next batch
    try:
        rows = blocks.shared_row_top(df, "r", "c", "v", score, k, min_support=support, column_block=block).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = direct_scores(cells, measure, support)
    got = {(x["key"], x["item_id"]): x["score"] for x in rows}
    assert len(got) == len(rows) <= k * 30 * -(-30 // block)
    for pair, value in got.items():
        assert value == pytest.approx(want[pair])
    for a in range(30):
        best = sorted((b for (x, b) in want if x == a), key=lambda b: (-round(want[a, b], 10), b))[:k]
        assert all((a, b) in got for b in best)


def test_hot_item_hands_on_k_pairs_per_id(spark):
    """An item with a third of all ratings: the pairs that leave the cells are bounded by k x ids, not by its raters."""
    rng = np.random.default_rng(6)
    pairs = {(u, 0) for u in range(600)} | {(int(u), int(i)) for u, i in zip(rng.integers(0, 600, 1300), rng.integers(1, 80, 1300))}
    df = spark.createDataFrame([(u, i, 1.0 + (u + i) % 5) for u, i in sorted(pairs)], "user_id bigint, item_id bigint, rating double")
    for entries, row, column in ((df, "user_id", "item_id"), (df, "item_id", "user_id")):
        n = entries.select(column).distinct().count()
        found = blocks.shared_row_top(entries, row, column, "rating", blocks.COSINE, 5)
        assert found.count() <= 5 * n * max(1, -(-n // 256))
    best = blocks.shared_row_top(df, "user_id", "item_id", "rating", blocks.SUPPORT, 7, pairs=True, column_block=16).collect()
    assert len(best) <= 7 * 15 and all(r["key"] < r["item_id"] for r in best)


@pytest.mark.parametrize("task_entries", [0, 350, 8_000_000])
@pytest.mark.parametrize("measure", ["cosine", "pearson", "jaccard"])
def test_shared_row_top_in_row_blocks(spark, monkeypatch, measure, task_entries):
    """One block, many blocks with rows in pieces, and the grid for what fits no block: the same neighbours."""
    monkeypatch.setattr(blocks, "_PIECE", 4)
    monkeypatch.setattr(blocks, "_PAIR_BUDGET", 100)
    cells, k = rated_cells(), 4
    if task_entries == 350:  # without the hot column, which fits no task
        cells = {(r, c): v for (r, c), v in cells.items() if c != 7}
        monkeypatch.setattr(blocks, "_grid_top", None)
    df = spark.createDataFrame([(r, c - 9, v) for (r, c), v in cells.items()], "r bigint, c bigint, v double")
    score = {"cosine": blocks.COSINE, "pearson": blocks.PEARSON, "jaccard": blocks.JACCARD}[measure]
    rows = blocks.shared_row_top(df, "r", "c", "v", score, k, min_support=3, column_block=8, task_entries=task_entries).collect()
    want = direct_scores(cells, measure, 3)
    got = {(x["key"] + 9, x["item_id"] + 9): x["score"] for x in rows}
    assert len(got) == len(rows)
    for pair, value in got.items():
        assert value == pytest.approx(want[pair])
    for a in range(30):
        best = sorted((b for (x, b) in want if x == a), key=lambda b: (-round(want[a, b], 10), b))[:k]
        assert all((a, b) in got for b in best)


def test_sparse_columns_hand_on_k_rows_in_all(spark):
    """Many columns in short rows: no grid of cells, so a column has its k best once and not once a cell."""
    rng = np.random.default_rng(8)
    cells = sorted({(int(r), int(c)) for r, c in zip(np.repeat(np.arange(1500), 8), rng.integers(0, 5000, 12000))})
    df = spark.createDataFrame([(r, c, 1.0) for r, c in cells], "r bigint, c bigint, v double")
    found = blocks.shared_row_top(df, "r", "c", "v", blocks.COSINE, 2)
    assert found.groupBy("key").count().agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("block_items", [None, 9])
def test_vector_top_k_masks_seen_before_the_cut(spark, block_items):
    rng = np.random.default_rng(1)
    q, i = rng.normal(size=(25, 6)), rng.normal(size=(60, 6))
    i[10] = i[11]  # a tie
    queries = spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(q)], "key bigint, vector array<double>")
    items = spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(i)], "item_id bigint, vector array<double>")
    scores = q @ i.T
    best = {(u, int(np.argmax(scores[u]))) for u in range(25)} | {(0, n) for n in range(57)}
    seen = spark.createDataFrame(sorted(best), "key bigint, item_id bigint")
    got = {}
    for r in scoring.vector_top_k(queries, items, 5, seen=seen, block_items=block_items, part_queries=7).collect():
        got.setdefault(r["key"], []).append((r["rank"], r["item_id"]))
    for u in range(25):
        order = sorted((n for n in range(60) if (u, n) not in best), key=lambda n: (-round(scores[u, n], 10), n))[:5]
        assert [n for _, n in sorted(got[u])] == order


@pytest.mark.parametrize("positive", [False, True])
def test_vector_top_k_stops_by_norms(spark, positive):
    """Falling norms end the rounds early; queries without vectors of their own and negative scores included."""
    rng = np.random.default_rng(8)
    q = np.vstack([rng.normal(size=(30, 4)), np.zeros((1, 4))])
    i = rng.normal(size=(90, 4)) * (0.9 ** np.arange(90))[:, None]
    queries = spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(q)], "key bigint, vector array<double>")
    items = spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(i)], "item_id bigint, vector array<double>")
    found = scoring.vector_top_k(queries, items, 3, exclude_self=True, positive=positive, block_items=8, part_queries=10)
    got = {}
    for r in found.collect():
        got.setdefault(r["key"], []).append((r["rank"], r["item_id"]))
    scores = q @ i.T
    for u in range(31):
        order = sorted((n for n in range(90) if n != u), key=lambda n: (-round(scores[u, n], 10), n))
        want = [n for n in order if not positive or scores[u, n] > 5e-11][:3]
        assert [n for _, n in sorted(got.get(u, []))] == want


def test_sparse_neighbors(spark):
    rng = np.random.default_rng(2)
    dense = rng.integers(0, 3, size=(40, 15)).astype(float)
    dense[:, 0] = 1.0  # a feature of every id
    dense[5] = 0.0
    rows = [(a, f, float(dense[a, f])) for a in range(40) for f in range(15) if dense[a, f]]
    df = spark.createDataFrame(rows, "id bigint, f int, w double")
    got = {}
    for r in similarity.sparse_neighbors(df, "id", "f", "w", 4).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["neighbor_id"]))
    length = np.linalg.norm(dense, axis=1)
    length[length == 0] = 1
    cos = (dense / length[:, None]) @ (dense / length[:, None]).T
    assert 5 not in got
    for a in got:
        order = sorted((b for b in range(40) if b != a and cos[a, b] > 0), key=lambda b: (-round(cos[a, b], 10), b))[:4]
        assert [b for _, b in sorted(got[a])] == order


@pytest.mark.parametrize("overlap", [False, True])
def test_sparse_top_k_over_several_indexes(spark, overlap):
    """Two sides, features of any type, one of them everywhere, items without shared features, and several rounds."""
    rng = np.random.default_rng(12)
    q, i = (np.where(rng.random((n, 25)) < 0.2, rng.integers(1, 5, (n, 25)), 0).astype(float) for n in (30, 70))
    if overlap:
        q, i = (q > 0).astype(float), (i > 0).astype(float)
    q[:, 0] = i[:60, 0] = 1.0
    i[69] = 0.0

    def frame(m):
        return spark.createDataFrame([(a, f"word {f}", float(m[a, f])) for a in range(len(m)) for f in range(25) if m[a, f]], "id bigint, feature string, weight double")

    scores = q @ i.T
    if overlap:
        scores = scores / ((q * q).sum(axis=1)[:, None] + (i * i).sum(axis=1)[None, :] - scores)
    for limits in ({}, {"index_items": 20, "part_queries": 9}, {"index_entries": 60}):
        got = {}
        for r in scoring.sparse_top_k(frame(q), frame(i), 5, overlap=overlap, **limits).collect():
            got.setdefault(r["key"], []).append((r["rank"], r["item_id"]))
        for u in range(30):
            order = sorted((n for n in range(70) if scores[u, n] > 5e-11), key=lambda n: (-round(scores[u, n], 10), n))[:5]
            assert [n for _, n in sorted(got.get(u, []))] == order


def test_zero_vector_and_duplicates(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0])], "item_id bigint, vector array<double>")
    got = {(r["item_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in similarity.cosine_neighbors(df, 3).collect()}
    assert got[2, 1] == (3, 1.0) and got[3, 1] == (2, 1.0)
    assert got[2, 3] == (4, -1.0) and got[1, 1] == (2, 0.0)


def test_mmr_matches_plain_greedy(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(12, 4))
    score = rng.random(12)
    recs = spark.createDataFrame([(1, n + 1, n, float(s)) for n, s in enumerate(score)], "user_id bigint, rank int, item_id bigint, score double")
    items = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "item_id bigint, vector array<double>")
    got = [r["item_id"] for r in hybrid.diversify(recs, items, 6, 0.3).orderBy("rank").collect()]
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    picked = [int(np.argmax(score))]
    while len(picked) < 6:
        rest = [n for n in range(12) if n not in picked]
        picked.append(max(rest, key=lambda n: 0.7 * score[n] - 0.3 * max(unit[n] @ unit[p] for p in picked)))
    assert got == picked


def test_truncated_svd(spark):
    rng = np.random.default_rng(8)
    matrix = rng.random((30, 12)) * (rng.random((30, 12)) < 0.5)
    rows = [(r, c, float(matrix[r, c])) for r in range(30) for c in range(12) if matrix[r, c]]
    df = spark.createDataFrame(rows, "u bigint, i bigint, x double")
    _, values = learned.truncated_svd(df, "u", "i", "x", 3, rounds=12)
    assert values == pytest.approx(np.linalg.svd(matrix)[1][:3], rel=1e-3)


def test_grid_products(spark, monkeypatch):
    from tastelake.operators import products

    monkeypatch.setattr(products, "LEAST_ENTRIES", 30)
    rng = np.random.default_rng(9)
    matrix = rng.random((40, 25)) * (rng.random((40, 25)) < 0.4)
    matrix[3] = rng.random(25)  # a full row
    rows = [(r, c, float(matrix[r, c])) for r in range(40) for c in range(25) if matrix[r, c]] + [(None, 1, 1.0), (1, None, 1.0)]
    grid = products.Grid(spark.createDataFrame(rows, "u bigint, i bigint, x double"), "u", "i", "x")
    assert grid.side > 2
    for source, target, whole in (("i", "u", matrix), ("u", "i", matrix.T)):
        known = [n for n in range(whole.shape[1]) if n % 3]
        y = rng.random((len(known), 2))
        given = spark.createDataFrame([(n, *map(float, v)) for n, v in zip(known, y)] + [(999, 1.0, 1.0)], f"{source} bigint, f0 double, f1 double")
        got = {r[target]: (r["f0"], r["f1"]) for r in grid.times(given, ["f0", "f1"], source).collect()}
        want = whole[:, known] @ y
        assert set(got) == {n for n in range(len(whole)) if whole[n, known].any()}
        assert all(got[n] == pytest.approx(want[n]) for n in got)


def test_approximate_neighbors_reach_their_recall(spark, views):
    """With the defaults: nine tenths of the exact neighbours of all items, and of the rows with id divisible by 50 against brute force."""
    found = learned.approximate_neighbors(views.item_vectors)
    exact = similarity.cosine_neighbors(views.item_vectors)
    assert learned.recall_against(found, exact).first()["recall"] >= 0.9
    assert learned.recall_against(found, exact.filter("item_id % 50 = 0")).first()["recall"] >= 0.9


def test_probes_follow_the_wanted_recall(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    rows = [(n, (centres[n % 12] + rng.normal(0, 0.1, 8)).tolist()) for n in range(600)] + [(700, [0.0] * 8)]
    df = spark.createDataFrame(rows, "item_id bigint, vector array<double>")
    units = df.select("item_id", F.col("vector"))
    own = learned.cell_centres(units, 12)
    few, many = (learned.needed_probes(units, own, 10, r) for r in (0.5, 1.0))
    assert 1 <= few <= many <= 12
    assert learned.approximate_neighbors(df.limit(0)).count() == 0


def test_lambda_gradients_pull_rows_apart():
    pull, bend = learned.lambda_gradients(np.array([0.0, 0.0, 1.0]), np.array([3.0, 1.0, 0.0]))
    assert pull[0] > 0 > pull[2] and (bend > 0).all() and pull.sum() == pytest.approx(0)
    same, none = learned.lambda_gradients(np.array([0.3, 0.1]), np.array([2.0, 2.0]))
    assert not same.any() and not none.any()


def test_listwise_ranking_beats_the_pointwise_model(spark):
    """Ratings that differ mostly between users: a model of values spends its trees on them, a model of orders does not."""
    rng = np.random.default_rng(9)
    rows = []
    for user in range(120):
        level = float(rng.normal(0, 3))
        for item in range(20):
            x, noise = float(rng.normal()), float(rng.normal())
            rows.append((user, item, level, x, noise, float(np.clip(np.round(level + 0.5 * x + 0.2 * rng.normal() + 3), 0, 6)), int(rng.random() < 0.4)))
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, level double, x double, noise double, rating double, fold int")
    train, test = df.filter("fold = 0"), df.filter("fold = 1")
    columns = ["level", "noise", "x"]

    def ndcg(scored):
        out = []
        for _, part in scored.select("user_id", "score", "rating").toPandas().groupby("user_id"):
            gain = 2.0 ** part.sort_values("score", ascending=False)["rating"].to_numpy()[:10] - 1
            best = 2.0 ** np.sort(part["rating"].to_numpy())[::-1][:10] - 1
            if best.sum():
                weight = 1 / np.log2(np.arange(len(gain)) + 2)
                out.append((gain * weight).sum() / (best * weight).sum())
        return float(np.mean(out))

    lists = ndcg(learned.listwise_ranker(train, test, columns, "rating"))
    points = ndcg(learned.boosted_ranker(train, test, columns, "rating", trees=10))
    print("NDCG@10 listwise", lists, "pointwise", points)
    assert lists > points


def test_halving_stops_losers(spark):
    rng = np.random.default_rng(10)
    u, i = rng.normal(size=(60, 3)), rng.normal(size=(40, 3))
    rows = [(f"user-{a}", b, float(np.clip(2.5 + u[a] @ i[b], 0.5, 5))) for a in range(60) for b in range(40) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "user_id string, item_id bigint, rating double")
    settings = [learned.Setting(1, 5.0), learned.Setting(4, 0.05), learned.Setting(3, 0.5), learned.Setting(4, 2.0)]
    found = learned.halving_search(df, settings, rungs=(2, 4, 6))
    assert [sum(r[0] == rung for r in found) for rung in range(3)] == [4, 2, 1]
    assert [r[1] for r in found if r[4] and r[0] == 2] == [learned.Setting(4, 0.05)]
    drawn = learned.drawn_settings(50)
    assert drawn == learned.drawn_settings(50) and all(32 <= s.factors <= 256 and 0.001 <= s.reg <= 0.101 for s in drawn)


def test_word_vectors_of_several_trainers(spark, monkeypatch):
    r = np.random.default_rng(12)
    topics = [[f"{t}{n}" for n in range(6)] for t in "ab"]
    rows = [(n, [str(w) for w in r.choice(topics[n % 2], 40)]) for n in range(400)] + [(400, []), (401, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    asked = []
    real = learned.Word2Vec
    monkeypatch.setattr(learned, "Word2Vec", lambda **settings: asked.append(settings["numPartitions"]) or real(**settings))
    monkeypatch.setattr(learned, "TRAINER_WORDS", 4000)
    got = {x["doc_id"]: np.array(x["vector"]) for x in learned.text_vectors(df.filter("tokens IS NOT NULL"), "tokens", "doc_id", size=8).collect()}
    assert asked == [4] and len(got) == 401 and not got[400].any()
    mean = [np.mean([got[n] for n in range(t, 400, 2)], axis=0) for t in (0, 1)]
    gaps = [np.mean([np.linalg.norm(got[n] - mean[(n + far) % 2]) for n in range(400)]) for far in (0, 1)]
    assert gaps[0] < gaps[1] / 2


def test_reach_and_communities(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 13)], "user_id bigint, item_id bigint")
    seeds = spark.createDataFrame([(10,)], "item_id bigint")
    got = {(r["kind"], r["id"]): r["hop"] for r in graph.reach(edges, seeds, 4).collect()}
    assert got == {("item", 10): 0, ("user", 1): 1, ("item", 11): 2, ("user", 2): 3, ("item", 12): 4}
    labels = {r["node"]: r["label"] for r in graph.communities(edges, 4).collect()}
    assert labels[13] != labels[11]


def test_als_lists_hold_no_seen_item(views):
    users, items = learned.als_factors(views.ratings, factors=4, iterations=2)
    lists = hybrid.score_unseen(users, items, views.ratings, 5)
    assert lists.join(views.ratings, ["user_id", "item_id"], "left_semi").count() == 0
    assert lists.groupBy("user_id").agg(F.max("rank").alias("m")).filter("m <> 5").count() == 0


def test_queries_train_with_the_documented_settings(views, monkeypatch):
    from inspect import signature

    from tastelake.plans import learned as plans

    asked = {}

    class Asked(Exception):
        pass

    def noted(name, real):
        def call(*args, **kwargs):
            bound = signature(real).bind(*args, **kwargs)
            bound.apply_defaults()
            asked.setdefault(name, []).append(bound.arguments)
            if name != "halving_search":
                raise Asked
            return [(0, x, 2, 1.0, False) for x in bound.arguments["settings"]]

        monkeypatch.setattr(learned, name, call)

    for name in ("als_factors", "truncated_svd", "boosted_ranker", "halving_search"):
        noted(name, getattr(learned, name))
    monkeypatch.setattr(plans, "_folded", lambda v: v.ratings.withColumn("fold", F.lit(0)))
    for query in (plans.als_recommendations, plans.truncated_svd, plans.boosted_ranking):
        with pytest.raises(Asked):
            query(views)
    assert (asked["als_factors"][0]["factors"], asked["als_factors"][0]["iterations"]) == (128, 50)
    assert asked["truncated_svd"][0]["rounds"] == 8 and asked["boosted_ranker"][0]["trees"] == 20
    assert plans.parameter_search(views).count() == 8
    assert asked["halving_search"][0]["rungs"] == (1, 3, 8)
    assert all(32 <= x.factors <= 256 and 0.001 <= x.reg <= 0.101 for x in asked["halving_search"][0]["settings"])


@pytest.mark.parametrize("shortest", [1, 10])
def test_equal_vectors_are_scored_once_a_user(spark, monkeypatch, shortest):
    """Items in classes of equal vectors, seen ones among the best classes, users without enough in their listed classes: as scoring all items."""
    monkeypatch.setattr(hybrid, "CLASS_LIST", shortest)
    compared, plain = [], hybrid.vector_top_k
    monkeypatch.setattr(hybrid, "vector_top_k", lambda q, i, k, **more: compared.append(i.count()) or plain(q, i, k, **more))
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 3, (30, 4)).astype(float)
    kinds[4] = kinds[5]
    rows = [(i, kinds[i % 30].tolist()) for i in range(300)]
    users = [(u, rng.integers(0, 3, 4).astype(float).tolist()) for u in range(40)]
    seen = {(u, int(i)) for u in range(39) for i in rng.integers(0, 300, 25)} | {(39, i) for i in range(296)}
    items_df, users_df = spark.createDataFrame(rows, "item_id bigint, vector array<double>"), spark.createDataFrame(users, "user_id bigint, vector array<double>")
    seen_df = spark.createDataFrame(sorted(seen), "user_id bigint, item_id bigint")
    found = {}
    for r in hybrid.score_unseen_classes(users_df, items_df, seen_df, 12).collect():
        found.setdefault(r["user_id"], []).append((r["rank"], r["item_id"], r["score"]))
    assert compared[0] <= 30
    for u, vector in users:
        scores = {i: float(np.dot(vector, v)) for i, v in rows if (u, i) not in seen}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:12]
        assert sorted(found[u]) == [(n, i, scores[i]) for n, i in enumerate(want, 1)]


def test_equal_sparse_vectors_are_one_class(spark, monkeypatch):
    """Copies and near copies: neighbours as by brute force, and each different vector is asked once."""
    asked, plain = [], scoring._round
    monkeypatch.setattr(scoring, "_round", lambda queries, *rest: asked.append(queries.count()) or plain(queries, *rest))
    rng = np.random.default_rng(4)
    kinds = [sorted({int(x) for x in rng.integers(0, 12, 3)}) for _ in range(15)]
    sets = {i: kinds[i % 15] for i in range(90)}
    df = spark.createDataFrame([(i, f, 1.0) for i, own in sets.items() for f in own], "id bigint, feature int, weight double")
    found = {}
    for r in scoring.sparse_top_k(df, df, 7, exclude_self=True, overlap=True).collect():
        found.setdefault(r["key"], []).append((r["rank"], r["item_id"], round(r["score"], 9)))
    assert asked[0] <= 15
    for a, own in sets.items():
        scores = {b: len({*own} & {*other}) / len({*own} | {*other}) for b, other in sets.items() if b != a and {*own} & {*other}}
        want = sorted(scores, key=lambda b: (-round(scores[b], 10), b))[:7]
        assert sorted(found[a]) == [(n, b, round(scores[b], 9)) for n, b in enumerate(want, 1)]


@pytest.mark.parametrize("other_side", [False, True])
def test_frequent_features_are_multiplied_dense(spark, monkeypatch, other_side):
    """Many equal scores, negative and tiny weights, ids without an entry: lists as by brute force, from one stage of cells; items are copied less the more indexes there are."""
    calls, plain = [], scoring._round

    def counted(queries, items, seen, parts, *rest):
        calls.append((parts, items.select(rest[-1].alias("part")).count()))
        return plain(queries, items, seen, parts, *rest)

    monkeypatch.setattr(scoring, "_round", counted)
    monkeypatch.setattr(scoring, "PARTS", 6)
    rng = np.random.default_rng(21)
    n, k = 900, 4
    m = np.where(rng.random((n, 80)) < np.where(np.arange(80) < 12, 0.4, 0.02), rng.integers(-1, 6, (n, 80)), 0).astype(float)
    m[:300, 40:] = 0.0
    m[7], m[8], m[9] = 0.0, m[10], 0.0
    m[9, 3] = 1e-12
    df = spark.createDataFrame([(a, f"word {f}", float(m[a, f])) for a in range(n) for f in range(80) if m[a, f]], "id bigint, feature string, weight double")
    scores = m @ m.T
    for size in (1000, 450):
        queries = df.filter("id % 3 < 2") if other_side else df
        got = {}
        for r in scoring.sparse_top_k(queries, df, k, exclude_self=True, index_items=size, part_queries=200).collect():
            got.setdefault(r["key"], []).append((r["rank"], r["item_id"], r["score"]))
        for u in range(n):
            if other_side and u % 3 == 2:
                continue
            order = sorted((i for i in range(n) if i != u and scores[u, i] > 5e-11), key=lambda i: (-round(scores[u, i], 10), i))[:k]
            assert [(x, i) for x, i, _ in sorted(got.get(u, []))] == list(enumerate(order, 1))
            assert all(abs(x - scores[u, i]) < 1e-9 for _, i, x in got.get(u, []))
    assert [c[0] for c in calls] == ([3, 6] if other_side else [5, 6])
    assert all(copies <= 5 * 900 for _, copies in calls) and calls[1][1] <= 3 * 900


def test_content_lists_join_ratings_once_and_hold_a_user_over_batches(spark, monkeypatch):
    """Lists as by brute force from classes of items, repeated ratings and genres, null ratings; a user's ratings may lie in many batches."""
    rng = np.random.default_rng(4)
    genres = {i: [f"t{i % 5}", f"b{i % 3}"] + ([f"t{i % 5}"] if i % 30 == 7 else []) for i in range(600)}
    rated = [(u, int(i), float(rng.integers(1, 10)) / 2) for u in range(25) for i in rng.integers(0, 600, 60)] + [(3, 11, None), (25, 12, None)]
    ratings = spark.createDataFrame(rated, "user_id bigint, item_id bigint, rating double")
    item_genres = spark.createDataFrame([(i, g) for i, own in genres.items() for g in own], "item_id bigint, genre string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    joined, plain = [], hybrid.score_unseen_classes
    monkeypatch.setattr(hybrid, "score_unseen_classes", lambda *a: joined.append(1) or plain(*a))
    try:
        found = {}
        for r in hybrid.content_recs(ratings, item_genres, 12).collect():
            found.setdefault(r["user_id"], []).append((r["rank"], r["item_id"], r["score"]))
    finally:
        spark.conf.set(key, before)
    assert not joined and sorted(found) == list(range(25))
    for u in range(25):
        taste = {}
        for v, i, x in rated:
            for g in genres[i] if v == u and x is not None else []:
                taste[g] = taste.get(g, 0.0) + x
        length = sum(x * x for x in taste.values()) ** 0.5
        seen = {i for v, i, _ in rated if v == u}
        scores = {i: sum(taste.get(g, 0.0) for g in set(own)) / length / len(set(own)) ** 0.5 for i, own in genres.items() if i not in seen}
        want = sorted(scores, key=lambda i: (-round(scores[i], 10), i))[:12]
        assert sorted(found[u]) == [(n, i, round(scores[i], 4)) for n, i in enumerate(want, 1)]


def test_signals_are_dealt_by_user_once(spark):
    """Normalised lists are fused, and their shares taken, without a further shuffle of the lists; shares as by joining the fused list again."""
    rng = np.random.default_rng(6)
    rows = [(u, s, int(i), float(rng.random())) for u in range(30) for s in ("cf", "content", "trending") for i in rng.choice(60, 20, replace=False)]
    signals = spark.createDataFrame(rows, "user_id bigint, signal string, item_id bigint, score double")
    weight = hybrid.weight_of(hybrid.LATE_FUSION_WEIGHTS)
    scaled = hybrid.normalised(signals)
    fused = hybrid.fuse(scaled, weight)
    assert fused._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {r["signal"]: r["share"] for r in hybrid.contributions(scaled, weight, fused).collect()}
    assert {r["signal"]: r["share"] for r in hybrid.shares(scaled, ("cf", "content", "trending"), weight).collect()} == want
    seen = spark.createDataFrame([(1, 3), (1, 4), (2, 900)], "user_id bigint, item_id bigint")
    top = spark.createDataFrame([(r, r, 1.0 / r) for r in range(1, 9)], "rank int, item_id bigint, score double")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    lists = hybrid.trending_lists(users, top, seen, 3, most=3)
    assert sorted((r["user_id"], r["item_id"]) for r in lists.collect()) == [(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]
    assert "BroadcastNestedLoop" not in lists._jdf.queryExecution().toString()


def test_candidates_are_dealt_once_for_their_genres(spark):
    """Re-ranking as by brute force; of the rows, only candidates are shuffled once, no row per candidate and genre."""
    rng = np.random.default_rng(8)
    genres = {i: [f"t{i % 5}", f"b{i % 3}"] + ([f"t{i % 5}"] if i == 7 else []) for i in range(40)}
    rated = [(u, int(i), float(rng.integers(1, 10)) / 2) for u in range(12) for i in rng.choice(40, 9, replace=False)]
    listed = [(u, int(i), round(float(rng.random()), 4)) for u in range(13) for i in rng.choice(45, 20, replace=False)]
    ratings = spark.createDataFrame(rated, "user_id bigint, item_id bigint, rating double")
    item_genres = spark.createDataFrame([(i, g) for i, own in genres.items() for g in own], "item_id bigint, genre string")
    candidates = spark.createDataFrame(listed, "user_id bigint, item_id bigint, score double")
    best = hybrid.genre_reranked(candidates, ratings, item_genres, (0.7, 0.3), 5)
    assert "Generate explode(genre" not in best._jdf.queryExecution().toString()
    found = {}
    for r in best.collect():
        found.setdefault(r["user_id"], []).append((r["rank"], r["item_id"], r["score"]))
    for u in range(13):
        taste = {}
        for v, i, x in rated:
            for g in genres[i] if v == u else []:
                taste[g] = taste.get(g, 0.0) + x
        total = sum(taste.values()) or 1.0
        raw = {i: 0.7 * s + 0.3 * sum(taste.get(g, 0.0) / total for g in genres.get(i, [])) for v, i, s in listed if v == u}
        want = sorted(raw, key=lambda i: (-round(raw[i], 10), i))[:5]
        assert [(r, i) for r, i, _ in sorted(found[u])] == [(n, i) for n, i in enumerate(want, 1)]
        assert all(abs(s - raw[i]) < 1e-6 for _, i, s in found[u])


def test_squares_of_lengths_travel_with_ratings(spark, monkeypatch):
    """Entries carry the sum of squared ratings of their column, which has few bytes, not its root; scores are the cosines."""
    rng = np.random.default_rng(9)
    rows = [(u, int(i), float(rng.integers(1, 11)) / 2) for u in range(40) for i in rng.choice(25, 8, replace=False)]
    tagged, plain = [], blocks.stored
    monkeypatch.setattr(blocks, "stored", lambda df, label: plain(df, label) if label != "tagged" else tagged.append(plain(df, label)) or tagged[-1])
    found = blocks.shared_row_top(spark.createDataFrame(rows, "u bigint, i bigint, x double"), "u", "i", "x", blocks.COSINE, 24).collect()
    columns = {}
    for u, i, x in rows:
        columns.setdefault(i, {})[u] = x
    squares = {i: sum(x * x for x in own.values()) for i, own in columns.items()}
    assert {(r["c"], r["f"]) for r in tagged[0].select("c", "f").collect()} == set(squares.items())
    got = {(r["key"], r["item_id"]): r["score"] for r in found}
    want = {}
    for a in columns:
        for b in columns:
            both = columns[a].keys() & columns[b].keys()
            if a != b and both:
                want[a, b] = sum(columns[a][u] * columns[b][u] for u in both) / (squares[a] ** 0.5 * squares[b] ** 0.5)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
