"""Recommendation lists: scoring, fusion, fallback and re-ranking."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastelake.functions.scalar import clamp_score, confidence, explanation, round_to
from tastelake.operators.ordering import position, running_total, top_n
from tastelake.operators.scoring import group_bounds, unit_rows, vector_top_k, vectors_of, whole_groups
from tastelake.session import stored

# Weights of the built-in fusions.
CF_WEIGHT = 0.60
TRENDING_BONUS = 0.10 * 0.5
TRENDING_POOL = 200
SIMILAR_WEIGHTS = {"cf": 0.45, "content": 0.30}
LATE_FUSION_WEIGHTS = {"cf": 0.30, "content": 0.25, "ncf": 0.20, "trending": 0.15, "diversity": 0.10}

#: Rated items of a user that are compared in one part; longer histories are cut.
HISTORY_ROWS = 50_000


def _best(df: DataFrame, score: str, n: int) -> DataFrame:
    return top_n(df, ["user_id"], [F.round(score, 10).desc(), F.col("item_id")], n)


def score_unseen(user_vectors: DataFrame, item_vectors: DataFrame, seen: DataFrame, k: int = 50) -> DataFrame:
    """Top k unseen items per user by factor product (user_id, rank, item_id, score)."""
    found = vector_top_k(
        user_vectors.select(F.col("user_id").alias("key"), "vector"),
        item_vectors.select("item_id", "vector"),
        k,
        seen=seen.select(F.col("user_id").alias("key"), "item_id"),
    )
    return found.select(F.col("key").alias("user_id"), "rank", "item_id", F.round("score", 4).alias("score"))


#: Least classes that a user's list of classes has.
CLASS_LIST = 10


def _classes(item_vectors: DataFrame, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, classes (vector, class_id, size) of items with equal vectors, and the class of each item with ``more`` of its columns; all stored."""
    items = stored(item_vectors.select("item_id", "vector", *more), "class-items")
    classes = stored(items.groupBy("vector").agg(F.min("item_id").alias("class_id"), F.count(F.lit(1)).alias("size")), "classes")
    return items, classes, stored(items.join(classes, "vector").select("item_id", "class_id", *more), "members")


def score_unseen_classes(user_vectors: DataFrame, item_vectors: DataFrame, seen: DataFrame, k: int = 50) -> DataFrame:
    """``score_unseen`` where many items have equal vectors: a class of such items is scored once per user, see ``_class_lists``."""
    items, classes, members = _classes(item_vectors)
    known = stored(seen.select("user_id", "item_id").distinct().join(members, "item_id"), "seen-members")
    return _class_lists(user_vectors, items, classes, members, known, known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), k)


def _class_lists(user_vectors: DataFrame, items: DataFrame, classes: DataFrame, members: DataFrame, known: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """Best k unseen items per user, from classes and the pairs known(user_id, item_id, class_id), none of which is there twice; history(user_id, n): how many, or more.

    A class stands at its least item id. A user's list holds the best classes, of which those are opened that may reach the k best: as long as the
    unseen items of classes with a higher score are fewer than k. No more of a class are seen than the user has seen in all, so only a first few classes
    of each user are joined with what the user has seen of them. Of a class no more than its first k unseen items can be among the best; they stay one array
    until the user's list is made. A user whose listed classes do not hold k unseen items above the last listed score is scored on all items instead.
    """
    n_classes, n_items = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n_items < 4 * n_classes:
        return score_unseen(user_vectors, items, known, k)
    listed = min(n_classes, max(CLASS_LIST, -(-4 * k * n_classes // n_items)))
    best = vector_top_k(user_vectors.select(F.col("user_id").alias("key"), "vector"), classes.select(F.col("class_id").alias("item_id"), "vector"), listed)
    rows = best.select(F.col("key").alias("user_id"), F.col("item_id").alias("class_id"), "score").join(classes.select("class_id", "size"), "class_id")
    rows = rows.join(history.select("user_id", F.col("n").alias("_all")), "user_id", "left")
    user = Window.partitionBy("user_id")
    step = F.dense_rank().over(user.orderBy(F.round("score", 10).desc()))

    def above(left: Column) -> Column:
        return F.coalesce(F.sum(left).over(user.orderBy("step").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))

    least = F.greatest(F.col("size") - F.coalesce("_all", F.lit(0)), F.lit(0))
    rows = rows.withColumn("step", step).withColumn("above", above(least)).withColumn("_whole", F.max("above").over(user) < k)
    rows = stored(rows.filter(F.col("above") < k).select("user_id", "class_id", "score", "size", "step", "_whole"), "class-lists-of-users")
    held = known.join(rows.select("user_id", "class_id"), ["user_id", "class_id"]).groupBy("user_id", "class_id").agg(F.collect_list("item_id").alias("_seen"))
    rows = rows.join(held, ["user_id", "class_id"], "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<bigint>")))
    rows = stored(rows.withColumn("above", above(F.col("size") - F.size("_seen"))), "open-classes")
    most = rows.agg(F.coalesce(F.max(F.size("_seen")), F.lit(0))).first()[0]
    firsts = top_n(members, ["class_id"], [F.col("item_id")], k + most).groupBy("class_id").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    rest = None
    if listed < n_classes:
        short = stored(rows.groupBy("user_id").agg(F.max("above").alias("_a"), F.first("_whole").alias("_w")).filter(F.col("_w") & (F.col("_a") < k)).select("user_id"), "open-users")
        if not short.isEmpty():
            rest = score_unseen(user_vectors.join(short, "user_id", "left_semi"), items, known, k)
            rows = rows.join(short, "user_id", "left_anti")
    opened = rows.filter(F.col("above") < k).join(stored(firsts, "class-lists"), "class_id")
    unseen = F.slice(F.array_except(F.slice("ids", F.lit(1), F.lit(k) + F.size("_seen")), "_seen"), 1, k)
    entries = F.transform(unseen, lambda i: F.struct((-F.round("score", 10)).alias("_order"), i.alias("item_id"), F.col("score").alias("score")))
    lists = opened.select("user_id", entries.alias("_l")).groupBy("user_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_l"))), 1, k).alias("_l"))
    found = lists.select("user_id", F.posexplode("_l").alias("pos", "x"))
    found = found.select("user_id", (F.col("pos") + 1).alias("rank"), F.col("x.item_id").alias("item_id"), F.round("x.score", 4).alias("score"))
    return found if rest is None else found.unionByName(rest)


def with_trending(cf: DataFrame, trending_top: DataFrame, seen: DataFrame, n: int = 50) -> DataFrame:
    """Weighted CF list plus a constant for unseen trending items that the list lacks.

    The trending pool is 200 ids at most; it travels as one array literal and every user gets a copy, so the plan needs
    no join that multiplies users with items.
    """
    pool = trending_top.filter(F.col("rank") <= TRENDING_POOL).agg(F.collect_list("item_id").alias("ids")).scalar()
    extra = (
        cf.select("user_id")
        .distinct()
        .select("user_id", F.explode(pool).alias("item_id"))
        .join(cf.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        .join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        .withColumn("raw", F.lit(TRENDING_BONUS))
    )
    scored = cf.select("user_id", "item_id", (F.lit(CF_WEIGHT) * F.col("score")).alias("raw")).unionByName(extra)
    return _best(scored, "raw", n).select("user_id", "rank", "item_id", round_to("raw", 4).alias("score"))


def first_unseen(users: DataFrame, ranking: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """The first n items of a whole ranking (item_id, rank from 1, score) that each user has not seen.

    The p-th unseen place is p plus the number of seen items before it, found by a running total over the user's seen ranks.
    """
    ranks = ranking.select("item_id", F.col("rank").cast("bigint").alias("_at"))
    mine = seen.join(users, "user_id", "left_semi").select("user_id", "item_id").distinct().join(ranks, "item_id")
    mine = position(mine.withColumn("_part", F.floor(F.col("_at") / 4096)), ["user_id"], "_part", [F.col("_at")], "_n")
    known = mine.select("user_id", (F.col("_at") - F.col("_n")).alias("place"), F.lit(0).alias("_own"))
    asked = users.select("user_id").distinct().withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    both = asked.withColumn("_own", F.lit(1)).unionByName(known).withColumn("_part", F.floor(F.col("place") / 4096))
    counted = running_total(both, ["user_id"], "_part", [F.col("place"), F.col("_own")], (1 - F.col("_own")).cast("bigint"), "_before")
    found = counted.filter("_own = 1").select("user_id", (F.col("place") + F.col("_before") + 1).alias("_at"))
    return found.join(ranking.withColumn("_at", F.col("rank").cast("bigint")), "_at").select("user_id", "rank", "item_id", "score")


def trending_lists(
    users: DataFrame, trending_top: DataFrame, seen: DataFrame | None, n: int, ranking: DataFrame | None = None, most: int | None = None
) -> DataFrame:
    """The trending list for every user, without seen items: each user gets the first n + (number of seen) entries, of these the first ``most``.

    ``ranking`` is the whole ranking of which ``trending_top`` is the beginning: users who have seen so much of the beginning that
    fewer than n entries are left get their first n from the whole. Of what users have seen, only entries of the list travel; a user's list is cut as one array.
    """
    entries = F.array_sort(F.collect_list(F.struct("rank", "item_id", "score")))
    pool = trending_top.agg(entries.alias("entries")).scalar()
    keys = users.select("user_id").distinct()
    if seen is None:
        asked = keys.withColumn("_left", F.slice(pool, F.lit(1), F.lit(n)))
    else:
        counts = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("_seen"))
        used = seen.select("user_id", "item_id").join(trending_top.select("item_id"), "item_id").groupBy("user_id").agg(F.collect_set("item_id").alias("_used"))
        asked = keys.join(counts, "user_id", "left").join(used, "user_id", "left").withColumn("_want", (F.coalesce("_seen", F.lit(0)) + n).cast("int"))
        asked = asked.withColumn("_used", F.coalesce("_used", F.array().cast("array<bigint>"))).withColumn("_first", F.slice(pool, F.lit(1), F.col("_want")))
        asked = asked.withColumn("_left", F.filter("_first", lambda e: ~F.array_contains("_used", e["item_id"])))
    short = None
    if seen is not None and ranking is not None:
        asked = stored(asked.select("user_id", "_used", "_left"), "trending-lists")
        short = asked.filter(F.size("_used") > F.size(pool) - n).select("user_id")
        if short.isEmpty():
            short = None
        else:
            asked = asked.join(short, "user_id", "left_anti")
    kept = F.col("_left") if most is None else F.slice("_left", 1, most)
    rows = asked.select("user_id", F.explode(kept).alias("e")).select("user_id", "e.*")
    if short is None:
        return rows
    whole = first_unseen(short, ranking, seen, n if most is None else min(n, most))
    return rows.unionByName(whole.select(*rows.columns))


def recommend(
    users: DataFrame,
    algorithm: str,
    *,
    lists: Mapping[str, DataFrame],
    trending_top: DataFrame,
    items: DataFrame,
    seen: DataFrame,
    n: int = 10,
    exclude_seen: bool = True,
    fallback_trending: bool = False,
) -> DataFrame:
    """Recommendation cards for a set of users.

    ``lists`` maps an algorithm to stored ranked lists (user_id, rank, item_id, score). A user without a list gets
    nothing unless ``fallback_trending`` is set. Seen items are dropped, then items without a card, then n are kept.
    """
    barred = seen if exclude_seen else None
    if algorithm == "trending":
        ranked = trending_lists(users, trending_top, barred, n).withColumn("algorithm", F.lit("trending"))
    else:
        stored = lists[algorithm].select("user_id", "rank", "item_id", "score")
        ranked = stored.join(users.select("user_id").distinct(), "user_id", "left_semi")
        if exclude_seen:
            ranked = ranked.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        ranked = ranked.withColumn("algorithm", F.lit(algorithm))
        if fallback_trending:
            without = users.join(stored, "user_id", "left_anti")
            ranked = ranked.unionByName(
                trending_lists(without, trending_top, barred, n).withColumn("algorithm", F.lit("trending"))
            )
    cards = ranked.join(items.select("item_id", "title", "genres", "year", "poster_url", "vote_average"), "item_id")
    kept = top_n(cards.withColumnRenamed("rank", "list_rank"), ["user_id"], [F.col("list_rank")], n)
    return kept.select(
        "user_id",
        "rank",
        "item_id",
        "title",
        clamp_score("score").alias("score"),
        "algorithm",
        explanation("algorithm").alias("explanation"),
        confidence("score").alias("confidence"),
    )


def normalised(signals: DataFrame, digits: int | None = None) -> DataFrame:
    """Min-max per (user, signal); a signal list is a top-k list, so its window is short.

    ``digits``: scores that are sums count as equal up to so many decimals. Rows are dealt by user once, which serves what follows per user and item as well.
    """
    signals = signals.repartition("user_id")
    spec = Window.partitionBy("user_id", "signal")
    low, high = F.min("score").over(spec), F.max("score").over(spec)
    apart = high > low if digits is None else F.round(high - low, digits) > 0
    scaled = F.when(apart, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    return signals.select("user_id", "signal", "item_id", scaled.alias("score"))


def stack_signals(signals: Mapping[str, DataFrame]) -> DataFrame:
    """Named lists (user_id, item_id, score) as one long frame."""
    out = None
    for name, df in signals.items():
        part = df.select("user_id", F.lit(name).alias("signal"), "item_id", F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def rare_genres(signals: DataFrame, item_genres: DataFrame) -> DataFrame:
    """Candidates of a user (user_id, item_id, score): mean over the item's genres of 1 - the genre's share of the user's candidates.

    Candidates are the items that any signal lists, each once; an item without a genre has no row.
    """
    pool = signals.select("user_id", "item_id").distinct()
    tagged = pool.join(item_genres.select("item_id", "genre").distinct(), "item_id")
    held = tagged.groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("_c"))
    sizes = pool.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    share = tagged.join(held, ["user_id", "genre"]).join(sizes, "user_id")
    return share.groupBy("user_id", "item_id").agg(F.avg(1 - F.col("_c") / F.col("_n")).alias("score"))


def cold_items(items: DataFrame, interactions: DataFrame, fewer_than: int = 1) -> DataFrame:
    """Items (item_id) with fewer than so many interactions; those without any are among them."""
    warm = interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= fewer_than)
    return items.select("item_id").join(warm, "item_id", "left_anti")


def weight_of(weights: Mapping[str, float]) -> Column:
    """Weight of the row's signal; signals without an entry weigh 0, so dropping one leaves the rest working."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("signal") == name, F.lit(float(value))).otherwise(w)
    return w


def fuse(signals: DataFrame, weight: Column, n: int = 20) -> DataFrame:
    """Weighted sum over signals (user_id, rank, item_id, score), best n."""
    fused = signals.withColumn("_part", weight * F.col("score")).groupBy("user_id", "item_id").agg(F.sum("_part").alias("raw"))
    return _best(fused, "raw", n).select("user_id", "rank", "item_id", round_to("raw", 6).alias("score"))


def contributions(signals: DataFrame, weight: Column, fused: DataFrame) -> DataFrame:
    """Share of every signal in the score of the items that were kept."""
    kept = signals.join(fused.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    total = kept.select(F.sum(weight * F.col("score")).alias("t")).scalar()
    return kept.groupBy("signal").agg(F.sum(weight * F.col("score")).alias("_part")).select(
        "signal", F.round(F.col("_part") / total, 6).alias("share")
    )


def shares(signals: DataFrame, names: Sequence[str], weight: Column, n: int = 20) -> DataFrame:
    """``contributions`` of the named signals to the best n of ``fuse``, each signal's part summed along with the whole, so that lists are not joined again."""
    part = weight * F.col("score")
    own = [F.sum(F.when(F.col("signal") == name, part)).alias(f"_p{i}") for i, name in enumerate(names)]
    fused = signals.groupBy("user_id", "item_id").agg(F.sum(part).alias("raw"), *own)
    sums = _best(fused, "raw", n).agg(*[F.sum(f"_p{i}").alias(f"_p{i}") for i in range(len(names))])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("signal"), F.col(f"_p{i}").alias("part")) for i, name in enumerate(names)])).alias("x")
    total = F.lit(0.0)
    for i in range(len(names)):
        total = total + F.coalesce(f"_p{i}", F.lit(0.0))
    rows = sums.select(total.alias("_total"), each).filter("x.part IS NOT NULL")
    return rows.select("x.signal", F.round(F.col("x.part") / F.col("_total"), 6).alias("share"))


def switch(cf: DataFrame, content: DataFrame, history: DataFrame, threshold: int) -> DataFrame:
    """Content list for users with a short history, CF list for the others. history(user_id, n)."""
    long_users = history.filter(F.col("n") >= threshold)
    short_users = history.filter(F.col("n") < threshold)
    a = cf.join(long_users, "user_id", "left_semi").withColumn("source", F.lit("collaborative"))
    b = content.join(short_users, "user_id", "left_semi").withColumn("source", F.lit("content"))
    return a.unionByName(b)


def genre_vectors(item_genres: DataFrame) -> tuple[DataFrame, Column]:
    """Unit genre vectors of items with the places of their genres (codes), and the sorted genre list as an array column. The dimension is the
    number of genres of the catalogue, a small vocabulary."""
    vocabulary = item_genres.agg(F.array_sort(F.collect_set("genre")).alias("g")).scalar()
    per_item = item_genres.groupBy("item_id").agg(F.collect_set("genre").alias("_own"), F.collect_list("genre").alias("_each"))
    length = F.sqrt(F.size("_own").cast("double"))
    vector = F.transform("_all", lambda g: F.when(F.array_contains("_own", g), 1.0 / length).otherwise(F.lit(0.0)))
    codes = F.transform("_each", lambda g: F.array_position("_all", g) - 1)
    return per_item.withColumn("_all", vocabulary).select("item_id", vector.alias("vector"), codes.alias("codes")), vocabulary


def _profiles_of(n_genres: int):
    """Sums of ratings by genre, as vectors of length 1, and numbers of ratings, of rows in the order of their users; a user's sums go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors(users: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            length = np.sqrt((sums * sums).sum(axis=1))
            some = length > 0
            lists = pa.FixedSizeListArray.from_arrays(pa.array((sums[some] / length[some, None]).ravel()), n_genres).cast(pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(users[some]), lists, pa.array(n[some])], ["user_id", "vector", "n"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            users, at, n = np.unique(batch.column("user_id").to_numpy(), return_inverse=True, return_counts=True)
            codes, rating = batch.column("codes"), batch.column("rating").fill_null(0.0).to_numpy()
            counts = np.diff(np.asarray(codes.offsets))
            slots = np.repeat(at, counts) * n_genres + codes.flatten().to_numpy()
            sums = np.bincount(slots, np.repeat(rating, counts), len(users) * n_genres).reshape(-1, n_genres)
            if held and held[0][0] == users[0]:
                n[0] += held[1][0]
                sums[0] += held[2][0]
            elif held:
                yield vectors(*held)
            yield vectors(users[:-1], n[:-1], sums[:-1])
            held = users[-1:], n[-1:], sums[-1:]
        if held:
            yield vectors(*held)

    return run


def _profiles(rated: DataFrame, vectors: DataFrame) -> DataFrame:
    """user_id, vector (sums of ratings by genre, of length 1), n: from rated(user_id, codes, rating); ``vectors`` has some vector of as many genres."""
    first = vectors.select(F.size("vector")).first()
    dealt = rated.filter("user_id IS NOT NULL").select("user_id", "codes", "rating").repartition("user_id").sortWithinPartitions("user_id")
    return dealt.mapInArrow(_profiles_of(first[0] if first else 1), "user_id bigint, vector array<double>, n bigint")


def genre_reranked(candidates: DataFrame, ratings: DataFrame, item_genres: DataFrame, weights: tuple[float, float], n: int) -> DataFrame:
    """Best n candidates (user_id, item_id, score) per user by the weighted sum of score and the share of the item's genres in the user's ratings.

    A candidate gets the few places of its genres, and is dealt by user once, where the user's shares are one vector: no row per candidate and genre.
    """
    vectors, _ = genre_vectors(item_genres)
    coded = stored(vectors, "genre-codes")
    rated = ratings.join(coded.select("item_id", "codes"), "item_id").select(F.col("user_id").cast("bigint").alias("user_id"), "codes", F.col("rating").cast("double").alias("rating"))
    tastes = stored(_profiles(rated, coded), "profiles").withColumn("_sum", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x))
    shares = tastes.select("user_id", F.transform("vector", lambda x: x / F.col("_sum")).alias("_shares"))
    listed = coded.join(candidates.select("item_id").distinct(), "item_id", "left_semi")
    rows = candidates.join(stored(listed.select("item_id", "codes"), "listed-codes"), "item_id", "left").join(shares, "user_id", "left")
    share = F.aggregate("codes", F.lit(0.0), lambda s, c: s + F.get("_shares", c.cast("int")))
    scored = rows.select("user_id", "item_id", (weights[0] * F.col("score") + weights[1] * F.coalesce(share, F.lit(0.0))).alias("raw"))
    return _best(scored, "raw", n).select("user_id", "rank", "item_id", round_to("raw", 6).alias("score"))


def content_recs(
    ratings: DataFrame, item_genres: DataFrame, k: int, candidates: DataFrame | None = None, once: bool = False
) -> DataFrame:
    """Unseen items by cosine between the rating-weighted genre profile of a user and the genres of the item.

    ``once``: no pair of user and item is there twice. Ratings meet the genres and the class of their items in one join; a user's sums by genre stay one vector.
    """
    vectors, _ = genre_vectors(item_genres)
    items, classes, members = _classes(vectors, "codes")
    rated = stored(ratings.join(members, "item_id").select(F.col("user_id").cast("bigint").alias("user_id"), "item_id", "class_id", "codes", F.col("rating").cast("double").alias("rating")), "rated-classes")
    profiles = _profiles(rated, classes)
    if candidates is not None:
        return score_unseen_classes(profiles, items.join(candidates, "item_id", "left_semi"), ratings, k)
    known = rated.select("user_id", "item_id", "class_id")
    profiles = stored(profiles, "profiles")
    return _class_lists(profiles, items, classes, members, known if once else stored(known.distinct(), "seen-members"), profiles.select("user_id", "n"), k)


def explain_by_item(recs: DataFrame, ratings: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """The rated item that speaks most for a recommendation: highest cosine similarity x rating, over all rated items.

    The work is list length x history per user. A history of more than ``HISTORY_ROWS`` is cut into parts by item, and the user's short list
    goes to each, so no user is one group. Without a rated item that has a vector the row has nulls.
    """
    known = stored(vectors_of(item_vectors, "item_id"), "explaining-items").select("item_id", "vector", "norm")
    sizes = ratings.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / HISTORY_ROWS).alias("_parts"))
    longer = stored(sizes.filter(F.col("_parts") > 1), "long-histories")
    parts = F.coalesce("_parts", F.lit(1))
    lists = recs.select("user_id", "item_id").join(known, "item_id").join(longer, "user_id", "left")
    lists = lists.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).withColumn("rating", F.lit(None).cast("double"))
    rated = ratings.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).join(known, "item_id").join(longer, "user_id", "left")
    rated = rated.withColumn("_part", F.pmod(F.xxhash64("item_id"), parts))
    columns = ["user_id", "_part", "item_id", "rating", "vector", "norm"]
    both = lists.filter("user_id IS NOT NULL").select(*columns, F.lit(0).alias("_kind")).unionByName(rated.filter("rating IS NOT NULL AND user_id IS NOT NULL").select(*columns, F.lit(1).alias("_kind")))
    dealt = both.repartition("user_id", "_part").sortWithinPartitions("user_id", "_part", "_kind", "item_id")
    kinds = "user_id bigint, item_id bigint, because_item bigint, strength double"
    best = dealt.mapInArrow(_strongest, kinds).groupBy("user_id", "item_id").agg(
        F.max_by("because_item", F.struct(F.round("strength", 8), -F.col("because_item"))).alias("because_item"),
        F.round(F.max("strength"), 6).alias("strength"),
    )
    return recs.select("user_id", "item_id").join(best, ["user_id", "item_id"], "left")


def _strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rated item and strength per item of each (user, part): of equal strengths at eight decimals the least item."""
    for batch in whole_groups(batches, ["user_id", "_part"]):
        users, items, kind = (batch.column(c).to_numpy() for c in ("user_id", "item_id", "_kind"))
        rating, vectors = batch.column("rating").to_numpy(zero_copy_only=False), unit_rows(batch)
        out = []
        for a, b in group_bounds(batch, ["user_id", "_part"]):
            mid = a + int(np.searchsorted(kind[a:b], 1))
            if a < mid < b:
                # a history of up to HISTORY_ROWS against some of the list at once
                step = max(1, 4_000_000 // (b - mid))
                for start in range(a, mid, step):
                    stop = min(mid, start + step)
                    strength = (vectors[start:stop] @ vectors[mid:b].T) * rating[mid:b]
                    at = np.round(strength, 8).argmax(axis=1)
                    out.append((users[start:stop], items[start:stop], items[mid + at], strength.max(axis=1)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["user_id", "item_id", "because_item", "strength"])


#: Lists that are re-ranked side by side.
_LISTS = 256


def _mmr(n: int, balance: float):
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["user_id"]):
            bounds = np.array(group_bounds(batch, ["user_id"]))
            # lists of like length stand side by side, so a long one does not widen the others
            bounds = bounds[np.argsort(bounds[:, 1] - bounds[:, 0], kind="stable")]
            users, items, score, units = batch.column("user_id").to_numpy(), batch.column("item_id").to_numpy(), batch.column("score").to_numpy(), unit_rows(batch)
            for first in range(0, len(bounds), _LISTS):
                starts, stops = bounds[first : first + _LISTS].T
                lists, width = np.arange(len(starts)), int((stops - starts).max())
                at = starts[:, None] + np.arange(width)
                free = at < stops[:, None]
                at = np.where(free, at, starts[:, None])
                own, vectors = score[at], units[at]
                closest, picked = np.full(at.shape, -np.inf), []
                for _ in range(min(n, width)):
                    value = balance * own - (1 - balance) * closest if picked else own
                    best = np.where(free, np.round(value, 10), -np.inf).argmax(axis=1)
                    picked.append(np.where(free.any(axis=1), at[lists, best], -1))
                    free[lists, best] = False
                    closest = np.maximum(closest, np.matmul(vectors, vectors[lists, best][:, :, None])[:, :, 0])
                chosen = np.stack(picked, axis=1)
                row, place = np.nonzero(chosen >= 0)
                taken = chosen[row, place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(users[taken]), pa.array((place + 1).astype(np.int32)), pa.array(items[taken]), pa.array(score[taken])], ["user_id", "rank", "item_id", "score"]
                )

    return rerank


def diversify(
    recs: DataFrame, item_vectors: DataFrame, n: int = 10, diversity: float = 0.3, candidates: int | None = None
) -> DataFrame:
    """Maximal marginal relevance over candidate lists; ``candidates`` keeps the best of each list only, None all of it.

    A list is never cut: its length is the number of recommendations asked for, not the length of a user's history. Many lists are re-ranked at once.
    """
    chosen = recs if candidates is None else recs.filter(F.col("rank") <= candidates)
    rows = chosen.join(stored(vectors_of(item_vectors, "item_id"), "listed-items"), "item_id").select(
        F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id"), F.col("score").cast("double").alias("score"), "vector", "norm"
    )
    dealt = rows.repartition("user_id").sortWithinPartitions("user_id", F.col("score").desc(), "item_id")
    return dealt.mapInArrow(_mmr(n, 1 - diversity), "user_id bigint, rank int, item_id bigint, score double")


def shift_popular(recs: DataFrame, popularity: DataFrame, penalty: float, n: int) -> DataFrame:
    """Re-rank by score minus penalty x percent rank of the item's popularity."""
    adjusted = recs.join(popularity.select("item_id", "percent_rank"), "item_id", "left").withColumn(
        "raw", F.col("score") - penalty * F.coalesce("percent_rank", F.lit(0.0))
    )
    return _best(adjusted.drop("rank"), "raw", n).select("user_id", "rank", "item_id", round_to("raw", 6).alias("score"))


def history_depth(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


