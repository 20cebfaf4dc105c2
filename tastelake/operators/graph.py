"""Operators on the user-item graph whose edges are ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.functions.scalar import draw
from tastelake.operators import means
from tastelake.operators.ordering import top_n
from tastelake.session import shared_dir, stored


def meta_paths(edges: DataFrame, item_genres: DataFrame) -> DataFrame:
    """Number of user-item-genre-item paths per user and genre: (items of the genre the user rated) x (items of the
    genre). Counting by product needs no pair of items."""
    rated = edges.join(item_genres, "item_id").groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n_rated"))
    sizes = item_genres.groupBy("genre").agg(F.count(F.lit(1)).alias("n_items"))
    return rated.join(sizes, "genre").select("user_id", "genre", (F.col("n_rated") * F.col("n_items")).alias("n_paths"))


def reach(edges: DataFrame, seed_items: DataFrame, hops: int) -> DataFrame:
    """Nodes (kind, id, hop) reached from a set of items within ``hops`` steps, each with its smallest hop.

    Every hop keeps distinct nodes only. The frontier is checkpointed in the shared folder, so a lost executor costs no
    recomputation of earlier hops.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select("user_id", "item_id").checkpoint()
    items = seed_items.select(F.col("item_id").alias("id")).distinct()
    frontier = items.checkpoint()
    known = {"item": frontier, "user": frontier.limit(0)}
    found = frontier.select(F.lit("item").alias("kind"), "id", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        source, target = ("item", "user") if hop % 2 else ("user", "item")
        step = edges.select(F.col(f"{source}_id").alias("id"), F.col(f"{target}_id").alias("next"))
        nodes = step.join(frontier, "id", "left_semi").select(F.col("next").alias("id")).distinct()
        frontier = nodes.join(known[target], "id", "left_anti").checkpoint()
        known[target] = known[target].unionByName(frontier)
        found = found.unionByName(frontier.select(F.lit(target).alias("kind"), "id", F.lit(hop).alias("hop")))
    return found


def propagated_vectors(edges: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """Item vectors averaged over users and back: (item_id, d, x). Ids are integers, vectors of one length.

    No vector travels with a rating: links are packed, and what is shuffled is each of them once per slice of the components and each vector once per group
    of targets (``means.py``).
    """
    links = stored(edges.select("user_id", "item_id"), "links")
    vectors = item_vectors.filter("vector IS NOT NULL").select("item_id", "vector")
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    parts = max(1, -(-links.count() // means.PART_LINKS))
    rated = links.join(vectors.select("item_id").distinct(), "item_id", "left_semi")
    users = means.Links(rated, "item_id", "user_id", parts)
    items = means.Links(links, "user_id", "item_id", parts)
    packed = stored(users.means(means.packed_vectors(vectors, "item_id", width, parts), width, False), "user-means")
    return items.means(packed, width, True)


def communities(edges: DataFrame, rounds: int) -> DataFrame:
    """Synchronous label propagation on the two-sided graph (node, label); items are ids, users negative ids.

    Working on user-item edges instead of co-rated item pairs keeps every round linear in the number of ratings. Labels
    are counted per (node, label) with partial sums, so a node with a third of all edges is no hot task.
    """
    shared_dir(edges.sparkSession)
    item, user = F.col("item_id"), -F.col("user_id") - 1
    links = edges.select(item.alias("src"), user.alias("node")).unionByName(edges.select(user.alias("src"), item.alias("node"))).checkpoint()
    labels = links.select(F.col("node"), F.col("node").alias("label")).distinct()
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "src"), "src").groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        labels = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")).checkpoint()
    return labels


def sampled_neighbors(edges: DataFrame, k: int, salt: str = "nbr") -> DataFrame:
    """k reproducible neighbours per user."""
    order = draw(F.lit(salt), F.col("user_id"), F.col("item_id"))
    return top_n(edges.withColumn("_o", order), ["user_id"], [F.col("_o"), F.col("item_id")], k).select("user_id", "rank", "item_id")
