"""Graph-shaped queries over ratings."""

from pyspark.sql import functions as F

from tastelake.operators import graph, trending
from tastelake.plans.oracle import sql
from tastelake.plans.registry import query


@query(
    "meta_paths",
    "G1",
    sql("""SELECT user_id, genre, count(*) * any_value(n_items) AS n_paths FROM ratings JOIN item_genres USING (item_id)
           JOIN (SELECT genre, count(*) AS n_items FROM item_genres GROUP BY genre) USING (genre) GROUP BY user_id, genre"""),
)
def meta_paths(v):
    return graph.meta_paths(v.ratings, v.item_genres)


_EDGES = {"rated": "SELECT user_id, item_id FROM ratings"}


@query(
    "reach_from_trending",
    "G2",
    sql("""SELECT 'item' AS kind, item_id AS id, 0 AS hop FROM s0 UNION ALL SELECT 'user', id, 1 FROM u1
           UNION ALL SELECT 'item', id, 2 FROM i2 UNION ALL SELECT 'user', id, 3 FROM u3""",
        {**_EDGES, "s0": "SELECT item_id FROM trending_top WHERE rank <= 10",
         "u1": "SELECT DISTINCT user_id AS id FROM rated WHERE item_id IN (SELECT item_id FROM s0)",
         "i2": "SELECT DISTINCT item_id AS id FROM rated WHERE user_id IN (SELECT id FROM u1) AND item_id NOT IN (SELECT item_id FROM s0)",
         "u3": "SELECT DISTINCT user_id AS id FROM rated WHERE item_id IN (SELECT id FROM i2) AND user_id NOT IN (SELECT id FROM u1)"}),
)
def reach_from_trending(v):
    edges = v.stored_ratings.select("user_id", "item_id")
    seeds = trending.top(trending.scores(v.ratings_raw, v.items), 10)
    return graph.reach(edges, seeds, 3)


@query(
    "propagated_vectors",
    "G3",
    sql("""SELECT item_id, d::INTEGER AS d, round(avg(x), 6) AS x FROM ratings JOIN (
             SELECT user_id, d, avg(x) AS x FROM ratings JOIN (
               SELECT item_id, unnest(vector) AS x, unnest(range(0, 64)) AS d FROM item_vectors) USING (item_id) GROUP BY user_id, d) USING (user_id)
           GROUP BY item_id, d"""),
)
def propagated_vectors(v):
    return graph.propagated_vectors(v.ratings, v.item_vectors).select("item_id", "d", F.round("x", 6).alias("x"))


def _vote(previous: str) -> str:
    return f"""SELECT node, label FROM (SELECT e.node, l.label, count(*) AS n FROM links e JOIN {previous} l ON l.node = e.src
               GROUP BY e.node, l.label) QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1"""


@query(
    "communities",
    "G4",
    sql("SELECT node, label FROM l3",
        {**_EDGES,
         "links": "SELECT item_id AS src, -user_id - 1 AS node FROM rated UNION ALL SELECT -user_id - 1, item_id FROM rated",
         "l0": "SELECT DISTINCT node, node AS label FROM links", "l1": _vote("l0"), "l2": _vote("l1"), "l3": _vote("l2")}),
)
def communities(v):
    return graph.communities(v.stored_ratings.select("user_id", "item_id"), 3)


@query(
    "neighbor_sample",
    "G5",
    sql("""SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
             ORDER BY ('0x' || substr(md5('nbr:' || user_id || ':' || item_id), 1, 8))::BIGINT, item_id) AS rank FROM ratings) WHERE rank <= 10"""),
)
def neighbor_sample(v):
    return graph.sampled_neighbors(v.ratings.select("user_id", "item_id"), 10)
