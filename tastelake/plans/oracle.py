"""Shared common table expressions of the check SQL, one per view."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "items": """
        SELECT p_partkey AS item_id, p_name || ' (' || CAST(1960 + p_size AS VARCHAR) || ')' AS title,
               p_type || '|' || p_brand AS genres, CAST(1960 + p_size AS INTEGER) AS year, p_name AS overview,
               CAST(NULL AS VARCHAR) AS poster_url, p_retailprice / CAST(100 AS DOUBLE) AS vote_average
        FROM part""",
    "item_genres": "SELECT item_id, unnest(string_split(genres, '|')) AS genre FROM items",
    "users": """
        SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS segment, c_nationkey AS nation_id,
               c_acctbal AS balance FROM customer""",
    "ratings_raw": """
        SELECT o_custkey AS user_id, l_partkey AS item_id,
               CAST(ceil(l_quantity / CAST(5 AS DOUBLE)) AS DOUBLE) / CAST(2 AS DOUBLE) AS rating,
               o_orderdate AS ts, l_orderkey, l_linenumber, l_quantity, l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ratings": """
        SELECT user_id, item_id, rating, first_ts AS ts FROM (
          SELECT *, min(ts) OVER (PARTITION BY user_id, item_id) AS first_ts,
                 row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, l_orderkey DESC,
                                    l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS rn
          FROM ratings_raw) WHERE rn = 1""",
    "interactions": """
        SELECT event_id, ts, user_id, event_type AS interaction_type, value AS intensity,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events""",
    "requests": """
        SELECT event_id, ts, user_id, event_type AS endpoint, value AS latency_ms,
               event_type = 'error' AS is_error FROM events""",
    "item_vectors": "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vector, label AS class FROM embeddings",
    "user_vector_parts": """
        SELECT user_id, d, sum(rating * vector[d]) / sum(rating) AS x
        FROM ratings JOIN item_vectors USING (item_id), range(1, 65) AS dims(d) GROUP BY user_id, d""",
    "user_vectors": "SELECT user_id, list(x ORDER BY d) AS vector FROM user_vector_parts GROUP BY user_id",
    "corpus": "SELECT doc_id, text, lang, source FROM documents",
    "trending": """
        SELECT item_id, round(avg(rating) * ln(1 + count(*)), 4) AS score, count(*) AS n_ratings
        FROM ratings_raw WHERE item_id IN (SELECT item_id FROM items) GROUP BY item_id""",
    "trending_top": """
        SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank
        FROM trending ORDER BY score DESC, item_id LIMIT 500""",
    "cf_recs": """
        SELECT user_id, rank, item_id, score FROM (
          SELECT u.user_id, i.item_id, round(list_dot_product(u.vector, i.vector), 4) AS score,
                 row_number() OVER (PARTITION BY u.user_id ORDER BY
                   round(list_dot_product(u.vector, i.vector), 10) DESC, i.item_id) AS rank
          FROM user_vectors u, item_vectors i
          WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = u.user_id AND r.item_id = i.item_id))
        WHERE rank <= 50""",
    "hybrid_recs": """
        SELECT user_id, rank, item_id, CAST(round(CAST(s AS DECIMAL(28, 8)), 4) AS DOUBLE) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 10) DESC, item_id) AS rank FROM (
            SELECT user_id, item_id, 0.6::DOUBLE * score AS s FROM cf_recs
            UNION ALL
            SELECT u.user_id, t.item_id, 0.05::DOUBLE FROM (SELECT DISTINCT user_id FROM cf_recs) u, trending_top t
            WHERE t.rank <= 200
              AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = u.user_id AND r.item_id = t.item_id)
              AND NOT EXISTS (SELECT 1 FROM cf_recs c WHERE c.user_id = u.user_id AND c.item_id = t.item_id)))
        WHERE rank <= 50""",
    "cf_similar": """
        SELECT item_id, rank, neighbor_id, score FROM (
          SELECT a.item_id, b.item_id AS neighbor_id, round(list_cosine_similarity(a.vector, b.vector), 4) AS score,
                 row_number() OVER (PARTITION BY a.item_id ORDER BY
                   round(list_cosine_similarity(a.vector, b.vector), 10) DESC, b.item_id) AS rank
          FROM item_vectors a JOIN item_vectors b ON a.item_id <> b.item_id) WHERE rank <= 20""",
    "split_numbered": """
        SELECT user_id, item_id, rating, ts,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos,
               count(*) OVER (PARTITION BY user_id) AS n FROM ratings""",
    "train": "SELECT user_id, item_id, rating, ts FROM split_numbered WHERE pos <= floor(0.8::DOUBLE * n)",
    "test": "SELECT user_id, item_id, rating, ts FROM split_numbered WHERE pos > floor(0.8::DOUBLE * n)",
    "relevant": "SELECT user_id, item_id FROM test WHERE rating >= 4",
    "popularity": "SELECT item_id, count(*) AS pop FROM train GROUP BY item_id",
    "train_trending": """
        SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS trank FROM (
          SELECT item_id, round(avg(rating) * ln(1 + count(*)), 4) AS score FROM train GROUP BY item_id)""",
    "recs": """
        SELECT user_id, item_id, score, rank FROM (
          SELECT u.user_id, t.item_id, t.score,
                 row_number() OVER (PARTITION BY u.user_id ORDER BY t.trank) AS rank
          FROM (SELECT DISTINCT user_id FROM train) u, train_trending t
          WHERE NOT EXISTS (SELECT 1 FROM train r WHERE r.user_id = u.user_id AND r.item_id = t.item_id))
        WHERE rank <= 20""",
    "tokens": """
        SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents""",
    "doc_terms": "SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term <> '' GROUP BY doc_id, term",
}


def rounded(text: str, digits: int) -> str:
    """Half-up rounding of a decimal quantity in SQL."""
    return f"CAST(round(CAST({text} AS DECIMAL(28, {digits + 4})), {digits}) AS DOUBLE)"


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the needed table expressions (and those they need) in front of a query."""
    known = {**CTES, **(extra or {})}
    names = list(known)
    needed: set[str] = set()
    text = body
    for name in reversed(names):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += " " + known[name]
    used = [f"{name} AS ({known[name].strip()})" for name in names if name in needed]
    return ("WITH " + ",\n".join(used) + "\n" + body.strip()) if used else body.strip()


def unseen_draws(keys: str, seen: str, n: int, text: str) -> str:
    """SQL of ``n`` different unseen items per row of ``keys`` (k): its columns, d and item_id."""
    return f"""SELECT * FROM (
        WITH numbered AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM items),
        known AS (SELECT user_id, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) + 1 AS place
                  FROM (SELECT DISTINCT user_id, idx FROM {seen} JOIN numbered USING (item_id))),
        free AS (SELECT k.*, (SELECT count(*) FROM items) - coalesce(c, 0) AS f, ('0x' || substr(md5({text}), 1, 8))::BIGINT AS start
                 FROM ({keys}) k LEFT JOIN (SELECT user_id, count(*) AS c FROM known GROUP BY user_id) USING (user_id)),
        places AS (SELECT free.*, d, (start + (d - 1) * greatest(1, f // {n})) % f AS place FROM free JOIN range(1, {n + 1}) AS t(d) ON d <= f)
        SELECT p.* EXCLUDE (f, start, place), i.item_id
        FROM (SELECT places.*, (SELECT count(*) FROM known WHERE known.user_id = places.user_id AND known.place <= places.place) AS skip FROM places) p
        JOIN numbered i ON i.idx = p.place + p.skip)"""
