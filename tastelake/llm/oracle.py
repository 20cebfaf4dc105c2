"""Check SQL of the text operators, for DuckDB over the same tables."""

from tastelake.llm.quality import COST, MAX_FALSE_REJECTIONS, RISK, TOP

QUALITY = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
wins AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
         FROM split, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
reps AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM wins, range(3) AS t(k) WHERE n > 1 GROUP BY r),
feats AS (
  SELECT doc_id, stratum, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines
  FROM docs JOIN split USING (r) LEFT JOIN reps USING (r)),
rules AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         least(coalesce(100 * n_symbols // nullif(n_words, 0), 0), {TOP}) AS symbols,
         least(coalesce(100 * n_repeat_words // nullif(n_words, 0), 0), {TOP}) AS repeats,
         least(coalesce(100 * n_dup_lines // nullif(n_lines, 0), 0), {TOP}) AS lines,
         least(coalesce(10 * word_chars // nullif(n_words, 0), 0), {TOP}) AS length FROM feats),
good AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
judged AS (SELECT stratum, good, rule, value
           FROM (UNPIVOT (SELECT stratum, good, symbols, repeats, lines, length
                          FROM rules JOIN good USING (doc_id) WHERE NOT base_failed)
                 ON symbols, repeats, lines, length INTO NAME rule VALUE value)),
counts AS (SELECT stratum, rule, value, sum((good = 1)::INT) AS g, sum((good <> 1)::INT) AS b FROM judged GROUP BY ALL),
cum AS (SELECT stratum, rule, value, sum(g) OVER up AS g_out, sum(b) OVER up AS b_out, sum(g) OVER al AS g_all, sum(b) OVER al AS b_all
        FROM counts WINDOW up AS (PARTITION BY stratum, rule ORDER BY value DESC ROWS UNBOUNDED PRECEDING),
                           al AS (PARTITION BY stratum, rule)),
strata AS (SELECT greatest(count(*), 1) AS s FROM (SELECT DISTINCT stratum FROM counts)),
tail AS (SELECT stratum, rule, value, sum(exp(coalesce(lgamma(g_all + 1) - lgamma(j + 1) - lgamma(g_all - j + 1), 0)
                  + j * ln({MAX_FALSE_REJECTIONS / 4}) + (g_all - j) * ln(1 - {MAX_FALSE_REJECTIONS / 4}))) AS p
         FROM cum, LATERAL (SELECT unnest(range(0, g_out::BIGINT + 1)) AS j) WHERE value > 0 AND g_all > 0 GROUP BY ALL),
oks AS (SELECT cum.*, min((coalesce(p, 1) <= {RISK} / (4 * s))::INT) OVER (PARTITION BY cum.stratum, cum.rule ORDER BY cum.value DESC ROWS UNBOUNDED PRECEDING) AS ok
        FROM cum LEFT JOIN tail ON cum.rule = tail.rule AND cum.value = tail.value AND cum.stratum IS NOT DISTINCT FROM tail.stratum, strata
        WHERE cum.value > 0),
best AS (SELECT stratum, rule, arg_max(value, (b_out * g_all - {COST} * g_out * b_all, value)) AS cutoff
         FROM oks WHERE ok = 1 AND b_out * g_all - {COST} * g_out * b_all > 0 GROUP BY ALL),
bad AS (SELECT rules.doc_id, rules.stratum, bool_or(CASE rule WHEN 'symbols' THEN symbols WHEN 'repeats' THEN repeats
                                        WHEN 'lines' THEN lines ELSE length END >= cutoff) AS rejected
        FROM rules JOIN best ON rules.stratum IS NOT DISTINCT FROM best.stratum GROUP BY ALL)
SELECT rules.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM rules LEFT JOIN bad ON rules.doc_id = bad.doc_id AND rules.stratum IS NOT DISTINCT FROM bad.stratum
"""


def secrets_sql() -> str:
    from tastelake.llm.secrets import BASE, RULES

    parts = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT r, '{r.kind}' AS kind, {rank} AS rank,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n
  FROM (SELECT r, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}', 0) AS m,
               regexp_extract_all(text, '{pattern}', {r.group}) AS g FROM docs WHERE regexp_matches(text, '{pattern}')),
       LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) WHERE length(g[i]) >= {r.least}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
named AS (SELECT *, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS s FROM spans),
found AS (SELECT r, {counts}, coalesce(string_agg(s, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}), '') AS base,
                 string_agg(s, ',' ORDER BY a, rank) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN found USING (r)
"""


NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
                     list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '{NO_WORD}'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '{NO_WORD}'), lambda x: x <> '') AS w
          FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS win
         FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT r, n, i, w[i:i + n - 1] AS win FROM docs, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hits AS (SELECT r, places.n, i, item_id FROM places JOIN wins ON places.n = wins.n AND places.win = wins.win),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, n, i FROM hits), range(10) AS t(k) WHERE k < n GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
          FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

NEAR = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) WHERE len(w) > 2
          UNION ALL SELECT r, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
named AS (SELECT r, hash(g) % 9223372036854775783 AS g FROM grams),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM named x JOIN named y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes s ON s.r = a JOIN sizes t ON t.r = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN least ON least.a = docs.r LEFT JOIN sizes USING (r)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
led AS (SELECT *, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM led
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place
        FROM s WHERE same QUALIFY place <= 5)
SELECT pos.anchor_id, positive_id, (row_number() OVER near)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW near AS (PARTITION BY pos.anchor_id, place ORDER BY score DESC, id)
QUALIFY row_number() OVER near <= 10
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
RANKED_SEARCH = f"""
WITH d AS (SELECT r, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
q AS (SELECT i, item_id, term, count(*) AS times
      FROM (SELECT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
gain AS (SELECT r, doc_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words)))) AS gain
         FROM tf JOIN df USING (term), total),
scores AS (SELECT i, item_id, r, doc_id, sum(times * gain)::BIGINT AS score FROM q JOIN gain USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) QUALIFY row_number() OVER best <= 20
"""
