"""Ranked search against a direct computation."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tastelake.llm import search
from tests.llm.conftest import listed

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, q in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(rows):
    some = [t for _, t, *_ in rows if t]
    texts = [" ".join(some[0].split()[:12]), " ".join(some[9].split()[5:40]), "one ONE one", "unknown", "", None, "ab  abé x", some[-1], "one ONE one"]
    return [(i if i != 3 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("group_bytes", [search.GROUP_BYTES, 100])
def test_ranked(spark, docs, rows, items, group_bytes):
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit(7) for c in ("place", "rank", "score", "doc_id")})
    got = search.ranked(docs, table, group_bytes=group_bytes)
    assert listed(got) == brute([r[:2] for r in rows], items)


def test_copies_are_one_class_with_all_members(spark, items):
    """More copies than ranks, ties in descending arrival, and null ids last."""
    rows = [(1000 - i, "one two") for i in range(50)] + [(None, "one two"), (5, "one two three"), (6, None)] + [(2000, "two two")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert listed(search.ranked(docs, table)) == brute(rows, items)
    assert listed(search.ranked(docs, table, k=3)) == brute(rows, items, 3)


def test_long_texts_are_cut_between_terms(spark):
    text = " ".join(f"w{i % 977}é" for i in range(400_000))
    assert len(text) > 2 * search.PIECE
    assert [t for part in search.terms_of(text) for t in part] == terms(text)
    docs = [(1, text), (2, "w1é w2é"), (3, "x" * 2_500_000)]
    items = [(0, "w1é w976é"), (1, "x" * 2_500_000)]
    got = search.ranked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert listed(got) == brute(docs, items)


def test_empty(spark, docs, nothing):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert search.ranked(nothing, items).count() == 0
    assert search.ranked(docs, items.limit(0)).count() == 0
