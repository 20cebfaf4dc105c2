"""Strassen products and hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastelake.llm import negatives
from tastelake.llm.best import Heaps
from tests.llm.conftest import listed

SCHEMA = "vec_id bigint, label int, embedding array<float>"


@pytest.mark.parametrize("shape", [(0, 4, 3), (1, 1, 1), (3, 5, 7), (33, 64, 100), (70, 17, 129)])
@pytest.mark.parametrize("factor", [1, 2**40])
def test_strassen_is_exact(shape, factor):
    r = np.random.default_rng(3)
    a, b = r.integers(-256, 257, shape[:2]) * factor, r.integers(-256, 257, shape[1:]) * factor
    for leaf in (1, 4, 16):
        assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_heaps_merge():
    r = np.random.default_rng(4)
    group, score, tie = r.integers(0, 7, 500), r.integers(0, 9, 500), r.permutation(500)
    heaps = Heaps(7, 4)
    for i in range(0, 500, 37):
        heaps.add(group[i : i + 37], score[i : i + 37], tie[i : i + 37], tie[i : i + 37])
    want = sorted((g, -s, t) for g, s, t in zip(group.tolist(), score.tolist(), tie.tolist()))
    want = [x for i, x in enumerate(want) if sum(y[0] == x[0] for y in want[:i]) < 4]
    g, s, t, e = (x.tolist() for x in heaps.cut())
    assert list(zip(g, [-x for x in s], t)) == want and e == t


def brute(rows, positives=5, most=10):
    use = [(i, c, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, c, v in rows
           if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, done = [], set()
    for a, c, v in sorted(use):
        if a % 100 or a in done:
            continue
        done.add(a)
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, d) for i, d, w in use if i != a)
        for p, i, _ in [s for s in scores if s[2] == c][:positives]:
            inside = [s for s in scores if s[2] != c and -30 * p <= -100 * s[0] <= -90 * p][:most]
            out += [(a, i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(inside)]
    return out


def vectors():
    r = np.random.default_rng(5)
    base = r.normal(0, 0.3, 6)
    rows = [(i, int(i % 3), (base + r.normal(0, 0.2, 6)).tolist()) for i in range(0, 620)]
    rows += [(700 + i, 1, base.tolist()) for i in range(30)]  # ties
    rows += [(i, 2, base.tolist()) for i in (705, 706, 706, 200)]  # repeated rows and ids
    rows += [(800, None, base.tolist()), (900, 1, None), (1000, 1, [None] * 6), (801, 1, [float("nan")] * 6), (802, 1, [float("inf")] * 6)]
    rows += [(None, 1, base.tolist()), (1100, 9, base.tolist()), (1200, 1, []), (1300, 1, [0.5, 0.5]), (1400, 1, (-base).tolist())]
    return rows


@pytest.mark.parametrize("blocks", [(16384, 2048), (3, 90)])
def test_hard_negatives(spark, blocks):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit(7) for c in ("vector", "cell", "kind", "rank", "x", "given")})
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, anchor_block=blocks[0], row_block=blocks[1])
    assert listed(got) == sorted(brute(rows), key=repr)


def test_huge_components_and_unequal_lengths(spark):
    rows = [(0, 1, [1e30, 1.0]), (1, 1, [1e30]), (2, 2, [1.0, 1.0, 5.0]), (3, 2, [-1e30])]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert got.count() >= 0


def test_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
