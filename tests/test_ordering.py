"""Two-level ordered helpers against plain windows, with one key that owns most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tastelake.operators import ordering as o


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(1 if rng.random() < 0.7 else rng.randint(2, 9), i, rng.randint(0, 40), rng.choice([None, 1.5, 2.5, -3.0, 7.25])) for i in range(600)]
    return spark.createDataFrame(data, "k int, id int, t int, v double").withColumn("chunk", F.floor(F.col("t") / 5))


def order():
    return [F.col("t"), F.col("id")]


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_position_and_running_total(rows):
    w = Window.partitionBy("k").orderBy(*order())
    same(o.position(rows, ["k"], "chunk", order(), "p").select("id", "p"), rows.select("id", F.row_number().over(w).cast("bigint").alias("p")))
    total = F.coalesce("v", F.lit(0.0))
    same(
        o.running_total(rows, ["k"], "chunk", order(), total, "s").select("id", F.round("s", 6)),
        rows.select("id", F.round(F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)),
    )


def test_neighbouring_rows(rows):
    w = Window.partitionBy("k").orderBy(*order())
    same(o.previous(rows, ["k"], "chunk", order(), {"id": "x"}).select("id", "x"), rows.select("id", F.lag("id").over(w)))
    same(o.following(rows, ["k"], "chunk", order(), {"id": "x"}).select("id", "x"), rows.select("id", F.lead("id").over(w)))


def test_carry_forward(rows):
    w = Window.partitionBy("k").orderBy(*order()).rowsBetween(Window.unboundedPreceding, 0)
    same(o.carry_forward(rows, ["k"], "chunk", order(), "v", "x").select("id", "x"), rows.select("id", F.last("v", ignorenulls=True).over(w)))


def test_quantiles(rows):
    got = {r["k"]: (r["a"], r["b"]) for r in o.exact_quantiles(rows, "v", {"a": 0.25, "b": 0.9}, ["k"]).collect()}
    by_key = {}
    for r in rows.filter("v is not null").collect():
        by_key.setdefault(r["k"], []).append(r["v"])
    for k, values in by_key.items():
        assert got[k] == pytest.approx(tuple(np.quantile(values, [0.25, 0.9])))


def test_ranges_follow_the_data(spark):
    """A month of epoch seconds, which is a sliver of all values, fills every range; ranges never overlap."""
    start = 1_700_000_000
    df = spark.range(20_000).select((F.lit(start) + F.pmod(F.col("id") * 7919, F.lit(2_592_000))).alias("ts")).distinct()
    placed = o.ranged(df, [F.col("ts")])
    spans = [(r["lo"], r["hi"], r["n"]) for r in placed.groupBy("_range").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).orderBy("_range").collect()]
    assert len(spans) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and max(s[2] for s in spans) < 3 * 20_000 / len(spans)
    starts = [r["_start"] for r in o.range_starts(placed).orderBy("_range").collect()]
    assert starts == [sum(s[2] for s in spans[:i]) for i in range(len(spans))]


def test_ranks_of_values_of_every_kind(spark):
    values = [-1e9, -5.5, -1.0, -1e-3, 0.0, 1e-9, 0.5, 1.0, 1.001, 7.0, 1e12, 7.0, -5.5]
    got = {r["v"]: (r["n"], r["before"]) for r in o.value_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    assert got == {v: (values.count(v), sum(x < v for x in values)) for v in values}


def test_top_n_is_limited_before_the_shuffle(rows):
    plan = o.top_n(rows, ["k"], order(), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_codebook(spark):
    values = np.random.default_rng(3).normal(size=700)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    book = spark.range(1).select(o.quantile_codebook(df, "v").alias("b")).first()["b"]
    assert np.allclose(book, np.quantile(values, np.arange(256) / 255))


def test_a_day_with_a_third_of_all_rows_is_split(spark):
    """One user's one day holds a third of the events: no chunk of it does, and sessions are those of a plain pass."""
    from tastelake.operators import metrics

    day = 86_400
    r = random.Random(8)
    rows = [(i, 1, r.randint(0, day - 1)) for i in range(3000)] + [(3000 + i, r.randint(2, 60), r.randint(0, 20 * day)) for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, s bigint")
    df = df.select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), F.lit(1).cast("bigint").alias("item_id"))
    placed = o.ranged(df, [F.col("user_id"), F.col("ts"), F.col("event_id")])
    largest = placed.groupBy("user_id", "_range").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * len(rows) / int(spark.conf.get("spark.sql.shuffle.partitions"))
    want, before = [], {}
    for e, u, s in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        if u not in before or s - before[u] > 1800:
            want.append([0, s, s])
        before[u] = s
        want[-1] = [want[-1][0] + 1, want[-1][1], s]
    got = sorted((x["n_events"], x["duration_seconds"]) for x in metrics.sessions(df).collect())
    assert got == sorted((n, b - a) for n, a, b in want)
