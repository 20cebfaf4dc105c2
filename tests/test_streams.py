"""Streams: several micro-batches, late rows, duplicates, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tastelake.session import work_path
from tastelake.streaming import jobs

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, interaction_type string, intensity double, item_id bigint"


def at(minute, day=1):
    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute)


@pytest.fixture()
def feed(spark):
    """Folder that files can be added to, and a stream over it, one file per micro-batch."""
    path = work_path(spark, "feed")

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)

    return add, stream


def test_late_rows_are_dropped(spark, feed):
    add, stream = feed
    path, state = work_path(spark, "late"), work_path(spark, "late-state")

    def run():
        jobs.deliver(jobs.window_scores(stream(), "1 hour", lateness="1 hour"), "update", path, state)

    add([(1, at(0), 1, "view", 1.0, 5)])
    run()
    add([(2, at(600), 1, "view", 1.0, 5)])
    run()
    add([(3, at(10), 1, "view", 1.0, 5), (4, at(610), 1, "view", 1.0, 5)])  # the first one is ten hours late
    run()
    rows = jobs.latest(spark.read.option("basePath", path).parquet(path), ["window_start", "item_id"])
    assert sorted(r["n"] for r in rows.collect()) == [1, 2]


def test_duplicates_across_batches(spark, feed):
    add, stream = feed
    path, state = work_path(spark, "dup"), work_path(spark, "dup-state")
    for rows in ([(1, at(0), 1, "view", 1.0, 5)], [(1, at(0), 1, "view", 1.0, 5), (2, at(1), 1, "view", 1.0, 5)]):
        add(rows)
        jobs.deliver(jobs.without_duplicates(stream()), "append", path, state)
    assert spark.read.option("basePath", path).parquet(path).count() == 2


def test_session_boundary_is_inclusive(spark, feed):
    add, stream = feed
    add([(1, at(0), 1, "view", 1.0, 5), (2, at(30), 1, "view", 1.0, 5), (3, at(61), 1, "view", 1.0, 5), (9, at(0, 9), 2, "view", 1.0, 5)])
    rows = jobs.delivered(spark, jobs.sessions(stream()), "append", "bound").filter("user_id = 1").collect()
    assert sorted(r["n_events"] for r in rows) == [1, 2]


def test_upsert_over_batches(spark, feed):
    add, stream = feed
    path, state = work_path(spark, "ups"), work_path(spark, "ups-state")
    for rows in ([(1, at(0), 1, "rate", 3.0, 5)], [(2, at(5), 1, "rate", 4.0, 5), (3, at(6), 1, "rate", 4.5, 5), (4, at(7), 2, "rate", 1.0, 5)]):
        add(rows)
        rated = stream().select("user_id", "item_id", F.col("intensity").alias("rating"), "ts", F.struct("ts", "event_id").alias("seq"))
        jobs.deliver(rated, "append", path, state, jobs.rating_deltas)
    merged = jobs.merged_ratings(spark.read.option("basePath", path).parquet(path)).collect()
    assert sorted((r["user_id"], r["rating"], r["ts"]) for r in merged) == [(1, 4.5, at(0)), (2, 1.0, at(7))]


def test_idle_profile_is_closed(spark, feed):
    add, stream = feed
    path, state = work_path(spark, "idle"), work_path(spark, "idle-state")
    for rows in ([(1, at(0), 1, "view", 1.0, 5)], [(2, at(0, 20), 2, "view", 1.0, 5)], [(3, at(0, 21), 2, "view", 1.0, 5)]):
        add(rows)
        jobs.deliver(jobs.expiring_profiles(stream(), "7 days"), "update", path, state)
    rows = spark.read.option("basePath", path).parquet(path)
    assert [r["user_id"] for r in rows.filter("closed").select("user_id").distinct().collect()] == [1]
