"""Streaming forms of the event operators.

Each function maps a streaming frame (event_id, ts, user_id, interaction_type, intensity, item_id) to another one;
``deliver`` runs it. State is bounded by watermarks wherever the operator allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tastelake.session import work_path
from tastelake.sources.tables import split_valid


def deliver(stream: DataFrame, mode: str, path: str, checkpoint: str, write: Callable | None = None):
    """Process all available input, then stop. A batch writes its own folder and overwrites it when it is replayed
    after a failure, so every input row counts exactly once."""

    def store(batch: DataFrame, batch_id: int) -> None:
        if write is not None:
            batch = write(batch)
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    run.awaitTermination()
    return run


def delivered(spark: SparkSession, stream: DataFrame, mode: str, label: str, write: Callable | None = None) -> DataFrame:
    """Rows a stream has delivered, with the ``batch_id`` that wrote them."""
    path = work_path(spark, label)
    deliver(stream, mode, path, work_path(spark, f"{label}-state"), write)
    return spark.read.option("basePath", path).parquet(path)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last version of every key of an update-mode output."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v"))
    return newest.select(*keys, *[F.col("_v")[c].alias(c) for c in rest])


def ingest_step(rules: Mapping[str, Column]) -> Callable[[DataFrame], DataFrame]:
    """Batch step that splits rows into good and quarantined ones."""

    def step(batch: DataFrame) -> DataFrame:
        good, bad = split_valid(batch, rules)
        return good.withColumn("broken_rules", F.array().cast("array<string>")).unionByName(bad)

    return step


def without_duplicates(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def window_scores(events: DataFrame, window: str, slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Count and mean intensity per window and item, with the trending score."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = events.withWatermark("ts", lateness).groupBy(span.alias("w"), "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("total")
    )
    return counts.select(F.unix_timestamp("w.start").alias("window_start"), "item_id", "n", "total")


def rates(events: DataFrame, window: str = "1 hour", slide: str = "5 minutes", lateness: str = "1 day") -> DataFrame:
    counts = events.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.unix_timestamp("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions per user; a session is given out once the watermark has passed its end."""
    counts = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n_events")
    )
    return counts.select(
        "user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n_events"
    )


def all_sessions(spark: SparkSession, events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of one run over all available input: the closed ones as delivered, and, with ``is_open``, those that the watermark
    has not passed yet, which are read from the state that the run has left."""
    path, state = work_path(spark, "sessions"), work_path(spark, "sessions-state")
    deliver(sessions(events, gap, lateness), "append", path, state)
    schema = "user_id bigint, start_us bigint, end_us bigint, n_events bigint"
    closed = spark.read.schema(schema).option("basePath", path).parquet(path).select("*", F.lit(False).alias("is_open"))
    waiting = spark.read.format("statestore").load(state).select(
        "value.user_id",
        F.unix_micros("value.session_window.start").alias("start_us"),
        F.unix_micros("value.session_window.end").alias("end_us"),
        F.col("value.count").alias("n_events"),
        F.lit(True).alias("is_open"),
    )
    return closed.select(*waiting.columns).unionByName(waiting)


def enriched(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events with the genres of their item; the static side may be broadcast if Spark finds it small."""
    return events.join(items.select("item_id", "genres"), "item_id")


def attributed_clicks(views: DataFrame, clicks: DataFrame, within: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Clicks on an item at most ``within`` after the same user saw it; both sides drop state behind the watermark."""
    left = views.select(
        F.col("event_id").alias("view_id"), F.col("user_id").alias("v_user"), F.col("item_id").alias("v_item"), F.col("ts").alias("view_ts")
    ).withWatermark("view_ts", lateness)
    right = clicks.select(F.col("event_id").alias("click_id"), "user_id", "item_id", F.col("ts").alias("click_ts")).withWatermark("click_ts", lateness)
    match = F.expr(
        f"v_user = user_id AND v_item = item_id AND click_ts >= view_ts AND click_ts <= view_ts + interval {within}"
    )
    return left.join(right, match).select("view_id", "click_id", "user_id", "item_id")


def running_profiles(events: DataFrame) -> DataFrame:
    """Counts and last activity per user so far. Partial sums are built before the shuffle, so a hot user is no hot task."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("interaction_type") == "purchase").alias("n_purchases"),
        F.unix_timestamp(F.max("ts")).alias("last_seen"),
    )


def running_genre_weights(events: DataFrame, items: DataFrame) -> DataFrame:
    """Summed intensity per user and genre of the items so far: one row of state per pair, with partial sums before the shuffle."""
    each = enriched(events, items).select("user_id", F.explode(F.split("genres", r"\|")).alias("genre"), "intensity")
    return each.groupBy("user_id", "genre").agg(F.sum("intensity").alias("weight"))


def split_late(stream: DataFrame, path: str, checkpoint: str, window: str, lateness: str) -> None:
    """Processes all available input and writes, per batch, the rows that a windowed aggregation with this ``lateness`` leaves out.

    Such a row's window ends at or before the watermark, which is the latest time of all earlier batches less ``lateness``. Each batch leaves its latest
    time as a mark of one row, so the marks of earlier batches give the watermark also after a restart or a replay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        top = None
        if batch_id:
            earlier = spark.read.schema("top timestamp, batch_id bigint").option("basePath", f"{path}/marks").parquet(f"{path}/marks")
            top = earlier.filter(F.col("batch_id") < batch_id).agg(F.max("top")).first()[0]
        batch.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")
        late = F.lit(False) if top is None else F.window("ts", window)["end"] <= F.lit(top) - F.expr(f"interval {lateness}")
        spans = batch.select("*", F.window("ts", window)["start"].alias("window_start"))
        spans.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")

    run = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()


def expiring_profiles(events: DataFrame, idle: str = "7 days", lateness: str = "1 day") -> DataFrame:
    """Per-user activity that is closed and forgotten after a period without events (event time).

    Needs a timer per user, which built-in aggregates lack; ``running_profiles`` is the form without expiry.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "last_seen": [last], "closed": [True]})
            return
        n, last = state.get if state.exists else (0, 0)
        for frame in frames:
            n += len(frame)
            last = max(last, int(frame["at"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last * 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "last_seen": [last], "closed": [False]})

    rows = events.withWatermark("ts", lateness).select("user_id", "ts", F.unix_timestamp("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(
        advance,
        "user_id bigint, n_events bigint, last_seen bigint, closed boolean",
        "n bigint, last bigint",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def rating_deltas(batch: DataFrame) -> DataFrame:
    """One delta row per (user, item) of a micro-batch: last rating and first time inside the batch."""
    return batch.groupBy("user_id", "item_id").agg(
        F.max_by("rating", "seq").alias("rating"),
        F.max("seq").alias("last_seq"),
        F.min_by("ts", "seq").alias("ts"),
        F.min("seq").alias("first_seq"),
    )


def merged_ratings(deltas: DataFrame) -> DataFrame:
    """Table state from stored deltas: last rating, first time. Deltas are only appended; a batch never rewrites the table."""
    return deltas.groupBy("user_id", "item_id").agg(
        F.max_by("rating", "last_seq").alias("rating"), F.min_by("ts", "first_seq").alias("ts")
    )


def error_windows(requests: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Requests and errors per window, for threshold alerts on the delivered rows."""
    errors, n = F.count_if("is_error"), F.count(F.lit(1))
    shares = requests.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w")).agg(n.alias("n"), errors.alias("errors"))
    return shares.select(F.unix_timestamp("w.start").alias("window_start"), "n", "errors")
