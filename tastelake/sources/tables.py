"""Batch table maintenance: inserts without duplicates, upserts, validated appends, log rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """First row per key by ``seq``. An aggregate, so duplicates shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != seq]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_row"))
    return first.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def insert_new(target: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Rows of a batch to append: first per key, keys the target already has are skipped."""
    return keep_first(batch, keys, seq).join(target.select(*keys), list(keys), "left_anti")


def upsert_ratings(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Merge (user_id, item_id, rating, ts, seq): the last rating wins, the first time stays."""
    return (
        base.unionByName(delta)
        .groupBy("user_id", "item_id")
        .agg(F.max_by("rating", "seq").alias("rating"), F.min_by("ts", "seq").alias("ts"), F.max("seq").alias("seq"))
    )


def append_interactions(df: DataFrame) -> DataFrame:
    """Rows fit for the interaction table: required fields present, intensity 1.0 by default."""
    required = F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & (F.col("interaction_type") != "")
    return df.filter(required).withColumn("intensity", F.coalesce("intensity", F.lit(1.0)))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) by named rules; quarantine rows carry the names of the broken rules."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    marked = df.withColumn("broken_rules", broken)
    good = marked.filter(F.size("broken_rules") == 0).drop("broken_rules")
    return good, marked.filter(F.size("broken_rules") > 0)


def log_rows(ranked: DataFrame, algorithm: str, latency_ms: Column | None = None) -> DataFrame:
    """One log row per user: recommended ids in rank order as JSON text. Lists are top-n lists, hence short."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    ids = F.transform(entries, lambda e: e["item_id"])
    return ranked.groupBy("user_id").agg(F.to_json(ids).alias("recommended_ids")).select(
        "user_id",
        F.lit(algorithm).alias("algorithm"),
        "recommended_ids",
        (latency_ms if latency_ms is not None else F.lit(None).cast("double")).alias("latency_ms"),
    )


def explode_log(log: DataFrame) -> DataFrame:
    """Log rows back to (.., rank, item_id)."""
    ids = F.from_json("recommended_ids", "array<bigint>")
    kept = [c for c in log.columns if c != "recommended_ids"]
    return log.select(*kept, F.posexplode(ids).alias("pos", "item_id")).withColumn("rank", F.col("pos") + 1).drop("pos")
