"""Catalogue search, filters and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.functions.scalar import NO_GENRE, any_of, contains_text, split_values


def by_genre(items: DataFrame, genre: str) -> DataFrame:
    return items.filter(F.array_contains(split_values("genres"), genre))


def search(
    items: DataFrame,
    text: str,
    genre: str | None = None,
    year_from: int | None = None,
    year_to: int | None = None,
    min_vote: float | None = None,
) -> DataFrame:
    """Literal text in title, genres or overview, and the optional filters; 0 or None switches a filter off."""
    hits = items.filter(any_of([F.coalesce(contains_text(c, text), F.lit(False)) for c in ("title", "genres", "overview")]))
    if genre:
        hits = by_genre(hits, genre)
    if year_from:
        hits = hits.filter((F.col("year") != 0) & (F.col("year") >= year_from))
    if year_to:
        hits = hits.filter((F.col("year") != 0) & (F.col("year") <= year_to))
    if min_vote:
        hits = hits.filter(F.col("vote_average") >= min_vote)
    return hits


def page(df: DataFrame, order: str, number: int = 1, size: int = 20) -> DataFrame:
    """One page with the totals of the whole result on every row."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows = df.orderBy(order).offset((number - 1) * size).limit(size)
    return rows.select(
        "*",
        total.alias("total"),
        F.lit(number).alias("page"),
        F.ceil(total / F.lit(float(size))).cast("bigint").alias("total_pages"),
    )


def genres(items: DataFrame) -> DataFrame:
    """Sorted distinct genres."""
    exploded = items.filter(F.col("genres") != NO_GENRE).select(F.explode(split_values("genres")).alias("genre"))
    return exploded.distinct().orderBy("genre")
