"""Ordered computations that never put one whole key into one task.

A plain window partitioned by user or item sorts all rows of that key in a single task, and one key may own a third of
the table. The helpers here work on two levels: rows are cut into *chunks* (for time: a day or an hour; for values: a
narrow value range), each chunk is ordered on its own, and what one chunk hands to the next travels through a small
per-chunk aggregate. The window over chunks holds one row per chunk, the window over rows one chunk.

``chunk`` must be a column that never decreases along ``order``. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastelake.session import stored

_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Best ``n`` rows per key. Spark limits each group before the shuffle, so a hot key sends n rows per task."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).filter(F.col(rank) <= n)


def running_total(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], amount: Column, out: str
) -> DataFrame:
    """Inclusive running sum of ``amount`` per key in the given order."""
    sized = df.withColumn("_amount", amount)
    per_chunk = sized.groupBy(*keys, chunk).agg(F.sum("_amount").alias("_chunk_sum"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(*_BEFORE)
    offsets = per_chunk.select(
        *keys, chunk, F.coalesce(F.sum("_chunk_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(*_UPTO)
    return (
        sized.join(offsets, [*keys, chunk])
        .withColumn(out, F.col("_offset") + F.sum("_amount").over(inside))
        .drop("_amount", "_offset")
    )


def position(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], out: str) -> DataFrame:
    """Row number per key, counted over chunks."""
    return running_total(df, keys, chunk, order, F.lit(1).cast("bigint"), out)


def previous(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], columns: Mapping[str, str]
) -> DataFrame:
    """``lag`` of several columns (source -> output name) per key, also across chunk borders."""
    packed = df.withColumn("_now", F.struct(*columns)).withColumn("_at", F.struct(*order))
    last = packed.groupBy(*keys, chunk).agg(F.max_by("_now", "_at").alias("_last"))
    chunks = Window.partitionBy(*keys).orderBy(chunk)
    carried = last.select(*keys, chunk, F.lag("_last").over(chunks).alias("_carry"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    joined = packed.join(carried, [*keys, chunk]).withColumn(
        "_prev", F.coalesce(F.lag("_now").over(inside), F.col("_carry"))
    )
    return joined.select(*df.columns, *[F.col("_prev")[src].alias(out) for src, out in columns.items()])


def following(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], columns: Mapping[str, str]
) -> DataFrame:
    """``lead`` of several columns per key, also across chunk borders."""
    packed = df.withColumn("_now", F.struct(*columns)).withColumn("_at", F.struct(*order))
    first = packed.groupBy(*keys, chunk).agg(F.min_by("_now", "_at").alias("_first"))
    chunks = Window.partitionBy(*keys).orderBy(chunk)
    carried = first.select(*keys, chunk, F.lead("_first").over(chunks).alias("_carry"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    joined = packed.join(carried, [*keys, chunk]).withColumn(
        "_next", F.coalesce(F.lead("_now").over(inside), F.col("_carry"))
    )
    return joined.select(*df.columns, *[F.col("_next")[src].alias(out) for src, out in columns.items()])


def carry_forward(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row, per key."""
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    last = df.withColumn("_at", at).groupBy(*keys, chunk).agg(F.max_by(value, "_at").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(*_BEFORE)
    carried = last.select(*keys, chunk, F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(*_UPTO)
    return (
        df.join(carried, [*keys, chunk])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_carry")
    )


def ranged(df: DataFrame, order: Sequence[Column], label: str = "ranges") -> DataFrame:
    """The rows, stored, with ``_range``: consecutive numbers of ranges of ``order`` with about equally many rows.

    Spark draws the splitters from a sample, so ranges follow the data, wherever its values lie, and there are as many as shuffle
    partitions. Rows equal in ``order`` share a range: hand in distinct rows. The last step of ``df`` runs twice, once for the sample.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), label)


def range_starts(placed: DataFrame, amount: Column | None = None) -> DataFrame:
    """_range and the number of rows (or the sum of ``amount``) in all ranges before it: a window over one row a range."""
    total = F.count(F.lit(1)) if amount is None else F.sum(amount)
    sizes = placed.groupBy("_range").agg(total.alias("_n"))
    before = Window.orderBy("_range").rowsBetween(*_BEFORE)
    return sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Value table per key: (keys, value, n, before), where ``before`` is the weight of all smaller values.

    Rows are counted per value before anything is ordered; the table of values is then stored in ranges from sampled splitters, which
    are ordered one by one.
    """
    amount = F.sum(weight) if weight is not None else F.count(F.lit(1))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("n"))
    placed = ranged(counted, [F.col(c) for c in (*keys, value)], "values")
    summed = running_total(placed, keys, "_range", [F.col(value)], F.col("n"), "_upto")
    return summed.select(*keys, value, "n", (F.col("_upto") - F.col("n")).alias("before"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per key (one output column per entry of ``probs``), exact and spread out."""
    ranks = value_ranks(df, value, keys, weight)
    totals = ranks.groupBy(*keys).agg(F.sum("n").alias("_total"))
    if keys:
        placed = ranks.join(totals, list(keys))
    else:
        placed = ranks.withColumn("_total", totals.scalar())
    found = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        for side, index in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
            found.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
    picked = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *found)
    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return picked.select(*keys, *out)


def one_row(df: DataFrame) -> Column:
    """The single row of a global aggregate as a struct column, usable in any expression of another frame."""
    return df.select(F.struct(*df.columns)).scalar()


def quantile_codebook(df: DataFrame, value: str, steps: int = 256) -> Column:
    """Array of ``steps`` evenly spaced exact quantiles (0 to 1) as a scalar column."""
    ranks = value_ranks(df, value)
    total = ranks.agg(F.sum("n").alias("total")).scalar()
    placed = ranks.withColumn("_last", total - 1)
    ratio = (F.lit(steps - 1) / F.greatest(F.col("_last"), F.lit(1))).cast("double")
    low = F.greatest(F.floor(F.col("before") * ratio) - 1, F.lit(0))
    high = F.least(F.ceil((F.col("before") + F.col("n")) * ratio) + 1, F.lit(steps - 1))
    tried = placed.withColumn("k", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    spot = F.col("k") / F.lit(float(steps - 1)) * F.col("_last")
    end = F.col("before") + F.col("n")
    v = F.col(value).cast("double")
    lower = F.when((F.col("before") <= F.floor(spot)) & (F.floor(spot) < end), v)
    upper = F.when((F.col("before") <= F.ceil(spot)) & (F.ceil(spot) < end), v)
    points = tried.groupBy("k").agg(F.max(lower).alias("lo"), F.max(upper).alias("hi"), F.max(spot - F.floor(spot)).alias("part"))
    quantile = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    entries = F.array_sort(F.collect_list(F.struct("k", quantile.alias("q"))))
    return points.agg(F.transform(entries, lambda e: e["q"]).alias("codebook")).scalar()
