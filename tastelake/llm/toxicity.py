"""Toxicity scores from two class-conditional Kneser-Ney models of the spelling of words.

Both classes predict the bytes of each word from the four bytes before it (padded at the start). The top order has counts per class; all lower
orders are continuation counts that both classes share, so a rare expression gets the same backoff probability from both
and its ratio tells only what the top order knows. Counts come from all labelled rows that may be learned from (folds 1 to 4), summed by Spark. The log ratio of
a byte in its context has an entry of its own for each gram, and that of a byte which neither class has seen one for each context, so the model
grows with the different grams of the labelled rows. Up to ``BROADCAST_GRAMS`` entries of 12 bytes it travels to the tasks; a larger one stays
a table: the different words of all texts are spelled once, joined with it by gram and context, and their ratios joined back to the rows by word.

A document is described by the length-normalised log ratio of the whole text and by the log ratios of its two most toxic
words, raw and per byte. A logistic curve over these is fitted on fold 1 (at most ``FIT_ROWS`` rows) with a model of the counts of folds 2 to 4; the curve
over the features by the model of all counts gives the score.

Null texts are empty. Empty texts have no evidence and get the curve's value there. Without labels of both classes every text
gets the smoothed share of toxic labels. Repeated rows score alike; a doc_id with several labels counts as toxic if any says so. A null
doc_id is held out (its text form is empty). An empty table gives an empty result. Labels, language, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastelake.llm.common import bytes_of, offsets_of, slices, small_batches, spread, words
from tastelake.session import stored

ORDER, DISCOUNT = 5, 0.75
#: Rows for fitting the curve; more labels are sampled by hash.
FIT_ROWS = 50_000
#: Labels that may travel to every task; with more, they are joined by key.
BROADCAST_LABELS = 1_000_000
#: Entries of a model (12 bytes each) that may travel to the driver and every task; a larger model is joined by key.
BROADCAST_GRAMS = 4_000_000
START, END = 2, 3
FEATURES = ("mean", "first", "second", "dense")


def fold() -> Column:
    """crc32 of the doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def spelled(unique: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ORDER-byte numbers of all places of the padded words, their word, and the bytes of each word (its end included)."""
    data, bounds = bytes_of(unique)
    size = np.diff(bounds)
    pad = ORDER - 1
    full = size + pad + 1
    starts = np.cumsum(full) - full
    text = np.full(int(full.sum()), START, np.int64)
    text[spread(starts + pad, size)] = data
    text[starts + pad + size] = END
    grams = np.zeros(max(len(text) - pad, 0), np.int64)
    for k in range(ORDER):
        grams = grams << 8 | text[k : k + len(grams)]
    at = spread(starts, size + 1)
    return grams[at], np.repeat(np.arange(len(size)), size + 1), size + 1


def coded(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of a slice, the word number of every place, and the document bounds."""
    col = part.column("w")
    bounds = offsets_of(col).astype(np.int64)
    found = col.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), bounds - bounds[0]


def gram_counts(docs: DataFrame) -> DataFrame:
    """first, g, c1, c0: places of each gram in toxic and ordinary rows. docs: w, toxic, first (of fold 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "w"):
            unique, index, bounds = coded(part)
            if not len(index):
                continue
            toxic = np.repeat(part.column("toxic").to_numpy() == 1, np.diff(bounds))
            first = np.repeat(part.column("first").to_numpy(zero_copy_only=False), np.diff(bounds))
            grams, word, _ = spelled(unique)
            g, where = np.unique(grams, return_inverse=True)
            for own in (True, False):
                counts = [np.bincount(index[(first == own) & (toxic == y)], minlength=len(unique)) for y in (True, False)]
                sums = [np.bincount(where, weights=c[word]).astype(np.int64) for c in counts]
                seen = sums[0] + sums[1] > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(seen.sum()), own)), pa.array(g[seen]), *(pa.array(x[seen]) for x in sums)], ["first", "g", "c1", "c0"]
                )

    rows = docs.select("w", "toxic", "first").mapInArrow(count, "first boolean, g bigint, c1 bigint, c0 bigint")
    return rows.groupBy("first", "g").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """g (ORDER - 1 bytes), p: interpolated Kneser-Ney probability of the last byte from continuation counts of both classes."""
    types = {ORDER: grams.select("g")}
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
        types[k] = stored(types[k + 1].groupBy(tail.alias("g")).agg(F.count(F.lit(1)).alias("n")), "continuations").select("g", "n")
    total = types[1].agg(F.sum("n")).first()[0] or 1
    p = types[1].select("g", ((F.col("n") - F.least(F.col("n"), F.lit(DISCOUNT))) / total + F.lit(DISCOUNT / 256)).alias("p"))
    for k in range(2, ORDER):
        own = types[k].withColumn("h", F.shiftright("g", 8)).withColumn("t", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        context = own.groupBy("h").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("kinds"))
        lower = p.select(F.col("g").alias("t"), F.col("p").alias("q"))
        p = own.join(context, "h").join(lower, "t").select(
            "g", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("s") + DISCOUNT * F.col("kinds") / F.col("s") * F.col("q")).alias("p")
        )
    return p


class Ratios:
    """Log ratios by key, told apart exactly."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def of(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            out[found] = self.values[at[found]]
        return out


class Model:
    """Log ratios by gram; a gram without one has its context's value, and 0 in an unknown context."""

    def __init__(self, grams: Ratios, contexts: Ratios):
        self.grams, self.contexts = grams, contexts

    def words(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log ratio and number of bytes of each word."""
        grams, word, size = spelled(unique)
        value = self.grams.of(grams, np.nan)
        empty = np.isnan(value)
        value[empty] = self.contexts.of(grams[empty] >> 8, 0.0)
        return np.bincount(word, weights=value, minlength=len(unique)), size

    def features(self, part: pa.RecordBatch) -> np.ndarray:
        unique, index, bounds = coded(part)
        out = np.zeros((part.num_rows, len(FEATURES)))
        if not len(index):
            return out
        ratio, size = self.words(unique)
        rows = np.flatnonzero(np.diff(bounds))
        begin = bounds[rows]
        value, length = ratio[index], size[index]
        out[rows, 0] = np.add.reduceat(value, begin) / np.add.reduceat(length, begin)
        out[rows, 1] = np.maximum.reduceat(value, begin)
        out[rows, 3] = np.maximum.reduceat(value / length, begin)
        # The second: the largest without the first place of the largest.
        owner = np.repeat(np.arange(len(rows)), np.diff(bounds)[rows])
        best = np.flatnonzero(value == out[rows, 1][owner])
        value[best[np.unique(owner[best], return_index=True)[1]]] = -np.inf
        out[rows, 2] = np.where(np.diff(bounds)[rows] > 1, np.maximum.reduceat(value, begin), 0)
        return out


class Tables(NamedTuple):
    """A model as tables (g, v): ratios of grams, ratios of bytes unseen in a context, and the number of both."""

    grams: DataFrame
    contexts: DataFrame
    entries: int


def train(docs: DataFrame) -> Model:
    """docs: w (words), toxic."""
    return collected(modelled(gram_counts(docs.withColumn("first", F.lit(False)))))


def modelled(counts: DataFrame) -> Tables:
    """counts: g, c1, c0, with as many rows per g as may be."""
    grams = counts.groupBy("g").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    grams = stored(grams, "grams").withColumn("h", F.shiftright("g", 8))
    context = grams.groupBy("h").agg(
        *[F.sum(f"c{y}").alias(f"s{y}") for y in (1, 0)], *[F.count(F.when(F.col(f"c{y}") > 0, 1)).alias(f"n{y}") for y in (1, 0)]
    )
    context = stored(context, "contexts")
    weight = {y: F.when(F.col(f"s{y}") > 0, DISCOUNT * F.col(f"n{y}") / F.col(f"s{y}")).otherwise(F.lit(1.0)) for y in (1, 0)}
    tail = F.col("g").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1))
    backoff = shared_backoff(grams).select(F.col("g").alias("t"), "p")
    joined = grams.withColumn("t", tail).join(context, "h").join(backoff, "t")

    def p(y: int) -> Column:
        top = F.when(F.col(f"s{y}") > 0, F.greatest(F.col(f"c{y}") - DISCOUNT, F.lit(0.0)) / F.col(f"s{y}")).otherwise(F.lit(0.0))
        return top + weight[y] * F.col("p")

    ratios = joined.select("g", F.log(p(1) / p(0)).alias("v"))
    unseen = context.select(F.col("h").alias("g"), F.log(weight[1] / weight[0]).alias("v"))
    single = F.col("v").cast("float").alias("v")
    return Tables(ratios.select("g", single), unseen.select("g", single), grams.count() + context.count())


def collected(tables: Tables) -> Model:
    """The model in memory, for tables of a checked size."""
    found = [t.toArrow() for t in (tables.grams, tables.contexts)]
    return Model(*(Ratios(f.column("g").to_numpy(), f.column("v").to_numpy()) for f in found))


def described(docs: DataFrame, tables: Tables, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and the features of every row. docs: w."""
    if tables.entries > BROADCAST_GRAMS:
        return joined_features(docs, tables, keep)
    model = docs.sparkSession.sparkContext.broadcast(collected(tables))
    fields = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "w"):
            x = model.value.features(part)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), *(pa.array(c) for c in x.T)], [*keep, *FEATURES]
            )

    return docs.select(*keep, "w").mapInArrow(run, fields + "".join(f", {f} double" for f in FEATURES))


def row_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_row, word, n: the different words of each row with their counts."""
    for part in slices(batches, "w"):
        unique, index, bounds = coded(part)
        if len(index):
            place = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            pairs, n = np.unique(place * len(unique) + index, return_counts=True)
            rows = part.column("_row").take(pa.array(pairs // len(unique)))
            yield pa.RecordBatch.from_arrays([rows, unique.take(pa.array(pairs % len(unique))), pa.array(n)], ["_row", "word", "n"])


def spelled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, g: one row for each place of a word."""
    for part in slices(batches, "word", 1 << 18):
        grams, word, _ = spelled(part.column("word"))
        yield pa.RecordBatch.from_arrays([part.column("word").take(pa.array(word)), pa.array(grams)], ["word", "g"])


def joined_features(docs: DataFrame, tables: Tables, keep: tuple[str, ...]) -> DataFrame:
    """As ``described``, with the model left where it is: different words are joined with it, rows with their words.

    Each different word of the table is spelled once. A frequent word is many rows of one side against one of the other, which adaptive
    execution splits. A row gathers the values of its own different words only.
    """
    rows = stored(docs.select(*keep, "w").withColumn("_row", F.monotonically_increasing_id()), "rows")
    counts = stored(rows.select("_row", "w").mapInArrow(row_words, "_row bigint, word string, n bigint"), "row-words")
    places = counts.select("word").distinct().mapInArrow(spelled_words, "word string, g bigint").withColumn("h", F.shiftright("g", 8))
    seen = places.join(tables.grams, "g", "left").join(tables.contexts.select(F.col("g").alias("h"), F.col("v").alias("u")), "h", "left")
    value = F.coalesce(F.col("v").cast("double"), F.col("u").cast("double"), F.lit(0.0))
    scored = seen.groupBy("word").agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("size"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("value", "n")), asc=False), 1, 2)
    found = counts.join(scored, "word").groupBy("_row").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("mean"),
        F.max("value").alias("first"), F.max(F.col("value") / F.col("size")).alias("dense"), top.alias("_top"),
    )
    second = F.when(F.col("_top")[0]["n"] > 1, F.col("_top")[0]["value"]).when(F.size("_top") > 1, F.element_at("_top", 2)["value"])
    found = found.withColumn("second", second).drop("_top")
    return rows.select(*keep, "_row").join(found, "_row", "left").select(*keep, *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES])


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights (means and scales taken in) and intercept of a logistic curve, by Newton steps with a ridge."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 2)
        return np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] / scale * mean).sum())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Labels: doc_id, toxic; fold 0 is never read."""
    small_batches(docs.sparkSession)
    lower = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    split = lower.select("doc_id", words().alias("w"))
    known = labels.filter((fold() != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known, "labels")
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    labelled = split.join(F.broadcast(known) if few else known, "doc_id")
    counts = stored(gram_counts(labelled.withColumn("first", fold() == 1)), "counts")
    fitting, model = modelled(counts.filter(~F.col("first"))), modelled(counts)
    second = known.filter(fold() == 1)
    n = second.count()
    if n > FIT_ROWS:
        second = second.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(FIT_ROWS / n * (1 << 20)))
    sample = described(split.join(F.broadcast(second), "doc_id").select("toxic", "w"), fitting, ("toxic",)).limit(FIT_ROWS).toPandas()
    curve = fit_curve(sample[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), sample["toxic"].to_numpy(float))
    line = F.lit(float(curve[-1]))
    for name, weight in zip(FEATURES, curve[:-1].tolist()):
        line = line + F.col(name) * F.lit(weight)
    score = 1 / (1 + F.exp(-line))
    rated = described(split, model, ("doc_id",)).select("doc_id", (fold() == 0).alias("held_out"), score.alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
