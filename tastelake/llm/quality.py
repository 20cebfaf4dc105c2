"""Quality rules whose cutoffs come from labelled documents with a proven limit on false rejections.

Every rule compares a whole percentage (or a mean length in tenths) with a cutoff. For each stratum, rule and cutoff, the good labelled
documents that the cutoff would reject are counted. A cutoff is allowed if the exact binomial test refutes that it rejects more
than its share of the allowed false rejections, at a level divided by strata and rules (Bonferroni); cutoffs of one rule are tested from the most
lenient on and the first failure ends the sequence, which needs no further correction. Among the allowed ones, that with the largest
surplus of rejected bad over rejected good documents (as shares) is taken, the most lenient of equals; without a surplus or
without enough labels a rule stays off in that stratum. All of it is DataFrame expressions.

Null or empty texts have no words and fail the base. A null stratum is one of its own. Repeated rows are judged alike; a doc_id
with several labels is good if any says so. Without labels nothing but the base rejects. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastelake.llm.common import words
from tastelake.session import stored

#: Share of a stratum's good documents that all rules together may reject, and the risk that this is exceeded anywhere.
MAX_FALSE_REJECTIONS, RISK = 0.02, 0.05
#: Lost shares of good documents count this many times as much as rejected shares of bad ones.
COST = 10
#: Largest cutoff of a rule; larger values count as this one.
TOP = 200
#: Labels that may travel to every task; with more, features of all documents are stored and joined by key.
BROADCAST_LABELS = 1_000_000
#: Strata whose cutoffs may travel to every task; with more, they are joined by key.
BROADCAST_STRATA = 10_000
RULES = ("symbols", "repeats", "lines", "length")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used inside."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_windows(w: Column) -> Column:
    """Hash and place of all 3-word windows, sorted."""
    positions = F.sequence(F.lit(0), F.size(w) - 3)
    windows = F.transform(positions, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    return F.when(F.size(w) >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def covered(windows: Column) -> Column:
    """Size of the union of [i, i + 2] over the windows with a twin beside them in the sorted array."""

    def twin(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(windows, k - 1)["h"] == x["h"]).otherwise(F.lit(False))
        return before | F.coalesce(F.get(windows, k + 1)["h"] == x["h"], F.lit(False))

    at = F.sort_array(F.transform(F.filter(windows, twin), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    total = F.aggregate(
        at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
    )
    return total["n"]


def measured(docs: DataFrame, stratum: str = "lang", keep_row: bool = False) -> DataFrame:
    """doc_id, stratum, the base counts and the number of lines with a word; ``keep_row`` adds the whole row as a struct.

    All counts are one struct that an ``inline`` hands on: later filters then use the counts and do not repeat their computation.
    """
    blank = " \t\n\x0b\f\r"
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []
    base = docs.select("doc_id", F.col(stratum).alias("stratum"), *row, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    repeats = bound(
        words("_text"),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), bound(word_windows(w), covered).alias("n_repeat_words")),
    )
    by_line = bound(
        lines,
        lambda l: F.struct((F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("dup"), F.size(l).cast("bigint").alias("all")),
    )
    counts = bound(
        F.struct(repeats.alias("r"), by_line.alias("l")),
        lambda x: F.struct(
            x["r"]["n_words"].alias("n_words"),
            F.length(F.translate(text, blank, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
            x["l"]["dup"].alias("n_dup_lines"),
            x["r"]["n_repeat_words"].alias("n_repeat_words"),
            x["l"]["all"].alias("n_lines"),
        ),
    )
    kept = ["row"] if keep_row else []
    return base.select("doc_id", "stratum", *kept, F.inline(F.array(counts)))


def rule_values() -> dict[str, Column]:
    """Whole numbers, 0 to TOP; larger is worse."""
    ratio = {
        "symbols": (100 * F.col("n_symbols"), F.col("n_words")),
        "repeats": (100 * F.col("n_repeat_words"), F.col("n_words")),
        "lines": (100 * F.col("n_dup_lines"), F.col("n_lines")),
        "length": (10 * F.col("word_chars"), F.col("n_words")),
    }
    return {
        k: F.when(below > 0, F.least(F.floor(above / below), F.lit(TOP))).otherwise(0).cast("bigint")
        for k, (above, below) in ratio.items()
    }


def log_gamma(x: str) -> str:
    """SQL of ln Gamma(x) for x >= 1: Stirling's series at x + 8, brought back by the recurrence."""
    y = f"({x} + 8e0)"
    product = " + ".join(f"ln({x} + {k}e0)" for k in range(8))
    series = f"1e0 / (12e0 * {y}) - 1e0 / (360e0 * pow({y}, 3)) + 1e0 / (1260e0 * pow({y}, 5))"
    return f"(({y} - 0.5e0) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {series} - ({product}))"


def binomial_tail(n: str, k: str, share: float, terms: int = 5000) -> Column:
    """P(at most k of n) when each has probability ``share``; 1 from the mean on.

    Terms are added from k downwards, where they shrink; what lies beyond ``terms`` is replaced by a geometric bound from above.
    """
    top = f"exp({log_gamma(f'({n} + 1e0)')} - {log_gamma(f'({k} + 1e0)')} - {log_gamma(f'({n} - {k} + 1e0)')} + {k} * {math.log(share)!r}D + ({n} - {k}) * {math.log1p(-share)!r}D)"
    odds = (1 - share) / share
    ratio = f"(({k} - i + 1e0) / ({n} - {k} + i) * {odds!r}D)"
    steps = f"sequence(1, cast(least({k}, {terms}) as int))"
    sums = f"aggregate({steps}, named_struct('t', 1e0, 's', 1e0), (a, i) -> named_struct('t', a.t * {ratio}, 's', a.s + a.t * {ratio}))"
    last = f"({k} / ({n} - {k} + 1e0) * {odds!r}D)"
    rest = f"if({k} > {terms}, a.t * {last} / (1e0 - {last}), 0e0)"
    total = f"aggregate(array({sums}), 0e0, (z, a) -> a.s + {rest})"
    return F.expr(f"case when {k} >= {n} * {share!r}D then 1e0 when {k} = 0 then {top} else {top} * {total} end")


def cutoffs(
    features: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE_REJECTIONS, risk: float = RISK
) -> DataFrame:
    """stratum and one cutoff per rule (null: off). Labels: doc_id, quality (1 good, 0 bad)."""
    good = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    values = rule_values()
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in values.items()]))
    # What the base rejects anyway tells nothing about the rules.
    judged = features.filter(~base_failed()).join(good, "doc_id").select("stratum", "good", rows.alias("r"))
    counts = judged.groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.value").alias("value")).agg(
        F.sum((F.col("good") == 1).cast("bigint")).alias("n_good"), F.sum((F.col("good") != 1).cast("bigint")).alias("n_bad")
    )
    lenient_first = Window.partitionBy("stratum", "rule").orderBy(F.desc("value"))
    upto = lenient_first.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum", "rule")
    tested = counts.select(
        "stratum",
        "rule",
        "value",
        *[F.sum(c).over(upto).alias(f"{c}_out") for c in ("n_good", "n_bad")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("n_good", "n_bad")],
    ).filter("value > 0")
    # At least one, as n_strata is 0 without rows.
    n_strata = counts.agg(F.count_distinct(F.coalesce(F.concat(F.lit("s"), F.col("stratum")), F.lit("")))).first()[0] or 1
    level = risk / (n_strata * len(RULES))
    p = binomial_tail("n_good_all", "n_good_out", max_false / len(RULES))
    passed = tested.withColumn("ok", (p <= F.lit(level)).cast("int")).withColumn("ok", F.min("ok").over(upto))
    surplus = F.expr(f"n_bad_out * n_good_all - {COST} * n_good_out * n_bad_all")
    best = passed.filter((F.col("ok") == 1) & (surplus > 0)).groupBy("stratum", "rule").agg(
        F.max_by("value", F.struct(surplus.cast("decimal(38,0)"), "value")).alias("cutoff")
    )
    one = [F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES]
    return best.groupBy("stratum").agg(*one)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false: float = MAX_FALSE_REJECTIONS, risk: float = RISK
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of docs."""
    features = stored(measured(docs, stratum), "quality")
    return judge(features, stored(cutoffs(features, labels, max_false, risk), "cutoffs"))


def judge(features: DataFrame, limits: DataFrame) -> DataFrame:
    """The verdict on rows of ``measured`` by the cutoffs of their stratum."""
    limits = limits.withColumnRenamed("stratum", "_stratum")
    small = limits.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = features.join(
        F.broadcast(limits) if small else limits, F.col("stratum").eqNullSafe(F.col("_stratum")), "left"
    )
    over = [F.coalesce(v >= F.col(f"max_{k}"), F.lit(False)) for k, v in rule_values().items()]
    rejected = over[0]
    for more in over[1:]:
        rejected = rejected | more
    base = [c for c in features.columns if c not in ("stratum", "n_lines")]
    return joined.select(*base, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep. Texts are not shuffled."""
    known = labels.select("doc_id", "quality")
    if known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sample = measured(docs.join(F.broadcast(known.select("doc_id").distinct()), "doc_id"), stratum)
    else:
        sample = measured(docs, stratum)
    limits = stored(cutoffs(stored(sample, "quality"), known), "cutoffs")
    return judge(measured(docs, stratum, keep_row=True), limits).filter("kept").select("row.*")
