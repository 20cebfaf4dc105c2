"""Secret scan over an incremental ledger of blobs.

A blob is a distinct text, addressed by its SHA-256. The ledger is a Parquet table with one row per blob and scan: the
rule versions that were applied and the spans they found, also where they found none. A run computes which (blob, rule version) pairs the
ledger lacks, scans only those and appends its rows; findings are then joined back to every document that has the blob. A new
rule, or a new version of one, costs one scan of that rule; a text that is already known costs its hash.

Everything is DataFrame expressions. Spans count code points, the end is exclusive. A null text is empty and has no
spans; repeated rows get the same findings; an empty table gives an empty result and writes no ledger rows. Columns beside doc_id
and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastelake.session import work_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; matches whose ``group`` is shorter than ``least`` are dropped.

    ``needs``: a literal that every match contains (checked before the pattern), or empty.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


BASE = (
    Rule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("git_host", 1, "gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("chat_bot", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("web_token", 1, "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{5,}", needs="eyJ"),
    Rule("url_login", 1, "[a-z][a-z0-9+]*://[A-Za-z0-9._-]+:[^\\x00-\\x20/@]+@", needs="://"),
)
RULES = BASE + ADDED
#: Spans in the ledger carry their rule version; ``rank`` is the place of the rule among those asked for.
FOUND = "array<struct<start:bigint,end:bigint,rule:string>>"
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
LEDGER = f"blob string, scanned array<string>, spans {FOUND}"


def rule_spans(rule: Rule, text: str = "text") -> Column:
    """Spans of one rule. Between two matches lies one piece of the split text, so running lengths give the places."""
    t, pattern = F.col(text), F.lit(rule.pattern)
    there = t.contains(rule.needs) & t.rlike(rule.pattern) if rule.needs else t.rlike(rule.pattern)
    between = F.transform(F.split(t, rule.pattern, -1), lambda x: F.length(x).cast("bigint"))
    whole = F.transform(F.regexp_extract_all(t, pattern, F.lit(0)), lambda x: F.length(x).cast("bigint"))
    part = F.transform(F.regexp_extract_all(t, pattern, F.lit(rule.group)), F.length)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["between"]
        end = begin + x["whole"]
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.key).alias("rule"))
        out = F.when(x["part"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    # The last piece of text has no match after it, so its two other lengths are null and it is left out.
    rows = F.filter(
        F.arrays_zip(between.alias("between"), whole.alias("whole"), part.alias("part")), lambda x: x["whole"].isNotNull()
    )
    return F.when(there, F.aggregate(rows, start, step)["out"]).otherwise(F.array().cast(FOUND))


def blob() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def ledger(spark, path: str) -> DataFrame:
    """Rows of a ledger; none where it has not been started."""
    if not exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def unseen(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, text and the rule versions that the ledger has for it, for blobs that lack any."""
    blobs = docs.select(blob().alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if not exists(docs.sparkSession, path):
        return blobs.withColumn("known", F.array().cast("array<string>"))
    known = ledger(docs.sparkSession, path).select("blob", F.explode("scanned").alias("rule"))
    known = known.groupBy("blob").agg(F.collect_set("rule").alias("known"))
    left = blobs.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return left.filter(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.col("known"))) > 0)


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the unseen (blob, rule version) pairs and appends them."""
    nothing = F.array().cast(FOUND)
    keys = F.array(*[F.lit(r.key) for r in rules])
    found = [F.when(F.array_contains("known", r.key), nothing).otherwise(rule_spans(r)) for r in rules]
    scanned = unseen(docs, path, rules).select("blob", F.array_except(keys, F.col("known")).alias("scanned"), F.concat(*found).alias("spans"))
    scanned.write.mode("append").parquet(path)


def blob_spans(spark, path: str, rules: tuple[Rule, ...]) -> DataFrame:
    """blob and the sorted spans of exactly the given rule versions, of blobs that have any row with spans."""
    hits = ledger(spark, path).filter(F.size("spans") > 0)
    # A blob has one row per scan; each scan has other rules. Versions that are not asked for stay in the ledger unseen.
    own = hits.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    asked = F.filter("spans", lambda s: s["rule"].isin([r.key for r in rules]))
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.kind))])
    named = F.transform(asked, lambda s: F.struct(s["start"].alias("start"), rank[s["rule"]].alias("rank"), s["end"].alias("end"), kind[s["rule"]].alias("kind")))
    return own.select("blob", F.sort_array(F.array_distinct(named)).alias("spans"))


def findings(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and the sorted spans of the given rule versions, for every row of docs."""
    own = blob_spans(docs.sparkSession, path, rules)
    return (
        docs.select("doc_id", blob().alias("blob"))
        .join(own, "blob", "left")
        .select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (sorted array) of every row; the ledger at ``path`` is used and brought up to date (none: a new one)."""
    at = path or work_path(docs.sparkSession, "blob-ledger")
    update_ledger(docs, at, rules)
    return findings(docs, at, rules)


def report(found: DataFrame) -> DataFrame:
    """Counts, digest and text form of the spans of ``findings``."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal run of covered code points replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        out = F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


#: Blobs with secrets whose spans may travel to every task; with more, they are joined by blob.
BROADCAST_BLOBS = 100_000


def masked(docs: DataFrame, path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs, with all their columns, whose secrets are replaced by ``mark``; an ``n_chars`` column follows the text."""
    at = path or work_path(docs.sparkSession, "blob-ledger")
    update_ledger(docs, at)
    hits = blob_spans(docs.sparkSession, at, RULES).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    few = hits.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(blob().alias("_key"), row).join(F.broadcast(hits) if few else hits, F.col("_key") == F.col("_blob"), "left")
    text = F.col("row.text")
    new = F.when(F.col("_spans").isNull(), text).otherwise(redacted(F.coalesce(text, F.lit("")), F.col("_spans"), mark))
    out = joined.select("row", new.alias("new"))
    size = F.when(F.col("new").eqNullSafe(text), F.col("row.n_chars")).otherwise(F.length("new")) if "n_chars" in docs.columns else None
    changed = {"text": F.col("new"), "n_chars": size}
    return out.select(*[
        changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col("row")[f.name].alias(f.name) for f in docs.schema.fields
    ])
