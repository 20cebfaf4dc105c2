"""Ranked lexical search of many items over all documents by bag deduplication.

1. One pass over the texts counts all terms of a document (its length n) and, restricted to the items' vocabulary, its term counts: its bag.
2. N, L and the documents per term come from the stored bags. With N and L each document gets its m, the length part of the score.
3. Documents with equal bag and m are one class: their hashes deal them out, equality of hash, m, terms and counts puts them together. A
   class keeps its first ``k`` doc_ids, as no item can return more of it.
4. Each class is scored once for all items, in 64-bit integers. Each task keeps the best ``k`` classes per item in a heap, Spark merges the
   heaps. Among equal scores the class with the smaller least doc_id comes first, so the ``k`` best documents are members of the ``k`` best classes.
5. Members of these classes are expanded in ascending doc_id.

Items are independent, so they are taken in groups of about ``GROUP_BYTES`` of text (a longer item is a group of its own). Vocabulary and
item terms of one group are what a task holds and what is broadcast; each group reads the texts once.

Nulls: a null text has no terms; a null doc_id comes after all others of its score; a null item_id is an item like others. Each row of
items is an item, each row of documents a document, repeated ones too, and ranks stay unique. Items without known terms give no
rows, nor do documents with a score of 0; an empty table gives an empty result. Other columns are not read. Long texts are counted in pieces cut
between terms; a text is one row, so it must fit into a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.llm.best import Heaps
from tastelake.llm.common import offsets_of, slices, small_batches, spread
from tastelake.operators.ordering import top_n
from tastelake.session import stored

TOP = 20
#: Text bytes of the items that are searched together.
GROUP_BYTES = 4 << 20
#: Characters that are counted at once.
PIECE = 1 << 20
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Scores and item terms that are worked on at once.
_CELLS = 400_000
_LAST = np.iinfo(np.int64).max


def terms_of(text: str) -> Iterator[list[str]]:
    """Lists of the terms of a text, in order."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        stop = gap.start() if gap else len(text)
        yield TERM.findall(text[at:stop].translate(_LOWER))
        at = stop


class Items:
    """Vocabulary of a group of items, and the items' terms as postings."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        counts = [Counter(t for part in terms_of(text or "") for t in part) for _, text in rows]
        self.places = [place for place, _ in rows]
        self.ids = {t: i for i, t in enumerate(sorted(set().union(*counts)))} if counts else {}
        postings = sorted((self.ids[t], item, n) for item, c in enumerate(counts) for t, n in c.items())
        table = np.array(postings, np.int64).reshape(-1, 3)
        self.starts = np.searchsorted(table[:, 0], np.arange(len(self.ids) + 1))
        self.item, self.times = table[:, 1], table[:, 2]


def item_groups(items: DataFrame, group_bytes: int) -> tuple[DataFrame, Iterator[Items]]:
    """Items (place, item_id) and their groups; one group at a time is on the driver."""
    rows = items.select("item_id", "text", F.monotonically_increasing_id().alias("place"))
    rows = stored(rows, "items")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // group_bytes))

    def groups() -> Iterator[Items]:
        for i in range(n):
            part = rows.filter(F.pmod(F.xxhash64("place"), F.lit(n)) == i).orderBy("place").select("place", "text")
            yield Items([tuple(r) for r in part.collect()])

    return rows.select("place", "item_id"), groups()


BAGS = "doc_id bigint, n bigint, ids array<int>, tfs array<int>"


def bags(docs: DataFrame, items) -> DataFrame:
    """doc_id, n, ids (ascending) and tfs of every document; ``items`` is a broadcast group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value.ids
        for batch in slices(batches):
            lengths, ids, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                n, found = 0, Counter()
                for part in terms_of(text):
                    n += len(part)
                    found.update(map(known.get, part))
                del found[None]
                own = sorted(found)
                lengths.append(n)
                ids.append(own)
                tfs.append([found[i] for i in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                ["doc_id", "n", "ids", "tfs"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, BAGS)


def classes(counted: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """m, ids, tfs and members (the first k doc_ids, nulls last) of every class of documents with a known term."""
    m = F.expr(f"100 - 25 + (25 * n * {n_docs}L) div {max(n_terms, 1)}L").alias("m")
    rows = counted.filter(F.size("ids") > 0).select("doc_id", m, "ids", "tfs", F.xxhash64("ids", "tfs").alias("h"))
    same = ["h", "m", "ids", "tfs"]
    first = top_n(rows, same, [F.col("doc_id").asc_nulls_last()], k)
    member = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")
    return first.groupBy(*same).agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["doc_id"]).alias("members")).drop("h")


def lists(col: pa.Array, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    bounds = offsets_of(col).astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(kind), bounds - bounds[0]


def bounded(own: Items, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The classes in parts of at most ``_CELLS`` scores and item terms; a class that has more comes alone."""
    ids, bounds = lists(batch.column("ids"))
    done = np.append(0, np.cumsum(own.starts[ids + 1] - own.starts[ids]))[bounds]
    done += np.arange(len(done)) * len(own.places)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(done, done[start] + _CELLS, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def scored(table: DataFrame, items, weights, k: int) -> DataFrame:
    """place, score and members of the best k classes per item and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = items.value, weights.value
        n = len(own.places)
        heaps = Heaps(n, k)
        members: dict[int, list] = {}
        seen = 0
        for batch in batches:
            for part in bounded(own, batch):
                ids, bounds = lists(part.column("ids"))
                tfs, _ = lists(part.column("tfs"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                m = part.column("m").to_numpy()[owner]
                gain = weight[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m))
                sizes = own.starts[ids + 1] - own.starts[ids]
                at = spread(own.starts[ids], sizes)
                scores = np.zeros(part.num_rows * n, np.int64)
                np.add.at(scores, np.repeat(owner * n, sizes) + own.item[at], np.repeat(gain, sizes) * own.times[at])
                scores = scores.reshape(part.num_rows, n)
                row, item = np.nonzero((scores > 0) & (scores >= heaps.floor))
                docs = part.column("members").to_pylist()
                least = np.array([_LAST if d[0] is None else d[0] for d in docs], np.int64)
                heaps.add(item, scores[row, item], least[row], row + seen)
                for i in np.unique(row).tolist():
                    members[i + seen] = docs[i]
                seen += part.num_rows
                if len(members) > 2 * n * k + _CELLS // max(n, 1):
                    live = set(heaps.cut()[3].tolist())
                    members = {i: d for i, d in members.items() if i in live}
        item, score, _, extra = heaps.cut()
        places = np.array(own.places, np.int64)[item]
        yield pa.RecordBatch.from_arrays(
            [pa.array(places), pa.array(score), pa.array([members[i] for i in extra.tolist()], pa.list_(pa.int64()))], ["place", "score", "members"]
        )

    return table.select("m", "ids", "tfs", "members").mapInArrow(run, "place bigint, score bigint, members array<bigint>")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents (doc_id, text) of every item (item_id, text)."""
    spark = docs.sparkSession
    names, groups = item_groups(items, group_bytes)
    found = None
    for group in groups:
        shared = spark.sparkContext.broadcast(group)
        counted = stored(bags(docs, shared), "bags")
        n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect()
        weight = np.zeros(len(group.ids), np.int64)
        at, df = np.array([r["id"] for r in holding], np.int64), np.array([r["df"] for r in holding], np.int64)
        weight[at] = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        best = scored(classes(counted, n_docs, n_terms, k), shared, spark.sparkContext.broadcast(weight), k)
        best = top_n(best, ["place"], [F.col("score").desc(), F.col("members")[0].asc_nulls_last()], k)
        each = best.select("place", "score", F.explode("members").alias("doc_id"))
        part = stored(top_n(each, ["place"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k), "ranked")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found.join(names, "place").select("item_id", "rank", "doc_id", "score")
