"""Best-fit packing of token pieces into sequences by exact-complement hashing.

The plan needs only how many pieces there are of each length, a table of at most ``capacity`` rows. Lengths are taken from the
longest down. The gap that is left is looked up in an index of single lengths, of pair sums and of triple sums; a combination
that fills it exactly is used as often as the counts allow. What finds no complement goes to the fullest place it fits in
(best fit, longest first). Taking triples early can use up the short pieces that later gaps need, so plans are made from the same table for
several orders of the three kinds of combination, best fit alone among them, and the one with fewest sequences is used. The plan says for every length which ranks go to which sequences; pieces are then ranked within
their length by a two-level count and looked up in the plan. No piece but those of one slice is ever in Python.

Null texts are empty; an empty document is its end id alone. Repeated rows are packed as often as they occur. A null doc_id
stays null. An empty table gives an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastelake.llm.common import small_batches, texts
from tastelake.llm.tokens import crc32, encoded
from tastelake.session import stored

CAPACITY = 2048
#: Pieces that are ranked together in one task.
CHUNK_ROWS = 20_000


@dataclass
class Plan:
    """Slots: ``per`` pieces of ``length`` in each of ``bins`` sequences from ``sequence`` on, from ``offset`` on."""

    capacity: int
    sequences: int = 0
    slots: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    ranked: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, per: int, bins: int, sequence: int, offset: int) -> None:
        first = self.ranked.get(length, 0)
        self.slots.append((length, first, per, bins, sequence, offset))
        self.ranked[length] = first + per * bins

    def open(self, lengths: list[int], bins: int) -> None:
        offset = 0
        for length in lengths:
            self.place(length, 1, bins, self.sequences, offset)
            offset += length
        self.sequences += bins


def uses(left: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often the combination can be taken."""
    return min(int(left[x]) // lengths.count(x) for x in lengths)


#: Orders in which combinations of one, two and three pieces are tried; each inner tuple is one run from the longest length down.
ORDERS = (((1, 2, 3),), ((1,), (2,), (3,)), ((1,), (2, 3)), ((1, 2), (3,)), ((1, 2),), ((1,),), ())


def complement(left: np.ndarray, length: int, gap: int, kinds: tuple[int, ...] = (1, 2, 3)) -> tuple[int, ...] | None:
    """One, two or three lengths (as ``kinds`` says) that together fill ``gap`` exactly beside one piece of ``length``; the longest first."""
    there = left > 0
    if 1 in kinds and there[gap] and uses(left, (length, gap)):
        return (gap,)

    def pair(total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        high = np.arange(total - 1, (total - 1) // 2, -1)
        for a in high[there[high] & there[total - high]]:
            found = (int(a), int(total - a))
            if uses(left, taken + found):
                return found
        return None

    if 2 in kinds and (found := pair(gap, (length,))):
        return found
    if 3 not in kinds:
        return None
    index = np.flatnonzero(there[: gap + 1])
    if not len(index):
        return None
    marks = np.zeros(gap + 1)
    marks[index] = 1
    size = 1 << int(2 * (gap + 1)).bit_length()
    sums = np.fft.irfft(np.fft.rfft(marks, size) ** 2, size)[: gap + 1] > 0.5  # pair sums that occur
    for a in index[::-1]:
        if sums[gap - a] and (found := pair(int(gap - a), (length, int(a)))):
            return (int(a), *found)
    return None


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """counts: pieces by length, 1 to ``capacity``. The plan with fewest sequences of all ``ORDERS``."""
    bound = -(-sum(length * count for length, count in counts.items()) // capacity)
    best = None
    for order in ORDERS:
        plan = plan_in_order(counts, capacity, order)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == bound:
            break
    return best


def plan_in_order(counts: dict[int, int], capacity: int, order: tuple[tuple[int, ...], ...]) -> Plan:
    plan, left = Plan(capacity), np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    if left[capacity]:
        plan.open([capacity], int(left[capacity]))
        left[capacity] = 0
    for kinds in order:
        for length in range(capacity - 1, 0, -1):
            while left[length] and (found := complement(left, length, capacity - length, kinds)) is not None:
                taken = (length, *found)
                bins = uses(left, taken)
                plan.open(list(taken), bins)
                for x in taken:
                    left[x] -= bins
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, bins) by free places
    for length in range(capacity, 0, -1):
        while left[length]:
            room = next((g for g in range(length, capacity + 1) if free[g]), None)
            if room is None:
                room, per = capacity, capacity // length
                free[room].append((plan.sequences, -(-int(left[length]) // per)))
                plan.sequences += free[room][-1][1]
            first, bins = free[room].pop()
            per = min(room // length, int(left[length]))
            used = min(bins, int(left[length]) // per)
            if used < bins:
                free[room].append((first + used, bins - used))
            plan.place(length, per, used, first, capacity - room)
            free[room - per * length].append((first, used))
            left[length] -= per * used
    return plan


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document, cut only where it is longer than ``capacity``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, offsets in encoded(batches, tokenizer):
            number = -(-np.diff(offsets) // capacity)
            row = np.repeat(np.arange(part.num_rows), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            begin = offsets[row] + start
            end = np.minimum(begin + capacity, offsets[row + 1])
            columns = [
                part.column("doc_id").take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(end - begin, pa.int64()),
                pa.array([crc32(ids[b:e]) for b, e in zip(begin, end)], pa.int64()),
            ]
            if keep_ids:
                bounds = np.append(begin, len(ids)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for rows with ``length`` (1 to ``capacity``), ``doc_id`` and ``piece``.

    ``cut`` is read twice and must give the same rows each time: a stored table.
    """
    lengths = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = plan_packing(lengths, capacity)
    chunks = max(1, -(-sum(lengths.values()) // CHUNK_ROWS))
    marked = cut.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("length", "_chunk").count()
    firsts = counts.select("length", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece")
    ranked = marked.withColumn("_row", F.row_number().over(inside)).join(firsts, ["length", "_chunk"])
    ranked = ranked.select(*cut.columns, (F.col("_first") + F.col("_row") - 1).alias("_rank"))
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 6)
    by_length = np.searchsorted(slots[:, 0], np.arange(capacity + 2))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                low, high = by_length[x], by_length[x + 1]
                at[own] = low + np.searchsorted(slots[low:high, 1], rank[own], side="right") - 1
            _, first, per, _, sequence, offset = slots[at].T
            bin_, turn = np.divmod(rank - first, per)
            added = [pa.array(sequence + bin_, pa.int64()), pa.array(offset + turn * length, pa.int64())]
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, *added], [*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(look_up, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place; ``keep_ids`` adds the token ids."""
    return pack(stored(pieces(docs, tokenizer, capacity, keep_ids), "pieces"), capacity)
