"""Windows of a fixed length that occur more than once in a corpus, found through super-k-mers.

A sequence of symbols (words or bytes) is cut where the minimiser of its windows changes: the least hash of the ``k``-symbol runs inside
a window, the leftmost of equals. A super-k-mer is the string under consecutive windows with one minimiser. Equal windows have
equal minimisers at equal places, so windows need comparing only between super-k-mers of one minimiser.

1. One pass over the documents counts super-k-mers per minimiser (least and largest string hash, count, first document), summed
   before the shuffle. A minimiser with one string needs no comparison: its windows repeat if the string does.
2. The minimisers that occur twice, and those with several strings, become two bitmaps of fixed size (bits by hash). They travel
   to the second pass, which hands on only super-k-mers that can matter. A full bitmap lets more through, never less.
3. Strings of minimisers with several strings go to their bucket, equal ones as one row, and are compared there. Minimisers with
   more than ``hot`` super-k-mers are not gathered: their windows are counted one by one by hash, which any number of tasks can share.
4. What each string has to remove is joined back to all its places.

Super-k-mers and strings are told apart by two 64-bit hashes (minimiser and string).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.llm.common import spread
from tastelake.session import stored

#: Bits of each bitmap (16 MB), a limit whatever the data.
BITMAP_BITS = 27
#: Super-k-mers of one minimiser that may meet in one task.
HOT = 50_000
_PART = 1 << 15  # bits of one value of bitmap_construct_agg
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Runs of window starts, and the least doc_id that has the windows.
RUNS = "array<struct<start:int,end:int,first:bigint>>"


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of symbols[i : i + k] for every i with k symbols, built from runs of doubled length."""
    out, width, parts, at = symbols, 1, [], 0
    sizes = {1: symbols}
    while width * 2 <= k:
        step = sizes[width]
        sizes[width * 2] = step[:-width] * (_BASE + np.uint64(2 * width)) + step[width:]
        width *= 2
    n = len(symbols) - k + 1
    out = np.zeros(n, np.uint64)
    for size in sorted(sizes, reverse=True):
        if k - at >= size:
            out = out * _M1 + sizes[size][at : at + n]
            at += size
    return mixed(out)


def sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: running minima from the left and from the right of blocks of w."""
    n = len(keys) - w + 1
    blocks = -(-len(keys) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


@dataclass
class Segments:
    """Super-k-mers of a slice: document row, first symbol in the slice and in the document, windows, place of the minimiser."""

    row: np.ndarray
    at: np.ndarray
    start: np.ndarray
    count: np.ndarray
    pivot: np.ndarray
    h_min: np.ndarray
    h_str: np.ndarray


def segments(symbols: np.ndarray, offsets: np.ndarray, window: int, k: int) -> Segments:
    """symbols: unsigned 64-bit hashes of all documents one after another; offsets: n + 1 document bounds."""
    starts = offsets[:-1]
    n_windows = np.maximum(np.diff(offsets) - window + 1, 0)
    if not n_windows.sum():
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none, none, none)
    hashes = run_hashes(symbols, k)
    place_bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    keys = (hashes >> place_bits << place_bits) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(keys, window - k + 1) & ((np.uint64(1) << place_bits) - np.uint64(1))
    valid = spread(starts, n_windows)
    pivot = least[valid].astype(np.int64)
    row = np.repeat(np.arange(len(starts)), n_windows)
    new = np.ones(len(valid), bool)
    new[1:] = (pivot[1:] != pivot[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    at, row, pivot = valid[first], row[first], pivot[first]
    length = count + window - 1
    # Sum of symbol * base ** place; the inverse power takes the place out again.
    scaled = mixed(symbols + _M2) * powers(_BASE, len(symbols))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scaled, dtype=np.uint64)])
    body = (total[at + length] - total[at]) * powers(_INVERSE, int(at.max()) + 1)[at]
    h_str = mixed(body ^ (length.astype(np.uint64) * _M1))
    return Segments(row, at, at - starts[row], count, pivot - at, hashes[pivot].view(np.int64), h_str.view(np.int64))


class Bitmap:
    """Membership of 64-bit hashes by their lowest bits."""

    def __init__(self, rows: list[tuple[int, bytes]], bits: int):
        self.bits = bits
        self.data = np.zeros((1 << bits) // 8, np.uint8)
        for part, value in rows:
            self.data[part * (_PART // 8) :][: len(value)] = np.frombuffer(value, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & ((1 << self.bits) - 1)
        return (self.data[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(frame: DataFrame, column: str, bits: int = BITMAP_BITS) -> Bitmap:
    """At most 2 ** bits / 8 bytes come to the driver, however many rows there are."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    parts = frame.select(F.floor(slot / _PART).alias("part"), F.pmod(slot, F.lit(_PART)).alias("bit"))
    rows = parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("value")).collect()
    return Bitmap([(int(r["part"]), bytes(r["value"])) for r in rows], bits)


@dataclass
class Corpus:
    """A frame of documents and how its rows turn into symbols.

    ``frame`` has doc_id, th (hash of the text) and the columns that the functions read; ``hashes(batch)``: 64-bit hashes of
    all symbols and the document bounds; ``strings(batch, at, length)``: the packed strings of runs of symbols; ``unpack(strings)``: their symbols
    again; ``slices(batches)``: the batches in slices of bounded size.
    """

    frame: DataFrame
    window: int
    k: int
    hashes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
    strings: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.Array]
    unpack: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    slices: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    hot: int = HOT
    bits: int = BITMAP_BITS

    @cached_property
    def minimisers(self) -> DataFrame:
        """h_min, lo, hi (least and largest string hash), n, first (least doc_id; null ones are largest), for n > 1."""
        hashes, cut, window, k = self.hashes, self.slices, self.window, self.k

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in cut(batches):
                s = segments(*hashes(part), window, k)
                ids = part.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s.h_min, s.h_str, ids[s.row] if len(s.row) else s.row)], ["h_min", "h_str", "doc"])

        rows = self.frame.mapInArrow(count, "h_min bigint, h_str bigint, doc bigint")
        found = rows.groupBy("h_min").agg(
            F.min("h_str").alias("lo"), F.max("h_str").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")
        )
        return stored(found.filter("n > 1"), "minimisers")

    @cached_property
    def places(self) -> DataFrame:
        """doc_id, th, start, count, h_min, h_str, pivot, kind and string of all super-k-mers with a minimiser that repeats.

        kind 0: equal strings only, 1: to be compared, 2: to be counted window by window; the string is null for kind 0.
        """
        several = F.col("lo") != F.col("hi")
        again = bitmap(self.minimisers, "h_min", self.bits)
        mixed_ = bitmap(self.minimisers.filter(several), "h_min", self.bits)
        hot = bitmap(self.minimisers.filter(several & (F.col("n") > self.hot)), "h_min", self.bits)
        context = self.frame.sparkSession.sparkContext
        shared = context.broadcast((again, mixed_, hot if hot.data.any() else None))
        hashes, cut, window, k, strings = self.hashes, self.slices, self.window, self.k, self.strings

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            again, several, hot = shared.value
            for part in cut(batches):
                s = segments(*hashes(part), window, k)
                keep = np.flatnonzero(again.has(s.h_min)) if len(s.row) else s.row
                row, at, start, count, pivot, h_min, h_str = (
                    x[keep] for x in (s.row, s.at, s.start, s.count, s.pivot, s.h_min, s.h_str)
                )
                kind = several.has(h_min).astype(np.int32)
                if hot is not None:
                    kind += kind * hot.has(h_min)
                # One string of equal ones is enough in a slice.
                _, one = np.unique(h_str, return_index=True)
                carry = np.zeros(len(kind), bool)
                carry[one] = kind[one] > 0
                own = np.flatnonzero(carry)
                packed = strings(part, at[own], count[own] + window - 1)
                index = np.zeros(len(kind), np.int64)
                index[own] = np.arange(len(own))
                text = packed.take(pa.array(index, mask=~carry))
                ints = [pa.array(x.astype(np.int32)) for x in (start, count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        part.column("th").take(pa.array(row)),
                        *ints,
                        pa.array(h_min.astype(np.int64)),
                        pa.array(h_str.astype(np.int64)),
                        pa.array(pivot.astype(np.int32)),
                        pa.array(kind),
                        text,
                    ],
                    ["doc_id", "th", "start", "count", "h_min", "h_str", "pivot", "kind", "string"],
                )

        schema = "doc_id bigint, th bigint, start int, count int, h_min bigint, h_str bigint, pivot int, kind int, string binary"
        return stored(self.frame.mapInArrow(emit, schema), "places")


def groups(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.Table]:
    """Rows sorted by h_min in tables that never divide a group, of about ``limit`` bytes of strings."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h_min").to_numpy()
        breaks = (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist()
        if held and held[-1].column("h_min")[-1].as_py() != h[0]:
            breaks.insert(0, 0)
        if size + batch.nbytes >= limit and breaks:
            yield pa.Table.from_batches([*held, batch.slice(0, breaks[-1])])
            held, size = [], 0
            batch = batch.slice(breaks[-1])
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def window_runs(flags: np.ndarray, first: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring flagged windows with one owner and one ``first``: owner, start, end, first. Sorted by owner and place."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (owner[at][1:] != owner[at][:-1]) | (place[at][1:] != place[at][:-1] + 1) | (first[at][1:] != first[at][:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return owner[at[begin]], place[at[begin]], place[at[end]] + 1, first[at[begin]]


def removals(corpus: Corpus, compare: Callable[[pa.Table], tuple[np.ndarray, ...]], once: bool) -> DataFrame:
    """doc_id, th, runs: windows that repeat, as runs of their starts with the least doc_id that has them.

    ``compare`` gets whole groups (h_min, h_str, count, pivot, n, first, string) and returns row, start, end and first of runs.
    ``once``: a window counts even if it occurs in one place only, which no caller sees as it belongs to no earlier document.
    """
    places = corpus.places
    alone = corpus.minimisers.filter("lo = hi").select(
        "h_min", F.col("lo").alias("h_str"), F.lit(0).alias("a"), F.lit(None).cast("int").alias("b"), "first"
    )
    doc = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max))
    strings = places.filter("kind = 1").groupBy("h_min", "h_str").agg(
        F.max("string").alias("string"), F.first("count").alias("count"), F.first("pivot").alias("pivot"),
        F.count(F.lit(1)).alias("n"), F.min(doc).alias("first"),
    )
    columns = ["h_min", "h_str", "count", "pivot", "n", "first", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            table = group.combine_chunks()
            row, start, end, first = compare(table)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("h_min").take(at).combine_chunks(),
                    table.column("h_str").take(at).combine_chunks(),
                    pa.array(start.astype(np.int32)),
                    pa.array(end.astype(np.int32)),
                    pa.array(first.astype(np.int64)),
                ],
                ["h_min", "h_str", "a", "b", "first"],
            )

    sorted_ = strings.select(*columns).repartition("h_min").sortWithinPartitions("h_min", "h_str")
    compared = sorted_.mapInArrow(run, "h_min bigint, h_str bigint, a int, b int, first bigint")
    results = alone.unionByName(compared).unionByName(_one_by_one(corpus, places))
    joined = places.join(results, ["h_min", "h_str"])
    begin = F.col("start") + F.col("a")
    end = F.col("start") + F.coalesce("b", "count")
    hits = joined.select("doc_id", "th", F.struct(begin.alias("start"), end.alias("end"), "first").alias("run"))
    if once:
        hits = hits.filter(F.col("run.first") < doc)
    return hits.groupBy("doc_id", "th").agg(F.collect_set("run").alias("runs"))


def _one_by_one(corpus: Corpus, places: DataFrame) -> DataFrame:
    """Results for hot minimisers: each window is a row, counted by two hashes of its symbols with sums before the shuffle."""
    doc = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max))
    strings = places.filter("kind = 2").groupBy("h_min", "h_str").agg(
        F.max("string").alias("string"), F.first("count").alias("count"), F.count(F.lit(1)).alias("n"), F.min(doc).alias("first")
    )
    window, unpack = corpus.window, corpus.unpack

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                symbols, offsets = unpack(part.column("string"))
                count = np.diff(offsets) - window + 1
                at = spread(offsets[:-1], count)
                row = pa.array(np.repeat(np.arange(part.num_rows), count))
                one, two = run_hashes(symbols, window), run_hashes(mixed(symbols + _M1), window)
                names = ["h_min", "h_str", "n", "first"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(row) for c in names), pa.array((at - np.repeat(offsets[:-1], count)).astype(np.int32)),
                     pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64))],
                    [*names, "a", "w1", "w2"],
                )

    rows = stored(
        strings.select("h_min", "h_str", "n", "first", "string").mapInArrow(
            spell, "h_min bigint, h_str bigint, n bigint, first bigint, a int, w1 bigint, w2 bigint"
        ),
        "windows",
    )
    total = rows.groupBy("w1", "w2").agg(F.sum("n").alias("_n"), F.min("first").alias("_first")).filter("_n > 1")
    return rows.join(total, ["w1", "w2"]).select("h_min", "h_str", "a", (F.col("a") + 1).alias("b"), F.col("_first").alias("first"))
