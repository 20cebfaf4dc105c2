"""Removal of repeated byte strings by column-wise construction of suffix orders.

Super-k-mers of bytes that share a minimiser are laid under each other with the minimisers in one column. The columns are then taken
from right to left; each round inserts one byte of every string. The order of the strings by what begins in the current column follows from the
order of the round before by a stable sort on the inserted bytes, which are the Burrows-Wheeler transform of that column, and
the common prefixes of neighbours follow from the least common prefix between their former places, plus one. A window
repeats if a neighbour shares ``window`` bytes with it. Equal windows have their minimiser in the same place, so no order
across columns is needed; the sorted shuffle files are the sequential files that the rounds read. See ``segments`` for the
passes and the treatment of hot keys.

Null texts are empty; texts shorter than a window keep all. Every row is a document of its own, so repeated rows remove each other.
Strings are judged on the input and never reach across documents. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.llm.common import bytes_of, slices, small_batches, spread, texts
from tastelake.llm.segments import HOT, Corpus, mixed, removals, window_runs

WINDOW, RUN = 200, 24
#: Bytes of a slice; each byte takes a number of 64 bits in several arrays.
SLICE = 1 << 20
_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = bytes_of(part.column("text"))
    return _SYMBOLS[data], bounds


def _strings(part: pa.RecordBatch, at: np.ndarray, length: np.ndarray) -> pa.Array:
    data, _ = bytes_of(part.column("text"))
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    chosen = np.ascontiguousarray(data[spread(at, length)])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(chosen)])


def _unpack(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = bytes_of(strings)
    return _SYMBOLS[data], bounds


def column_rounds(data: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Flags by string and column offset: does the window that starts there occur in another string of the group?

    String i has its bytes from ``begin[i]`` and covers columns -left[i] to right[i] - 1; groups are ascending numbers. The
    result is one flat array, string after string, with a place for every window start.
    """
    length = left + right
    n_windows = length - window + 1
    base = np.cumsum(n_windows) - n_windows
    flags = np.zeros(int(n_windows.sum()), bool)
    entering = np.argsort(-right, kind="stable")
    entered = 0
    order = np.zeros(0, np.int64)
    common = np.zeros(0, np.int64)  # common[i]: shared prefix of order[i - 1] and order[i]
    for column in range(int(right.max()) - 1, -int(left.max()) - 1, -1):
        stop = int(np.searchsorted(-right[entering], -column, side="left"))
        if stop > entered:  # strings whose last byte stands in this column: empty so far, so first of their group
            order = np.concatenate([entering[entered:stop], order])
            common = np.concatenate([np.zeros(stop - entered, np.int64), common])
            entered = stop
        here = left[order] >= -column
        if not here.all():  # strings that have ended on the left; the next one inherits the smaller common prefix
            kept = np.flatnonzero(here)
            if not len(kept):
                order, common = order[:0], common[:0]
                continue
            from_ = np.append(0, kept[:-1] + 1)
            common = np.minimum.reduceat(common, from_)[: len(kept)] if kept[-1] == len(here) - 1 else np.minimum.reduceat(common[: kept[-1] + 1], from_)
            order = order[kept]
        if not len(order):
            continue
        symbol = data[begin[order] + column + left[order]]
        key = group[order] * 256 + symbol
        turn = np.argsort(key, kind="stable")
        sorted_ = key[turn]
        equal = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
        low, high = turn[equal - 1], turn[equal]
        shared = common[high]
        far = np.flatnonzero(high - low > 1)
        if len(far):  # least of common[low + 1 .. high]
            pairs = np.column_stack([low[far] + 1, high[far] + 1]).ravel()
            shared[far] = np.minimum.reduceat(np.append(common, 0), pairs)[::2]
        common = np.zeros(len(order), np.int64)
        common[equal] = shared + 1
        order = order[turn]
        if column <= 0:
            long = common >= window
            hit = long.copy()
            hit[:-1] |= long[1:]
            who = order[hit]
            flags[base[who] + column + left[who]] = True
    return flags


def repeated_windows(table: pa.Table, window: int) -> tuple[np.ndarray, ...]:
    data, bounds = bytes_of(table.column("string").combine_chunks())
    left = table.column("pivot").to_numpy().astype(np.int64)
    length = np.diff(bounds)
    group = np.cumsum(np.append(0, np.diff(table.column("h_min").to_numpy()) != 0))
    flags = column_rounds(data, bounds[:-1], left, length - left, group, window)
    n_windows = length - window + 1
    row = np.repeat(np.arange(len(length)), n_windows)
    flags |= table.column("n").to_numpy()[row] > 1
    return window_runs(flags, np.zeros(len(row), np.int64), row, spread(np.zeros(len(length), np.int64), n_windows))


def corpus(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> Corpus:
    small_batches(docs.sparkSession)
    frame = texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return Corpus(frame, window, min(run, window), _hashes, _strings, _unpack, lambda b: slices(b, "text", SLICE), hot)


def without_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row."""
    found = removals(corpus(docs, window, hot=hot), lambda t: repeated_windows(t, window), once=False)
    keyed = texts(docs).withColumn("th", F.xxhash64("text"))
    spans = found.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "runs")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))
    joined = keyed.join(spans, same, "left").select("doc_id", "text", F.expr("transform(runs, x -> struct(x.start as start, x.end as end))").alias("runs"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_bytes else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                raw, n_spans = text.encode(), 0
                rest = raw
                if own:
                    gone = np.zeros(len(raw) + 1, np.int64)
                    for r in own:
                        gone[r["start"]] += 1
                        gone[r["end"] - 1 + window] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest))
            n, removed, n_spans, digest, rest = zip(*out) if out else ((), (), (), (), ())
            columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, removed, n_spans)), pa.array(digest, pa.string())]
            if keep_bytes:
                columns.append(pa.array(rest, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    return joined.mapInArrow(cut, schema)
