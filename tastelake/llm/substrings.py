"""Removal of repeated passages: words under a window that also starts in a document with a smaller doc_id.

Super-k-mers of words travel as one packed string (words joined by blanks) to the bucket of their minimiser; there the words get numbers and
the windows, as rows of numbers, are sorted and counted exactly. See ``segments`` for the passes and the treatment of hot keys.

Null and empty texts have no words; texts shorter than a window keep all. Rows with one doc_id are one document to the
rule, so they never remove each other's words; a null doc_id counts as larger than all others. Windows are judged on the input. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.llm.common import offsets_of, slices, small_batches, spread, texts, words
from tastelake.llm.segments import HOT, Corpus, mixed, removals, window_runs

WINDOW, RUN = 50, 8


def _hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = part.column("h")
    bounds = offsets_of(col).astype(np.int64)
    return col.values.to_numpy()[bounds[0] : bounds[-1]].view(np.uint64), bounds - bounds[0]


def _strings(part: pa.RecordBatch, at: np.ndarray, length: np.ndarray) -> pa.Array:
    flat = part.column("w").flatten() if "w" in part.schema.names else pa.array([], pa.string())
    chosen = flat.take(pa.array(spread(at, length)))
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), chosen), " ").cast(pa.binary())


def _codes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of all words (equal words, equal numbers), the bounds of the strings, and how many different words."""
    lists = pc.split_pattern(strings.cast(pa.string()), " ")
    coded = lists.flatten().dictionary_encode()
    bounds = offsets_of(lists).astype(np.int64)
    return coded.indices.to_numpy(), bounds - bounds[0], coded


def _unpack(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes from the words' bytes, for the windows of hot minimisers."""
    codes, bounds, coded = _codes(strings)
    own = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()]
    return np.array(own, np.uint64)[codes], bounds


def sorted_windows(table: pa.Table, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that occur more than once in the group, with the least doc_id: row, start, end, first."""
    codes, bounds, _ = _codes(table.column("string").combine_chunks())
    n_windows = np.diff(bounds) - window + 1
    at = spread(bounds[:-1], n_windows)
    row = np.repeat(np.arange(len(n_windows)), n_windows)
    group = np.cumsum(np.append(0, np.diff(table.column("h_min").to_numpy()) != 0))
    # One window is one fixed-width byte string: its group, then its words, as big-endian numbers above 0.
    spelled = np.empty((len(at), window + 1), ">u4")
    spelled[:, 0] = group[row] + 1
    spelled[:, 1:] = np.lib.stride_tricks.sliding_window_view(codes, window)[at] + 1
    key = np.ascontiguousarray(spelled).view(f"S{4 * (window + 1)}").ravel()
    order = np.argsort(key, kind="stable")
    same = np.append(False, key[order][1:] == key[order][:-1])
    begin = np.flatnonzero(~same)
    n, first = table.column("n").to_numpy()[row], table.column("first").to_numpy()[row]
    total, least = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    which = np.cumsum(~same) - 1
    total[order] = np.add.reduceat(n[order], begin)[which]
    least[order] = np.minimum.reduceat(first[order], begin)[which]
    return window_runs(total > 1, least, row, at - np.repeat(bounds[:-1], n_windows))


def corpus(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> Corpus:
    small_batches(docs.sparkSession)
    split = texts(docs).select("doc_id", F.xxhash64("text").alias("th"), words().alias("w"))
    frame = split.select("doc_id", "th", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    return Corpus(frame, window, min(run, window), _hashes, _strings, _unpack, lambda b: slices(b, "h"), hot)


def without_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words as text) of every row."""
    found = removals(corpus(docs, window, hot=hot), lambda t: sorted_windows(t, window), once=True)
    keyed = texts(docs).withColumn("th", F.xxhash64("text"))
    spans = found.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "runs")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))
    joined = keyed.join(spans, same, "left").select("doc_id", "text", F.expr("transform(runs, x -> struct(x.start as start, x.end as end))").alias("runs"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if keep_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                split = text.encode().split()
                if own:
                    gone = np.zeros(len(split) + 1, np.int64)
                    for r in own:
                        gone[r["start"]] += 1
                        gone[r["end"] - 1 + window] -= 1
                    kept = [w for w, g in zip(split, np.cumsum(gone).tolist()) if not g]
                else:
                    kept = split
                rest = b" ".join(kept)
                out.append((len(split), len(split) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode()))
            n, removed, digest, rest = zip(*out) if out else ((), (), (), ())
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            if keep_text:
                columns.append(pa.array(rest, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    return joined.mapInArrow(cut, schema)
