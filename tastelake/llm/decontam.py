"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

The automaton of the items' words is built on the driver from a bounded block of items and broadcast; documents stream through it word by
word, and the longest match that ends at each word says whether a window of ``window`` words, or a whole shorter item, ends there. Larger
benchmarks are cut into blocks of about ``block_words`` words, each scanned against all documents, and the hits are joined. Words that are
in no item, and pairs of neighbours that are in none, cannot lie inside a match: a NumPy look-up drops them first, so
Python walks through candidate runs only.

Null texts have no words, items without words match nothing, repeated rows are judged alike, an empty benchmark or document
table gives zero hits or no rows. ``item_id`` counts as text; rows of one item_id are separate texts of the same item.
Windows of a null item_id count as hits, but it has no name, so it is not among the items.
Of the documents only the columns that are asked for are read, and the added columns have fixed names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.llm.common import lower_ascii, small_batches
from tastelake.session import stored

WINDOW, BLOCK_WORDS = 10, 250_000
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def item_words(text: str = "text"):
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), NO_WORD, -1), "")


class Automaton:
    """Suffix automaton of several word sequences, with the items of every window and of every short item."""

    def __init__(self, items: Sequence[tuple[str | None, Sequence[str]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if len(words)]
        for _, words in coded:
            self.last = 0
            for w in words:
                self._extend(w)
        self.windows: dict[int, set[str]] = {}
        self.shorts: dict[int, list[tuple[int, str]]] = {}
        for name, words in coded:
            for at, state, _ in self._walk(words):
                if at + 1 >= window:
                    self.windows.setdefault(self._of_length(state, window), set()).add(name)
            if len(words) < window:
                self.shorts.setdefault(self._of_length(state, len(words)), []).append((len(words), name))
        # The nearest state on the way to the root, itself included, that ends a short item.
        self.nearest = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__) if self.shorts else ():
            self.nearest[state] = state if state in self.shorts else self.nearest[self.link[state]]
        self.shortest = min([window, *(len(w) for _, w in coded)])
        pairs = {(a, b) for _, w in coded for a, b in zip(w, w[1:])}
        self.bits = max(16, (8 * len(pairs)).bit_length())
        self.pairs = np.zeros(1 << self.bits, bool)
        if pairs:
            first, second = np.array(sorted(pairs), np.uint64).T
            self.pairs[self._slot(first, second)] = True

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return mixed >> np.uint64(64 - self.bits)

    def _extend(self, w: int) -> None:
        p, step = self.last, self.next
        if (q := step[p].get(w)) is not None:
            self.last = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
            return
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        self.last = new

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _of_length(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _walk(self, words: Sequence[int]) -> Iterator[tuple[int, int, int]]:
        """Place, state and length of the longest match that ends there."""
        state = length = 0
        for at, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(w)) is not None:
                state, length = to, length + 1
            yield at, state, length

    def matches(self, words: Sequence[int]) -> Iterator[tuple[int, int, set[str] | tuple[str, ...]]]:
        """(first word, word after the last, items) of every occurrence that ends at a word."""
        for at, state, length in self._walk(words):
            if length >= self.window:
                yield at + 1 - self.window, at + 1, self.windows[self._of_length(state, self.window)]
            state = self.nearest[state]
            while state > 0:
                for n, name in self.shorts[state]:
                    if n <= length:
                        yield at + 1 - n, at + 1, (name,)
                state = self.nearest[self.link[state]]


def scan_words(automaton: Automaton, vocabulary: pa.Array, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Hit flags of all words of the rows one after another, the n + 1 offsets, and the items of each row with hits."""
    offsets = np.asarray(words.offsets, np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    flat = words.flatten()
    hit = np.zeros(len(flat), bool)
    found: dict[int, set[str]] = {}
    if not len(flat) or not len(vocabulary):
        return hit, offsets, found
    ids = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = ids >= 0
    # joined[i]: word i + 1 may follow word i inside a match.
    joined = known[:-1] & known[1:]
    at = np.flatnonzero(joined)
    joined[at] = automaton.pairs[automaton._slot(ids[at], ids[at + 1])]
    cuts = offsets[1:-1]
    joined[cuts[(cuts > 0) & (cuts < len(flat))] - 1] = False
    begins = np.flatnonzero(known & ~np.append(False, joined))
    ends = np.flatnonzero(known & ~np.append(joined, False)) + 1
    long = ends - begins >= automaton.shortest
    rows = np.searchsorted(offsets, begins, side="right") - 1
    for row, b, e in zip(rows[long].tolist(), begins[long].tolist(), ends[long].tolist()):
        for first, stop, items in automaton.matches(ids[b:e].tolist()):
            hit[b + first : b + stop] = True
            found.setdefault(row, set()).update(items)
    return hit, offsets, found


def runs(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """Items with their words in blocks; one block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), item_words().alias("words")).filter("size(words) > 0")
    items = stored(items, "items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for block in range(n):
        rows = items.filter(F.pmod(F.xxhash64("name", "words"), F.lit(n)) == block).collect()
        yield sorted(((r["name"], r["words"]) for r in rows), key=lambda x: (x[0] is None, x[0] or "", x[1]))


HITS = "array<struct<start:int,end:int>>"


def scan(
    docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``keep`` columns, n_words, hits (runs of hit words) and items (sorted ids) of every row of docs."""
    return scan_rows(docs, benchmark, keep, window, block_words).select("row.*", "n_words", "hits", "items")


def scan_rows(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str], window: int, block_words: int) -> DataFrame:
    """As ``scan``, with the kept columns in a struct ``row``, so that none clashes with the added ones."""
    spark = docs.sparkSession
    small_batches(spark)
    automata = [spark.sparkContext.broadcast(Automaton(b, window)) for b in item_blocks(benchmark, block_words)]
    marked = docs.select(item_words().alias("words"), F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"))
    if len(automata) == 1:
        return _scanned(marked, automata[0], "row")
    # Rows with the same kept columns and words have the same hits, so these are the key.
    marked = marked.withColumn("key", F.sha2(F.to_json(F.struct("words", "row")), 256))
    hits = None
    for automaton in automata:
        part = _scanned(marked, automaton, "key").filter(F.size("hits") > 0)
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("h"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    start = F.array().cast(HITS)

    def step(out, x):
        last = F.element_at(out, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(grown))
        return F.when(F.size(out) == 0, F.array(x)).when(last["end"] >= x["start"], longer).otherwise(F.array_append(out, x))

    merged = merged.select("key", F.aggregate("h", start, step).alias("hits"), "items")
    return marked.join(merged, "key", "left").select(
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.coalesce("hits", F.array().cast(HITS)).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _scanned(docs: DataFrame, automaton, keep: str) -> DataFrame:
    from tastelake.llm.common import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton.value
        vocabulary = pa.array(list(own.ids), pa.string())
        for part in slices(batches, "words"):
            hit, offsets, found = scan_words(own, vocabulary, part.column("words"))
            spans = [runs(hit[offsets[i] : offsets[i + 1]]) if i in found else [] for i in range(part.num_rows)]
            columns = [part.column(keep), pa.array(np.diff(offsets), pa.int64())]
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            columns.append(pa.array([sorted(x for x in found.get(i, ()) if x is not None) for i in range(part.num_rows)], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, [keep, "n_words", "hits", "items"])

    kind = docs.schema[keep].dataType.simpleString()
    if keep == "row":
        kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema[keep].dataType.fields) + ">"
    return docs.select(keep, "words").mapInArrow(run, f"{keep} {kind}, n_words bigint, hits {HITS}, items array<string>")


def report(scanned: DataFrame) -> DataFrame:
    """The digest of ``scan``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without(text: str, hits: Sequence[dict[str, int]]) -> str:
    """The text without the hit words, the separators between them included; the words beside a cut stay apart."""
    places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for h in hits:
        out.append(text[at : places[h["start"]][0]])
        at = places[h["end"] - 1][1]
    return "".join(out) + text[at:]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = 1, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """docs without the benchmark passages: rows of which more than ``max_coverage`` of the words are hit go, from the others
    the runs of at least ``min_words`` hit words are cut out. Same columns; an ``n_chars`` column follows the new text."""
    schema, names = docs.schema, docs.columns
    scanned = scan_rows(docs, benchmark, names, window, block_words)
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    left = scanned.filter(hit <= max_coverage * F.col("n_words"))
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits").to_pylist()
            columns = batch.column("row").flatten()
            if any(hits):
                texts = [
                    without(t, [h for h in own if h["end"] - h["start"] >= min_words]) if own else t
                    for t, own in zip(columns[place].to_pylist(), hits)
                ]
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    cleaned = left.mapInArrow(cut, schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else cleaned
