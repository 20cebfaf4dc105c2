"""Means of vectors over links between two kinds of ids, hop by hop, without a vector per link.

Links are packed in pieces of one part of the targets and one of the sources, a few bytes each. A task owns a group of target parts and a slice of the
vectors' components: it keeps the sums of its targets while the pieces and the packed vectors of one part of the sources after another stream past. So each link is shuffled once per
slice and each vector once per group of targets, of which there are ``GROUPS`` until their targets no longer fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastelake.session import stored

#: Links of a part, about; slices of the components at most; groups of targets, and least links of one; targets of a group at most, about.
PART_LINKS, SLICES, GROUPS, LEAST_LINKS, GROUP_TARGETS = 8_000_000, 8, 4, 200_000, 2_000_000
#: Ids of a packed row of vectors at most.
_PACKED = 50_000


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of each source, by a hash."""
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


def _ends(values: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, first and last-plus-one place of each run of equal values in a sorted array."""
    kinds, start = np.unique(values, return_index=True)
    return list(zip(kinds.tolist(), start.tolist(), [*start[1:].tolist(), len(values)]))


def _small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 up in as few bytes each as the largest needs, behind a byte that says how many."""
    size = next(b for b in (1, 2, 4, 8) if b == 8 or int(values.max(initial=0)) < 1 << 8 * b)
    return bytes([size]) + values.astype(f"u{size}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def _bounds(width: int) -> np.ndarray:
    slices = max(1, min(SLICES, width))
    return np.arange(slices + 1) * width // slices


def _packed(ids: np.ndarray, values: np.ndarray, number: int, parts: int) -> Iterator[tuple]:
    """Rows (slice, part, ids, values) of the vectors' components in one slice."""
    part = _part_of(ids, parts)
    order = np.argsort(part, kind="stable")
    for c, a, b in _ends(part[order]):
        for start in range(a, b, _PACKED):
            own = order[start : min(b, start + _PACKED)]
            yield number, c, ids[own].tobytes(), np.ascontiguousarray(values[own]).tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["slice", "part", "ids", "vectors"])


def packed_vectors(vectors: DataFrame, key: str, width: int, parts: int) -> DataFrame:
    """Vectors (``key``, vector) of one length as rows of many ids and one slice."""
    bounds = _bounds(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                if (np.diff(np.asarray(batch.column(1).offsets)) != width).any():
                    raise ValueError("vectors differ in length")
                whole = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
                for s in range(len(bounds) - 1):
                    rows = list(_packed(ids, whole[:, bounds[s] : bounds[s + 1]], s, parts))
                    yield _rows(rows)

    known = vectors.select(F.col(key).cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).dropna()
    return known.mapInArrow(run, "slice int, part int, ids binary, vectors binary")


class Links:
    """links(source, target), repeated ones counted as often; those with a null are left out. Ids are integers."""

    def __init__(self, links: DataFrame, source: str, target: str, parts: int):
        self.target, self.parts = target, parts
        rows = links.select(F.col(target).cast("bigint").alias("t"), F.col(source).cast("bigint").alias("s")).dropna()
        mine = F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int").alias("own")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            own, t, s = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            held.clear()
            order = np.argsort(own, kind="stable")
            for number, a, b in _ends(own[order]):
                at = order[a:b]
                targets, place = np.unique(t[at], return_inverse=True)
                yield piece(number, -1, len(targets), targets.tobytes(), b"", b"")
                sources = s[at]
                part = _part_of(sources, parts)
                by_part = np.lexsort((place, sources, part))
                for c, x, y in _ends(part[by_part]):
                    some = by_part[x:y]
                    ids, counts = np.unique(sources[some], return_counts=True)
                    steps = np.diff(ids.view(np.uint64), prepend=np.uint64(0))
                    yield piece(number, c, y - x, steps[:1].tobytes() + _small(steps[1:]), _small(counts), _small(place[some]))

        def piece(*values) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["own", "part", "n", "a", "b", "c"])

        dealt = rows.select(mine, "t", "s").repartitionById(parts, "own")
        self.pieces = stored(dealt.mapInArrow(pack, "own int, part int, n bigint, a binary, b binary, c binary"), "links")
        n_links, n_targets = self.pieces.agg(F.sum(F.when(F.col("part") >= 0, F.col("n"))), F.sum(F.when(F.col("part") < 0, F.col("n")))).first()
        wanted = max(min(GROUPS, (n_links or 0) // LEAST_LINKS), -(-(n_targets or 0) // GROUP_TARGETS), 1)
        self.groups = min(parts, wanted)

    def means(self, packed: DataFrame, width: int, last: bool) -> DataFrame:
        """Mean of the source vectors per target: rows as of ``packed_vectors``, or (target, d, x) when it is the ``last`` hop."""
        bounds, parts, groups, target = _bounds(width), self.parts, self.groups, self.target
        slices = len(bounds) - 1
        blank = F.lit(None).cast("binary")
        group = F.pmod(F.col("own"), F.lit(groups))
        every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: group * slices + s)).alias("cell")
        # a part's vectors come before its links, the lists of targets before all
        links = self.pieces.select(every, "part", F.lit(1).alias("kind"), "own", "a", "b", "c")
        each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * slices + F.col("slice"))).alias("cell")
        sent = packed.select(each, "part", F.lit(0).alias("kind"), F.lit(0).alias("own"), F.col("ids").alias("a"), F.col("vectors").alias("b"), blank.alias("c"))
        both = links.unionByName(sent).repartitionById(groups * slices, "cell").sortWithinPartitions("cell", "part", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, part, state = None, None, {}
            for batch in batches:
                for i in range(batch.num_rows):
                    new, now, kind, own, a, b, c = (batch.column(j)[i].as_py() for j in range(7))
                    if new != cell:
                        if cell is not None:
                            yield from done(cell, state)
                        cell, part, state = new, None, {}
                    k = int(np.diff(bounds)[cell % slices])
                    if now < 0:
                        targets = np.frombuffer(a, np.int64)
                        state[own] = targets, np.zeros((k, len(targets))), np.zeros(len(targets), np.int64)
                        continue
                    if now != part:
                        part, ids, vectors, ready = now, [np.zeros(0, np.int64)], [np.zeros((0, k))], False
                    if not kind:
                        ids.append(np.frombuffer(a, np.int64))
                        vectors.append(np.frombuffer(b, np.float64).reshape(-1, k))
                        continue
                    if not ready:
                        known, whole, ready = np.concatenate(ids), np.concatenate(vectors), True
                        order = np.argsort(known, kind="stable")
                        # an id with several vectors counts once for each of them
                        known, start, often = np.unique(known[order], return_index=True, return_counts=True)
                        whole = np.add.reduceat(whole[order].T, start, axis=1) if len(start) else whole.T
                    if len(known):
                        add(known, often, whole, state[own], a, b, c)
            if cell is not None:
                yield from done(cell, state)

        def add(known: np.ndarray, often: np.ndarray, whole: np.ndarray, sums: tuple, a: bytes, b: bytes, c: bytes) -> None:
            steps = np.concatenate([np.frombuffer(a[:8], np.uint64), _large(a[8:]).astype(np.uint64)])
            sources = np.cumsum(steps, dtype=np.uint64).view(np.int64)
            place = np.searchsorted(known, sources).clip(max=len(known) - 1)
            at = np.repeat(np.where(known[place] == sources, place, -1), _large(b))
            met = at >= 0
            at, to = at[met], _large(c)[met].astype(np.int64)
            n = len(sums[0])
            sums[2][:] += np.bincount(to, often[at], n).astype(np.int64)
            for d, row in enumerate(whole):
                sums[1][d] += np.bincount(to, row[at], n)

        def done(cell: int, state: dict) -> Iterator[pa.RecordBatch]:
            number = cell % slices
            for targets, sums, count in state.values():
                met = np.flatnonzero(count)
                for start in range(0, len(met), _PACKED):
                    own = met[start : start + _PACKED]
                    values = sums[:, own] / count[own]
                    if last:
                        ids, d = np.tile(targets[own], len(values)), np.repeat(np.arange(bounds[number], bounds[number + 1]), len(own))
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(d.astype(np.int32)), pa.array(values.reshape(-1))], [target, "d", "x"])
                    else:
                        yield _rows(list(_packed(targets[own], values.T, number, parts)))

        return both.mapInArrow(run, f"{target} bigint, d int, x double" if last else "slice int, part int, ids binary, vectors binary")
