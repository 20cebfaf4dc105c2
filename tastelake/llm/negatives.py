"""Hard negatives of anchor vectors by exact integer products.

Vectors become integers, ``floor(scale * x)``. Anchors are cut into blocks, all rows into at most ``BLOCKS`` blocks; a cell is one block of each. Its
anchors come first and stay, its rows stream past in tiles. Anchors x tile is multiplied by Strassen's recursion on int64 tiles that are
padded with zeros, and each anchor keeps its best entries in a heap. Heaps of an anchor's cells are merged by Spark.

1. Positives: the first ``positives`` other rows of the anchor's label; only rows of one label are multiplied.
2. Negatives: with the positives' scores known, one heap per positive takes rows of other labels whose score lies in the positive's window.

Recursion ends at ``LEAF`` rows or columns. A leaf is multiplied in doubles if every sum in it is below 2 ** 53, so exact, else in int64. Scores are 64-bit
integers: where a sum leaves their range it wraps, as int64 additions do, and components beyond +-2 ** 62 count as that.

Rows with a null id, label or vector, or with any null or non-finite component take no part. Shorter vectors are padded with zeros. A repeated
row counts as often as it occurs, a repeated anchor once (the first by label, then vector). Anchors without positives, and positives without
negatives, give no rows; so does an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastelake.llm.best import Heaps
from tastelake.llm.common import offsets_of, slices
from tastelake.operators.ordering import top_n
from tastelake.session import stored

POSITIVES, NEGATIVES, WINDOW, SCALE = 5, 10, (30, 90), 256.0
#: Anchors of a cell, least rows of a block of all rows, and most such blocks: with more rows the blocks grow, as they only stream.
ANCHOR_BLOCK, ROW_BLOCK, BLOCKS = 16_384, 2_048, 64
#: Side of a tile, and of the products that end the recursion.
TILE, LEAF = 1_024, 16
_LOW = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, exactly (modulo 2 ** 64)."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) == 0:
        return np.zeros((m, n), np.int64)
    levels = 0
    while min(m, k, n) > leaf << levels:
        levels += 1
    unit = 1 << levels
    a, b = _padded(a, unit, unit), _padded(b, unit, unit)
    # Each level adds up to two blocks on either side before it multiplies.
    top = int(np.abs(a).max()) * int(np.abs(b).max()) * 4**levels * (a.shape[1] // unit)
    return _product(a, b, levels, top < 2**53)[:m, :n]


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return np.pad(x, ((0, -x.shape[0] % rows), (0, -x.shape[1] % columns)))


def _product(a: np.ndarray, b: np.ndarray, levels: int, doubles: bool) -> np.ndarray:
    if levels == 0:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if doubles else a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    down = levels - 1, doubles
    p1 = _product(a11 + a22, b11 + b22, *down)
    p2 = _product(a21 + a22, b11, *down)
    p3 = _product(a11, b12 - b22, *down)
    p4 = _product(a22, b21 - b11, *down)
    p5 = _product(a11 + a12, b22, *down)
    p6 = _product(a21 - a11, b11 + b12, *down)
    p7 = _product(a12 - a22, b21 + b22, *down)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def whole_numbers(col: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of a list array as an int64 matrix; shorter rows are padded with zeros."""
    bounds = offsets_of(col).astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.float64)
    whole = np.clip(np.floor(flat * scale), -(2.0**62), 2.0**62).astype(np.int64)
    sizes = np.diff(bounds)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and sizes.min() == width:
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


def of_width(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


class Cell:
    """The anchors of a cell, sorted by label and id, and their heaps."""

    def __init__(self, batches: list[pa.RecordBatch], scale: float):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.vectors = whole_numbers(table.column("vector").combine_chunks(), scale)[order]
        self.given = [table.column("given").combine_chunks()[int(i)].as_py() or [] for i in order]

    def products(self, batch: pa.RecordBatch, scale: float, same_label: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Anchor rows, ids and labels of a tile's rows, and their scores."""
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        vectors = whole_numbers(batch.column("vector"), scale)
        width = max(self.vectors.shape[1], vectors.shape[1])
        self.vectors, vectors = of_width(self.vectors, width), of_width(vectors, width)
        if same_label:
            groups = [np.flatnonzero(labels == own) for own in np.intersect1d(labels, self.labels)]
        else:
            groups = [np.arange(len(ids))]
        for rows in groups:
            first, stop = 0, len(self.ids)
            if same_label:
                first, stop = np.searchsorted(self.labels, labels[rows[0]], "left"), np.searchsorted(self.labels, labels[rows[0]], "right")
            for begin in range(0, len(rows), TILE):
                part = rows[begin : begin + TILE]
                for at in range(first, stop, TILE):
                    own = slice(at, min(at + TILE, stop))
                    yield own, ids[part], labels[part], strassen(self.vectors[own], vectors[part].T)


def offer(heaps: Heaps, group: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
    """Gives allowed entries of a score tile to the heaps of its rows: those at or above the row's floor and its k-th score here."""
    allowed &= scores >= heaps.floor[group][:, None]
    if np.count_nonzero(allowed) > 4 * heaps.k * len(group) and len(ids) > heaps.k:
        open_ = np.where(allowed, scores, _LOW)
        allowed &= scores >= np.partition(open_, len(ids) - heaps.k, axis=1)[:, len(ids) - heaps.k][:, None]
    row, column = np.nonzero(allowed)
    heaps.add(group[row], scores[row, column], ids[column], np.zeros(len(row), np.int64))


def best_positives(cell: Cell, batches: Iterator[pa.RecordBatch], scale: float, k: int) -> list[np.ndarray]:
    """anchor_id, id and score of each anchor's best rows of its own label."""
    heaps = Heaps(len(cell.ids), k)
    for batch in batches:
        for own, ids, _, scores in cell.products(batch, scale, True):
            offer(heaps, np.arange(own.start, own.stop), scores, cell.ids[own][:, None] != ids[None, :], ids)
    group, score, tie, _ = heaps.cut()
    return [cell.ids[group], tie, score]


def best_negatives(cell: Cell, batches: Iterator[pa.RecordBatch], scale: float, k: int, window: tuple[int, int]) -> list[np.ndarray]:
    """anchor_id, place of the positive, its id and score, id and score of the best rows of other labels in its window."""
    n, places = len(cell.ids), max((len(g) for g in cell.given), default=0)
    known = np.zeros((n, places), bool)
    positive, score_of = np.zeros((n, places), np.int64), np.zeros((n, places), np.int64)
    for i, given in enumerate(cell.given):
        for j, x in enumerate(given):
            known[i, j], positive[i, j], score_of[i, j] = True, x["id"], x["score"]
    # Whole numbers s with window[0] * p <= 100 * s <= window[1] * p.
    least, most = -((-window[0] * score_of) // 100), (window[1] * score_of) // 100
    heaps = Heaps(n * places, k)
    for batch in batches:
        for own, ids, labels, scores in cell.products(batch, scale, False):
            other = cell.labels[own][:, None] != labels[None, :]
            for j in range(places):
                inside = other & (scores >= least[own, j][:, None]) & (scores <= most[own, j][:, None]) & known[own, j][:, None]
                offer(heaps, np.arange(own.start, own.stop) * places + j, scores, inside, ids)
    group, score, tie, _ = heaps.cut()
    row, place = group // max(places, 1), group % max(places, 1)
    return [cell.ids[row], place, positive[row, place], score_of[row, place], tie, score]


def over_cells(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], work, schema: str, scale: float) -> DataFrame:
    """``work(cell, batches)`` of every cell of anchors (vec_id, label, vector, given) x rows (vec_id, label, vector)."""
    anchor_blocks, row_blocks = sizes

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("_o", every(row_blocks)).select((block(anchor_blocks) * row_blocks + F.col("_o")).alias("cell"), F.lit(0).alias("kind"), "*")
    right = rows.withColumn("_o", every(anchor_blocks)).select((F.col("_o") * row_blocks + block(row_blocks)).alias("cell"), F.lit(1).alias("kind"), "*")
    both = left.drop("_o").unionByName(right.drop("_o"), allowMissingColumns=True)
    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = [pa.int64()] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = runs_of(batches)
        key, kind, batch = next(parts, (None, None, None))
        while batch is not None:
            own, now = [], key
            while batch is not None and key == now and kind == 0:
                own.append(batch)
                key, kind, batch = next(parts, (None, None, None))
            streamed: list = [key, kind, batch]

            def tiles() -> Iterator[pa.RecordBatch]:
                while streamed[2] is not None and streamed[0] == now:
                    yield streamed[2]
                    streamed[:] = next(parts, (None, None, None))

            if own:
                found = work(Cell(own, scale), tiles())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], names)
            for _ in tiles():  # a cell without anchors
                pass
            key, kind, batch = streamed

    # The number is given, so that few but heavy cells are not put together.
    dealt = both.repartition(max(anchor_blocks * row_blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cell")
    return dealt.sortWithinPartitions("cell", "kind").mapInArrow(run, schema)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """cell, kind and the rows of one run of both, in slices of a bounded number of bytes."""
    for batch in slices(batches, "vector"):
        cell, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield int(cell[a]), int(kind[a]), batch.slice(a, b - a)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id, label and vector of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()
    rows = vectors.filter(given & finite)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col(vector).alias("vector"))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    *,
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    scale: float = SCALE,
    anchor_block: int = ANCHOR_BLOCK,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and the ``vector`` column; ``anchor`` picks the anchors by vec_id or label. Rows of other labels count as
    negatives of a positive with score p if ``window[0] * p <= 100 * score <= window[1] * p``.
    """
    rows = usable(vectors, vector)
    chosen = rows.filter(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x"))
    chosen = stored(chosen.select("vec_id", "x.label", "x.vector"), "anchors")
    sizes = max(1, -(-chosen.count() // anchor_block)), max(1, min(BLOCKS, -(-vectors.count() // row_block)))
    pair = "array<struct<id:bigint,score:bigint>>"

    def first(cell: Cell, tiles: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        return best_positives(cell, tiles, scale, positives)

    def second(cell: Cell, tiles: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        return best_negatives(cell, tiles, scale, negatives, window)

    found = over_cells(chosen.withColumn("given", F.lit(None).cast(pair)), rows, sizes, first, "anchor_id bigint, id bigint, score bigint", scale)
    found = top_n(found, ["anchor_id"], [F.col("score").desc(), F.col("id")], positives)
    lists = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("given"))
    given = F.transform("given", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    led = chosen.join(lists.select(F.col("anchor_id").alias("vec_id"), given.alias("given")), "vec_id")
    led = stored(led.select("vec_id", "label", "vector", "given"), "positives")
    schema = "anchor_id bigint, place bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    mined = over_cells(led, rows, sizes, second, schema, scale)
    mined = top_n(mined, ["anchor_id", "place"], [F.col("negative_score").desc(), F.col("negative_id")], negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
