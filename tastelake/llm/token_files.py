"""Token ids in binary files: frequency-ranked, byte-aligned variable-length, control bytes apart from data bytes.

Ids are replaced by their rank by frequency, so the common ones take one byte. Four values share a control byte with two bits each
(bytes of the value less one); the data bytes follow in their own run. The reader turns control bytes into lengths with
a table of 256 rows and gathers the bytes with NumPy.

A file is a run of blocks. A block: ``TLK1``, then unsigned 32-bit little-endian numbers of documents, control bytes and data
bytes, then a validity byte, a signed 64-bit doc_id and an unsigned 32-bit token count per document, the control bytes, the data
bytes, and a line end that Spark's writer puts after each row. Files are written by Spark in ascending doc_id
order (range partitions, sorted inside), so they lie wherever Spark can write. The rank table, one row per
token id that occurs, lies beside them as Parquet; it is bounded by the vocabulary.

Null texts are empty (one end id). Null doc_ids come first, repeated rows follow each other. An empty table
gives no files with rows and an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastelake.llm.common import offsets_of, slices, small_batches, spread, texts
from tastelake.llm.tokens import crc32, encoded
from tastelake.session import stored, work_path

MAGIC = b"TLK1"
HEAD = struct.Struct("<4sIII")
#: Token bytes (two or four an id) of one file, and of one block.
FILE_BYTES, BLOCK_BYTES = 16 << 20, 2 << 20
#: Lengths of the four values of a control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    size = 1 + (values > 0xFF) + (values > 0xFFFF).astype(np.int64) + (values > 0xFFFFFF)
    padded = np.ones(-(-len(values) // 4) * 4, np.int64)
    padded[: len(values)] = size
    control = ((padded.reshape(-1, 4) - 1) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    return control, raw[np.arange(4) < size[:, None]]


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    out = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    return b"".join((
        HEAD.pack(MAGIC, len(doc_ids), len(control), len(data)),
        bytes(x is not None for x in doc_ids),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.asarray(counts, "<u4").tobytes(),
        control.tobytes(),
        data.tobytes(),
    ))


def read_blocks(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, token counts and ranks of each block of a file."""
    at = 0
    while at < len(content):
        magic, n, n_control, n_data = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at += HEAD.size
        valid = content[at : at + n]
        ids = np.frombuffer(content, "<i8", n, at + n)
        counts = np.frombuffer(content, "<u4", n, at + 9 * n)
        at += 13 * n
        control = np.frombuffer(content, np.uint8, n_control, at)
        data = np.frombuffer(content, np.uint8, n_data, at + n_control)
        at += n_control + n_data + 1
        yield [int(x) if ok else None for x, ok in zip(ids, valid)], counts, decode_values(control, data, int(counts.sum()))


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the ids as little-endian bytes (two an id where all fit, else four)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, offsets in encoded(batches, tokenizer):
            width = 2 if len(ids) == 0 or ids.max() < 1 << 16 else 4
            raw = ids.astype(f"<u{width}").tobytes()
            bounds = (offsets * width).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), binary], ["doc_id", "n_tokens", "ids"]
            )

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def ids_in(part: pa.RecordBatch) -> np.ndarray:
    """Ids of all rows of a slice of ``tokenized``."""
    col = part.column("ids")
    bounds = offsets_of(col)
    raw = np.frombuffer(col.buffers()[2], np.uint8)
    width = np.where(part.column("n_tokens").to_numpy() * 4 == np.diff(bounds), 4, 2)
    if (width == width[0]).all():
        return raw[bounds[0] : bounds[-1]].view(f"<u{width[0]}").astype(np.uint32)
    return np.concatenate([raw[b:e].view(f"<u{w}").astype(np.uint32) for b, e, w in zip(bounds, bounds[1:], width)])


def frequency_ranks(tokens: DataFrame) -> DataFrame:
    """id, n, rank: most frequent first, then by id. One row per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in slices(batches, "ids"):
            own = np.bincount(ids_in(part))
            if len(own) > len(total):
                own, total = total, own.astype(np.int64)
            total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    counts = tokens.mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.col("n").desc(), "id")
    return counts.select("id", "n", (F.row_number().over(order) - 1).alias("rank"))


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Files ``path``/tokens of the texts' ids in ascending doc_id order, and ``path``/ranks."""
    spark = docs.sparkSession
    plain = tokenized(docs, tokenizer)
    at = work_path(spark, "tokens")
    plain.write.option("compression", "zstd").parquet(at)
    tokens = spark.read.schema(plain.schema).parquet(at)
    ranks = stored(frequency_ranks(tokens), "ranks")
    ranks.write.parquet(f"{path}/ranks")
    by_id = rank_table(ranks)
    size = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, -(-2 * size // FILE_BYTES))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids", BLOCK_BYTES):
            block = write_block(part.column("doc_id").to_pylist(), part.column("n_tokens").to_numpy(), by_id[ids_in(part)])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    ordered = tokens.repartitionByRange(files, "doc_id", F.crc32("ids")).sortWithinPartitions("doc_id", F.crc32("ids"))
    ordered.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value")).write.text(f"{path}/tokens")


def rank_table(ranks: DataFrame) -> np.ndarray:
    """Rank by id; at most one row per id of the vocabulary comes to the driver."""
    found = ranks.select("id", "rank").toPandas()
    table = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.uint32)
    table[found["id"].to_numpy()] = found["rank"].to_numpy()
    return table


def file_number(path: Column) -> Column:
    """Spark's number in a file name, as five digits are not always enough, with the number of the split file behind it."""
    name = F.substring_index(path, "/", -1)
    return F.struct(F.regexp_extract(name, "part-([0-9]+)", 1).cast("bigint"), F.regexp_extract(name, "-c([0-9]+)", 1).cast("string"), name)


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, in file order: start counts all ids before it."""
    small_batches(spark)
    by_rank = rank_table(spark.read.schema("rank bigint, id bigint").parquet(f"{path}/ranks").select(F.col("rank").alias("id"), F.col("id").alias("rank")))
    files = spark.read.format("binaryFile").load(f"{path}/tokens").select("path", "content")
    schema = "path string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                content, done = batch.column("content")[row].as_buffer(), 0
                for doc_ids, counts, ranks in read_blocks(memoryview(content)):
                    ids, ends = by_rank[ranks], np.cumsum(counts, dtype=np.int64)
                    columns = [
                        pa.array([batch.column("path")[row].as_py()] * len(doc_ids)),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(done + ends - counts),
                        pa.array(counts, pa.int64()),
                        pa.array([crc32(ids[e - c : e]) for e, c in zip(ends, counts)], pa.int64()),
                    ]
                    if keep_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    done += int(ends[-1])
                    yield pa.RecordBatch.from_arrays(columns, ["path", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = stored(files.mapInArrow(decode, schema), "decoded")
    before = Window.orderBy(file_number(F.col("path"))).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    firsts = rows.groupBy("path").agg(F.sum("n_tokens").alias("_n"))
    firsts = firsts.select("path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    kept = ["n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    return rows.join(firsts, "path").select("doc_id", (F.col("_first") + F.col("inside")).alias("start"), *kept)
