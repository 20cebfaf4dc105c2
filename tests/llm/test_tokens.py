import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tastelake.llm import packing, token_files
from tastelake.llm.tokens import Encoder
from tastelake.session import work_path
from tests.llm.conftest import listed

PATHS = [public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json")]


def plain_ids(path, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return [x.ids + [0] for x in own.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", PATHS)
def test_encoder_equals_library(path):
    r = random.Random(1)
    parts = [" ", "  ", "\n", "a", "Foo", "é", "É", "1", ".", ",", "'s", " ", "\t", "　", "́", "中文", "\x1c", "ß", "<|endoftext|>", "<|startoftext|>", "<|endof", "|>", "👍", "\x85", "İ"]
    texts = ["", " ", "x.\n\ny"] + ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(3000)]
    ids, ends = Encoder(path).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == plain_ids(path, texts)


@pytest.mark.parametrize("lengths", [[], [1], [2048] * 3, [1025] * 9, [700, 900, 1500] * 40, list(range(1, 2049)), [1] * 5000])
def test_plan_places_every_piece_once(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.plan_packing(counts)
    spans = {}
    for length, first, per, bins, sequence, offset in plan.slots:
        for k in range(bins):
            for j in range(per):
                spans.setdefault(sequence + k, []).append((offset + j * length, length))
    assert sum(len(s) for s in spans.values()) == len(lengths)
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert {k: v for k, v in plan.ranked.items() if v} == counts
    assert len(spans) >= -(-sum(lengths) // 2048)


def test_exact_complements_waste_nothing():
    plan = packing.plan_packing({1000: 10, 1048: 10, 500: 5, 548: 5, 300: 4, 700: 4})
    assert plan.sequences == -(-(20480 + 5240 + 4000) // 2048)


def test_packed_documents(docs, rows, nothing):
    want = []
    for row, ids in zip(rows, plain_ids(PATHS[0], [r[1] or "" for r in rows])):
        want += [(row[0], p // 2048, p, len(ids[p : p + 2048]), crc(ids[p : p + 2048])) for p in range(0, len(ids), 2048)]
    got = packing.pack_documents(docs, PATHS[0], keep_ids=True).collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(crc(r["ids"]) == r["ids_crc32"] for r in got)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    assert packing.pack_documents(nothing, PATHS[0]).collect() == []


def test_values_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1] * 7 + [3], np.uint32)
    control, data = token_files.encode_values(values)
    assert (token_files.decode_values(control, data, len(values)) == values).all()
    assert len(control) == -(-len(values) // 4)


def test_token_files(spark, docs, rows, nothing):
    path = work_path(spark, "t")
    token_files.write(docs, PATHS[1], path)
    got = token_files.read(spark, path, keep_ids=True).collect()
    want = [(r[0], ids) for r, ids in zip(rows, plain_ids(PATHS[1], [r[1] or "" for r in rows]))]
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == sorted((i or -1, ids) for i, ids in want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), crc(r["ids"]))
        at += r["n_tokens"]
    order = [r["doc_id"] or -1 for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    empty = work_path(spark, "t")
    token_files.write(nothing, PATHS[1], empty)
    assert token_files.read(spark, empty).collect() == []


def best_fit_decreasing(lengths, capacity=2048):
    from bisect import bisect_left, insort

    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        n += gap == capacity
        if gap > x:
            insort(gaps, gap - x)
    return n


@pytest.mark.parametrize("low, high, n", [(1, 2048, 5000), (600, 760, 2750), (20, 500, 4000), (900, 1200, 3000), (1, 30, 3000), (500, 2048, 2000)])
def test_never_more_sequences_than_best_fit(low, high, n):
    r = random.Random(low)
    lengths = [r.randint(low, high) for _ in range(n)]
    plan = packing.plan_packing({x: lengths.count(x) for x in set(lengths)})
    bound = -(-sum(lengths) // 2048)
    print(low, high, n, "sequences", plan.sequences, "best fit", best_fit_decreasing(lengths), "bound", bound)
    assert bound <= plan.sequences <= best_fit_decreasing(lengths)


def test_files_are_ordered_by_number(spark):
    from pyspark.sql import functions as F

    rows = spark.range(100_001).select(F.format_string("file:/a/part-%05d-0f3c-c000.txt", "id").alias("path"), "id")
    last = rows.orderBy(token_files.file_number(F.col("path")).desc()).limit(3).collect()
    assert [r["id"] for r in last] == [100_000, 99_999, 99_998]
