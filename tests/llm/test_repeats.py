import hashlib
import random

import numpy as np
import pytest

from tastelake.llm import near, segments, substrings, suffixes
from tests.llm.conftest import listed


def brute_words(rows, window):
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    big = 1 << 62
    for i, w in split:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (big if i is None else i):
                gone |= set(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, window):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = {}
    for _, b in raw:
        for j in range(len(b) - window + 1):
            seen[b[j : j + window]] = seen.get(b[j : j + window], 0) + 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - window + 1):
            if seen[b[j : j + window]] > 1:
                gone[j : j + window] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_substring_removal(docs, rows, hot):
    assert listed(substrings.without_repeats(docs, hot=hot)) == brute_words(rows, 50)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_suffix_removal(docs, rows, hot):
    assert listed(suffixes.without_repeats(docs, hot=hot)) == brute_bytes(rows, 200)


def test_kept_text_and_empty_tables(docs, nothing):
    r = substrings.without_repeats(docs, keep_text=True).filter("doc_id = 11").first()
    assert r["kept"] == "" and r["n_removed"] == r["n_words"] == 160
    assert substrings.without_repeats(nothing).collect() == [] == suffixes.without_repeats(nothing).collect()


def test_segments_cover_each_window_once():
    r = np.random.default_rng(0)
    symbols = segments.mixed(r.integers(0, 4, 3000).astype(np.uint64))
    bounds = np.array([0, 0, 10, 500, 549, 3000])
    s = segments.segments(symbols, bounds, 50, 8)
    got = sorted((int(row), int(a) + k) for row, a, n in zip(s.row, s.start, s.count) for k in range(n))
    assert got == [(d, k) for d in range(5) for k in range(max(0, bounds[d + 1] - bounds[d] - 49))]
    assert ((s.pivot >= s.count - 1) & (s.pivot <= 42)).all()


def test_column_rounds_equal_brute_force():
    r = np.random.default_rng(2)
    for _ in range(30):
        n, window = int(r.integers(1, 12)), 6
        left, right = r.integers(0, 8, n), r.integers(6, 14, n)
        group = np.sort(r.integers(0, 3, n))
        length = left + right
        data = r.integers(0, 2, int(length.sum())).astype(np.uint8)
        begin = np.cumsum(length) - length
        flags = suffixes.column_rounds(data, begin, left, right, group, window)
        at = 0
        for i in range(n):
            for j in range(length[i] - window + 1):
                own, column = data[begin[i] + j : begin[i] + j + window].tolist(), j - left[i]
                twin = any(
                    k != i and group[k] == group[i] and 0 <= column + left[k] <= length[k] - window
                    and data[begin[k] + column + left[k] :][:window].tolist() == own for k in range(n)
                )
                if column <= 0:
                    assert flags[at] == twin
                at += 1


def brute_groups(rows, words, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t, *_ in rows:
        w = (t or "").translate(lower).encode().split()
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for a, row in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None] if sets[a] else [row[0]]
        least = min(ids) if ids and ids[0] is not None else None
        out.append((row[0], len(sets[a]), least, row[0] == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cold,cells", [(32, 2_000_000), (2, 2_000_000), (2, 300)])
def test_near_groups(docs, rows, cold, cells):
    assert listed(near.near_groups(docs, cold=cold, cell_values=cells)) == brute_groups(rows, 3, 85)


def test_near_groups_other_settings(docs, rows, nothing):
    assert listed(near.near_groups(docs, words=5, percent=80)) == brute_groups(rows, 5, 80)
    assert near.near_groups(nothing).collect() == []


def test_one_of_each(docs, rows, nothing):
    got = near.one_of_each(docs)
    assert got.columns == docs.columns
    ids = sorted((r["doc_id"] for r in got.select("doc_id").collect()), key=repr)
    groups = brute_groups(rows, 5, 80)
    want = sorted({least for _, n, least, _ in groups if n and least is not None}) + [i for i, n, _, _ in groups if not n]
    assert ids == sorted(want, key=repr)
    assert near.one_of_each(nothing).collect() == []


def test_hot_group_meets_a_member_with_many_own_values(spark):
    base = " ".join(hashlib.sha1(b"%d" % i).hexdigest()[:8] for i in range(302))
    own = "array_join(transform(sequence(1, {n}), j -> substr(sha1(concat(id, ' ', j)), 1, 8)), ' ')"
    made = spark.range(80_000).selectExpr("id AS doc_id", f"concat('{base} ', {own.format(n=50)}) AS text")
    shared = near.featured(spark.range(1).selectExpr("id AS doc_id", f"'{base}' AS text"), 3).first()["set"]
    sketches = near.featured(made, 3).selectExpr("doc_id", "slice(set, 1, 32) AS s").join(spark.createDataFrame([(shared,)], "b array<bigint>"))
    rare = sketches.filter("size(array_except(s, b)) >= 13").select("doc_id").limit(1)  # 13 of 32 values that nobody shares
    hot = spark.range(100_000, 100_060).selectExpr("id AS doc_id", f"concat('{base} ', {own.format(n=1)}) AS text")
    got = near.near_groups(hot.union(made.join(rare, "doc_id").select("doc_id", "text")).localCheckpoint()).collect()
    assert len(got) == 61 and len({x["component_id"] for x in got}) == 1
    assert near.apart(85, 32) == 26 and near.apart(80, 32) == 28


def test_contracted_edges_keep_components(spark):
    r = random.Random(11)
    edges = [(g * 1000 + r.randint(0, 60), g * 1000 + r.randint(0, 60)) for g in range(30) for _ in range(900)]
    edges += [(100_000 + i, 100_001 + i) for i in range(300)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)
    want = {x["id"]: x["root"] for x in near.connected(df).collect()}
    few = near.contracted(df)
    got = {x["id"]: x["root"] for x in near.connected(few).collect()}
    assert {i: x for i, x in want.items() if i != x} == {i: x for i, x in got.items() if i != x}
    assert few.count() <= 2 * len(want) < len(edges) / 5
    assert near.contracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("longest", [512, 4])
def test_texts_of_common_phrases_leave_large_clusters(spark, monkeypatch, longest):
    r = random.Random(5)
    phrases = [" ".join(f"w{r.randint(0, 9999)}" for _ in range(10)) for _ in range(40)]
    rows = [(i, " ".join(r.sample(phrases, 6))) for i in range(400)]
    rows += [(1000 + i, rows[i % 40][1] + f" own{i} end") for i in range(80)]
    rows += [(2000 + i, rows[i][1].replace(" ", " x ", 1)) for i in range(60)]
    held, verified = [], near.verified

    def spy(clusters, *rest):
        held.extend(x["s"] for x in clusters.groupBy("cluster").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect())
        return verified(clusters, *rest)

    monkeypatch.setattr(near, "verified", spy)
    monkeypatch.setattr(near, "LIST", longest, raising=False)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert listed(near.near_groups(docs, cold=2, cell_values=5000)) == brute_groups(rows, 3, 85)
    if longest == 512:
        assert held and max(held) < 5000  # one cluster of all texts before


def test_sketches_are_compared_on_their_union():
    r, k = np.random.default_rng(3), 16
    sets = [np.unique(r.integers(0, 40, r.integers(1, 50))).astype(np.int32) for _ in range(200)]
    sketches, n = np.full((len(sets), k), np.iinfo(np.int32).max, np.int32), np.array([len(s) for s in sets])
    for row, s in zip(sketches, sets):
        row[: min(k, len(s))] = s[:k]
    a, b = np.triu_indices(len(sets), 1)
    least = near.least_shared(60, k)

    def want(x, y):
        union, both = np.union1d(x, y), set(x) & set(y)
        if max(len(x), len(y)) <= k:
            return 100 * len(both) >= 60 * len(union)
        return len(set(union[:k]) & both) >= least * min(k, len(x), len(y))

    expected = [want(sets[i], sets[j]) for i, j in zip(a, b)]
    assert near.alike(sketches[a], sketches[b], n[a], n[b], 60).tolist() == expected and any(expected) and not all(expected)
