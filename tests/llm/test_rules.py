import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastelake.llm import decontam, quality, secrets, toxicity
from tastelake.llm.queries import ORACLE_SQL, QUERIES
from tastelake.session import work_path
from tests.compare import duck, duck_rows, spark_rows
from tests.llm.conftest import listed, sentence


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_check_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    names, got = spark_rows(QUERIES[name](spark, folder))
    want_names, want, _ = duck_rows(duck(folder), ORACLE_SQL[name])
    assert names == want_names and got == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_check_sql_on_special_rows(spark, docs, rows, name, tmp_path):
    import duckdb

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "x y"), (5, "one"), (6, rows[7][1]), (7, ""), (6, "Twice B")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(10, 1, 0), (10, 0, None), (41, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    big = "<p>" + "é" * 600
    pages = [(1, "u", big), (4, None, big), (None, "u", big), (2, "u", None), (3, "u", "short"), (5, "u", "short"), (4, "u", big)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    r = random.Random(9)
    vectors = [(i, i % 3, [r.choice((0.1, 0.2, 0.4)) for _ in range(5)]) for i in range(320)]
    vectors += [(400, None, [0.1] * 5), (500, 1, None), (501, 1, [None] * 5), (502, 1, [float("nan")] * 5), (None, 1, [0.1] * 5), (503, 0, [0.4] * 5)] * 2
    spark.createDataFrame(vectors, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    names, got = spark_rows(QUERIES[name](spark, str(tmp_path)))
    want_names, want, _ = duck_rows(con, ORACLE_SQL[name])
    assert names == want_names and got == want


def test_binomial_tail(spark):
    for n, k, p in [(10, 0, 0.1), (100, 3, 0.1), (5000, 10, 0.005), (200_000, 900, 0.005), (7, 7, 0.5), (50, 20, 0.1)]:
        got = spark.range(1).select(F.lit(float(n)).alias("n"), F.lit(float(k)).alias("k")).select(quality.binomial_tail("n", "k", p)).first()[0]
        terms = [math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)]
        assert got == 1 if k >= n * p else got == pytest.approx(sum(terms), rel=1e-6)


def test_cutoffs_limit_false_rejections(spark):
    r = random.Random(3)
    data = [(i, "en", 100, 500, r.randint(0, 3) if i % 4 else r.randint(30, 90), 0, 0, 5) for i in range(8000)]
    features = spark.createDataFrame(data, "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(8000)], "doc_id bigint, quality int")
    limits = quality.cutoffs(features, labels).collect()
    assert len(limits) == 1 and 3 < limits[0]["max_symbols"] <= 30 and limits[0]["max_lines"] is None
    few = quality.cutoffs(features.filter("doc_id < 40"), labels).collect()
    assert few == []
    noise = labels.withColumn("quality", (F.col("doc_id") % 7 > 0).cast("int"))
    assert quality.cutoffs(features, noise).collect() == []


def test_kept_documents_has_all_columns(docs, nothing, spark):
    labels = spark.createDataFrame([(10, 1)], "doc_id bigint, quality int")
    got = quality.kept_documents(docs, labels)
    assert got.columns == docs.columns
    want = quality.quality_rules(docs, labels).filter("kept").select("doc_id")
    assert listed(got.select("doc_id")) == listed(want)
    assert quality.kept_documents(nothing, labels).collect() == []


def test_automaton_equals_brute_force():
    r = random.Random(4)
    for _ in range(60):
        items = [(str(i), r.choices("abc", k=r.randint(0, 9))) for i in range(r.randint(0, 5))]
        text = r.choices("abcd", k=40)
        own = decontam.Automaton(items, 4)
        hit, names = set(), set()
        for first, stop, found in own.matches([own.ids.get(w, -1) for w in text]):
            hit |= set(range(first, stop))
            names |= set(found)
        want_hit, want_names = set(), set()
        for name, w in items:
            n = min(4, len(w))
            for j in range(len(w) - n + 1 if n else 0):
                for at in range(len(text) - n + 1):
                    if text[at : at + n] == w[j : j + n]:
                        want_hit |= set(range(at, at + n))
                        want_names.add(name)
        assert (hit, names) == (want_hit, want_names)


def test_decontamination_in_blocks_and_cuts(spark, docs, rows, nothing):
    passage = rows[25][1].split()[20:60]
    bench = spark.createDataFrame([(1, " ".join(passage[:25])), (2, " ".join(passage[15:])), (3, "one"), (4, None)], "item_id bigint, text string")
    one = listed(decontam.report(decontam.scan(docs, bench)))
    assert one == listed(decontam.report(decontam.scan(docs, bench, block_words=10)))
    assert sum(r[-1] for r in one) >= 7
    got = decontam.decontaminate(docs, bench)
    assert got.columns == docs.columns
    text = got.filter(F.col("doc_id") == rows[25][0]).first()
    assert " ".join(passage[:10]) not in text["text"] and text["n_chars"] == len(text["text"])
    assert got.filter("doc_id = 3").count() == 0  # all of it is an item
    assert decontam.decontaminate(nothing, bench).collect() == []
    empty = bench.limit(0)
    assert decontam.scan(docs, empty).filter("size(hits) > 0").count() == 0


def test_ledger_scans_each_pair_once(spark, docs, nothing):
    path = work_path(spark, "ledger")
    secrets.update_ledger(docs, path, secrets.BASE)
    n = secrets.ledger(spark, path).count()
    assert n == docs.select(secrets.blob()).distinct().count()
    secrets.update_ledger(docs, path, secrets.BASE)
    assert secrets.ledger(spark, path).count() == n  # nothing unseen
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("token: abcdefgh")))
    secrets.update_ledger(more, path, secrets.BASE)
    assert secrets.ledger(spark, path).count() == n + 1
    secrets.update_ledger(more, path)  # the added rules are unseen for every blob
    assert secrets.ledger(spark, path).count() == 2 * (n + 1)
    assert listed(secrets.report(secrets.findings(more, path))) == listed(secrets.report(secrets.scan(more)))
    assert secrets.scan(nothing).collect() == []


def test_masked(docs, rows, nothing):
    got = secrets.masked(docs)
    assert got.columns == docs.columns
    r = got.filter("doc_id = 64").first()
    assert r["text"] == "[SECRET]\" secret: abc [SECRET] [SECRET] é [SECRET]" and r["n_chars"] == len(r["text"])
    plain = {(x["doc_id"], x["text"]) for x in got.filter("doc_id is null or doc_id not in (61, 64)").collect()}
    assert plain == {(x[0], x[1]) for x in rows if x[0] not in (61, 64)}
    assert secrets.masked(nothing).collect() == []


def test_toxicity_held_out(spark, docs, nothing):
    r = random.Random(8)
    bad = ["grum" + "".join(r.choices("abcde", k=3)) for _ in range(300)]
    data = []
    for i in range(700):
        w = sentence(r, r.randint(5, 80)).split()
        if i % 5 == 1:
            w[r.randrange(len(w))] = r.choice(bad)
            w[r.randrange(len(w))] = r.choice(bad)
        data.append((i, " ".join(w), int(i % 5 == 1)))
    made = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    got = toxicity.toxicity(made.select("doc_id", "text"), made.select("doc_id", "toxic")).join(made, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 700 and sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    rated = toxicity.toxicity(docs, made.select("doc_id", "toxic")).collect()
    assert len(rated) == docs.count() and all(0 <= r["score"] <= 1 for r in rated)
    assert toxicity.toxicity(nothing, made.select("doc_id", "toxic")).collect() == []
    none = toxicity.toxicity(docs, made.select("doc_id", "toxic").limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}


def test_toxicity_grams_never_share_an_entry(spark):
    from tastelake.llm.segments import mixed

    def place(grams):  # the hash slot of a gram among 2 ** 21
        return mixed(grams.astype(np.uint64)) & np.uint64((1 << 21) - 1)

    rare = toxicity.spelled(pa.array(["qzxjk"]))[0][1:]
    letters = np.frombuffer(b"abcdefghilmnoprstuvwy", np.uint8).astype(np.int64)
    common = np.zeros(1, np.int64)
    for _ in range(5):
        common = (common[:, None] << 8 | letters).ravel()
    common = common[np.isin(place(common), place(rare))]
    assert len(set(place(common))) >= 4
    ordinary = " ".join(int(g).to_bytes(5, "big").decode() for g in common)
    docs = spark.createDataFrame([("qzxjk other", 1)] + [(ordinary, 0)] * 300, "text string, toxic int")
    ratio, _ = toxicity.train(docs.select(F.split("text", " ").alias("w"), "toxic")).words(pa.array(["qzxjk"]))
    assert ratio[0] > 5


def test_toxicity_learns_spellings_of_the_curves_fold(spark):
    r = random.Random(3)
    data = []
    for i in range(1200):
        w, k = sentence(r, 30).split(), zlib.crc32(str(i).encode()) % 5
        toxic = int(i % 4 == 1)
        if toxic:  # one spelling is labelled in fold 1 only
            w[r.randrange(30)] = "wokkipuz" if k == 0 or k == 1 and i % 8 == 1 else "grumvash"
        data.append((i, " ".join(w), toxic))
    made = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    got = toxicity.toxicity(made.select("doc_id", "text"), made.select("doc_id", "toxic")).filter("held_out").join(made, "doc_id").collect()
    assert sum(x["predicted"] for x in got if x["toxic"]) >= 0.9 * sum(x["toxic"] for x in got)
    assert sum(x["predicted"] for x in got if not x["toxic"]) <= 0.1 * len(got)


def direct_log_ratio(toxic, ordinary, word):
    """Interpolated Kneser-Ney of order 5 written out: class counts at the top, continuation counts of both classes below."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT

    def grams(w):
        text = b"\x02" * (order - 1) + w.encode() + b"\x03"
        return [text[i : i + order] for i in range(len(text) - order + 1)]

    classes = [[g for w in side for g in grams(w)] for side in (toxic, ordinary)]
    kinds = {order: set(classes[0]) | set(classes[1])}
    for k in range(order - 1, 0, -1):
        kinds[k] = {g[1:] for g in kinds[k + 1]}

    def before(g):  # different bytes seen before a shorter gram
        return sum(x[1:] == g for x in kinds[len(g) + 1])

    def backoff(g):
        if len(g) == 1:
            total = len(kinds[2])
            return max(before(g) - d, 0) / total + d / 256
        same = [x for x in kinds[len(g)] if x[:-1] == g[:-1]]
        total = sum(before(x) for x in same)
        return max(before(g) - d, 0) / total + d * len(same) / total * backoff(g[1:])

    def p(side, g):
        same = [x for x in side if x[:-1] == g[:-1]]
        weight = d * len(set(same)) / len(same) if same else 1.0
        top = max(same.count(g) - d, 0) / len(same) if same else 0.0
        return weight, top + weight * (backoff(g[1:]) if g in kinds[order] else 0)

    out = 0.0
    for g in grams(word):
        (w1, p1), (w0, p0) = p(classes[0], g), p(classes[1], g)
        out += math.log(p1 / p0) if g in kinds[order] else math.log(w1 / w0)
    return out


def test_toxicity_is_kneser_ney(spark):
    toxic, ordinary = "grumvash grumble ash vash ash".split(), "grain ash rumble mash brain stumble".split()
    docs = spark.createDataFrame([(" ".join(toxic), 1), (" ".join(ordinary), 0)], "text string, toxic int")
    model = toxicity.train(docs.select(F.split("text", " ").alias("w"), "toxic"))
    asked = ["grumvash", "grumble", "ash", "mash", "grumb", "stash", "é", "zzz"]
    ratio, size = model.words(pa.array(asked))
    assert size.tolist() == [len(w.encode()) + 1 for w in asked]
    assert ratio == pytest.approx([direct_log_ratio(toxic, ordinary, w) for w in asked], abs=1e-5)


def test_toxicity_by_keys_equals_the_model_in_memory(spark, docs, monkeypatch):
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").collect()
    labels = spark.createDataFrame([(r["doc_id"], int(i % 3 == 0)) for i, r in enumerate(texts)], "doc_id bigint, toxic int")
    columns = ("doc_id", "held_out", "score")

    def scores():
        return sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in toxicity.toxicity(docs, labels).select(*columns).collect()))

    broadcast = scores()
    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(toxicity, "collected", lambda tables: pytest.fail("the model came to the driver"))
    joined = scores()
    assert [r[:3] for r in joined] == [r[:3] for r in broadcast] and len(joined) == docs.count()
    assert [r[3] for r in joined] == pytest.approx([r[3] for r in broadcast], abs=1e-9)


def test_toxicity_model_as_tables_without_grams(spark, nothing, monkeypatch):
    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", -1)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert toxicity.toxicity(nothing, labels).collect() == []


def test_raised_rule_version_gives_its_own_spans(spark):
    from dataclasses import replace

    docs = spark.createDataFrame([(1, "0123456789abcdef01234567 " + "0123456789abcdef" * 3)], "doc_id bigint, text string")
    path = work_path(spark, "ledger")
    first = secrets.Rule("hex", 1, "[0-9a-f]{24,}", 0, 24)
    raised = replace(first, version=2, pattern="[0-9a-f]{40,}", least=40)
    own, more = secrets.Rule("one", 1, "0123"), secrets.Rule("two", 1, "0123")
    assert secrets.report(secrets.scan(docs, path, (first,))).first()["spans"] == "hex:0:24,hex:25:73"
    assert secrets.report(secrets.scan(docs, path, (raised,))).first()["spans"] == "hex:25:73"
    assert secrets.report(secrets.scan(docs, path, (first,))).first()["spans"] == "hex:0:24,hex:25:73"
    both = secrets.report(secrets.scan(docs, path, (more, own))).first()["spans"]
    assert both.startswith("two:0:4,one:0:4,two:16:20") or both.startswith("two:0:4,one:0:4")


def test_windows_of_a_null_item_count(spark):
    text = " ".join(f"word{chr(97 + i)}" for i in range(14))
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, text), (None, "single"), (7, "here")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontam.report(decontam.scan(docs, items)).collect()}
    assert got[1]["n_hit"] == 14 and got[1]["contaminated"] and got[1]["n_items"] == 0
    assert got[2]["n_hit"] == 1 and got[2]["n_items"] == 1
