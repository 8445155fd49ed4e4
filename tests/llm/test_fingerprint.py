import datetime
import decimal
import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelyard.llm import fingerprint


def likeness(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def edited(own, other):
    n = len(own) // 2
    return own[: len(own) - n] + other[:n]


def test_edits_neighbours_and_equal_texts(docs, corpus):
    rows = fingerprint.compare(docs).collect()
    assert len(rows) == len(corpus)
    ordered = sorted(((i, t or "") for i, t, *_ in corpus if i is not None), key=lambda r: r[0])
    ordered = [(None, corpus[8][1])] + ordered
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    for k, (i, t) in enumerate(ordered):
        if i == 7:  # repeated
            continue
        r = got[i][0]
        e = edited(t, ordered[(k + 1) % len(ordered)][1])
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest(), i
        assert r["near_edited"] == np.mean([r["fingerprint"][j : j + 4] == r["edited_fingerprint"][j : j + 4] for j in range(0, 4 * fingerprint.K, 4)])
    same = {}
    for r in rows:
        text = next(t or "" for i, t, *_ in corpus if i == r["doc_id"])
        assert same.setdefault(" ".join(text.split()), r["fingerprint"]) == r["fingerprint"]


def test_collision_rate_is_the_generalised_jaccard(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for i in range(60):
        own = rng.integers(0, 60, 150)
        other = np.where(rng.random(150) < i / 60, own, rng.integers(0, 200, 150))
        pairs.append((i, " ".join(f"w{x}" for x in own), " ".join(f"w{x}" for x in other)))
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    a = fingerprint.signatures(df, ["i"], "a").withColumnRenamed("fp", "fa")
    b = fingerprint.signatures(df, ["i"], "b").withColumnRenamed("fp", "fb")
    got = {r["i"]: r["v"] for r in a.join(b, "i").select("i", fingerprint.likeness("fa", "fb").alias("v")).collect()}
    off = np.array([got[i] - likeness(x, y) for i, x, y in pairs])
    assert abs(off.mean()) < 0.03 and off.std() < 1.5 * math.sqrt(0.25 / fingerprint.K)


def test_weights_count(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a a a a a a a a b"), (3, "b a"), (4, ""), (5, " \t ")], "i long, t string")
    fp = {r["i"]: r["fp"] for r in fingerprint.signatures(df, ["i"], "t").collect()}
    assert fp[1] == fp[3] != fp[2] and fp[4] == fp[5] == "0000" * fingerprint.K


def test_single_and_none_and_native(spark, no_docs):
    one = spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")
    r = fingerprint.compare(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(edited("a b c d", "a b c d").encode()).hexdigest()
    assert fingerprint.compare(no_docs).filter(F.lit(True)).count() == 0
    assert "Python" not in fingerprint.compare(one)._jdf.queryExecution().executedPlan().toString()


def test_small_ranges_chain(spark):
    rows = [(i * i, f"w{i} x{i % 7} common") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = fingerprint.neighbours(df, range_bytes=200)
    got = {r["doc_id"]: r["next_text"] for r in found.filter("not extra").collect()}
    assert got == {i: rows[(k + 1) % 300][1] for k, (i, _) in enumerate(rows)}
    assert found.filter("not extra").groupBy("range").count().agg(F.max("count")).first()[0] <= 4


def test_outlier_ids_and_hot_rows_are_cut(spark):
    rows = [(i, f"w{i}") for i in range(100)] + [(2**62, "far"), (-(2**62), "near")] + [(50, f"other {i}") for i in range(200)] + [(60, "the same row")] * 300 + [(None, f"none {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = fingerprint.neighbours(df, range_bytes=800)
    assert found.filter("not extra").groupBy("range").count().agg(F.max("count")).first()[0] <= 14
    h = {t: v for t, v in df.select("text", F.xxhash64("text")).distinct().collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
    want = sorted((repr(i), t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered))
    assert sorted((repr(r["doc_id"]), r["text"], r["next_text"]) for r in found.filter("not extra").collect()) == want


def test_ids_of_any_type(spark):
    texts_ = [f"w{i} x{i % 5} common" for i in range(80)]
    for kind, ids in (("string", [f"id,\"{i % 9}é{i}" for i in range(80)]), ("double", [i / 3 - 9 for i in range(80)]), ("date", [datetime.date(2020, 1, 1) + datetime.timedelta(days=i * 3) for i in range(80)]), ("decimal(20,2)", [decimal.Decimal(i) / 4 for i in range(80)])):
        rows = [*zip(ids, texts_), (None, "no id")]
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
        found = fingerprint.neighbours(df, range_bytes=300)
        ordered = sorted(rows, key=lambda r: (r[0] is not None, (r[0].encode() if kind == "string" else r[0]) if r[0] is not None else 0))
        want = {t: ordered[(k + 1) % len(ordered)][1] for k, (_, t) in enumerate(ordered)}
        assert {r["text"]: r["next_text"] for r in found.filter("not extra").collect()} == want, kind
        assert found.filter("not extra").select("range").distinct().count() > 10
        assert fingerprint.compare(df).count() == 81
