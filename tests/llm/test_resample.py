"""Counts, gains, weights, noise and ranks against plain Python; draws follow the target."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(ws), [zlib.crc32(x.encode()) % 10000 for x in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]]


def plain(rows, target, percent=25, least=20):
    """rows: (doc_id, text); doc_id, n_features, weight, score, rank of each, sorted."""
    s, t = Counter(b for _, x in rows for b in runs(x)[1]), Counter(b for x in target for b in runs(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        n, f = runs(x)
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0)))) for b in f]
        w = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    take = percent * len(able) // 100
    got = [(r[0], *r[2:], k + 1 if k < take else None) for k, r in enumerate(able)] + [(r[0], *r[2:], None) for r in out if r[1] < least]
    return sorted(got, key=repr)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "an er th on in re st ou le mi"), (2, None), (3, "Anan ererth Onin 12 an er"), (4, "")], "item_id long, text string")


def test_against_loops(docs, corpus, target):
    got = sorted((tuple(r) for r in resample.resample(docs, target).collect()), key=repr)
    assert got == plain([(r[0], r[1]) for r in corpus], [r.text for r in target.collect()])
    assert sum(r[4] is not None for r in got) > 0


def test_chunks_split_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["Über", "x9", "a", "zwei", "3"], 1000))
    for chunk in (1, 2, 3, 7, 999, 1000, 1001):
        monkeypatch.setattr(resample, "_CHUNK", chunk)
        parts = list(resample.features(text.encode()))
        assert sum(n for n, _ in parts) == 1000 and Counter(np.concatenate([b for _, b in parts]).tolist()) == Counter(runs(text)[1])
    assert list(resample.features(None)) == list(resample.features(b" .,-")) == []


def test_counts_of_empty_and_many_parts(spark, docs, no_docs, corpus):
    want = np.bincount([b for r in corpus for b in runs(r[1])[1]], minlength=10000)
    assert (resample.bucket_counts(docs) == want).all() and (resample.bucket_counts(docs.repartition(13)) == want).all()
    assert resample.bucket_counts(no_docs).sum() == 0


def test_empty_tables(spark, docs, no_docs, target):
    assert resample.resample(no_docs, target).count() == 0
    assert resample.resample(docs, target.limit(0)).count() == docs.count()
    assert resample.drawn(no_docs, target).columns == no_docs.columns


def test_drawn_rows(docs, corpus, target):
    clash = docs.withColumns({"row": F.lit("r"), "n_words": F.lit(1), "weight": F.lit(2), "rank": F.lit(3)})
    got = resample.drawn(clash, target)
    assert got.columns == clash.columns
    want = [r for r in plain([(r[0], r[1]) for r in corpus], [r.text for r in target.collect()]) if r[4] is not None]
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in want)


def test_hot_id_is_ranked_whole(spark, target):
    rows = [(None if i % 3 else i, " ".join(["alpha beta"] * 15)) for i in range(3000)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), target).collect()
    ranks = sorted(r.rank for r in got if r.rank is not None)
    assert ranks == list(range(1, 751)) and len(got) == 3000


def test_draws_lean_to_the_target(spark):
    rows = [(i, " ".join(["wanted words come here often"] * 5 if i % 10 == 0 else [f"other {i % 7} text of no use"] * 5)) for i in range(2000)]
    target = spark.createDataFrame([("wanted words come here often",)] * 50, "text string")
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, percent=10).filter("rank is not null").collect()
    assert len(got) == 200 and sum(r.doc_id % 10 == 0 for r in got) > 150
