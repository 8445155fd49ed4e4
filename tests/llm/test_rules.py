"""Measures and verdicts against plain loops; planted texts that each rule catches."""

import re

import pytest
from pyspark.sql import functions as F

from panelyard.llm import rules

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    ws = [w for w in SPACES.split(text) if w]
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at, hit = {}, set()
    for i in range(len(ws) - 7):
        at.setdefault(tuple(ws[i : i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            hit |= {p + k for p in places for k in range(8)}
    stop = sum(re.sub("[.,;:]+$", "", w.lower()) in rules.STOP_WORDS for w in ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), sum(bool(re.search(rules.LETTER, w)) for w in ws), stop,
            len(ls), len(ls) - len(set(ls)), sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in ls), sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in ls), len(hit))


def verdict(m):
    m = dict(zip(rules.MEASURES, m))

    def bad(r):
        per = 1 if r.per is None else m[r.per]
        return bool(per) and ((r.low is not None and m[r.measure] / per < r.low) or (r.high is not None and m[r.measure] / per > r.high))

    return any(map(bad, rules.BASE)), [r.name for r in (*rules.BASE, *rules.RULES) if bad(r)]


PROSE = "the cat sat on the mat and it was one of those days that are made for sleep by day and for play at night in the old house"
PLANTED = {
    "few": "only a few words here",
    "prose": PROSE,
    "repeat": " ".join([PROSE] * 3),
    "overlap": "a b a b a b a b a b a b a b a b a b a b a b a b of the and to",
    "symbols": " ".join(w + "***" for w in PROSE.split()),
    "lines": "\n".join([PROSE[:40], "the rest is of no use to us", PROSE[:40], PROSE[:40], PROSE[:40], " ", PROSE[:40]]),
    "bullets": "\n".join(f"- {w} of the {k}" for k, w in enumerate(PROSE.split())),
    "ellipsis": "\n".join(f"{w} of the more..." for w in PROSE.split()),
    "no stops": " ".join(f"wort{k}x" for k in "abcdefghijklmnopqrstuvwxyz"),
    "digits": " ".join(f"{k} the" if k % 3 == 0 else str(k) for k in range(60)),
    "long words": " ".join(["the"] + ["x" * 30 + str(k) for k in range(12)] + ["of"]) * 2,
    "other spaces": "one two three\x0bfour\x0cfive\r\nsix\tseven  eight",
    "emoji": "\U0001f600 " * 25,
}


def test_measures_against_loops(spark, docs, corpus):
    rows = [(k, t) for k, t in PLANTED.items()] + [(f"c{i}", r[1]) for i, r in enumerate(corpus)] + [("long", " ".join(["der die das und"] * 5000))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    for k, t in rows:
        m = plain(t)
        base, failed = verdict(m)
        assert tuple(got[k][x] for x in rules.MEASURES) == m, k
        assert (got[k].base_failed, got[k].failed, got[k].kept) == (base, failed, not failed), k
    caught = {"few": "few_words", "repeat": "repeated_words", "symbols": "symbols", "lines": "repeated_lines", "bullets": "bullet_lines", "ellipsis": "ellipsis_lines", "no stops": "stop_words", "digits": "letters", "long words": "word_length"}
    assert got["prose"].kept and all(rule in got[k].failed for k, rule in caught.items())


def test_one_projection_without_user_functions(docs):
    plan = rules.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("split(") <= 2  # words and lines, once each


def test_rows_come_back(spark, docs, no_docs, corpus):
    assert rules.judge(docs).count() == len(corpus)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r[0]) for r in corpus if not verdict(plain(r[1]))[1])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert rules.judge(no_docs).count() == rules.keep(no_docs).count() == 0
    clash = docs.withColumns({"n_words": F.lit("x"), "judged": F.lit(1), "row": F.lit(2), "kept": F.lit(3)})
    assert rules.keep(clash).columns == clash.columns and rules.judge(clash).count() == len(corpus)


def test_own_table(docs):
    only = (rules.Rule("short", "n_words", high=50),)
    assert {tuple(r.failed) for r in rules.judged(docs, {"doc_id": F.col("doc_id")}, only, ()).collect()} <= {(), ("short",)}


def test_labels(spark):
    folder = "/root/testdata/sf0.01"
    try:
        d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    except Exception:
        pytest.skip("no tables here")
    r = rules.judge(d).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((F.col("kept") | (F.col("n_words") < 20)).cast("int")).alias("long_kept")).collect()
    by = {x.quality: x for x in r}
    assert by[1].long_kept > 0.99 and by[0].kept < 0.4
