"""Exponential means, memberships, bridges, balance and outcomes against pandas and plain loops."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import events, outcomes, rotation, timing


def day(k):
    return date(2020, 1, 1) + timedelta(days=k)


@pytest.fixture(scope="module")
def series():
    rng = random.Random(5)
    rows = []
    for s, gaps, n in (("dense", 0.0, 900), ("holes", 0.4, 400), ("sparse", 0.97, 900), ("none", 1.0, 20), ("late", 0.0, 60)):
        for i in range(n):
            v = None if rng.random() < gaps or (s == "late" and i < 30) else rng.gauss(5, 3) * (1000 if i == 7 else 1)
            rows.append((day(i), s, v))
    return rows


@pytest.mark.parametrize(("alpha", "least"), [(0.5, 1), (1 / 14, 14), (0.9, 2), (0.02, 1), (1.0, 1)])
def test_ewm_is_that_of_pandas(spark, series, alpha, least):
    df = spark.createDataFrame(series, "trade_date date, ts_code string, v double").repartition(5)
    got = timing.ewm(df, "v", "y", alpha=alpha, least=least)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InPandas" not in plan
    p = got.toPandas().sort_values(["ts_code", "trade_date"], ignore_index=True)
    src = pd.DataFrame(series, columns=["trade_date", "ts_code", "v"]).sort_values(["ts_code", "trade_date"], ignore_index=True)
    want = src.groupby("ts_code")["v"].transform(lambda x: x.astype(float).ewm(alpha=alpha, adjust=False, min_periods=least).mean())
    assert len(p) == len(src) and (p["y"].isna() == want.isna()).all()
    assert np.allclose(p["y"].to_numpy(float), want.to_numpy(float), rtol=1e-11, atol=1e-12, equal_nan=True)


def test_rsi_and_denoised(spark):
    rng = random.Random(2)
    rows = [(day(i), f"s{k}", 10 + rng.random() * 3, None if rng.random() < 0.3 else rng.gauss(0, 1)) for k in range(6) for i in range(80)] + [(day(i), "flat", 4.0, None) for i in range(40)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, adj_close double, v double")
    src = pd.DataFrame(rows, columns=["trade_date", "ts_code", "adj_close", "v"]).sort_values(["ts_code", "trade_date"], ignore_index=True)

    def rsi(x):
        d = x.diff()
        g, l = (y.where(d.notna()).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for y in (d.clip(lower=0), -d.clip(upper=0)))  # noqa: E741
        return (100 * g / (g + l)).where(g + l > 0, 50.0).where(g.notna())

    want = src.groupby("ts_code")["adj_close"].transform(rsi)
    got = timing.rsi(df).toPandas().sort_values(["ts_code", "trade_date"])["rsi"]
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)
    q = src.groupby("trade_date")["v"]
    clipped = src["v"].clip(lower=q.transform(lambda x: x.quantile(0.05)), upper=q.transform(lambda x: x.quantile(0.95)))
    want = clipped.groupby(src["ts_code"]).transform(lambda x: x.rolling(3, min_periods=2).median().ewm(span=3, adjust=False).mean())
    got = timing.denoised(df, "v", "y")
    assert got.columns == [*df.columns, "y"]
    assert np.allclose(got.toPandas().sort_values(["ts_code", "trade_date"])["y"].to_numpy(float), want.to_numpy(float), equal_nan=True)


@pytest.fixture(scope="module")
def members():
    rng = random.Random(8)
    rows = {(day(d), c, s) for d in range(12) for c in "xyz" for s in range(8) if rng.random() < 0.5}
    rows = {r for r in rows if r[1:] != ("x", 0)} | {(day(11), "x", 0)}  # planted: a member on the last day alone
    return sorted(rows)


def test_planted_leak_is_counted(spark, members):
    cal = [day(d) for d in range(14)]
    df, dates = spark.createDataFrame(members + members[:3], "trade_date date, concept_code string, ts_code int"), spark.createDataFrame([(d,) for d in cal], "trade_date date")
    found = rotation.membership_leaks(df, dates)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    latest = {(c, s) for d, c, s in members if d == day(11)}
    want = {(d, *p, "leaked") for d in cal for p in latest if (d, *p) not in set(members)} | {(d, c, s, "lost") for d, c, s in members if (c, s) not in latest}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert sum(g[1:] == ("x", 0, "leaked") for g in got) == 13  # 11 sessions before, 2 after
    values = spark.createDataFrame([(d, s, float(s)) for d in cal for s in range(7)], "trade_date date, ts_code int, v double")
    for r in rotation.lookahead_effect(df, found, values, "v").collect():
        then, now = {s for d, c, s in members if (d, c) == (r.trade_date, r.concept_code)}, {s for c, s in latest if c == r.concept_code}
        mean = lambda x: np.mean([s for s in x if s < 7]) if [s for s in x if s < 7] else None
        assert (r.members_then, r.members_backfilled, r.leaked, r.lost) == (len(then), len(now), len(now - then), len(then - now))
        assert (r.mean_then, r.mean_backfilled) == (pytest.approx(mean(then)), pytest.approx(mean(now)))


def test_bridge_of_a_popular_concept(spark):
    rng = random.Random(3)
    stocks = [(day(d), s, rng.random() + 1, rng.random(), rng.choice([True, False, None]), rng.gauss(0, 1), None if d == 0 else rng.random() + 1) for d in range(4) for s in range(900)]
    rows = [(day(d), "all", s) for d in range(4) for s in range(950)] + [(day(d), f"c{k}", rng.randrange(950)) for d in range(4) for k in range(24) for _ in range(40)]
    sdf = spark.createDataFrame(stocks, "trade_date date, ts_code int, mv double, amount double, up boolean, step double, mv_before double")
    got = {(r.trade_date, r.concept_code): r for r in rotation.bridge(spark.createDataFrame(rows, "trade_date date, concept_code string, ts_code int"), sdf, least=5, most=100).collect()}
    by = {(d, s): x for d, s, *x in stocks}
    assert len(got) == len({r[:2] for r in rows})
    for (d, c), r in got.items():
        own = [s for a, b, s in rows if (a, b) == (d, c)]
        have = [by[d, s] for s in own if s < 900]
        before = [by[d, s] for a, b, s in rows if (a + timedelta(days=1), b) == (d, c) and s < 900]
        weight = [x[4] for x in before]
        assert (r.source_member_count, r.matched_member_count) == (len(own), len({s for s in own if s < 900})) and r.usable == (5 <= r.matched_member_count <= 100)
        assert r.concept_mv == pytest.approx(sum(x[0] for x in have)) and r.breadth_equal == pytest.approx(np.mean([bool(x[2]) for x in have]))
        assert r.breadth_capital == pytest.approx(sum(x[0] for x in have if x[2]) / sum(x[0] for x in have)) and r.concept_amount == pytest.approx(sum(x[1] for x in have))
        assert (r.concept_return is None) == (d == day(0)) and (d == day(0) or r.concept_return == pytest.approx(sum(x[4] * x[3] for x in before) / sum(weight)))
    # The popular concept has half of all rows, and no task of the salted stage more than twice the mean.
    salted = spark.createDataFrame(rows, "d date, c string, s int").withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(64))).repartition(8, "d", "c", "salt")
    sizes = [r["count"] for r in salted.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / 8
    with pytest.raises(ValueError):
        rotation.salted_sums(sdf, ["trade_date"], {}, {"n": "mv"}, "ts_code")


def test_balance_of_all_covariates(spark):
    rng = random.Random(6)
    num = lambda: None if rng.random() < 0.15 else rng.gauss(0, 2)
    rows = [("h", day(d), f"e{e}", f"c{c}", num(), num(), 1.0, 1.0) for d in range(5) for e in range(4) for c in range(rng.randint(1, 5))]
    own = {(r[1], r[2]): r[4] for r in rows}
    rows = [(*r[:4], own[r[1], r[2]], *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, "axis string, trade_date date, event_code string, control_code string, event_a double, control_a double, event_flat double, control_flat double")
    got = {(r.covariate, r.weighting): r for r in events.balance(df, ["a", "flat"], ["axis"]).collect()}
    p = pd.DataFrame(rows, columns=df.columns)
    for weighting, e in (("event_once", p.sort_values("control_code").drop_duplicates(["trade_date", "event_code"])), ("all_pairs", p)):
        a, c = e["event_a"].dropna().astype(float), p["control_a"].dropna().astype(float)
        smd = (a.mean() - c.mean()) / math.sqrt((a.var(ddof=0) + c.var(ddof=0)) / 2)
        r = got["a", weighting]
        assert (r.events, r.controls) == (len(a), len(c)) and r.smd == pytest.approx(smd) and r.abs_smd == pytest.approx(abs(smd))
        assert got["flat", weighting].smd is None
    assert events.balance(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("fraction", [0.01, 0.1, 0.5, 1.0])
def test_trimmed(spark, fraction):
    rng = random.Random(4)
    rows = [(g, None if rng.random() < 0.1 else round(rng.gauss(0, 0.02), 3)) for g in "abc" for _ in range({"a": 400, "b": 7, "c": 1}[g])] + [("a", 0.0005)] * 50 + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for width in (1e-3, 0.05):
        got = {r.g: r for r in outcomes.trimmed(df, ["g"], "v", fraction, width).collect()}
        for g in "abc":
            v = sorted((x for k, x in rows if k == g and x is not None), reverse=True)
            if not v:
                continue
            drop = max(1, math.ceil(len(v) * fraction))
            assert (got[g].n, got[g].dropped) == (len(v), drop) and got[g].mean == pytest.approx(np.mean(v))
            assert got[g].trimmed_mean == (pytest.approx(np.mean(v[drop:]), abs=1e-12) if v[drop:] else None)
        assert "d" not in got
    v = sorted((x for _, x in rows if x is not None), reverse=True)
    assert outcomes.trimmed(df, [], "v", 0.1).first().trimmed_mean == pytest.approx(np.mean(v[math.ceil(len(v) * 0.1) :]), abs=1e-12)


def test_years_days_and_costs(spark):
    rng = random.Random(7)
    rows = [("g", date(2010 + k // 90, 1, 1) + timedelta(days=k % 90 * 4), rng.gauss(0.001, 0.02)) for k in range(540) for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "g string, trade_date date, v double")
    p = pd.DataFrame(rows, columns=["g", "d", "v"])
    p["y"] = [d.year for d in p["d"]]
    got = {r.year: r for r in outcomes.yearly(df, ["g"], "v").collect()}
    for y, x in p.groupby("y"):
        before = p[p["y"] < y]["v"].mean() if y >= 2013 else None
        assert got[y].n == len(x) and got[y].mean == pytest.approx(x["v"].mean()) and (got[y].mean_before is None) == (before is None)
        assert before is None or (got[y].mean_before == pytest.approx(before) and got[y].holds == (before * x["v"].mean() > 0))
    d = p.groupby("d")["v"].mean()
    r = outcomes.day_concentration(df, ["g"], "v").first()
    gain = d.clip(lower=0).sort_values(ascending=False, kind="stable")
    roll = d.rolling(252, min_periods=63).sum().dropna()
    assert r.days == len(d) and r.annual_mean == pytest.approx(d.mean() * 252) and r.without_best == pytest.approx(d.drop(gain.index[:10]).mean() * 252)
    assert r.best_share == pytest.approx(gain[:10].sum() / gain.sum()) and r.rolling_positive_ratio == pytest.approx((roll > 0).mean())
    for r in outcomes.cost_curve(df, ["g"], "v", [0, 30]).collect():
        h = r.cost_bps / 20000
        net = (1 + p["v"]) * (1 - h) - 1 - h
        m = p["v"].mean()
        assert r.mean_net == pytest.approx(net.mean()) and r.positive_ratio == pytest.approx((net > 0).mean()) and r.break_even_bps == pytest.approx(20000 * m / (2 + m) if m > 0 else 0)
