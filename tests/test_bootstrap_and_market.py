"""Resampled means and market features against plain loops."""

import hashlib
import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from panelyard.operators import gates, regimes, stats
from pyspark.sql import functions as F


def day(k):
    return date(2024, 1, 1) + timedelta(days=k)


def test_block_bootstrap_against_copied_blocks(spark):
    rng = random.Random(4)
    series = {"long": [rng.gauss(1, 2) for _ in range(53)], "gaps": [None if k % 4 == 0 else rng.gauss(0, 1) for k in range(40)], "pair": [1.0, 3.0], "one": [5.0], "short": [rng.random() for _ in range(6)]}
    df = spark.createDataFrame([(s, day(k), v) for s, x in series.items() for k, v in enumerate(x)], "s string, d date, v double").repartition(3)
    got = {r.s: r for r in stats.block_bootstrap(df, ["s"], "v", "d", 8, 50, 11).collect()}
    for s, x in series.items():
        v = [y for y in x if y is not None]
        assert got[s].mean == pytest.approx(np.mean(v))
        if len(v) < 2:
            assert got[s].low is None
            continue
        size, means = min(8, len(v)), []
        for d in range(50):
            starts = [int(hashlib.md5(f"11:{d}:{k}".encode()).hexdigest()[:8], 16) % (len(v) - size + 1) for k in range(math.ceil(len(v) / size))]
            means.append(np.mean([v[a + i] for a in starts for i in range(size)][: len(v)]))
        assert got[s].low == pytest.approx(np.percentile(means, 2.5)) and got[s].high == pytest.approx(np.percentile(means, 97.5))
    assert stats.block_bootstrap(df.limit(0), ["s"], "v", "d").count() == 0


def test_conditional_grid_ranks_pairs_of_a_slice(spark):
    rng = random.Random(9)
    num = lambda: None if rng.random() < 0.2 else float(rng.randint(0, 5))
    rows = [(day(d), f"{s}", num(), num(), num(), num(), rng.choice([True, False, None])) for d in range(6) for s in range(15)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, a double, b double, y1 double, y2 double, up boolean")
    made = gates.conditional_grid(df, {"a": F.col("a"), "sum": F.col("a") + F.col("b")}, {"all": F.lit(True), "up": F.col("up")}, {1: "y1", 2: "y2"})
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.score, r.condition, r.horizon, r.trade_date): (r.n, r.ic) for r in made.collect()}
    p = pd.DataFrame(rows, columns=df.columns).assign(sum=lambda x: x["a"] + x["b"])
    for (score, condition, h, d), (n, ic) in got.items():
        x = p[(p["trade_date"] == d) & ((p["up"] == True) if condition == "up" else True)][[score, f"y{h}"]].dropna()  # noqa: E712
        r = x.rank()
        flat = len(x) < 3 or r.iloc[:, 0].std() == 0 or r.iloc[:, 1].std() == 0
        assert n == len(x) and (ic is None if flat else ic == pytest.approx(np.corrcoef(r.T.to_numpy())[0, 1]))
    assert len(got) == 48


def test_market_features(spark):
    rng = random.Random(3)
    rows = [(day(d), f"s{s}", None if rng.random() < 0.05 else 10 * math.exp(rng.gauss(0, 0.05)), rng.random() * 100, rng.choice(["x", "y", None]), rng.random() < 0.8) for s in range(12) for d in range(60)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, adj_close double, amount_cny double, industry_l1_code string, is_factor_eligible boolean").repartition(3)
    got = regimes.market_features(df).toPandas().sort_values("trade_date", ignore_index=True)
    p = pd.DataFrame(rows, columns=df.columns).sort_values(["ts_code", "trade_date"])
    p["ret"] = p["adj_close"] / p.groupby("ts_code")["adj_close"].shift(1) - 1
    s = p[p["is_factor_eligible"]]
    r = s.groupby("trade_date")["ret"].mean()
    b = s.groupby("trade_date")["ret"].apply(lambda x: (x.dropna() > 0).mean())
    t = s.groupby("trade_date")["amount_cny"].sum()
    i = s.groupby(["trade_date", "industry_l1_code"])["ret"].mean().reset_index().groupby("trade_date")["ret"]
    xc = np.arange(20) - 9.5
    slope = np.log1p(r.clip(lower=-0.999)).rolling(20).apply(lambda a: xc @ np.cumsum(a) / (xc @ xc), raw=True)
    want = [(1 + r).rolling(20).apply(np.prod, raw=True) - 1, slope, r.rolling(20).std(ddof=0), b.rolling(5).mean(), b.rolling(20).mean(), i.apply(lambda x: (x.dropna() > 0).mean() if x.notna().any() else np.nan), i.std(ddof=0), t.rolling(5).mean() / t.rolling(20).mean() - 1]
    for name, w in zip(regimes.MARKET, want):
        w = w.reindex(got["trade_date"]).to_numpy(float)
        ok = ~np.isnan(w) if name.startswith("market_breadth") and np.isnan(w).any() else np.ones(len(w), bool)
        assert np.allclose(got[name].to_numpy(float)[ok], w[ok], equal_nan=True), name
