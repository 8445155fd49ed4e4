"""Component diagnostics and attribution against plain pandas and numpy."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import attribution, diagnostics


def day(k):
    return date(2024, 1, 1) + timedelta(days=k)


@pytest.fixture(scope="module")
def wide():
    rng = random.Random(4)
    value = lambda: None if rng.random() < 0.25 else float(rng.randint(0, 6))
    rows = [(day(d), f"{s:03d}", value(), value(), value(), float(d) if d % 3 else None, rng.random()) for d in range(14) for s in range(9)]
    rows += [(day(20), "000", 1.0, 1.0, None, None, 0.5), (day(21), "000", None, None, None, None, None)]
    return pd.DataFrame(rows, columns=["trade_date", "ts_code", "a", "b", "c", "flat", "target"])


def frame(spark, pdf):
    kinds = ", ".join(f"{c} {'date' if c == 'trade_date' else 'string' if c == 'ts_code' else 'double'}" for c in pdf)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), kinds)


def near(a, b):
    return (a is None and (b is None or np.isnan(b))) or (a is not None and abs(a - b) < 1e-9)


def spearman(x):
    x = x.dropna()
    r = x.rank()
    return np.nan if len(x) < 3 or r.iloc[:, 0].std() == 0 or r.iloc[:, 1].std() == 0 else np.corrcoef(r.T.to_numpy())[0, 1]


NAMES = ["a", "b", "c", "flat"]


def test_value_correlation(spark, wide):
    got = {(r.component_a, r.component_b): r for r in diagnostics.value_correlation(frame(spark, wide), NAMES).collect()}
    assert len(got) == 16
    for x in NAMES:
        for y in NAMES:
            if x == y:
                assert got[x, y].mean_daily_spearman == 1.0 and got[x, y].days == sum(g[x].notna().sum() >= 3 for _, g in wide.groupby("trade_date"))
                continue
            daily = pd.Series([spearman(g[[x, y]]) for _, g in wide.groupby("trade_date")])
            assert near(got[x, y].mean_daily_spearman, daily.mean()) and got[x, y].days == daily.notna().sum()


def test_ic_correlation_and_one_shuffle(spark, wide):
    df = frame(spark, wide)
    got = {(r.component_a, r.component_b): r.ic_series_correlation for r in diagnostics.ic_correlation(df, NAMES[:3], "target", 4).collect()}
    ic = pd.DataFrame({c: [spearman(g[[c, "target"]]) if g[[c, "target"]].dropna().shape[0] >= 4 else np.nan for _, g in wide.groupby("trade_date")] for c in NAMES[:3]})
    want = ic.corr()
    assert all(near(v, want.loc[k]) for k, v in got.items()) and len(got) == 9
    plan = diagnostics.value_correlation(df, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_top_overlap(spark, wide):
    got = {(r.component_a, r.component_b, r.top_n): r.mean_jaccard for r in diagnostics.top_overlap(frame(spark, wide), NAMES[:3], (2, 5)).collect()}
    top = lambda g, c, n: set(g.dropna(subset=[c]).sort_values([c, "ts_code"], ascending=[False, True]).head(n)["ts_code"])
    for (x, y, n), v in got.items():
        days = [g for _, g in wide.groupby("trade_date") if g[x].notna().any() and g[y].notna().any()]
        assert near(v, np.mean([len(top(g, x, n) & top(g, y, n)) / len(top(g, x, n) | top(g, y, n)) for g in days]))
    assert len(got) == 6


@pytest.fixture(scope="module")
def daily():
    rng = np.random.default_rng(8)
    rows = []
    for s, n in (("one", 120), ("two", 45), ("few", 5)):
        x = rng.normal(size=(n, 5))
        noise = np.convolve(rng.normal(size=n + 4), np.ones(5), "valid")[:n]
        y = 0.3 + x @ np.array([0.5, 0, -1, 2, 0.1]) + noise
        rows += [(s, day(i), float(y[i]), *map(float, x[i])) for i in range(n)]
    rows.append(("one", day(500), None, *[1.0] * 5))
    rows += [("same", day(i), float(i), *[2.0] * 5) for i in range(20)]
    return rows


XS = [f"x{k}" for k in range(5)]


def robust(y, x, lags):
    n, d = len(y), np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(d.T @ d)
    b = inv @ d.T @ y
    u = y - d @ b
    g = d * u[:, None]
    s = g.T @ g
    for k in range(1, min(lags, n - 1) + 1):
        c = g[k:].T @ g[:-k]
        s += (1 - k / (lags + 1)) * (c + c.T)
    return b, np.sqrt(np.diag(inv @ s @ inv)), 1 - u @ u / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("lags", [0, 1, 6])
def test_five_controls_with_robust_errors(spark, daily, lags):
    df = spark.createDataFrame(daily, "s string, trade_date date, y double, " + ", ".join(f"{c} double" for c in XS))
    got = {(r.s, r.term): r for r in attribution.hac_regression(df, ["s"], "y", XS, lags).collect()}
    for s in ("one", "two"):
        v = np.array([r[2:] for r in daily if r[0] == s and r[2] is not None])
        b, se, r2 = robust(v[:, 0], v[:, 1:], lags)
        for k, term in enumerate(["alpha", *XS]):
            r = got[s, term]
            assert r.n_obs == len(v) and near(r.r_squared, r2) and near(r.coefficient, b[k]) and near(r.std_error, se[k]) and near(r.t_value, b[k] / se[k])
    assert got["few", "alpha"].coefficient is None and got["same", "alpha"].coefficient is None
    assert attribution.hac_regression(df.filter("s = 'one'"), [], "y", XS, lags).count() == 6
    assert attribution.hac_regression(df.limit(0), ["s"], "y", XS, lags).count() == 0


def test_bootstrap_against_copied_rows(spark, daily):
    df = spark.createDataFrame(daily, "s string, trade_date date, y double, " + ", ".join(f"{c} double" for c in XS)).filter("s <> 'same'")
    got = {r.s: r for r in attribution.bootstrap_alpha(df, ["s"], "y", XS[:2], 6, 60, seed=3).collect()}
    import hashlib

    for s in ("one", "two"):
        v = np.array([r[2:5] for r in daily if r[0] == s and r[2] is not None])
        alphas = []
        for d in range(60):
            starts = [int(hashlib.md5(f"3:{d}:{k}".encode()).hexdigest()[:8], 16) % (len(v) - 6) for k in range(len(v) // 6)]
            rows = v[[a + i for a in starts for i in range(6)]]
            alphas.append(np.linalg.lstsq(np.column_stack([np.ones(len(rows)), rows[:, 1:]]), rows[:, 0], rcond=None)[0][0])
        assert got[s].draws == 60 and near(got[s].alpha_low, np.percentile(alphas, 2.5)) and near(got[s].alpha_high, np.percentile(alphas, 97.5))
    assert "few" not in got  # no block fits


def test_style_returns(spark):
    rng = random.Random(6)
    rows = [(day(d), f"{s:02d}", rng.choice([True, True, False]), 10 + rng.random(), None if rng.random() < 0.1 else rng.randint(0, 9) / 1.0) for d in range(12) for s in range(12)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, ok boolean, adj_open double, sig double")
    got = {r.trade_date: r.sig for r in attribution.style_returns(df, ["sig"], "ok").collect()}
    p = pd.DataFrame(rows, columns=["d", "c", "ok", "o", "sig"]).sort_values(["c", "d"])
    p["f"] = p.groupby("c")["o"].shift(-2) / p.groupby("c")["o"].shift(-1) - 1
    days = sorted(p["d"].unique())
    for i, d in enumerate(days[:-2]):
        g = p[(p["d"] == d) & p["ok"]].dropna(subset=["f", "sig"])
        r = g["sig"].rank(pct=True)
        assert near(got[days[i + 2]], g["f"][r >= 2 / 3].mean() - g["f"][r <= 1 / 3].mean())
    assert set(got) == set(days[2:])
