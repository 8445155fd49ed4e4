"""Factor health and drift against pandas."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from panelyard.operators import gates, health


def day(k):
    return date(2024, 1, 1) + timedelta(days=k)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [("f", day(d), f"s{s:02d}", None if rng.random() < 0.1 else round(rng.gauss(0, 1), 1), None if rng.random() < 0.1 else rng.gauss(0, 0.02), rng.random()) for d in range(40) for s in range(26 if d % 9 else 4)]
    return out + [("g", day(d), f"s{s:02d}", float(s), 0.5, None) for d in range(3) for s in range(12)]


def near(a, b):
    return (a is None and (b is None or np.isnan(b))) or (a is not None and not np.isnan(b) and abs(a - b) < 1e-9)


def test_daily_health(spark, rows):
    df = spark.createDataFrame(rows, "factor string, trade_date date, ts_code string, x double, y double, ctx double").repartition(3)
    got = {(r.factor, r.trade_date): r for r in health.daily_health(df, "x", "y", 5, 10, ["factor"], ["ctx"]).collect()}
    p = pd.DataFrame(rows, columns=df.columns).dropna(subset=["x", "y"])
    seen = 0
    for f, own in p.groupby("factor"):
        before = None
        for d, g in own.sort_values(["trade_date", "ts_code"]).groupby("trade_date"):
            if len(g) < 10:
                assert (f, d) not in got
                continue
            seen += 1
            r, rank = got[f, d], g["x"].rank(method="first")
            bucket = pd.qcut(rank, 5, labels=False) + 1
            means = g["y"].groupby(bucket).mean()
            top, low = rank / len(g) > 1 - 1 / 5, rank / len(g) <= 1 / 5
            held = set(g["ts_code"][top])
            overlap = np.nan if before is None else len(held & before) / len(held | before)
            before = held
            assert r.observation_count == len(g) and near(r.rank_ic, g["x"].rank().corr(g["y"].rank())) and near(r.pearson_ic, g["x"].corr(g["y"])) and near(r.score_dispersion, g["x"].std())
            assert all(near(r[f"decile_{k}_return"], means.get(k, np.nan)) for k in range(1, 6)) and near(r.decile_spread, means[5] - means[1])
            mono = np.nan if means.nunique() < 2 else pd.Series(means.index, index=means.index).corr(means.rank())
            assert near(r.decile_monotonicity, mono) and near(r.top_bottom_score_gap, g["x"][top].mean() - g["x"][low].mean())
            assert near(r.top_stock_concentration, g["x"][top].abs().max() / g["x"][top].abs().sum()) and near(r.holding_overlap, overlap) and near(r.top_decile_turnover, 1 - overlap) and near(r.ctx, g["ctx"].mean())
    assert seen == len(got) > 30
    assert health.daily_health(df.limit(0), "x", "y").count() == 0


def test_rolling_health(spark):
    rng = random.Random(3)
    rows = [(a, day(d), None if rng.random() < 0.1 else rng.gauss(0, 1), rng.gauss(0, 1)) for a in "ab" for d in range(60)]
    got = health.rolling_health(spark.createDataFrame(rows, "a string, trade_date date, rank_ic double, decile_spread double"), (8, 20, 40), ["a"]).toPandas().sort_values(["a", "trade_date"], ignore_index=True)
    p = pd.DataFrame(rows, columns=["a", "trade_date", "rank_ic", "decile_spread"])
    roll = lambda c, k, how: p.groupby("a")[c].rolling(k, min_periods=max(5, k // 2)).agg(how).reset_index(level=0, drop=True)
    for k in (8, 20, 40):
        assert np.allclose(got[f"icir_{k}"], roll("rank_ic", k, "mean") / roll("rank_ic", k, "std"), equal_nan=True) and np.allclose(got[f"spread_{k}"], roll("decile_spread", k, "mean"), equal_nan=True)
    assert np.allclose(got["ic_velocity_8_20"], roll("rank_ic", 8, "mean") - roll("rank_ic", 20, "mean"), equal_nan=True)


def drift(v, recent, baseline, medium, persistence, least, threshold):
    v = [x for x in v if x is not None]
    now, old = v[-recent:], v[-(recent + baseline) : -recent]
    if not now or not old:
        return None
    mad = 1.4826 * np.median(np.abs(np.array(old) - np.median(old)))
    scale = mad if mad > 1e-12 else np.std(old)
    delta = np.mean(now) - np.mean(old)
    z = delta / (scale / math.sqrt(len(now)))
    roll = pd.Series(now).rolling(10, min_periods=10).mean()
    moved = (roll - np.mean(old)) * (1 if delta >= 0 else -1) > scale / math.sqrt(10)
    run = 0
    for m in reversed(moved.tolist()):
        if not m:
            break
        run += 1
    return (len(old), len(now), np.mean(v[-medium:]), delta, z, run, "strengthening" if delta > 0 else "weakening", bool(abs(z) >= threshold and run >= persistence and len(now) >= least))


def test_drift_needs_persistence_and_days(spark):
    rng = random.Random(7)
    series = {
        "still": [rng.gauss(0, 1) for _ in range(200)], "up": [rng.gauss(0, 1) for _ in range(170)] + [rng.gauss(2, 1) for _ in range(30)], "over": [rng.gauss(0, 1) for _ in range(170)] + [rng.gauss(3, 1) for _ in range(20)] + [rng.gauss(0, 0.1) for _ in range(10)],
        "gaps": [None if k % 3 == 0 else rng.gauss(-1 if k > 150 else 1, 1) for k in range(200)], "short": [rng.gauss(0, 1) for _ in range(36)], "down": [rng.gauss(1, 1) for _ in range(100)] + [-1.0 - k / 50 for k in range(40)],
    }
    df = spark.createDataFrame([(s, day(k), v) for s, x in series.items() for k, v in enumerate(x)], "s string, trade_date date, v double")
    for persistence, least in ((3, 1), (0, 1), (3, 31)):
        got = {r.s: r for r in gates.relation_drift(df, ["s"], "v", 30, 120, persistence=persistence, medium=60, least_recent=least).collect()}
        for s, x in series.items():
            want, r = drift(x, 30, 120, 60, persistence, least, 2.0), got[s]
            assert (r.baseline_days, r.recent_days, r.persistence_days, r.direction, r.is_drift) == (want[0], want[1], want[5], want[6], want[7]), s
            assert r.medium_mean == pytest.approx(want[2]) and r.delta == pytest.approx(want[3]) and r.robust_z == pytest.approx(want[4])
    assert gates.relation_drift(df, ["s"], "v", 30, 120).filter("is_drift").count() >= 2
    wide = {r.s: r.medium_mean for r in gates.relation_drift(df, ["s"], "v", 5, 10, medium=100).collect()}
    assert wide["still"] == pytest.approx(np.mean(series["still"][-100:]))
