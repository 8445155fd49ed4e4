"""Boxes against a plain walk over random securities, under several rules."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from panelyard.operators import boxes


def walked(rows, r):
    """Boxes of one security, row by row; rows: (open, high, low, close, volume)."""
    o, h, l, c, v = (np.array(x) for x in zip(*rows))  # noqa: E741
    tr = np.array([np.nan] + [max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, len(c))])
    step = np.array([np.nan] + [c[i] / c[i - 1] - 1 for i in range(1, len(c))])
    out, box = [], None
    for t in range(max(r.lookback, r.atr_window + 1, r.long_window + 1), len(c)):
        if box is None:
            atr, up, low = tr[t - r.atr_window : t].mean(), h[t - r.lookback : t].max(), l[t - r.lookback : t].min()
            slope = np.polyfit(np.arange(r.lookback), c[t - r.lookback : t], 1)[0]
            short, long = step[t - r.short_window : t].std(), step[t - r.long_window : t].std()
            ratio = short / long
            if not (atr > 0 and (up - low) / atr <= r.max_width_atr and abs(slope) / atr <= r.max_slope_atr and (r.max_volatility_ratio is None or ratio <= r.max_volatility_ratio)):
                continue
            box = (t, up, low, atr, ratio)
        t0, up, low, atr, ratio = box
        reason = "breakout" if c[t] > up + r.breakout_atr * atr else "downside_failure" if c[t] < low - r.failure_atr * atr else "expired" if t - t0 >= r.max_active else None
        if reason is None:
            continue
        m = {}
        if reason == "breakout":
            p, a, d = r.process_window, r.acceleration_window, np.diff(c)
            usual = np.median(v[t - r.volume_window : t])
            m = {
                "range_compactness": -(up - low) / atr, "volatility_contraction": -math.log(ratio), "approach_velocity": np.polyfit(np.arange(p), c[t - p : t], 1)[0] / atr, "pre_acceleration": (d[t - 1 - a : t - 1].mean() - d[t - 1 - 2 * a : t - 1 - a].mean()) / a / atr,
                "direction_persistence": (d[t - 1 - p : t - 1] > 0).mean(), "consolidation_age": r.lookback + t - t0, "breakout_strength": (c[t] - up) / atr, "breakout_velocity": (c[t] - c[t - 1]) / atr,
                "breakout_acceleration": (c[t] - c[t - 1] - d[t - 1 - a : t - 1].mean()) / atr, "relative_volume": math.log(v[t] / usual), "gap_atr": (o[t] - c[t - 1]) / atr,
            }
        out.append((t0, t, reason, up, low, m))
        box = None
    return out + ([(box[0], None, None, box[1], box[2], {})] if box else [])


@pytest.mark.parametrize("rules", [boxes.BoxRules(max_width_atr=9.0, max_slope_atr=0.5), boxes.BoxRules(lookback=8, atr_window=4, short_window=3, long_window=9, process_window=4, acceleration_window=1, volume_window=5, max_width_atr=6.0, max_slope_atr=0.4, max_volatility_ratio=1.2, max_active=6)])
def test_boxes_are_those_of_a_walk(spark, rules):
    rng = random.Random(11)
    series = {}
    for k in range(8):
        price, rows = 10.0, []
        for _ in range(140):
            price *= math.exp(rng.gauss(0, 0.004 if rng.random() < 0.9 else 0.04))
            rows.append((price * (1 + rng.gauss(0, 0.002)), price * 1.004, price * 0.996, price, rng.uniform(500, 1500)))
        series[f"s{k}"] = rows
    day = lambda t: date(2024, 1, 1) + timedelta(days=t)
    df = spark.createDataFrame([(day(t), s, *map(float, r)) for s, rows in series.items() for t, r in enumerate(rows)], "trade_date date, ts_code string, adj_open double, adj_high double, adj_low double, adj_close double, volume_shares double").repartition(3)
    made = boxes.boxes(df, rules)
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString() and "Pandas" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.ts_code, r.created_at): r for r in made.collect()}
    want = {(s, day(t0)): x for s, rows in series.items() for x in walked(rows, rules) for t0 in [x[0]]}
    assert got.keys() == want.keys() and len({x[2] for x in want.values()}) >= 3
    for key, (t0, t, reason, up, low, m) in want.items():
        r = got[key]
        assert (r.reason, r.closed_at, r.source_end) == (reason, None if t is None else day(t), day(t0 - 1)) and r.upper == pytest.approx(up) and r.lower == pytest.approx(low)
        assert all(r[n] == pytest.approx(x) for n, x in m.items()) and (m or r.gap_atr is None)
    assert boxes.boxes(df.limit(0), rules).count() == 0
