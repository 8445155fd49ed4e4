"""Matched controls against all pairs of a cell."""

import datetime

import numpy as np
import pandas as pd
import pytest

from panelyard.operators import events

DAY = datetime.date(2024, 1, 2)


def all_pairs(pdf, controls, neighbours, caliper):
    """Every pair of a cell, by plain loops."""
    out = []
    for group, cell in pdf.groupby("industry_l1_code"):
        x = cell[controls]
        mid = x.median()
        mad, sd = 1.4826 * (x - mid).abs().median(), x.std(ddof=0)
        z = (x - mid) / mad.where(mad > 1e-12, sd.where(sd > 1e-12, 1.0))
        for i in cell.index[cell["is_event"]]:
            d = np.sqrt(sum((z.loc[~cell["is_event"], c] - z.at[i, c]) ** 2 for c in controls) / len(controls))
            near = sorted((v, str(cell.at[k, "ts_code"])) for k, v in d.items() if v <= caliper)[:neighbours]
            out += [(group, cell.at[i, "ts_code"], code, round(v, 9), k) for k, (v, code) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("controls", [["x"], ["x", "y"]])
def test_nearest_of_all_pairs(spark, controls):
    r = np.random.default_rng(7)
    n = 240
    pdf = pd.DataFrame({"trade_date": DAY, "industry_l1_code": np.where(np.arange(n) < 200, "A", "B"), "ts_code": np.arange(n), "is_event": r.random(n) < 0.2, "x": r.integers(0, 40, n) / 4.0, "y": r.normal(size=n).round(1)})
    pdf.loc[:59, ["x", "y"]] = 3.0  # copies: their smallest codes as text are the neighbours
    made = events.match_controls(spark.createDataFrame(pdf), controls, 3, 0.4)
    got = sorted((t["industry_l1_code"], t["event_code"], str(t["control_code"]), round(t["match_distance"], 9), t["rank"]) for t in made.collect())
    assert got == all_pairs(pdf, controls, 3, 0.4) and len(got) > 60
    assert made.schema["event_code"].dataType == made.schema["control_code"].dataType


def test_no_pairs_are_joined(spark):
    pdf = pd.DataFrame({"trade_date": DAY, "industry_l1_code": "A", "ts_code": range(4), "is_event": [True, False, False, False], "x": 1.0})
    made = events.match_controls(spark.createDataFrame(pdf), ["x"])
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_walked_in_bounded_steps():
    r = np.random.default_rng(3)
    x, event = r.normal(size=(3000, 1)), np.arange(3000) % 10 == 0
    codes = np.array([str(i) for i in range(3000)])
    small, large = events.nearest(codes, event, x, 3, 1.0, cells=64), events.nearest(codes, event, x, 3, 1.0)
    assert all((a == b).all() for a, b in zip(small, large)) and len(small[0]) > 800
    assert not len(events.nearest(codes[:0], event[:0], x[:0], 3, 1.0)[0]) and not len(events.nearest(codes[:1], event[:1], x[:1], 3, 1.0)[0])
