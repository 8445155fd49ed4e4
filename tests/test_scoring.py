"""Run measures and points against plain loops."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from panelyard.operators import scoring


def points(value, name):
    if value is None or not np.isfinite(value):
        return 0
    return next((p for least, p in scoring.BANDS[name] if value >= least), 0)


@pytest.fixture(scope="module")
def daily():
    rng = random.Random(2)
    rows = []
    for f, drift in (("good", 0.002), ("bad", -0.001), ("turned", None), ("lone", 0.0005)):
        for n in (2, 5, 10, 20):
            for h in (1, 3):
                for cost in (0.0, 20.0):
                    if f == "lone" and n != 5:
                        continue
                    for k in range(420):
                        mean = drift if drift is not None else (0.002 if k < 336 else -0.004)
                        x = rng.gauss(mean / (1 + n / 20), 0.01) - cost / 1e5
                        rows.append((f, n, h, cost, date(2020, 1, 1) + timedelta(days=2 * k), x + rng.gauss(0, 0.002), x, rng.choice([1.0, 1.0, 0.8])))
    return pd.DataFrame(rows, columns=["factor", "top_n", "holding", "cost_bps", "trade_date", "return", "excess", "executed"])


def measured(g):
    g = g.sort_values("trade_date", ignore_index=True)
    split = max(int(len(g) * 0.8), 1)
    e, y = g["excess"], pd.Series([d.year for d in g["trade_date"]])
    nav = (1 + g["return"]).cumprod()
    roll = e.rolling(252, min_periods=63).sum().dropna()
    gain = e.clip(lower=0).sort_values(ascending=False)
    late = e[split:].groupby(y[split:]).sum()
    return {
        "is_excess": e[:split].mean() * 252, "oos_excess": e[split:].mean() * 252 if len(e) > split else 0.0, "excess": e.mean() * 252, "execution": g["executed"].mean(), "calmar": g["return"].mean() * 252 / abs((nav / nav.cummax() - 1).min()),
        "rolling": (roll > 0).mean() if len(roll) else 0.0, "concentration": gain[:10].sum() / gain.sum() if gain.sum() else 1.0, "years": (e.groupby(y).sum() > 0).mean(), "walk": (late > 0).mean() if len(late) else 0.0,
    }


def test_run_measures(spark, daily):
    got = {(r.factor, r.top_n, r.holding, r.cost_bps): r for r in scoring.run_measures(spark.createDataFrame(daily)).collect()}
    groups = daily.groupby(["factor", "top_n", "holding", "cost_bps"])
    assert len(got) == groups.ngroups
    for key, g in groups:
        for name, want in measured(g).items():
            assert got[key][name] == pytest.approx(want, abs=1e-9), (key, name)


def classed(m, t, b):
    """Points and class of one factor: measures by run, medians of its tests, and what is known of it."""
    pick = lambda n, c: [x for (s, _, cost), x in m.items() if s == n and cost == c]
    p, g, med = pick(2, 20.0), pick(2, 0.0), lambda xs: float(np.median(xs)) if xs else None
    out, reversal = {"oos_effectiveness": 0, "tradable_performance": 0, "stability": 0}, False
    if p:
        i, o, e = (med([x[c] for x in p]) for c in ("is_excess", "oos_excess", "excess"))
        keep = o / i if i > 0 else (1.0 if o > 0 else -1.0)
        out["oos_effectiveness"] = (8 if o > 0 else 0) + points(keep, "retention") + points(np.mean([x["walk"] for x in p]), "walk") + (4 if t["oos_ic"] > 0 else 0)
        gross = med([x["excess"] for x in g])
        out["tradable_performance"] = points(e, "excess") + points(med([x["calmar"] for x in p]), "calmar") + points(e / gross if gross > 0 else 0.0, "resilience") + points(med([x["execution"] for x in p]), "execution")
        out["stability"] = points(med([x["years"] for x in p]), "years") + points(med([x["rolling"] for x in p]), "rolling") + points(1 - med([x["concentration"] for x in p]), "spread")
        reversal = i > 0 and o < 0 and t["oos_ic"] < 0
    curve = [med([x["excess"] for x in pick(n, 20.0)]) for n in (2, 5, 10, 20)]
    valid = [v for v in curve if v is not None]
    if len(valid) < 2 or curve[0] is None or curve[0] <= 0:
        out["topn_structure"] = 0
    elif all(a >= c for a, c in zip(valid, valid[1:])) and all(v > 0 for v in valid):
        out["topn_structure"] = 10
    else:
        out["topn_structure"] = 7 if curve[1] is not None and curve[1] > 0 else 5
    out["statistical_evidence"] = points(t["ic"], "ic") + points(t["icir"], "icir") + (2 if t["fdr_q"] <= 0.05 else 1 if t["fdr_q"] <= 0.1 else 0) + points(t["structure"], "structure")
    out["independence_explanation"] = 2 if b["explained"] else 0
    total = sum(out.values())
    if b["violations"] > 0 or not b["covered"]:
        name = "INVALID"
    elif reversal or total <= 49:
        name = "REJECTED"
    elif total <= 64:
        name = "WATCHLIST"
    else:
        name = "APPROVED" if total > 79 and all(out[k] >= v for k, v in scoring.LEAST.items()) else "CANDIDATE"
    return out | {"total": total, "classification": name}


def test_points_and_classes(spark, daily):
    runs = scoring.run_measures(spark.createDataFrame(daily))
    rng = random.Random(5)
    factors = ["good", "bad", "turned", "lone", "absent"]
    tests = [(f, rng.uniform(-0.02, 0.08), rng.uniform(-0.5, 1.5), -0.01 if f == "turned" else rng.uniform(-0.02, 0.05), rng.uniform(0, 0.2), rng.uniform(0, 1)) for f in factors[:4] for _ in range(3)]
    basics = [(f, int(f == "lone"), True, f != "bad") for f in factors]
    got = {r.factor: r.asDict() for r in scoring.score(runs, spark.createDataFrame(tests, "factor string, ic double, icir double, oos_ic double, fdr_q double, structure double"), spark.createDataFrame(basics, "factor string, violations int, covered boolean, explained boolean")).collect()}
    t = pd.DataFrame(tests, columns=["factor", "ic", "icir", "oos_ic", "fdr_q", "structure"]).groupby("factor").median()
    for f, violations, covered, explained in basics:
        m = {k: measured(g) for k, g in daily[daily["factor"] == f].groupby(["top_n", "holding", "cost_bps"])}
        own = t.loc[f].to_dict() if f in t.index else {"ic": 0.0, "icir": 0.0, "oos_ic": 0.0, "fdr_q": 1.0, "structure": 0.0}
        want = classed(m, own, {"violations": violations, "covered": covered, "explained": explained})
        assert got[f] == want | {"factor": f}, f
    assert got["turned"]["classification"] == "REJECTED" and got["lone"]["classification"] == "INVALID" and got["absent"]["total"] == 2


@pytest.mark.parametrize(("levels", "want"), [((4, 3, 2, 1), 10), ((4, 5, 2, 1), 7), ((4, -1, 2, 1), 5), ((-1, 3, 2, 1), 0), ((4, None, 2, None), 10), ((4, None, None, None), 0)])
def test_order_by_size(spark, levels, want):
    rows = [("f", n, 1, 20.0, *[0.1] * 2, float(v) / 10, *[0.5] * 6) for n, v in zip((2, 5, 10, 20), levels) if v is not None]
    runs = spark.createDataFrame(rows, "factor string, top_n int, holding int, cost_bps double, is_excess double, oos_excess double, excess double, calmar double, execution double, rolling double, concentration double, years double, walk double")
    none = spark.createDataFrame([], "factor string, ic double, icir double, oos_ic double, fdr_q double, structure double")
    basics = spark.createDataFrame([("f", None, True, None)], "factor string, violations int, covered boolean, explained boolean")
    assert scoring.score(runs, none, basics).first().topn_structure == want
