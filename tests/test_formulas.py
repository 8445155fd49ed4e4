import math
from dataclasses import replace

import pytest
from panels import make_panel

from panelyard.plans.dsl import ContractError, FormulaError
from panelyard.plans.factor import Factor, compute, inferred_lookback, load_factor, prefix_differences


def spec(formula, fields=("close",), rows=30, **more):
    return Factor("f", formula, tuple(fields), rows, **more)


def values(spark, pdf, s):
    return {(str(r["trade_date"]), r["ts_code"]): r["factor_value"] for r in compute(spark.createDataFrame(pdf), s).collect()}


def test_lag_and_full_windows(spark):
    pdf = make_panel(6, 1)
    got = sorted(values(spark, pdf, spec("mean(close, 3)")).items())
    c = pdf["adj_close"].tolist()
    assert [v for _, v in got[:2]] == [None, None]
    assert got[2][1] == pytest.approx(sum(c[:3]) / 3)
    assert sorted(values(spark, pdf, spec("lag(close, 2)")).items())[3][1] == pytest.approx(c[1])


def test_missing_value_takes_a_slot(spark):
    pdf = make_panel(6, 1)
    pdf.loc[2, "adj_close"] = None
    got = [v for _, v in sorted(values(spark, pdf, spec("mean(close, 2)")).items())]
    assert [v is None for v in got] == [True, False, True, True, False, False]


def test_percent_rank_averages_ties_over_values(spark):
    pdf = make_panel(1, 5)
    pdf["adj_close"] = [1.0, 2.0, 2.0, None, 5.0]
    got = [v for _, v in sorted(values(spark, pdf, spec("cs_rank(close)")).items())]
    assert got == [0.25, 0.625, 0.625, None, 1.0]


def test_infinities_flow_until_the_end(spark):
    pdf = make_panel(1, 2)
    pdf["turnover_rate"] = 0.0
    f = ("close", "turnover_rate")
    assert set(values(spark, pdf, spec("clip(close / turnover_rate, -5, 5)", f)).values()) == {5.0}
    assert set(values(spark, pdf, spec("close / turnover_rate", f)).values()) == {None}


def test_missing_compares_unequal(spark):
    pdf = make_panel(2, 1)
    pdf.loc[1, "adj_close"] = None
    got = [v for _, v in sorted(values(spark, pdf, spec("where(close != 1, 1, 0) + where(close > 1, 10, 0)")).items())]
    assert got == [11.0, 1.0]


@pytest.mark.parametrize("bad", ["close.real", "close[0]", "lambda: 1", "[close for x in y]", "__import__('os')", "'text'", "1 < close < 2", "mean(close, 0)", "mean(close, True)", "mean(close, 1.5)", "open(1)", "group_mean(close)", "unknown", "close %", "slope(close, 1)"])
def test_outside_the_language(spark, bad):
    with pytest.raises(FormulaError):
        compute(spark.createDataFrame(make_panel(2, 1)), spec(bad))


def test_contracts(spark):
    panel = spark.createDataFrame(make_panel(3, 1))
    with pytest.raises(FormulaError):
        compute(panel, spec("close + volume"))
    with pytest.raises(ContractError):
        compute(panel, spec("ret(close, 5)", rows=4))
    with pytest.raises(ContractError):
        compute(panel, spec("close", ("close", "no_such_field")))
    with pytest.raises(ContractError):
        compute(panel, spec("x", features={"close": "1 + 1"}))
    assert inferred_lookback(spec("ret(lag(close, 1), 20) + mean(x, 5)", features={"x": "delta(close, 3)"})) == 21


def test_groups_and_masks(spark):
    pdf = make_panel(1, 4)
    s = spec("cs_rank(close, by=industry)", ("close", "industry"), min_group_size=2)
    assert [v for _, v in sorted(values(spark, pdf, s).items())] == [0.5, 0.5, 1.0, 1.0]
    assert set(values(spark, pdf, replace(s, min_group_size=3)).values()) == {None}
    pdf.loc[3, "is_factor_eligible"] = False
    got = [v for _, v in sorted(values(spark, pdf, spec("cs_rank(close)", universe="factor_eligible")).items())]
    assert got == [pytest.approx(1 / 3), pytest.approx(2 / 3), 1.0, None]


def test_winsor_and_zscore(spark):
    pdf = make_panel(1, 5)
    pdf["adj_close"] = [1.0, 2.0, 3.0, 4.0, 100.0]
    got = [v for _, v in sorted(values(spark, pdf, spec("close", winsorize="mad", mad_scale=5.0)).items())]
    assert got == [1.0, 2.0, 3.0, 4.0, 8.0]
    z = [v for _, v in sorted(values(spark, pdf, spec("close", winsorize="mad", standardize="zscore", direction="negative")).items())]
    assert sum(z) == pytest.approx(0) and math.fsum(v * v for v in z) == pytest.approx(5) and z[0] > z[-1]


def test_no_formula_reads_the_future(spark):
    pdf = make_panel(12, 6)
    panel = spark.createDataFrame(pdf)
    dates = sorted(pdf["trade_date"].unique())
    s = spec("cs_zscore(mean(r, 3)) + slope(close, 4) - cs_rank(std(volume, 3), by=industry)", ("close", "volume", "industry"), features={"r": "ret(close, 1)"}, min_group_size=2, winsorize="mad")
    assert prefix_differences(panel, s, [dates[5], dates[8]]).count() == 0


def test_declarations():
    import json

    d = {"version": 1, "kind": "factor", "factor": {"name": "m", "direction": "negative"}, "data": {"required_fields": ["close"], "lookback_days": 3}, "scope": {"universe": "liquid"}, "calculation": {"parameters": {"n": {"value": 3}}, "formula": "ret(close, n)", "winsorize": "mad"}}
    f = load_factor(json.dumps(d))
    assert f.parameters == {"n": 3} and f.universe == "liquid" and f.direction == "negative" and f.winsorize == "mad"
    d["scope"]["colour"] = "red"
    with pytest.raises(ContractError):
        load_factor(json.dumps(d))
