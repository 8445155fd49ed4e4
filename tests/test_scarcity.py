"""Scarcity against loops: a ridge fit of each security's earlier rows, and the composites on its residual."""

from datetime import date, timedelta

import numpy as np
import pandas as pd

from panelyard.operators import supply


def test_scarcity_is_that_of_plain_loops(spark):
    rng = np.random.default_rng(4)
    days, codes, window, least = 110, 6, 30, 20
    rows = [(date(2024, 1, 1) + timedelta(days=d), f"s{c}", f"i{c % 2}", *rng.normal(0, 1, 6), *rng.uniform(0, 1, 3)) for d in range(days) for c in range(codes)]
    cols = ["trade_date", "ts_code", "industry_l1_code", "lt", "excess_ret_1", "intraday_range", "volatility_20", "risk_adjusted_ret_5", "ret_z_60", "close_location", "upper_shadow_ratio", "up_days_ratio_5"]
    p = pd.DataFrame(rows, columns=cols)
    p["turnover_z_60"] = rng.normal(0, 1, len(p))
    p.loc[rng.random(len(p)) < 0.05, "lt"] = np.nan
    p.loc[rng.random(len(p)) < 0.05, "risk_adjusted_ret_5"] = np.nan
    p["market_lt"] = p.groupby("trade_date")["lt"].transform("mean")
    p["industry_lt"] = p.groupby(["trade_date", "industry_l1_code"])["lt"].transform("mean")
    kinds = ", ".join(f"{c} {'date' if c == 'trade_date' else 'string' if c in ('ts_code', 'industry_l1_code') else 'double'}" for c in p)
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), kinds)
    got = supply.scarcity(df, window=window, least=least).toPandas().sort_values(["ts_code", "trade_date"], ignore_index=True)

    w = p.sort_values(["ts_code", "trade_date"], ignore_index=True)

    def own_z(value, by):
        daily = w.groupby([*by, "trade_date"])[value].first().reset_index().sort_values([*by, "trade_date"])
        g = daily.groupby(by)[value] if by else daily[value]
        roll = lambda how: getattr(g.rolling(60, min_periods=supply.part(60)), how)(**({"ddof": 0} if how == "std" else {}))
        mean, sd = roll("mean"), roll("std")
        if by:
            mean, sd = mean.reset_index(level=0, drop=True), sd.reset_index(level=0, drop=True)
        daily["z"] = (daily[value] - mean) / sd.replace(0, np.nan)
        return w.merge(daily[[*by, "trade_date", "z"]], on=[*by, "trade_date"], how="left")["z"]

    w["mz"], w["iz"] = own_z("market_lt", []), own_z("industry_lt", ["industry_l1_code"])
    res = np.full(len(w), np.nan)
    for _, g in w.groupby("ts_code"):
        x = np.column_stack([np.ones(len(g)), g["excess_ret_1"].abs(), g["intraday_range"], g["mz"], g["iz"], g["volatility_20"]])
        y = g["lt"].to_numpy()
        ok = np.isfinite(x).all(axis=1) & np.isfinite(y)
        for t in range(window, len(g)):
            past = np.flatnonzero(ok[t - window : t]) + t - window
            if ok[t] and len(past) >= least:
                b = np.linalg.solve(x[past].T @ x[past] + 1e-6 * np.eye(6), x[past].T @ y[past])
                res[g.index[t]] = y[t] - x[t] @ b
    w["r"] = res
    assert np.isfinite(res).sum() > 100
    same = lambda name, want: np.testing.assert_allclose(got[name].to_numpy(float), np.asarray(want, float), atol=1e-6, err_msg=name)
    same("volume_residual", w["r"])
    same("scarcity", -w["r"])
    by = w.groupby("ts_code")
    same("volume_residual_mean_5", by["r"].rolling(5).mean().reset_index(level=0, drop=True))
    days_short = (w["r"].fillna(0) < 0).astype(float).groupby(w["ts_code"]).rolling(5).mean().reset_index(level=0, drop=True)
    cond = (w["risk_adjusted_ret_5"].clip(lower=0) * (-w["r"]).clip(lower=0)).where(w["r"].notna() & w["risk_adjusted_ret_5"].notna())
    same("conditional_scarcity", cond)
    same("close_quality_scarcity", cond * w["close_location"] * (1 - w["upper_shadow_ratio"]))
    same("persistent_scarcity", cond * days_short * w["up_days_ratio_5"])
    same("low_volume_rise", w["ret_z_60"].clip(lower=0) * (-w["turnover_z_60"]).clip(lower=0))
    slope = by["r"].rolling(5).apply(lambda a: -np.polyfit(np.arange(5), a, 1)[0], raw=True).reset_index(level=0, drop=True)
    same("scarcity_slope_5", slope)
