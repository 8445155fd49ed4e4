import numpy as np
import pandas as pd
import pytest
from panels import make_panel, sessions

from panelyard.operators import gates, paths, portfolio, residual, value
from panelyard.sources import files


def plain_residual(y, x, least, ridge):
    ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
    out = np.full(len(y), np.nan)
    if ok.sum() >= max(least, x.shape[1] + 3):
        z = (x[ok] - x[ok].mean(axis=0)) / x[ok].std(axis=0)
        a = np.column_stack([np.ones(ok.sum()), z])
        penalty = ridge * np.eye(a.shape[1])
        penalty[0, 0] = 0
        out[ok] = y[ok] - a @ np.linalg.solve(a.T @ a + penalty, a.T @ y[ok])
    return out


def test_a_chain_of_residuals_is_plain_least_squares_step_by_step(spark):
    rng = np.random.default_rng(1)
    n = 3 * 2 * 15
    pdf = pd.DataFrame({"trade_date": np.repeat(sessions(3), n // 3), "g": np.tile(np.repeat(["a", "b"], 15), 3), "ts_code": np.tile(np.arange(30), 3), **{c: rng.normal(size=n) for c in "xyzw"}})
    pdf.loc[4, "y"] = None
    steps = [value.Step("r1", "y", ("x",), 2.0), value.Step("r2", "z", ("r1", "x")), value.Step("r3", "w", ("r2", "r1"))]
    got = {(r["trade_date"], r["ts_code"]): r for r in value.residual_chain(spark.createDataFrame(pdf), steps, ["trade_date", "g"], 5).collect()}
    for _, group in pdf.groupby(["trade_date", "g"]):
        known = {c: group[c].to_numpy(float) for c in "xyzw"}
        for s in steps:
            known[s.out] = plain_residual(known[s.y], np.column_stack([known[c] for c in s.controls]), 5, s.ridge)
        for i, (d, code) in enumerate(zip(group["trade_date"], group["ts_code"])):
            for s in steps:
                want = known[s.out][i]
                assert got[d, code][s.out] == (None if np.isnan(want) else pytest.approx(want, abs=1e-9))


def plain_value_features(panel, p):
    """The eight features by loops over dates and industries; pandas windows of each security."""
    d = panel.sort_values(["ts_code", "trade_date"], ignore_index=True)
    by, code = d.groupby("ts_code"), d["ts_code"]
    shifted = lambda x, k: x.groupby(code).shift(k)

    def roll(x, k, how="mean", shift=0):
        return (shifted(x, shift) if shift else x).groupby(code).rolling(k, min_periods=k).agg(how).reset_index(level=0, drop=True).reindex(d.index)

    pos = lambda x: x.where(x > 0)
    ret = np.log(pos(d["adj_close"])).groupby(code).diff()
    cell = [d["trade_date"], d["industry_l1_code"].fillna("none")]
    n, total = ret.notna().groupby(cell).transform("sum"), ret.fillna(0).groupby(cell).transform("sum")
    peers = (total - ret) / (n - 1).replace(0, np.nan)
    rel = ret - peers
    ill, turn = ret.abs() / (pos(d["amount_cny"]) / 1e8), d["turnover_rate"].where(d["turnover_rate"] >= 0)
    change = lambda x: np.log(pos(roll(x, p.confirmation))) - np.log(pos(roll(x, p.liquidity, shift=p.confirmation)))

    def res(y, xs, ridge=0.0):
        v, out = np.column_stack([y, *xs]), np.full(len(d), np.nan)
        for _, rows in d.dropna(subset=["industry_l1_code"]).groupby(["trade_date", "industry_l1_code"]):
            at = rows.index.to_numpy()
            at = at[np.isfinite(v[at]).all(axis=1)]
            if len(at) >= max(p.least, len(xs) + 3):
                x = v[at, 1:]
                x = x[:, x.std(axis=0) > 1e-12]
                z = (x - x.mean(axis=0)) / x.std(axis=0)
                y0 = v[at, 0] - v[at, 0].mean()
                out[at] = y0 - z @ np.linalg.lstsq(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y0, rcond=None)[0]
        return pd.Series(out)

    fund = [np.log(pos(d["revenue_ttm"])), np.log(pos(d["net_assets"])), d["roe_ttm"], d["revenue_growth_yoy"], d["roe_change_yoy"], d["debt_to_assets"], (d["net_profit_ttm"] <= 0) * 1.0]
    gap = -res(d["log_total_mv"], fund, p.ridge)
    days, slopes = sorted(d["trade_date"].unique()), {}
    v = np.column_stack([d["log_total_mv"], *fund])
    for key, rows in d.dropna(subset=["industry_l1_code"]).groupby(["trade_date", "industry_l1_code"]):
        at = rows.index[np.isfinite(v[rows.index]).all(axis=1)]
        if len(at) >= max(p.least, len(fund) + 3):
            x, y = v[at, 1:], v[at, 0]
            sd = x.std(axis=0)
            use = sd > 1e-12
            z = (x[:, use] - x[:, use].mean(axis=0)) / sd[use]
            b = np.zeros(len(fund))
            b[use] = np.linalg.solve(z.T @ z + p.ridge * np.eye(use.sum()), z.T @ (y - y.mean())) / sd[use]
            slopes[key] = b
    revision = np.full(len(d), np.nan)
    before = {c: shifted(x, p.revision) for c, x in enumerate(fund)}
    group_before = shifted(d["industry_l1_code"], p.revision)
    for i in d.index:
        k = days.index(d["trade_date"][i]) - p.revision
        b = slopes.get((days[k], d["industry_l1_code"][i])) if k >= 0 else None
        if b is not None and group_before[i] == d["industry_l1_code"][i]:
            parts = [b[c] * (fund[c][i] - before[c][i]) for c in before]
            revision[i] = np.nansum(parts) if np.isfinite(parts).any() else np.nan
    vol, moved, size = roll(ret, 20, "std"), roll(ret.abs(), 5, "sum"), d["log_circ_mv"]
    f1 = res(gap, [np.log(pos(roll(ill, 20))), np.log(pos(roll(turn, 20))), vol, size], p.ridge)
    f2 = res(revision, [f1])
    f8 = res(roll(rel, p.formation, "sum", p.skip), [f1, f2])
    f3 = res(-roll(rel, p.pullback, "sum", p.pullback_skip), [f1, f2, f8])
    f4 = res(roll(rel, p.confirmation, "sum"), [f3, f8, -rel, vol])
    f5 = res(-change(ill), [moved, vol, f3, f4])
    f6 = res(change(turn), [moved, vol, f5, size, f3, f4])

    def corr(a, b):
        k = p.delay_window
        ma, mb = roll(a, k), roll(b, k)
        spread = (roll(a * a, k) - ma * ma).clip(lower=0) * (roll(b * b, k) - mb * mb).clip(lower=0)
        return ((roll(a * b, k) - ma * mb) / np.sqrt(spread).replace(0, np.nan)).abs()

    now, later = corr(ret, peers), sum(corr(ret, shifted(peers, k)).fillna(0) for k in range(1, p.delay_lags + 1))
    delay = later / (now + later).replace(0, np.nan)
    f7 = res(shifted(delay, p.delay_change) - delay, [f4, f5, f6])
    out = d[["trade_date", "ts_code"]].copy()
    for name, f in zip(value.FEATURES, (f1, f2, f8, f3, f4, f5, f6, f7)):
        g = f.groupby(d["trade_date"])
        mid = g.transform("median")
        mad = (f - mid).abs().groupby(d["trade_date"]).transform("median")
        f = f.where(~(mad > 0), f.clip(mid - p.mad_scale * mad, mid + p.mad_scale * mad))
        g = f.groupby(d["trade_date"])
        out[name] = (f - g.transform("mean")) / g.transform(lambda x: x.std(ddof=0)).replace(0, np.nan)
    return out


def test_value_features_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(2)
    panel = make_panel(45, 24).sort_values(["ts_code", "trade_date"], ignore_index=True)
    n = len(panel)
    panel = panel.assign(adj_close=panel["adj_close"] * np.exp(rng.normal(0, 0.02, n)), amount_cny=rng.uniform(1e7, 1e8, n), turnover_rate=rng.uniform(0.5, 3, n), log_total_mv=np.log(panel["total_mv_cny"]) + rng.normal(0, 0.1, n), log_circ_mv=rng.normal(20, 1, n))
    panel = panel.assign(**{c: rng.uniform(1, 5, n) for c in value.FUNDAMENTALS})
    panel["net_profit_ttm"] -= 3
    panel["industry_l1_code"] = panel["industry_l1_code"].astype(object).where(panel["ts_code"] != panel["ts_code"].iloc[-1], None)  # one without an industry
    p = value.Parameters(revision=3, formation=8, skip=3, pullback=6, pullback_skip=2, liquidity=8, delay_window=12, delay_lags=2, delay_change=3, least=10)
    got = value.value_features(spark.createDataFrame(panel), p).toPandas().sort_values(["ts_code", "trade_date"], ignore_index=True)
    want = plain_value_features(panel, p)
    assert len(got) == n and (got["ts_code"] == want["ts_code"]).all()
    for name in value.FEATURES:
        assert want[name].notna().sum() > 100, name
        assert np.allclose(got[name].to_numpy(float), want[name].to_numpy(float), atol=1e-6, equal_nan=True), name
    assert got[got["ts_code"] == panel["ts_code"].iloc[-1]][list(value.FEATURES)].isna().all().all()


def test_revision_uses_the_slopes_of_then(spark):
    rng = np.random.default_rng(3)
    panel = make_panel(8, 24)
    n = len(panel)
    panel = panel.assign(log_total_mv=rng.normal(size=n), **{c: rng.uniform(1, 5, n) for c in value.FUNDAMENTALS})
    panel["net_profit_ttm"] -= 3
    got = value.gap_and_revision(spark.createDataFrame(panel), value.Parameters(revision=2, ridge=5.0, least=10), "industry_l1_code").toPandas()
    x = pd.DataFrame({"a": np.log(panel["revenue_ttm"]), "b": np.log(panel["net_assets"]), **{c: panel[c] for c in ("roe_ttm", "revenue_growth_yoy", "roe_change_yoy", "debt_to_assets")}, "l": (panel["net_profit_ttm"] <= 0) * 1.0})
    days = sessions(8)
    for (d, g), rows in panel.groupby(["trade_date", "industry_l1_code"]):
        at = days.index(d)
        own = got[(got["trade_date"] == d) & (got["industry_l1_code"] == g)].set_index("ts_code")
        assert np.allclose(own.loc[rows["ts_code"], "gap"], -plain_residual(rows["log_total_mv"].to_numpy(), x.loc[rows.index].to_numpy(), 10, 5.0))
        if at < 2:
            assert own["revision"].isna().all()
            continue
        then = panel[(panel["trade_date"] == days[at - 2]) & (panel["industry_l1_code"] == g)]
        past, y = x.loc[then.index].to_numpy(), then["log_total_mv"].to_numpy()
        z = (past - past.mean(axis=0)) / past.std(axis=0)
        slopes = np.linalg.solve(z.T @ z + 5.0 * np.eye(z.shape[1]), z.T @ (y - y.mean())) / past.std(axis=0)
        assert np.allclose(own.loc[rows["ts_code"], "revision"], (x.loc[rows.index].to_numpy() - x.loc[then.index].to_numpy()) @ slopes)


def test_capped_weights_are_those_of_repeated_filling(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(v)) for g in range(20) for i, v in enumerate(rng.pareto(1.0, rng.integers(1, 40)))] + [(99, 0, 0.0), (99, 1, None), (99, 2, 0.0)]
    got = portfolio.capped_weights(spark.createDataFrame(rows, "g int, ts_code int, v double"), ["g"], "v", 0.1).toPandas()
    for g, own in got.groupby("g"):
        w = own["v"].fillna(0).to_numpy()
        w = w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))
        if 0.1 * len(w) <= 1:
            w = np.full(len(w), 1 / len(w))
        full = np.zeros(len(w), bool)
        while 0.1 * len(w) > 1 and (w > 0.1 + 1e-12).any():
            full |= w >= 0.1 - 1e-12
            rest = np.where(full, 0, w if w[~full].sum() > 0 else 1.0)
            w = np.where(full, 0.1, rest * (1 - 0.1 * full.sum()) / rest.sum())
        assert np.allclose(own["capped"], w), g


def test_range_maxima_are_plain_maxima(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"ts_code": "a", "trade_date": sessions(60), "adj_high": rng.normal(size=60)})
    pdf["adj_high"] = pdf["adj_high"].astype(object).where(pdf.index != 7, None)
    spans = [("a", int(s), int(s + k)) for s in rng.integers(1, 40, 30) for k in (0, 1, 2, 7, 20)]
    got = paths.range_maximum(spark.createDataFrame(pdf), "adj_high", spark.createDataFrame(spans, "ts_code string, start int, end int"), 20, "m").collect()
    for r in got:
        inner = pdf["adj_high"].astype(float).iloc[r["start"] : max(r["start"], r["end"] - 1)].max()
        assert r["m"] == (None if np.isnan(inner) else pytest.approx(inner))


def test_regime_residual_passes_short_series_through(spark):
    rng = np.random.default_rng(6)
    long, short = sessions(120), sessions(30)
    pdf = pd.DataFrame({"s": ["l"] * 120 + ["k"] * 30, "trade_date": long + short, "x": rng.normal(size=150)})
    pdf["y"] = 2 * pdf["x"] + np.where(pdf["trade_date"] > long[99], 1.0, 0.0) * (pdf["s"] == "l")
    got = residual.regime_residual(spark.createDataFrame(pdf), ["s"], "y", ["x"], 100, 20, "r").toPandas()
    assert np.allclose(got[got["s"] == "l"].sort_values("trade_date")["r"], [0.0] * 100 + [1.0] * 20)
    assert np.allclose(got[got["s"] == "k"].sort_values("trade_date")["r"], pdf[pdf["s"] == "k"]["y"])


def test_gate_without_its_test_fails(spark):
    tests = spark.createDataFrame([(1, 0.5, 0.9, 0.01, 1.0), (1, 0.4, 0.9, 0.01, 1.0), (2, None, 0.9, 0.01, None)], "k int, mean double, positive_ratio double, fdr_q double, top_bottom_mean double")
    assert not gates.gate(tests, {"k": 1}, 0.0, 0.0).first()["passed"] and not gates.gate(tests, {"k": 3}, 0.0, 0.0).first()["passed"]
    assert not gates.gate(tests, {"k": 2}, 0.0, 0.0, tail=True).first()["passed"]


def test_tables_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, "c")], "n int, t string")
    df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/x.csv")
    df.coalesce(1).write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/x.tsv")
    df.write.parquet(f"{tmp_path}/x.parquet")
    for name in ("x.csv", "x.tsv", "x.parquet"):
        assert sorted(map(tuple, files.read_table(spark, f"{tmp_path}/{name}").collect())) == [(1, "a,b"), (2, "c")]
    assert files.read_table(spark, f"{tmp_path}/x.csv", "n long, t string").dtypes == [("n", "bigint"), ("t", "string")]
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/x.xlsx")


def test_results_are_kept_by_identity(spark, tmp_path):
    made = []

    def build(rows=((1, 2),)):
        made.append(1)
        return spark.createDataFrame(list(rows), "trade_date int, ts_code int")

    for version in ("v1", "v1", "v2"):
        assert files.cached(spark, str(tmp_path), {"version": version, "start": 3}, build).count() == 1
    assert len(made) == 2
    key = files.cache_key({"version": "v1", "start": 3})
    (tmp_path / f"{key}.parquet" / "_SUCCESS").unlink()
    with pytest.raises(files.DamagedEntry):
        files.cached(spark, str(tmp_path), {"start": 3, "version": "v1"}, build)
    with pytest.raises(ValueError):
        files.cached(spark, str(tmp_path), {"version": "v3"}, lambda: build([(1, 2), (1, 2)]))
    assert not (tmp_path / f"{files.cache_key({'version': 'v3'})}.parquet").exists()


def test_tables_are_written_by_suffix_and_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    for name in ("t.csv", "t.parquet", "t.json"):
        files.write_table(df, f"{tmp_path}/{name}")
        assert sorted((r["n"], r["t"]) for r in files.read_table(spark, f"{tmp_path}/{name}").collect()) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="exists"):
        files.write_table(df, f"{tmp_path}/t.csv")


def test_raw_tables_manifests_and_completeness(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "n int")
    df.write.parquet(f"{tmp_path}/raw/v1/vendor/daily.parquet")
    assert files.raw_dataset(spark, str(tmp_path), "v1", "vendor", "daily").count() == 1
    assert files.raw_dataset(spark, str(tmp_path), "v1", "vendor", "none") is None and files.manifest(spark, str(tmp_path), "v1") is None
    spark.createDataFrame([("v1", '{"rows": 5}')], "version string, manifest string").write.parquet(f"{tmp_path}/manifests")
    assert files.manifest(spark, str(tmp_path), "v1") == {"rows": 5} and files.manifest(spark, str(tmp_path), "v2") is None
    assert files.is_complete({"version_kind": "complete"}) and not files.is_complete({"version_kind": "partial", "rows": 10**7, "start": "2016-01-01"})
    assert files.is_complete({"rows": 2_000_000, "start": "2016-01-04"}) and not files.is_complete({"rows": 2_000_000, "start": "2018-01-04"}) and not files.is_complete({})


def test_observations_are_written_once(spark, tmp_path):
    import json

    events = spark.createDataFrame([(1, 2.5)], "ts_code int, severity double")
    folder = files.write_observation(spark, str(tmp_path), {"template": "wick", "as_of": "2024-01-05"}, events)
    card = json.loads(spark.read.text(f"{folder}/card.json").first()[0])
    assert card["template"] == "wick" and card["events"].startswith("1-") and spark.read.parquet(f"{folder}/events.parquet").count() == 1
    with pytest.raises(FileExistsError):
        files.write_observation(spark, str(tmp_path), {"template": "wick", "as_of": "2024-01-05"}, events)
    assert files.write_observation(spark, str(tmp_path), {"template": "wick", "as_of": "2024-01-08"}, events) != folder
