import math

import numpy as np
import pandas as pd
import pytest
from panels import day, make_panel, one_stock
from pyspark.sql import functions as F

from panelyard.functions import frames
from panelyard.operators import boxes, events, execution, joins, portfolio, residual, rotation, statements, stats, timing
from panelyard.sources import panel as panels


def test_cardinality_checks(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    b = spark.createDataFrame([(1, 5)], "k int, w int")
    assert joins.checked_join(a, b, ["k"]).count() == 2
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(b, a, ["k"])
    assert [tuple(r) for r in joins.unmatched(a, spark.createDataFrame([(1, 0), (2, 0)], "k int, w int"), ["k"]).collect()] == [(2, "right_only")]


def test_intervals_half_open_open_ended_and_overlapping(spark):
    left = spark.createDataFrame([("a", day(d)) for d in ("2023-12-31", "2024-01-01", "2024-01-05", "2024-01-10", "2024-03-01")] + [("b", day("2024-01-01"))], "ts_code string, trade_date date")
    right = spark.createDataFrame([("a", day("2024-01-01"), day("2024-01-10"), "x"), ("a", day("2024-01-05"), day("2024-01-07"), "y"), ("a", day("2024-02-01"), None, "z")], "ts_code string, in_date date, out_date date, code string")
    got = {(r["ts_code"], str(r["trade_date"])): r["code"] for r in joins.interval_join(left, right, ["ts_code"], "trade_date", "in_date", "out_date", ["code"]).collect()}
    assert got == {("a", "2023-12-31"): None, ("a", "2024-01-01"): "x", ("a", "2024-01-05"): "y", ("a", "2024-01-10"): None, ("a", "2024-03-01"): "z", ("b", "2024-01-01"): None}
    assert joins.overlaps(right, ["ts_code"], "in_date", "out_date").count() == 1


def test_quantile_buckets_follow_linear_edges(spark):
    for n, q in ((10, 5), (17, 5), (23, 10), (101, 10), (7, 3)):
        rows = spark.range(1, n + 1).select("id", frames.quantile_bucket(F.col("id"), F.lit(n), q).alias("b")).orderBy("id").collect()
        want = (pd.qcut(pd.Series(range(1, n + 1)), q, labels=False) + 1).tolist()
        assert [r["b"] for r in rows] == want, (n, q)


def test_newey_west_variants():
    x = np.array([0.1, 0.3, -0.2, 0.4, 0.0, 0.2, -0.1, 0.25])
    d = x - x.mean()
    v = d @ d / 8 + sum(2 * (1 - k / 3) * (d[k:] @ d[:-k]) / 8 for k in (1, 2))
    assert stats.newey_west(x, 2)[1] == pytest.approx(x.mean() / math.sqrt(v / 8))
    flat = d @ d / 8 + sum(2 * np.mean(d[k:] * d[:-k]) for k in (1, 2))
    assert stats.newey_west(x, 2, kernel="flat", floor=1e-12)[1] == pytest.approx(x.mean() / math.sqrt(max(flat, 1e-12) / 8))
    assert stats.newey_west(x, 20, truncate=False) != stats.newey_west(x, 20)
    assert stats.newey_west([1.0], 2) == (None, None) and stats.newey_west([1.0, 1.0], 2)[1] is None
    assert stats.newey_west([1.0, 2.0], None, least=3) == (None, None)


def test_distributed_newey_west_is_the_same(spark):
    x = [0.1, 0.3, None, -0.2, 0.4, 0.0, 0.2]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "series string, trade_date int, ic double")
    r = stats.newey_west_sums(df, ["series"], 3).first()
    assert r["nw_t"] == pytest.approx(stats.newey_west(x, 3)[1])


def test_fdr_is_monotone(spark):
    p = [0.01, 0.04, 0.03, None, 0.2]
    got = {r["p_value"]: r["fdr_q"] for r in stats.fdr(spark.createDataFrame([(v,) for v in p], "p_value double")).collect()}
    assert got == {0.01: pytest.approx(0.04), 0.03: pytest.approx(0.16 / 3), 0.04: pytest.approx(0.16 / 3), 0.2: pytest.approx(0.2), None: None}


def test_residuals_vanish_without_noise(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"trade_date": day("2024-01-02"), "ts_code": [str(i) for i in range(40)], "industry": [str(i % 4) for i in range(40)], "a": rng.normal(size=40), "b": rng.normal(size=40)})
    pdf["y"] = 2 * pdf["a"] - pdf["b"] + 3
    pdf["z"] = 1.5 * pdf["a"] + pdf["industry"].astype(int)
    df = spark.createDataFrame(pdf)
    assert residual.least_squares(df, "y", ["a", "b"], ["trade_date"], 10, "r").agg(F.max(F.abs("r"))).first()[0] < 1e-9
    assert residual.industry_and_size(df, "z", "a", "industry", "r").agg(F.max(F.abs("r"))).first()[0] < 1e-9
    noisy = pdf.assign(y=rng.normal(size=40))
    got = {r["ts_code"]: r["r"] for r in residual.industry_and_size(spark.createDataFrame(noisy), "y", "a", "industry", "r").collect()}
    x = np.column_stack([np.ones(40), noisy["a"], *(noisy["industry"] == k for k in "123")]).astype(float)
    want = noisy["y"] - x @ np.linalg.lstsq(x, noisy["y"], rcond=None)[0]
    assert [got[str(i)] for i in range(40)] == pytest.approx(want.tolist())


def test_rolling_residual_uses_prior_rows_only(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"ts_code": "a", "trade_date": [d.date() for d in pd.bdate_range("2024-01-01", periods=40)], "x": rng.normal(size=40)})
    pdf["y"] = 3 * pdf["x"] + 1
    got = residual.rolling_residual(spark.createDataFrame(pdf), "y", ["x"], 10, "r").orderBy("trade_date").collect()
    assert all(r["r"] is None for r in got[:10]) and all(abs(r["r"]) < 1e-4 for r in got[10:])


def ledger(spark, pdf, score=1.0, what="days", holding=1, top=1, rules=None, multiplier=None):
    panel = spark.createDataFrame(pdf)
    scores = panel.select("trade_date", "ts_code").withColumn("factor_value", F.lit(score))
    grid = spark.createDataFrame([("s", top, holding, 0.0)], "scenario string, top_n int, holding_days int, cost_bps double")
    out = portfolio.ledgers(panel, scores, grid, rules=rules or portfolio.Rules(initial_cash=100_000, lot_size=100), what=what, multiplier=multiplier)
    return out.orderBy("trade_date").collect()


def test_entry_at_the_next_open_and_exit_after_holding(spark):
    trades = ledger(spark, one_stock([8.0, 10.0, 11.0, 11.0]), what="trades")
    assert [(str(t["trade_date"]), t["side"]) for t in trades][:2] == [("2024-01-03", "BUY"), ("2024-01-04", "SELL")]
    assert trades[0]["shares"] == 10_000
    assert ledger(spark, one_stock([8.0, 10.0, 11.0, 11.0]))[-1]["nav"] == pytest.approx(110_000)


def test_limit_up_blocks_a_buy_and_limit_down_defers_a_sale(spark):
    pdf = one_stock([8.0, 10.0, 11.0])
    pdf.loc[1, "is_limit_up_open"] = True
    pdf.loc[2, "is_limit_up_open"] = True
    assert ledger(spark, pdf)[-1]["nav"] == 100_000 and not ledger(spark, pdf, what="trades")
    pdf = one_stock([8.0, 10.0, 11.0, 12.0])
    pdf.loc[2, "is_limit_down_open"] = True
    sells = [t for t in ledger(spark, pdf, what="trades") if t["side"] == "SELL"]
    assert str(sells[0]["trade_date"]) == "2024-01-05"


def test_multiplier_and_skip_policy(spark):
    pdf = one_stock([10.0] * 4)
    half = {d: 0.5 if i == 1 else 0.0 for i, d in enumerate(pdf["trade_date"])}
    trades = [t for t in ledger(spark, pdf, holding=2, what="trades", multiplier=half) if t["side"] == "BUY"]
    assert len(trades) == 1 and trades[0]["gross"] == 25_000
    pdf = one_stock([10.0] * 5)
    pdf.loc[2:, "is_limit_down_open"] = True
    rules = portfolio.Rules(initial_cash=100_000, blocked_exit="skip")
    assert len([t for t in ledger(spark, pdf, what="trades", rules=rules) if t["side"] == "BUY"]) == 1


def test_ledger_identity(spark):
    pdf = pd.concat([one_stock([10.0 + i * 0.1 * k for i in range(12)]).assign(ts_code=f"c{k}") for k in range(1, 5)])
    panel = spark.createDataFrame(pdf)
    scores = panel.select("trade_date", "ts_code", F.crc32(F.concat("ts_code", F.col("trade_date").cast("string"))).cast("double").alias("factor_value"))
    grid = spark.createDataFrame([(f"{n}{h}", n, h, 20.0) for n in (1, 2) for h in (1, 3)], "scenario string, top_n int, holding_days int, cost_bps double")
    days = portfolio.ledgers(panel, scores, grid, rules=portfolio.Rules(lot_size=1)).collect()
    assert len(days) == 48 and all(d["cash"] >= 0 and d["nav"] == pytest.approx(d["cash"] + d["gross_exposure"]) for d in days)
    w = portfolio.capped_weights(spark.createDataFrame([("g", 8.0), ("g", 1.0), ("g", 1.0)], "g string, w double"), ["g"], "w", 0.5).collect()
    assert sorted(r["capped"] for r in w) == pytest.approx([0.25, 0.25, 0.5])


def test_box_breaks_out(spark):
    closes = [10.00, 10.02, 10.01, 10.03, 10.00, 10.04, 10.02, 10.05, 10.08, 10.12, 10.9]
    pdf = pd.DataFrame({"trade_date": [d.date() for d in pd.bdate_range("2024-01-02", periods=11)], "ts_code": "a", "adj_open": [c - 0.01 for c in closes], "adj_high": [c + 0.05 for c in closes], "adj_low": [c - 0.05 for c in closes], "adj_close": closes, "volume_shares": np.linspace(1000, 1200, 11)})
    rules = boxes.BoxRules(lookback=4, atr_window=2, short_window=2, long_window=3, process_window=3, acceleration_window=1, volume_window=3)
    registry = boxes.Registry()
    registry.register("double_strength", lambda m: 2 * (m.close[m.at] - m.box["upper"]) / m.box["atr"])
    rows = boxes.boxes(spark.createDataFrame(pdf), rules, registry).collect()
    out = [r for r in rows if r["reason"] == "breakout"]
    assert len(out) >= 1 and out[-1]["double_strength"] == pytest.approx(2 * out[-1]["breakout_strength"])
    assert out[-1]["closed_at"] > out[-1]["created_at"] or out[-1]["closed_at"] == out[-1]["created_at"]
    with pytest.raises(ValueError):
        registry.register("gap_atr", lambda m: 0.0)


def test_statement_revisions_are_replayed(spark):
    cols = ["ts_code", "ann_date", "f_ann_date", "end_date", "report_type", "update_flag"]
    income = [("a", "20230330", "20230330", "20221231", "1", "0", 100.0, 10.0), ("a", "20230420", "20230420", "20221231", "1", "1", 120.0, 12.0), ("a", "20240328", "20240328", "20231231", "1", "0", 150.0, 20.0)]
    balance = [("a", "20230330", "20230330", "20221231", "1", "0", 80.0, 200.0, 100.0), ("a", "20240328", "20240328", "20231231", "1", "0", 120.0, 300.0, 150.0)]
    i = spark.createDataFrame(income, [*cols, "total_revenue", "n_income_attr_p"])
    b = spark.createDataFrame(balance, [*cols, "total_hldr_eqy_exc_min_int", "total_assets", "total_liab"])
    sessions = spark.createDataFrame([(day(d),) for d in ("2023-03-30", "2023-03-31", "2023-04-21", "2024-03-29")], "trade_date date")
    got = statements.fundamentals(i, b, sessions).orderBy("available_date").collect()
    assert [str(r["available_date"]) for r in got] == ["2023-03-31", "2023-04-21", "2024-03-29"]
    assert [r["revenue_ttm"] for r in got] == [100.0, 120.0, 150.0]
    assert got[2]["revenue_growth_yoy"] == pytest.approx(0.25) and got[2]["roe_ttm"] == pytest.approx(0.2) and got[0]["debt_to_assets"] == 0.5


def test_panel_units_and_status(spark):
    daily = spark.createDataFrame([("20240102", "a", 10.0, 10.2, 9.9, 10.1, 10.0, 123.0, 456.0, 1.0), ("20240103", "a", 10.0, 10.2, 9.9, 10.1, 10.1, 123.0, 456.0, 1.0)], "trade_date string, ts_code string, open double, high double, low double, close double, pre_close double, vol double, amount double, pct_chg double")
    sets = {
        "daily": daily, "adj_factor": spark.createDataFrame([("20240102", "a", 2.0)], "trade_date string, ts_code string, adj_factor double"), "daily_basic": spark.createDataFrame([("20240102", "a", 100.0)], "trade_date string, ts_code string, total_mv double"),
        "suspend": spark.createDataFrame([("20240104", "a")], "trade_date string, ts_code string"), "stock_basic": spark.createDataFrame([("a",)], "ts_code string"), "st_status": spark.createDataFrame([("20240103", "a", "ST x")], "trade_date string, ts_code string, name string"),
    }
    p = {str(r["trade_date"]): r for r in panels.build_panel(sets).collect()}
    first = p["2024-01-02"]
    assert first["volume_shares"] == 12_300 and first["amount_cny"] == 456_000 and first["total_mv_cny"] == 1_000_000 and first["adj_close"] == pytest.approx(20.2)
    assert not first["is_st"] and p["2024-01-03"]["is_st"] and p["2024-01-04"]["is_suspended"] and p["2024-01-04"]["listing_trade_days"] == 3
    assert "point_in_time_st_status" in {r["rule"] for r in panels.quality_issues(panels.build_panel(sets)).collect()}


def test_publish_and_load(spark, tmp_path):
    pdf = make_panel(6, 3).assign(st_status_known=True, circ_mv_cny=1.0)
    df = spark.createDataFrame(pdf)
    assert panels.content_hash(df) == panels.content_hash(df.repartition(3))
    version = panels.publish(df, str(tmp_path))
    got = panels.load(spark, str(tmp_path), start="2024-01-04", end="2024-01-05")
    assert got.count() == 6 and version.startswith("18-")
    with pytest.raises(ValueError):
        panels.publish(df.withColumn("raw_high", F.lit(0.5)), str(tmp_path))


def test_cooldowns(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 5, 6, 11, 12, 30)], "ts_code string, n int")
    kept = lambda inclusive: sorted(r["n"] for r in events.greedy_cooldown(df, "ts_code", "n", 5, inclusive).collect())
    assert kept(True) == [1, 6, 11, 30] and kept(False) == [1, 11, 30] or kept(False) == [1, 12, 30]


def test_retention_and_greedy(spark):
    ranks = [("a", i, r) for i, r in enumerate([6, 4, 6, 7, 6, 3])]
    df = spark.createDataFrame(ranks, "ts_code string, trade_date int, rank int")
    assert [r["held"] for r in rotation.retained(df, "ts_code", 4, 6).orderBy("trade_date").collect()] == [False, True, True, False, False, True]
    rows = [(1, "a", 9.0, [1, 2, 3]), (1, "b", 8.0, [1, 2, 4]), (1, "c", 7.0, [5, 6]), (1, "d", 6.0, [7])]
    got = rotation.greedy_distinct(spark.createDataFrame(rows, "trade_date int, concept_code string, score double, members array<int>"), ["trade_date"], "score", "members", 2, 0.5)
    assert [r["concept_code"] for r in got.orderBy("rank").collect()] == ["a", "c"]


def test_implied_volatility_round_trip(spark):
    pdf = pd.DataFrame({"k": [90.0, 100.0, 110.0], "t": [0.5, 1.0, 0.25], "v": [0.2, 0.35, 0.5], "call": [True, False, True]})
    pdf["p"] = timing.option_price(np.full(3, 100.0), pdf["k"].to_numpy(), pdf["t"].to_numpy(), np.full(3, 0.03), pdf["v"].to_numpy(), pdf["call"].to_numpy())
    got = spark.createDataFrame(pdf).select("v", timing.implied_volatility(F.col("p"), F.lit(100.0), F.col("k"), F.col("t"), F.lit(0.03), F.col("call")).alias("s")).collect()
    assert all(abs(r["s"] - r["v"]) < 1e-4 for r in got)


def test_hmm_filter_is_causal_and_normalised(spark):
    rng = np.random.default_rng(3)
    x = np.where(np.arange(200) // 50 % 2 == 0, rng.normal(-1, 0.3, 200), rng.normal(1, 0.3, 200))
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "e string, trade_date int, v double")
    full = {r["trade_date"]: (r["p0"], r["p1"]) for r in timing.hmm_filter(df, "v", "e", fit_rows=120, refit=20).collect()}
    short = {r["trade_date"]: (r["p0"], r["p1"]) for r in timing.hmm_filter(df.filter("trade_date < 150"), "v", "e", fit_rows=120, refit=20).collect()}
    assert all(sum(p) == pytest.approx(1) for p in full.values()) and all(full[k] == pytest.approx(v) for k, v in short.items())
    assert np.mean([(p[1] > 0.5) == (x[k] > 0) for k, p in full.items()]) > 0.95


def test_execution_ledger_fills_over_days_and_balances(spark):
    days = pd.bdate_range("2024-01-02", periods=30)
    pdf = pd.DataFrame([{"trade_date": d.date(), "ts_code": c, "raw_open": 10.0, "adj_open": 10.0, "adj_close": 10.0, "amount_cny": 1e6, "is_suspended": False, "listing_trade_days": 100} for d in days for c in ("a", "b")])
    panel = execution.prepared(portfolio.executable(spark.createDataFrame(pdf), portfolio.Rules()))
    targets = spark.createDataFrame([(days[12].date(), "a", 0.5), (days[12].date(), "b", 0.5)], "entry_date date, ts_code string, target_weight double")
    free = execution.Costs(initial_cash=400_000, lot_size=100, participation=0.05, multiplier=0.0)
    got = execution.ledgers(panel, targets, {"free": free, "dear": execution.Costs(initial_cash=400_000)}).orderBy("scenario", "trade_date").collect()
    days_free = [r for r in got if r["scenario"] == "free"]
    assert all(r["nav"] == pytest.approx(400_000) for r in days_free)
    assert [r["cash"] for r in days_free][12:17] == pytest.approx([300_000, 200_000, 100_000, 0, 0], abs=1.0)
    dear = [r for r in got if r["scenario"] == "dear"]
    assert dear[-1]["nav"] < 400_000 and all(r["cash"] >= 0 for r in dear)
