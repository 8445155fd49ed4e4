"""The groups of the timing table against pandas; a table whose features never see their own day."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import timing, timing_groups as g

DAYS = [d for d in (date(2024, 1, 2) + timedelta(days=k) for k in range(126)) if d.weekday() < 5][:90]
TEXT = [d.strftime("%Y%m%d") for d in DAYS]
CLOSE = 3000 * np.exp(np.linspace(0, 0.08, 90) + 0.01 * np.sin(np.arange(90)))


def pdf(df):
    return df.toPandas().sort_values("trade_date", ignore_index=True)


def same(got, want):
    return np.allclose(pd.to_numeric(got).to_numpy(float), np.asarray(want, float), equal_nan=True)


@pytest.fixture(scope="module")
def index(spark):
    rows = [(t, "000300.SH", float(c)) for t, c in zip(TEXT, CLOSE)] + [(t, "OTHER", 1.0) for t in TEXT]
    return g.index_frame(spark.createDataFrame(rows, "trade_date string, ts_code string, close double"), "000300.SH")


@pytest.fixture(scope="module")
def stocks(spark):
    rows = [(t, f"{i:06d}", round(0.01 * math.sin(p / 5 + i), 6), str(1_000_000 + i * 1000)) for i in range(8) for p, t in enumerate(TEXT)]
    return rows, spark.createDataFrame(rows, "trade_date string, ts_code string, pct_chg double, amount string")


def test_breadth(index, stocks):
    p = pdf(g.breadth(index, stocks[1]))
    c = pd.Series(CLOSE)
    lr = np.log(c).diff()
    assert same(p["index_ret_20d"], c.pct_change(20)) and same(p["index_vol_20d"], lr.rolling(20, min_periods=10).std()) and same(p["index_drawdown_60d"], c / c.rolling(60, min_periods=20).max() - 1)
    ma = c.rolling(60, min_periods=30).mean()
    assert same(p["index_above_ma60"], (c > ma).astype(float).where(ma.notna()))
    s = pd.DataFrame(stocks[0], columns=["d", "c", "r", "a"]).groupby("d")["r"]
    up, down = s.agg(lambda x: (x > 0).sum()).reset_index(drop=True), s.agg(lambda x: (x < 0).sum()).reset_index(drop=True)
    ratio = up / (up + down)
    assert same(p["up_ratio"], ratio) and same(p["adv_dec_log"], np.log((up + 0.5) / (down + 0.5))) and same(p["breadth_thrust"], ratio.rolling(5, min_periods=3).mean() - ratio.rolling(20, min_periods=10).mean())
    assert list(pdf(g.breadth(index)).columns) == ["trade_date", "index_ret_20d", "index_ret_60d", "index_vol_20d", "index_drawdown_60d", "index_above_ma20", "index_above_ma60"]


def test_breadth_from_prices(spark, index):
    df = spark.createDataFrame([(TEXT[0], "a", 10.0, 9.0), (TEXT[0], "b", 8.0, 9.0), (TEXT[0], "c", 9.0, 9.0), (TEXT[0], "d", 9.0, None)], "trade_date string, ts_code string, close double, pre_close double")
    assert pdf(g.breadth(index, df))["up_ratio"][0] == 0.5


def test_valuation(spark):
    basic = spark.createDataFrame([("20240102", "14"), ("2024-01-03", "-3"), ("20240104", "x"), ("bad", "9")], "trade_date string, pe string")
    bond = spark.createDataFrame([("20240102", 10.0, 2.6), ("20240102", 1.0, 9.0), ("20240103", 10.0, 2.7)], "date string, curve_term double, yield_rate double")
    p = pdf(g.valuation(basic, bond, 0.03))
    assert same(p["pe_ttm"], [14, -3, np.nan]) and same(p["bond_10y_yield"], [0.026, 0.027, 0.03]) and same(p["erp"], [1 / 14 - 0.026, np.nan, np.nan])
    assert same(pdf(g.valuation(basic))["erp"], [np.nan] * 3)


def test_funding_and_flow(spark, stocks):
    buy, left = np.linspace(1e7, 2e7, 90) * (1 + 0.1 * np.cos(np.arange(90))), np.linspace(2e8, 2.3e8, 90)
    df = spark.createDataFrame([(t, float(b) / 2, float(x) / 2) for t, b, x in zip(TEXT, buy, left) for _ in range(2)], "trade_date string, rzmre double, rzye double")
    p = pdf(g.funding(df, stocks[1]))
    q = pd.Series(buy / sum(1_000_000 + i * 1000 for i in range(8)))
    m, s = q.rolling(20, min_periods=10).mean(), q.rolling(20, min_periods=10).std()
    assert same(p["rzmre_ratio"], q) and same(p["rzye_chg_5d"], pd.Series(left).pct_change(5)) and same(p["rzmre_boll_pos_20"], (q - m) / s) and same(p["rzmre_boll_pct_20"], (q - (m - 2 * s)) / (4 * s))
    assert same(pdf(g.funding(df.drop("rzye")))["rzmre_ratio"], buy)
    p = pdf(g.money_flow(df.select("trade_date", F.col("rzmre").alias("net_amount"))))
    assert same(p["main_net_ratio_ma5"], pd.Series(buy).rolling(5, min_periods=3).mean()) and same(p["main_net_ratio_sum_20d"], pd.Series(buy).rolling(20, min_periods=10).sum())


def test_options(spark, index):
    spot, rate = CLOSE[0], 0.02
    basic, daily = [], []
    for code, strike, days, vol, kind in (("A", spot, 30, 0.25, "C"), ("B", spot * 1.02, 30, 0.35, "认沽"), ("LATE", spot, 60, 0.9, "C"), ("FAR", spot * 1.2, 30, 0.9, "P"), ("SOON", spot, 5, 0.9, "P")):
        price = float(timing.option_price(spot, strike, days / 365, rate, vol, kind == "C"))
        basic.append((code, float(strike), (DAYS[0] + timedelta(days=days)).strftime("%Y%m%d"), kind))
        daily.append((TEXT[0], code, price, 100.0))
    daily.append((TEXT[1], "A", 0.0, 50.0))
    b, d = spark.createDataFrame(basic, "ts_code string, exercise_price double, maturity_date string, call_put string"), spark.createDataFrame(daily, "trade_date string, ts_code string, close double, amount double")
    iv = g.at_the_money(b, d, index).collect()
    assert len(iv) == 1 and iv[0].iv_atm == pytest.approx(0.30, abs=1e-4)
    p = pdf(g.option_sentiment(b, d, index))
    assert same(p["put_call_log"], [math.log(301 / 201), math.log(1 / 51)])
    own = spark.createDataFrame([(TEXT[30], 0.2), (TEXT[30], 0.4)], "trade_date string, iv double")
    p = pdf(g.option_sentiment(b, d, index, own))
    real = pd.Series(np.log(CLOSE)).diff().rolling(20, min_periods=10).std()[30] * 252**0.5
    assert len(p) == 3 and p["iv_realized_spread"][2] == pytest.approx(0.3 - real)


def test_futures(spark, index):
    hold = spark.createDataFrame([(TEXT[0], "IF2402", 10.0, 30.0), (TEXT[0], "IF2403", 5.0, 9.0), (TEXT[0], "IC2402", 99.0, 1.0)], "trade_date string, symbol string, long_hld double, short_hld double")
    ends = {"IF2401": 4, "IF2402": 40, "IF2403": 70, "IF2406": 160, "IC2402": 40}
    basic = spark.createDataFrame([(f"{k}.CFX", k, (DAYS[0] + timedelta(days=v)).strftime("%Y%m%d")) for k, v in ends.items()], "ts_code string, symbol string, delist_date string")
    daily = spark.createDataFrame([(TEXT[0], f"{k}.CFX", float(CLOSE[0] * (1 + i / 100))) for i, k in enumerate(ends)], "trade_date string, ts_code string, close double")
    r = g.futures_sentiment(index, "IF", hold, daily, basic).first()
    assert r.fut_ls_log == pytest.approx(math.log(40 / 16)) and r.fut_near_basis_ann == pytest.approx(0.01 * 365 / 40) and r.fut_next_basis_ann == pytest.approx(0.02 * 365 / 70)
    assert g.futures_sentiment(index, "IF", hold).columns == ["trade_date", "fut_ls_log"]
    with pytest.raises(ValueError):
        g.futures_sentiment(index, "IF")


@pytest.fixture(scope="module")
def groups_of(spark, index, stocks):
    basic = spark.createDataFrame([(t, float(x)) for t, x in zip(TEXT, np.linspace(14, 11, 90))], "trade_date string, pe_ttm double")
    bond = spark.createDataFrame([(t, float(x)) for t, x in zip(TEXT, np.linspace(2.6, 2.8, 90))], "trade_date string, yield double")
    margin = spark.createDataFrame([(t, float(1e7 + 1e5 * k), 2e8) for k, t in enumerate(TEXT)], "trade_date string, rzmre double, rzye double")
    pmi = spark.createDataFrame([(TEXT[5], 49.8), (TEXT[25], 50.3), (TEXT[45], 50.8), (TEXT[65], 49.0)], "available_date string, pmi double")
    epu = spark.createDataFrame([(TEXT[10], 100.0), (TEXT[50], 150.0)], "date string, epu double")
    return {"valuation": g.valuation(basic, bond), "market_breadth": g.breadth(index, stocks[1]), "leverage_funding": g.funding(margin, stocks[1]), "macro": g.macro(pmi=pmi, epu=epu)}


def test_table_is_late_and_labelled(index, groups_of):
    p = pdf(g.timing_table(index, groups_of, 1, (5, 10, 20), z=20, pct=40))
    assert {"erp", "erp_z_20", "up_ratio_pct_40", "rzmre_ratio_high_90", "index_vol_20d_z_20", "high_leverage_and_weak_breadth"} <= set(p.columns) and len(p) == 90
    assert p["label_20d_excess_return"][0] == pytest.approx(CLOSE[20] / CLOSE[0] - 1) and p["label_5d_excess_return"][3] == pytest.approx(CLOSE[8] / CLOSE[3] - 1) and pd.isna(p["label_20d_excess_return"][89])
    assert pd.isna(p["pmi"][5]) and p["pmi"][6] == 49.8 and p["pmi"][24] == 49.8 and p["pmi"][26] == 50.3 and p["pmi_above_50"][26] == 1.0 and p["pmi_chg_1m"][26] == pytest.approx(0.5)
    erp = pd.Series(1 / np.linspace(14, 11, 90) - np.linspace(2.6, 2.8, 90) / 100)
    med = erp.rolling(20, min_periods=20).median()
    z = (0.67448975 * (erp - med) / (erp - med).abs().rolling(20, min_periods=20).median().replace(0, np.nan)).clip(-3, 3)
    pct = erp.rolling(40, min_periods=20).apply(lambda x: (x <= x[-1]).mean(), raw=True).clip(0.01, 0.99)
    assert same(p["erp"], erp.shift(1)) and same(p["erp_z_20"], z.shift(1)) and same(p["erp_pct_40"], pct.shift(1)) and same(p["erp_chg_5d"], (erp - erp.shift(5)).shift(1))
    assert same(p["erp_high_90"], (pct > 0.9).astype(float).where(pct.notna()).shift(1)) and same(p["erp_low_5"], (pct < 0.05).astype(float).where(pct.notna()).shift(1))
    assert same(p["high_leverage_and_weak_breadth"], p["rzmre_ratio_pct_40"] * (1 - p["up_ratio_pct_40"]))


def test_lags_by_group_and_a_benchmark(spark, index, groups_of):
    bench = spark.createDataFrame([(d, 100.0 + k) for k, d in enumerate(DAYS)], "trade_date date, index_close double")
    p = pdf(g.timing_table(index, {k: groups_of[k] for k in ("valuation", "macro")}, {"macro": 3}, (2,), bench, z=20, pct=40))
    assert pd.isna(p["pmi"][7]) and p["pmi"][8] == 49.8
    assert p["label_2d_excess_return"][0] == pytest.approx(CLOSE[2] / CLOSE[0] - 102 / 100)
    # What is said of a session does not change when later sessions come.
    cut = {k: v.filter(F.col("trade_date") < DAYS[60]) for k, v in groups_of.items()}
    early = pdf(g.timing_table(index.filter(F.col("trade_date") < DAYS[60]), cut, z=20, pct=40))
    whole = pdf(g.timing_table(index, groups_of, z=20, pct=40)).iloc[:60]
    assert all(same(early[c], whole[c]) for c in early.columns if c != "trade_date" and not c.startswith("label"))
