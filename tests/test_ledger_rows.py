"""What a ledger's task is given."""

from panels import make_panel
from pyspark.sql import functions as F

from panelyard.operators import portfolio


def test_rows_follow_the_depth_not_the_securities(spark):
    panel = spark.createDataFrame(make_panel(days=40, stocks=60))
    scores = panel.select("trade_date", "ts_code", F.pmod(F.xxhash64("trade_date", "ts_code"), F.lit(1000)).cast("double").alias("factor_value"))
    grid = spark.createDataFrame([("a", 1, 2, 0.0), ("b", 2, 4, 20.0)], "scenario string, top_n int, holding_days int, cost_bps double")
    rows = portfolio.touched(panel, scores, grid, "is_liquid", portfolio.Rules(lot_size=1), 2)
    by = {r["scenario"]: r for r in rows.groupBy("scenario").agg(F.count("*").alias("n"), F.count_distinct("trade_date").alias("days"), F.sum(F.col("candidate").cast("int")).alias("candidates"), F.min("cut").alias("cut")).collect()}
    assert {s: (r["days"], r["candidates"], r["cut"]) for s, r in by.items()} == {"a": (40, 80, True), "b": (40, 160, True)}
    assert max(r["n"] for r in by.values()) <= 40 * 4 * 6 + 40  # of 40 x 60: a candidate's date and up to the sale, and a row a session
    trades = portfolio.ledgers(panel, scores, grid, rules=portfolio.Rules(lot_size=1), buffer=2, what="trades").filter("side = 'SELL'")
    assert trades.count() > 60


def test_blocked_exits_stay_in_sight(spark):
    pdf = make_panel(days=12, stocks=1)
    pdf.loc[3:7, "is_suspended"] = True
    panel = spark.createDataFrame(pdf)
    scores = panel.filter(F.col("trade_date") == str(pdf["trade_date"][0])).select("trade_date", "ts_code", F.lit(1.0).alias("factor_value"))
    grid = spark.createDataFrame([("a", 1, 2, 0.0)], "scenario string, top_n int, holding_days int, cost_bps double")
    sold = portfolio.ledgers(panel, scores, grid, what="trades").filter("side = 'SELL'").collect()
    assert [t["trade_date"] for t in sold] == [pdf["trade_date"][8]]
