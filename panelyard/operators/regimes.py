"""Market regimes from breadth, cap-weighted returns and the size spread; all from what is known at the close.

The market tables have one row a session, so their windows need no partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames

def _market() -> Window:
    return Window.orderBy("trade_date")


def _stocks(panel: DataFrame, long: int, cap: str) -> DataFrame:
    w = frames.history()
    past = lambda k: frames.safe_ratio(F.col("adj_close"), F.lag("adj_close", k).over(w)) - 1
    return panel.withColumns({"one": past(1), "many": past(long), "cap_before": F.lag(cap, 1).over(w)})


def _compound(r: Column, size: int) -> Column:
    return frames.compound(r, size, _market())


def breadth_regimes(panel: DataFrame, long: int = 20, change: int = 5, cap: str = "circ_mv_cny") -> DataFrame:
    """trade_date, market_breadth, breadth_change, market_return, regime: repair, overheat or retreat."""
    s = _stocks(panel, long, cap).filter("is_tradeable")
    daily = s.groupBy("trade_date").agg(
        F.avg(F.when(F.col("many").isNotNull(), (F.col("many") > 0).cast("double"))).alias("market_breadth"),
        frames.safe_ratio(F.sum(F.when(F.col("cap_before") > 0, F.col("one") * F.col("cap_before"))), F.sum(F.when((F.col("cap_before") > 0) & F.col("one").isNotNull(), F.col("cap_before")))).alias("step"),
    )
    daily = daily.withColumns({"breadth_change": F.col("market_breadth") - F.lag("market_breadth", change).over(_market()), "market_return": _compound(F.col("step"), long)})
    up = F.col("market_return") > 0
    repair = up & (F.col("breadth_change") > 0) & (F.col("market_breadth") >= 0.3) & (F.col("market_breadth") < 0.7)
    regime = F.when(repair, "repair").when(up & (F.col("market_breadth") >= 0.7), "overheat").otherwise("retreat")
    return daily.select("trade_date", "market_breadth", "breadth_change", "market_return", regime.alias("regime"))


def document_regimes(panel: DataFrame, long: int = 20, change: int = 5, spread: int = 10, usual: int = 120, least: int = 60, busy: float = 1.15, cap: str = "circ_mv_cny") -> DataFrame:
    """trade_date and regime: overheat, retreat, repair, divergence or neutral, the first that holds; and what it rests on.

    Overheated breadth is above the 80 % quantile of its own past; the size spread is
    the smallest third's mean return minus the largest's, ties by security.
    """
    w, d = frames.history(), Window.partitionBy("trade_date")
    amount = frames.safe_ratio(frames.rolling(F.col("amount_cny"), 5), frames.rolling(F.col("amount_cny"), 20))
    s = _stocks(panel, long, cap).withColumn("busy", amount).filter("is_tradeable")
    breadth = s.filter("many is not null").groupBy("trade_date").agg(F.avg((F.col("many") > 0).cast("double")).alias("market_breadth"), F.median("busy").alias("amount_ratio"))
    # The cap before is that of the security's last row with a return.
    one = s.filter(F.col("one").isNotNull() & (F.col(cap) > 0)).withColumn("cap_before", F.lag(cap, 1).over(w)).filter("cap_before > 0")
    one = one.withColumn("third", frames.quantile_bucket(F.row_number().over(d.orderBy("cap_before", "ts_code")), F.count("*").over(d), 3))
    mean = lambda k: F.avg(F.when(F.col("third") == k, F.col("one")))
    daily = one.groupBy("trade_date").agg((F.sum(F.col("one") * F.col("cap_before")) / F.sum("cap_before")).alias("cap_step"), (mean(1) - mean(3)).alias("size_step"))
    m = breadth.join(daily, "trade_date", "full")
    m = m.withColumns({
        "breadth_change": F.col("market_breadth") - F.lag("market_breadth", change).over(_market()), "market_return": _compound(F.col("cap_step"), long), "size_spread": _compound(F.col("size_step"), spread),
        "breadth_high": frames.rolling_quantile(F.col("market_breadth"), usual, 0.8, least, 1, _market()),
    })
    up = F.col("market_return") > 0
    regime = (
        F.when(up & (F.col("market_breadth") >= F.col("breadth_high")) & (F.col("amount_ratio") >= busy), "overheat")
        .when((F.col("market_return") <= 0) & (F.col("breadth_change") <= 0), "retreat")
        .when(up & (F.col("breadth_change") > 0) & (F.col("size_spread") > 0), "repair")
        .when(up & (F.col("size_spread") <= 0), "divergence")
        .otherwise("neutral")
    )
    return m.select("trade_date", "market_breadth", "amount_ratio", "breadth_change", "market_return", "size_spread", regime.alias("regime"))


MARKET = ("market_return_20d", "market_return_slope_20d", "market_volatility_20d", "market_breadth_5d", "market_breadth_20d", "industry_breadth", "industry_dispersion", "market_turnover_change_5_20")


def market_features(panel: DataFrame, universe: str = "is_factor_eligible", industry: str = "industry_l1_code") -> DataFrame:
    """trade_date and MARKET: what state models of the market read; of the broad universe, equal weights.

    One aggregate a date and industry gives all daily measures, partial sums first; the
    slope is that of the cumulative log return over 20 sessions.
    """
    step = frames.safe_ratio(F.col("adj_close"), F.lag("adj_close").over(frames.history())) - 1
    s = panel.withColumn("ret", step).filter(F.coalesce(F.col(universe), F.lit(False)))
    up = F.sum((F.col("ret") > 0).cast("long"))
    cells = s.groupBy("trade_date", industry).agg(F.count("ret").alias("n"), F.sum("ret").alias("sum"), up.alias("up"), F.sum("amount_cny").alias("amount"))
    mean = F.when(F.col(industry).isNotNull(), frames.safe_ratio(F.col("sum"), F.col("n")))
    cells = cells.withColumn("mean", mean)
    daily = cells.groupBy("trade_date").agg(
        frames.safe_ratio(F.sum("sum"), F.sum("n")).alias("r"), frames.safe_ratio(F.sum("up"), F.sum("n")).alias("breadth"), F.sum("amount").alias("turnover"),
        F.avg(F.when(F.col("mean").isNotNull(), (F.col("mean") > 0).cast("double"))).alias("industry_breadth"), F.stddev_pop("mean").alias("industry_dispersion"),
    )
    w = _market()
    m = daily.withColumns({"log": F.when(F.col("r").isNotNull(), F.log1p(F.greatest("r", F.lit(-0.999)))), "k": F.row_number().over(w)})
    m = m.withColumn("path", F.when(F.col("log").isNotNull(), F.sum("log").over(w)))
    roll = lambda c, size, kind="mean": frames.rolling(F.col(c), size, kind, w=w)
    grown = F.when(F.count("r").over(w.rowsBetween(-19, 0)) >= 20, F.product(1 + F.col("r")).over(w.rowsBetween(-19, 0)) - 1)
    return m.select(
        "trade_date", grown.alias("market_return_20d"), frames.slope(F.col("path"), F.col("k"), 20, w).alias("market_return_slope_20d"), roll("r", 20, "std").alias("market_volatility_20d"),
        roll("breadth", 5).alias("market_breadth_5d"), roll("breadth", 20).alias("market_breadth_20d"), "industry_breadth", "industry_dispersion", (frames.safe_ratio(roll("turnover", 5), roll("turnover", 20)) - 1).alias("market_turnover_change_5_20"),
    )
