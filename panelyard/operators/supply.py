"""Supply-contraction features of a bar and its past, as columns; a feature that reads a feature comes in a later stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.operators.residual import rolling_residual

EPS = 1e-12


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def part(window: int, least: int = 5, share: float = 0.75) -> int:
    """Values that a window needs: three quarters of it, and a minimum."""
    return max(least, round(window * share))


def change(x: Column, n: int) -> Column:
    return frames.safe_ratio(x, F.lag(x, n).over(frames.history())) - 1


def log_turnover() -> Column:
    return F.log1p(F.col("turnover_rate") / 100)


def history_z(x: Column, window: int, least: int) -> Column:
    return frames.safe_ratio(x - frames.rolling(x, window, "mean", least), frames.rolling(x, window, "std", least))


def close_location() -> Column:
    span = F.col("adj_high") - F.col("adj_low")
    return F.when(span > EPS, (F.col("adj_close") - F.col("adj_low")) / (span + EPS)).when(span.isNotNull(), 0.5)


def upper_shadow() -> Column:
    return (F.col("adj_high") - F.greatest("adj_open", "adj_close")) / (F.col("adj_high") - F.col("adj_low") + EPS)


def body() -> Column:
    return F.abs(F.col("adj_close") - F.col("adj_open")) / (F.col("adj_high") - F.col("adj_low") + EPS)


def tick_return(tick: float = 0.01) -> Column:
    return frames.safe_ratio(F.lit(tick), positive(F.col("adj_close")))


def effective_ticks(window: int, tick: float = 0.01) -> Column:
    return (F.col("adj_close") - F.lag("adj_close", window).over(frames.history())) / tick


def prices(panel: DataFrame) -> DataFrame:
    """First stage: what reads the panel alone."""
    w = frames.history()
    close = positive(F.col("adj_close"))
    previous = F.lag(close, 1).over(w)
    amount = positive(F.col("amount_cny"))
    return panel.withColumns({
        "log_return": F.ln(close) - F.ln(previous), "ret_1": change(close, 1), "ret_5": change(close, 5),
        "lt": log_turnover(), "log_amount": F.log1p(amount), "log_avg_amount_20": F.log1p(frames.rolling(amount, 20, "mean", part(20))),
        "close_location": close_location(), "upper_shadow_ratio": upper_shadow(), "body_ratio": body(), "tick_return": tick_return(), "effective_ticks_5": effective_ticks(5),
        "intraday_range": (F.col("adj_high") - F.col("adj_low")) / (previous + EPS), "gap_return": frames.safe_ratio(F.col("adj_open"), previous) - 1,
        "turnover_5": frames.rolling(F.col("turnover_rate") / 100, 5, "sum"),
    })


def activity(df: DataFrame, industry: str = "industry_l1_code", floor: float = 0.001) -> DataFrame:
    """Second stage: excess returns over peers, volatility, activity z-scores, impact and breadth."""
    cell, day = Window.partitionBy("trade_date", industry), Window.partitionBy("trade_date")
    peers = lambda c: F.col(c) - F.when(F.col(industry).isNotNull(), frames.leave_one_out(F.col(c), cell))
    up = F.when(F.col("log_return").isNotNull(), (F.col("log_return") > 0).cast("double"))
    known = F.col("log_return").isNotNull()
    out = df.withColumns({
        "excess_ret_1": peers("ret_1"), "excess_ret_5": peers("ret_5"), "volatility_20": frames.rolling(F.col("log_return"), 20, "std", part(20, 2), ddof=1),
        "turnover_z_60": history_z(F.col("lt"), 60, part(60)), "amount_z_60": history_z(F.col("log_amount"), 60, part(60)),
        "amihud_20": frames.rolling(F.abs("log_return") / (positive(F.col("amount_cny")) + EPS), 20, "mean", 10) * 1e8,
        "zero_return_days_20": frames.rolling(F.when(known, (F.abs("log_return") < 1e-8).cast("double")).otherwise(0.0), 20, "sum"),
        "market_breadth": F.coalesce(F.avg(up).over(day), F.lit(0.0)), "industry_breadth": F.coalesce(F.avg(up).over(cell), F.lit(0.0)), "market_lt": F.avg("lt").over(day), "industry_lt": F.avg("lt").over(cell),
    })
    impact = lambda r, t: F.col(r) / F.greatest(t, F.lit(floor))
    return out.withColumns({
        "risk_adjusted_ret_5": F.when(F.col("excess_ret_5").isNotNull() & F.col("volatility_20").isNotNull(), F.least(F.greatest(F.col("excess_ret_5") / (F.col("volatility_20") * 5**0.5 + EPS), F.lit(-3.0)), F.lit(3.0))),
        "price_impact_1": impact("excess_ret_1", F.col("turnover_rate") / 100), "price_impact_5": F.when(F.col("turnover_5").isNotNull(), impact("excess_ret_5", F.col("turnover_5"))),
        "tick_noise": F.col("tick_return") / (F.col("volatility_20") + EPS), "up_days_ratio_5": frames.rolling((F.coalesce(F.col("excess_ret_1"), F.lit(0.0)) > 0).cast("double"), 5, "mean"),
        "ret_z_60": history_z(F.col("excess_ret_5"), 60, 30),
    })


def _daily_z(df: DataFrame, value: str, out: str, by: list[str], window: int = 60) -> DataFrame:
    """``df`` with the z of a value that is one a date (and group) over that series' own past."""
    daily = df.groupBy("trade_date", *by).agg(F.first(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy("trade_date")  # one row a session (and group)
    z = frames.safe_ratio(F.col("_v") - frames.rolling(F.col("_v"), window, "mean", part(window), w=w), frames.rolling(F.col("_v"), window, "std", part(window), w=w))
    return df.join(daily.select("trade_date", *by, z.alias(out)), ["trade_date", *by], "left")


def scarcity(df: DataFrame, industry: str = "industry_l1_code", window: int = 120, least: int = 80) -> DataFrame:
    """Third stage: turnover beyond what activity, displacement and volatility explain, from earlier rows only, and its composites."""
    d = _daily_z(_daily_z(df, "market_lt", "market_turnover_z", []), "industry_lt", "industry_turnover_z", [industry]).withColumn("_abs", F.abs("excess_ret_1"))
    fit = rolling_residual(d, "lt", ["_abs", "intraday_range", "market_turnover_z", "industry_turnover_z", "volatility_20"], window, "volume_residual", least)
    d = d.join(fit, ["ts_code", "trade_date"]).withColumn("_ordinal", F.row_number().over(frames.history()))
    r = F.col("volume_residual")
    d = d.withColumns({
        "scarcity": -r, "volume_residual_mean_5": frames.rolling(r, 5, "mean"), "scarcity_days_ratio_5": frames.rolling((F.coalesce(r, F.lit(0.0)) < 0).cast("double"), 5, "mean"),
        "conditional_scarcity": F.greatest(F.col("risk_adjusted_ret_5"), F.lit(0.0)) * F.greatest(-r, F.lit(0.0)),
        "low_volume_rise": F.greatest(F.col("ret_z_60"), F.lit(0.0)) * F.greatest(-F.col("turnover_z_60"), F.lit(0.0)),
    })
    d = d.withColumns({"conditional_scarcity": F.when(r.isNotNull() & F.col("risk_adjusted_ret_5").isNotNull(), F.col("conditional_scarcity")), "low_volume_rise": F.when(F.col("ret_z_60").isNotNull() & F.col("turnover_z_60").isNotNull(), F.col("low_volume_rise"))})
    return d.withColumns({
        "scarcity_slope_5": frames.slope(F.col("scarcity"), F.col("_ordinal"), 5), "close_quality_scarcity": F.col("conditional_scarcity") * F.col("close_location") * (1 - F.col("upper_shadow_ratio")),
        "persistent_scarcity": F.col("conditional_scarcity") * F.col("scarcity_days_ratio_5") * F.col("up_days_ratio_5"),
    }).drop("_abs", "_ordinal")
