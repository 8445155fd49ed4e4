"""Composite radar recipes: events that need a cross-section beside a security's own past."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.operators.radar import eligible
from panelyard.operators.residual import least_squares, one_control


@dataclass(frozen=True)
class Settings:
    short: int = 5
    long: int = 20
    upper: float = 0.9
    lower: float = 0.3
    step: float = 0.1
    window: int = 60
    least: int = 20
    least_section: int = 5


def _cell(*by: str):
    return Window.partitionBy("trade_date", *by)


def _base(panel: DataFrame, s: Settings) -> DataFrame:
    w = frames.history()
    back = lambda n: frames.safe_ratio(F.col("adj_close"), F.lag("adj_close", n).over(w)) - 1
    return panel.withColumns({"return_1d": back(1), "return_short": back(s.short), "return_long": back(s.long)}).withColumn("abs_return_1d", F.abs("return_1d"))


def _past(df: DataFrame, column: str, out: str, s: Settings, window: int | None = None, least: int | None = None) -> DataFrame:
    return df.withColumn(out, frames.prior_percentile(F.col(column), window or s.window, least or s.least))


def index_up_breadth_down(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    daily = df.groupBy("trade_date").agg(F.median("return_short").alias("market_return"), F.avg(F.coalesce(F.col("return_1d") > 0, F.lit(False)).cast("double")).alias("advancing_ratio"))
    daily = daily.withColumn("breadth_change", F.col("advancing_ratio") - F.lag("advancing_ratio", s.short).over(Window.orderBy("trade_date")))  # one row a session
    d = df.join(F.broadcast(daily), "trade_date").withColumn("contribution", F.col("return_short") * F.greatest("amount_cny", F.lit(0.0)))
    d = _past(d.withColumn("contribution_pct", frames.pct_rank(F.col("contribution"))), "market_return", "market_pct", s)
    return d, (F.col("market_pct") >= s.upper) & (F.col("breadth_change") <= -s.step) & (F.col("contribution_pct") >= 0.9), F.col("market_pct") - s.upper - F.col("breadth_change") - s.step


def turnover_concentration(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    d = df.withColumn("amount_pct", frames.pct_rank(F.col("amount_cny")))
    top = F.when(F.col("amount_pct") >= 0.95, F.col("amount_cny")).otherwise(0.0)
    d = _past(d.withColumn("top_share", frames.safe_ratio(F.sum(top).over(_cell()), F.sum("amount_cny").over(_cell()))), "top_share", "concentration_pct", s)
    return d, (F.col("concentration_pct") >= s.upper) & (F.col("amount_pct") >= 0.95), F.col("concentration_pct") - s.upper + F.col("amount_pct") - 0.95


def turnover_displacement_close(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    d = _past(_past(df, "turnover_rate", "turnover_pct", s), "abs_return_1d", "displacement_pct", s)
    place = frames.safe_ratio(F.col("adj_close") - F.col("adj_low"), F.col("adj_high") - F.col("adj_low"))
    d = d.withColumn("event_subtype", F.when(place >= 0.7, "strong_close_absorption").otherwise("weak_close_pressure"))
    return d, (F.col("turnover_pct") >= s.upper) & (F.col("displacement_pct") <= s.lower), F.col("turnover_pct") - s.upper + s.lower - F.col("displacement_pct")


def enhanced_residual(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    d = df.withColumn("volatility", frames.rolling(F.col("return_1d"), s.long, "std", max(5, s.long // 2)))
    res = least_squares(d, "return_short", ["log_total_mv", "volatility"], ["trade_date", "industry_l1_code"], s.least_section, "residual")
    d = d.join(res.select("trade_date", "ts_code", "residual"), ["trade_date", "ts_code"])
    d = d.withColumn("residual_pct", frames.pct_rank(F.col("residual"), "industry_l1_code"))
    up, down = F.col("residual_pct") >= s.upper, F.col("residual_pct") <= 1 - s.upper
    d = d.withColumn("event_subtype", F.when(up, "positive_residual").when(down, "negative_residual").otherwise("none"))
    return d, up | down, F.greatest(F.col("residual_pct") - s.upper, 1 - s.upper - F.col("residual_pct"))


def price_volume_residual(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    d = one_control(df.withColumn("log_volume", F.log1p(F.greatest("volume_shares", F.lit(0.0)))), "log_volume", "abs_return_1d", ["trade_date"], s.least_section, "volume_residual")
    d = _past(_past(d, "abs_return_1d", "move_pct", s), "volume_residual", "residual_pct", s)
    thin = (F.col("move_pct") >= s.upper) & (F.col("residual_pct") <= s.lower)
    churn = (F.col("move_pct") <= s.lower) & (F.col("residual_pct") >= s.upper)
    d = d.withColumn("event_subtype", F.when(thin, "large_move_low_volume_residual").when(churn, "high_volume_low_displacement").otherwise("none"))
    return d, thin | churn, F.abs(F.col("move_pct") - F.col("residual_pct"))


def leader_decoupling(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    d = df.withColumn("size_pct", frames.pct_rank(F.col("log_total_mv"), "industry_l1_code")).withColumn("gap", F.col("return_short") - F.median("return_short").over(_cell("industry_l1_code")))
    d = d.withColumn("industry_advancing", F.avg(F.coalesce(F.col("return_1d") > 0, F.lit(False)).cast("double")).over(_cell("industry_l1_code")))
    d = _past(d, "gap", "gap_pct", s)
    return d, (F.col("size_pct") >= 0.9) & (F.col("gap_pct") >= s.upper) & (F.col("industry_advancing") <= 0.5 - s.step / 2), F.col("gap_pct") - s.upper + 0.5 - F.col("industry_advancing")


def failed_breakout(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    d = df.withColumn("prior_high", frames.rolling(F.col("adj_close"), s.long, "max", shift=1)).withColumn("strength", frames.safe_ratio(F.col("adj_close"), F.col("prior_high")) - 1)
    d = d.withColumn("recent_strength", frames.rolling(F.col("strength"), s.short, "max", 1, shift=1))
    return d, (F.col("recent_strength") > 0) & (F.col("strength") < 0), F.col("recent_strength") - F.col("strength")


def participation_deterioration(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    up = F.coalesce(F.col("return_1d") > 0, F.lit(False)).cast("double")
    d = df.withColumn("up_ratio", frames.rolling(up, s.long, "mean"))
    d = d.withColumn("participation_change", F.col("up_ratio") - F.lag("up_ratio", s.short).over(frames.history()))
    d = _past(d, "return_long", "momentum_pct", s)
    return d, (F.col("momentum_pct") >= s.upper) & (F.col("participation_change") <= -s.step), F.col("momentum_pct") - s.upper - F.col("participation_change") - s.step


def percentile_migration(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    d = df.withColumn("_tr", frames.true_range(F.col("adj_high"), F.col("adj_low"), F.lag("adj_close").over(frames.history()), strict=False))
    d = _past(d.withColumn("atr", frames.rolling(F.col("_tr"), s.long, "mean") / F.col("adj_close")), "atr", "atr_pct", s)
    d = d.withColumn("velocity", F.col("atr_pct") - F.lag("atr_pct", s.short).over(frames.history()))
    d = d.withColumn("event_subtype", F.when(F.col("velocity") >= 0, "rapid_rise").otherwise("rapid_fall"))
    return d, F.abs("velocity") >= s.step, F.abs("velocity") - s.step


def short_long_conflict(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    short = max(20, s.short * 12)
    d = _past(_past(df, "amount_cny", "short_pct", s, max(10, short // 3), max(5, short // 6)), "amount_cny", "long_pct", s)
    d = d.withColumn("gap", F.col("short_pct") - F.col("long_pct")).withColumn("event_subtype", F.when(F.col("gap") >= 0, "recent_only_extreme").otherwise("long_term_only_extreme"))
    return d, F.abs("gap") >= s.step, F.abs("gap") - s.step


def residual_concentration(df: DataFrame, s: Settings) -> tuple[DataFrame, Column, Column]:
    """Trading beyond what a security's own usual amount and size explain, on days when a few securities hold most of it."""
    usual = frames.rolling(F.ln(F.when(F.col("amount_cny") > 0, F.col("amount_cny"))), s.long, "mean", max(5, s.long // 2), shift=1)
    d = df.withColumn("log_amount", F.when(F.col("amount_cny") > 0, F.ln("amount_cny"))).withColumn("usual_amount", usual)
    d = d.withColumn("own_amount", F.when(F.coalesce("is_liquid", F.lit(False)), F.col("log_amount")))
    res = least_squares(d, "own_amount", ["usual_amount", "log_total_mv"], ["trade_date"], s.least_section, "excess")
    d = d.join(res.select("trade_date", "ts_code", "excess"), ["trade_date", "ts_code"])
    d = d.withColumn("excess_pct", frames.pct_rank(F.col("excess"))).withColumn("mass", F.expm1(F.greatest("excess", F.when(F.col("excess").isNotNull(), F.lit(0.0)))))
    d = d.withColumn("mass", F.when(F.col("excess").isNotNull(), F.col("mass"))).withColumn("contributes", F.coalesce((F.col("excess") > 0) & (F.col("excess_pct") >= s.upper), F.lit(False)))
    daily = d.groupBy("trade_date").agg(frames.safe_ratio(F.sum(F.when(F.col("contributes"), F.col("mass"))), F.sum("mass")).alias("mass_share"))
    market = Window.orderBy("trade_date")  # one row a session
    daily = daily.withColumn("share_pct", frames.prior_percentile(F.col("mass_share"), s.window, s.least, market)).select("trade_date", "share_pct")
    d = d.join(F.broadcast(daily), "trade_date")
    return d, F.col("contributes") & (F.col("share_pct") >= s.upper), F.col("excess_pct") - s.upper + F.col("share_pct") - s.upper


RECIPES = {f.__name__: f for f in (index_up_breadth_down, turnover_concentration, turnover_displacement_close, enhanced_residual, price_volume_residual, leader_decoupling, failed_breakout, participation_deterioration, percentile_migration, short_long_conflict, residual_concentration)}


def scan(panel: DataFrame, recipe: str, settings: Settings = Settings()) -> DataFrame:
    """trade_date, ts_code, event_subtype, severity, is_event of one recipe."""
    d, event, severity = RECIPES[recipe](_base(panel, settings), settings)
    subtype = F.col("event_subtype") if "event_subtype" in d.columns else F.lit(None).cast("string")
    return d.select("trade_date", "ts_code", subtype.alias("event_subtype"), F.when(severity.isNotNull(), F.greatest(severity, F.lit(0.0))).alias("severity"), (eligible(panel.columns) & F.coalesce(event, F.lit(False))).alias("is_event"))
