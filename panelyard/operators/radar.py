"""Relation anomalies: measures of a bar, their strictly prior percentiles, and events where all tests of a template hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.operators.residual import one_control


@dataclass(frozen=True)
class Test:
    """A column at or above ("ge") or at or below ("le") a threshold of its scale 0 to 1."""

    column: str
    side: str
    at: float

    def holds(self) -> Column:
        return F.coalesce(F.col(self.column) >= self.at if self.side == "ge" else F.col(self.column) <= self.at, F.lit(False))

    def excess(self) -> Column:
        if self.side == "ge":
            return (F.col(self.column) - self.at) / max(1 - self.at, 1e-9)
        return (self.at - F.col(self.column)) / max(self.at, 1e-9)


@dataclass(frozen=True)
class Template:
    """measures: columns made of the bar or its past, in stages; history: which get a prior percentile ``<name>_pct``; tests: all must hold."""

    name: str
    measures: tuple[dict, ...]
    history: tuple[str, ...]
    tests: tuple[Test, ...]
    residual: tuple[str, str] | None = None  # (measure, control): its daily residual is measured too, as <measure>_residual
    required: Column | None = None


def _change(n: int) -> Column:
    return frames.safe_ratio(F.col("adj_close"), F.lag("adj_close", n).over(frames.history())) - 1


def _span() -> Column:
    return F.nullif(F.col("adj_high") - F.col("adj_low"), F.lit(0.0))


def _peers(x: str, by: str) -> Column:
    return F.avg(x).over(Window.partitionBy("trade_date", by))


def templates() -> dict[str, Template]:
    """The kinds of templates, with their usual thresholds."""
    close, low, high, open_ = (F.col(f"adj_{c}") for c in ("close", "low", "high", "open"))
    w = frames.history()
    found = [
        Template("price_drop_without_volume", ({"return_h": _change(5), "volume": F.col("volume_shares")},), ("return_h", "volume"), (Test("return_h_pct", "le", 0.2), Test("volume_pct", "le", 0.4))),
        Template("volume_surge_without_impact", ({"abs_return": F.abs(_change(1)), "volume": F.col("volume_shares")},), ("abs_return", "volume"), (Test("volume_pct", "ge", 0.8), Test("abs_return_pct", "le", 0.4))),
        Template("high_turnover_low_displacement", ({"abs_return": F.abs(_change(1)), "turnover": F.col("turnover_rate")},), ("turnover",), (Test("turnover_pct", "ge", 0.8), Test("abs_return_residual_pct", "le", 0.3)), residual=("abs_return", "turnover_pct")),
        Template("low_liquidity_large_displacement", ({"abs_return": F.abs(_change(1)), "amount": F.col("amount_cny")},), ("abs_return", "amount"), (Test("abs_return_pct", "ge", 0.8), Test("amount_pct", "le", 0.4))),
        Template(
            "long_lower_wick_strong_close",
            ({"wick": (F.least(open_, close) - low) / _span(), "close_position": (close - low) / _span(), "return_3": _change(3)},),
            ("wick", "return_3"), (Test("wick_pct", "ge", 0.7), Test("close_position", "ge", 0.5), Test("return_3_pct", "le", 0.4)),
        ),
        Template("stock_industry_divergence", ({"return_h": _change(5)}, {"gap": F.col("return_h") - _peers("return_h", "industry_l1_code")}), ("gap",), (Test("gap_pct", "ge", 0.9),)),
        Template(
            "volatility_compression_breakout",
            ({"step": _change(1), "prior_high": F.max("adj_high").over(w.rowsBetween(-10, -1))}, {"volatility": frames.rolling(F.col("step"), 5, "std", shift=1), "break": (close > F.col("prior_high")).cast("double")}),
            ("volatility",), (Test("volatility_pct", "le", 0.4), Test("break", "ge", 1.0)),
        ),
        Template("trend_exhaustion", ({"return_long": _change(10), "return_short": _change(2)},), ("return_long", "return_short"), (Test("return_long_pct", "ge", 0.8), Test("return_short_pct", "le", 0.4))),
    ]
    return {t.name: t for t in found}


def eligible(columns: list[str], least_age: int = 0) -> Column:
    """Old enough, and not known or presumed to be special-treated, suspended or locked at a limit: a missing status counts against, a missing lock for it."""
    rule = F.lit(True)
    if "listing_trade_days" in columns:
        rule = rule & (F.coalesce("listing_trade_days", F.lit(0)) >= least_age)
    for name, presumed in (("is_st", True), ("is_suspended", True), ("is_limit_up_open", False), ("is_limit_down_open", False)):
        if name in columns:
            rule = rule & ~F.coalesce(name, F.lit(presumed))
    return rule


def scan(panel: DataFrame, template: Template, window: int = 60, least: int = 20) -> DataFrame:
    """trade_date, ts_code, the template's measures and percentiles, severity, is_event."""
    out = panel
    for stage in template.measures:
        out = out.withColumns(stage)
    names = [n for stage in template.measures for n in stage]
    out = out.withColumns({f"{m}_pct": frames.prior_percentile(F.col(m), window, least) for m in template.history})
    if template.residual:
        y, x = template.residual
        out = one_control(out, y, x, ["trade_date"], 5, f"{y}_residual")
        out = out.withColumn(f"{y}_residual_pct", frames.prior_percentile(F.col(f"{y}_residual"), window, least))
        names += [f"{y}_residual"]
    tested = [t.column for t in template.tests]
    holds = eligible(panel.columns)
    for t in template.tests:
        holds = holds & t.holds()
    severity = sum((t.excess() for t in template.tests), F.lit(0.0))
    shown = list(dict.fromkeys([*names, *[f"{m}_pct" for m in template.history], *tested]))
    return out.select("trade_date", "ts_code", *shown, F.when(severity.isNotNull(), F.greatest(severity, F.lit(0.0))).alias("severity"), holds.alias("is_event"))


def observation(scanned: DataFrame, recent_days: int = 60) -> DataFrame:
    """One row: events, their share and z against the earlier rate, and the largest share of one security."""
    days = scanned.groupBy("trade_date").agg(F.count("*").alias("rows"), F.sum(F.col("is_event").cast("int")).alias("events"))
    daily = days.withColumn("rate", F.col("events") / F.col("rows")).withColumn("recent", F.row_number().over(Window.orderBy(F.desc("trade_date"))) <= recent_days)  # one row a session
    rates = daily.agg(F.avg(F.when(F.col("recent"), F.col("rate"))).alias("recent_rate"), F.avg(F.when(~F.col("recent"), F.col("rate"))).alias("past_rate"), F.stddev_samp(F.when(~F.col("recent"), F.col("rate"))).alias("past_std"), F.sum("events").alias("events"))
    top = scanned.filter("is_event").groupBy("ts_code").count().agg(F.max("count").alias("most"))
    both = rates.join(F.broadcast(top))
    return both.select("events", "recent_rate", "past_rate", frames.safe_ratio(F.col("recent_rate") - F.col("past_rate"), F.col("past_std")).alias("rate_z"), frames.safe_ratio(F.col("recent_rate"), F.col("past_rate")).alias("rate_ratio"), frames.safe_ratio(F.col("most"), F.col("events")).alias("top_share"))


def concentration(panel: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, total, hhi, top_share, coherence: how a signed amount spreads over the rows of a group."""
    size = F.abs(F.col(value))
    g = panel.groupBy(*by).agg(F.sum(value).alias("total"), F.sum(size).alias("_a"), F.sum(size * size).alias("_q"), F.max(size).alias("_m"))
    return g.select(*by, "total", frames.safe_ratio(F.col("_q"), F.col("_a") * F.col("_a")).alias("hhi"), frames.safe_ratio(F.col("_m"), F.col("_a")).alias("top_share"), frames.safe_ratio(F.abs("total"), F.col("_a")).alias("coherence"))


def drift(daily: DataFrame, value: str = "ic", baseline: int = 120, recent: int = 20, order: str = "trade_date", axes: list[str] | None = None) -> DataFrame:
    """axes, baseline_mean, recent_mean, delta, robust_z: the last ``recent`` values against the ``baseline`` before them."""
    axes = axes or []
    back = F.row_number().over(Window.partitionBy(*axes).orderBy(F.desc(order)))
    v = daily.filter(F.col(value).isNotNull()).withColumn("_back", back).filter(F.col("_back") <= baseline + recent)
    base = F.when(F.col("_back") > recent, F.col(value))
    v = v.withColumn("_mid", F.median(base).over(Window.partitionBy(*axes)))
    s = v.groupBy(*axes).agg(
        F.avg(base).alias("baseline_mean"), F.avg(F.when(F.col("_back") <= recent, F.col(value))).alias("recent_mean"), F.count(F.when(F.col("_back") <= recent, 1)).alias("recent_days"),
        (F.median(F.abs(base - F.col("_mid"))) * 1.4826).alias("_mad"), F.stddev_pop(base).alias("_std"),
    )
    scale = F.when(F.col("_mad") > 1e-12, F.col("_mad")).otherwise(F.col("_std"))
    delta = F.col("recent_mean") - F.col("baseline_mean")
    return s.select(*axes, "baseline_mean", "recent_mean", "recent_days", delta.alias("delta"), frames.safe_ratio(delta, scale / F.sqrt("recent_days")).alias("robust_z"))
