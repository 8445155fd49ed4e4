"""An experiment: quality of a factor, its predictive power on a grid, ledgers and robustness.

The grid of horizons, targets and universes is a column, so the whole first level
is one plan; what comes to the driver are summary rows, one per test or scenario.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.operators import portfolio, stats
from panelyard.plans.factor import Factor, compute


def quality(panel: DataFrame, values: DataFrame) -> DataFrame:
    """One row: coverage, missing share, median section, share of distinct values, valid groups."""
    p = values.agg(F.count("*").alias("rows"), F.count("factor_value").alias("valid"), F.count_distinct("factor_value").alias("distinct"), F.count_distinct("ts_code").alias("codes"))
    daily = values.groupBy("trade_date").agg(F.count("factor_value").alias("n")).agg(F.median("n").alias("median_section"), F.count("*").alias("days"))
    return p.crossJoin(daily).select("rows", "codes", "days", "median_section", frames.safe_ratio(F.col("valid"), F.col("rows")).alias("coverage"), frames.safe_ratio(F.col("distinct"), F.col("valid")).alias("distinct_ratio"))  # one row each


def grid(panel: DataFrame, values: DataFrame, horizons: list[int], universes: list[str], oos_share: float = 0.2) -> DataFrame:
    """horizon, target, universe, sample (all, oos), trade_date, n, ic: daily rank ICs of the whole grid in one plan."""
    joined = panel.join(values.select("trade_date", "ts_code", "factor_value"), ["trade_date", "ts_code"])
    for h in horizons:
        joined = stats.forward_targets(joined, h).withColumnsRenamed({"stock_return": f"_s{h}", "stock_minus_peers": f"_m{h}"})
    cells = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(t).alias("target"), F.col(f"{c}{h}").alias("y")) for h in horizons for t, c in (("stock_return", "_s"), ("stock_minus_peers", "_m"))))
    inside = F.filter(F.array(*(F.when(F.coalesce(u, F.lit(False)), F.lit(u)) for u in universes)), lambda u: u.isNotNull())
    rows = joined.select("trade_date", "ts_code", "factor_value", F.explode(cells).alias("c"), inside.alias("us")).select("trade_date", "ts_code", "factor_value", "c.*", F.explode("us").alias("universe"))
    ic = stats.daily_ic(rows, "factor_value", "y", ["horizon", "target", "universe"])
    days = panel.select("trade_date").distinct().withColumn("_late", F.percent_rank().over(Window.orderBy("trade_date")) >= 1 - oos_share)  # one row a session
    return ic.join(F.broadcast(days), "trade_date")


def summary(ic: DataFrame, lags: int = 5) -> DataFrame:
    """horizon, target, universe: IC summary, out-of-sample mean, HAC t, p and FDR q of each test."""
    axes = ["horizon", "target", "universe"]
    s = stats.ic_summary(ic, axes).join(stats.newey_west_sums(ic, axes, lags).select(*axes, "nw_t"), axes)
    s = s.join(ic.filter("_late").groupBy(*axes).agg(F.avg("ic").alias("oos_mean")), axes, "left")
    return stats.fdr(s.withColumn("p_value", two_sided_p(F.col("nw_t"))))


def two_sided_p(t):
    """Normal two-sided p of a statistic: a rational form of the error function, good to about 1e-7."""
    z = F.abs(t) / math.sqrt(2)
    k = 1 / (1 + 0.3275911 * z)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    return F.least(poly * F.exp(-z * z), F.lit(1.0))


def robustness(days: DataFrame, benchmark: DataFrame) -> DataFrame:
    """scenario: share of years and of rolling years with positive excess, share of the ten best days in all gains."""
    w = Window.partitionBy("scenario").orderBy("trade_date")
    d = days.join(F.broadcast(benchmark), "trade_date", "left").withColumn("excess", F.coalesce(frames.safe_ratio(F.col("nav"), F.lag("nav").over(w)) - 1, F.lit(0.0)) - F.coalesce("benchmark_return", F.lit(0.0)))
    years = d.groupBy("scenario", F.year("trade_date").alias("y")).agg(F.sum("excess").alias("e")).groupBy("scenario").agg(F.avg((F.col("e") > 0).cast("double")).alias("year_positive_ratio"))
    rolled = d.withColumn("r", frames.rolling(F.col("excess"), 252, "sum", 63, w=w)).groupBy("scenario").agg(F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("rolling_positive_ratio"), F.avg("excess").alias("mean_excess"))
    gain = F.greatest("excess", F.lit(0.0))
    best = d.withColumn("g", gain).withColumn("k", F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("g"), "trade_date")))
    top = best.groupBy("scenario").agg(frames.safe_ratio(F.sum(F.when(F.col("k") <= 10, F.col("g"))), F.sum("g")).alias("top10_day_share"))
    return years.join(rolled, "scenario").join(top, "scenario")


def run(panel: DataFrame, spec: Factor, horizons: list[int], universes: list[str], scenarios: DataFrame, rules: portfolio.Rules = portfolio.Rules()) -> dict[str, DataFrame]:
    """All levels as lazy frames: values, quality, tests, days, metrics, robustness."""
    values = compute(panel, spec)
    days = portfolio.ledgers(panel, values, scenarios, universes[0], rules)
    return {
        "values": values, "quality": quality(panel, values), "tests": summary(grid(panel, values, horizons, universes)), "days": days,
        "metrics": portfolio.metrics(days), "robustness": robustness(days, portfolio.universe_benchmark(panel, universes[0])),
    }
