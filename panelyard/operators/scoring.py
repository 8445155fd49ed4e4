"""A profile of points for factors: what holds out of sample, can be traded, is stable, is ordered by size of the pick and is significant; and a class.

Everything is columns over tables of runs and tests, so many factors are scored at once.
Missing evidence earns nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames

YEAR = 252
# Points from a value on, the highest first; and the profile's classes.
BANDS = {
    "retention": ((0.7, 6), (0.4, 5), (0.2, 3), (0.0, 1)), "walk": ((0.8, 7), (0.6, 5), (0.4, 3), (0.2, 1)), "excess": ((0.15, 10), (0.10, 8), (0.05, 6), (0.02, 3), (0.0, 1)), "calmar": ((1.0, 6), (0.7, 5), (0.4, 3), (0.2, 1)),
    "resilience": ((0.8, 5), (0.6, 4), (0.4, 2), (0.2, 1)), "execution": ((0.95, 4), (0.85, 3), (0.70, 2), (0.50, 1)), "years": ((0.7, 6), (0.6, 5), (0.5, 3), (0.4, 1)), "rolling": ((0.7, 5), (0.6, 4), (0.5, 3), (0.4, 1)),
    "spread": ((0.8, 4), (0.6, 3), (0.4, 2), (0.2, 1)), "ic": ((0.05, 3), (0.03, 2), (0.01, 1)), "icir": ((1.0, 3), (0.5, 2), (0.2, 1)), "structure": ((0.8, 2), (0.5, 1)),
}
REJECTED, WATCHED, CANDIDATE = 49, 64, 79
LEAST = {"oos_effectiveness": 17, "tradable_performance": 17, "stability": 12}
SIZES = (2, 5, 10, 20)


def band(value: Column, name: str) -> Column:
    points = F.lit(0)
    for least, score in reversed(BANDS[name]):
        points = F.when(value >= least, score).otherwise(points)
    return F.when(value.isNotNull(), points).otherwise(0)


def run_measures(daily: DataFrame, late: float = 0.2, window: int = YEAR, least: int = 63, best: int = 10, year: int = YEAR) -> DataFrame:
    """factor, top_n, holding, cost_bps and each run's annual excess (in and out of sample, and whole), Calmar ratio, execution rate and shares of positive years, windows and days.

    daily: a row of a run and session with ``return``, ``excess`` and ``executed`` (share of the signals that could be bought).
    """
    key = ["factor", "top_n", "holding", "cost_bps"]
    run, time = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("trade_date")
    d = daily.withColumns({"_k": F.row_number().over(time), "_n": F.count("*").over(run), "_nav": F.exp(F.sum(F.log1p(F.greatest("return", F.lit(-0.999999)))).over(time))})
    split = F.greatest(F.floor(F.col("_n") * (1 - late)), F.lit(1))
    gain = F.greatest("excess", F.lit(0.0))
    d = d.withColumns({"_old": F.col("_k") <= split, "_fall": F.col("_nav") / F.max("_nav").over(time) - 1, "_roll": frames.rolling(F.col("excess"), window, "sum", least, w=time), "_best": F.row_number().over(run.orderBy(gain.desc(), "trade_date")) <= best})
    years = d.groupBy(*key, F.year("trade_date").alias("_y")).agg(F.sum("excess").alias("_e"), F.sum(F.when(~F.col("_old"), F.col("excess"))).alias("_late"))
    up = lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double")))
    by_year = years.groupBy(*key).agg(up("_e").alias("years"), F.coalesce(up("_late"), F.lit(0.0)).alias("walk"))
    annual = lambda test: F.coalesce(F.avg(F.when(test, F.col("excess"))) * year, F.lit(0.0))
    out = d.groupBy(*key).agg(
        annual(F.col("_old")).alias("is_excess"), annual(~F.col("_old")).alias("oos_excess"), (F.avg("excess") * year).alias("excess"), F.avg("executed").alias("execution"),
        frames.safe_ratio(F.avg("return") * year, F.abs(F.min("_fall"))).alias("calmar"), F.coalesce(up("_roll"), F.lit(0.0)).alias("rolling"),
        F.coalesce(frames.safe_ratio(F.sum(F.when(F.col("_best"), gain)), F.sum(gain)), F.lit(1.0)).alias("concentration"),
    )
    return out.join(by_year, key)


def score(runs: DataFrame, tests: DataFrame, basics: DataFrame, top_n: int = 2, cost_bps: float = 20.0) -> DataFrame:
    """factor, the six dimensions' points, total and classification.

    runs: ``run_measures``; tests: factor, ic, icir, oos_ic, fdr_q, structure of each L1 test; basics: factor, violations
    (future data), covered, explained.  Primary runs are those of ``top_n`` at ``cost_bps``; medians are over their holdings.
    """
    primary = (F.col("top_n") == top_n) & (F.col("cost_bps") == cost_bps)
    of = lambda c, test=primary: F.median(F.when(test, F.col(c)))
    sized = {n: of("excess", (F.col("top_n") == n) & (F.col("cost_bps") == cost_bps)).alias(f"top{n}") for n in SIZES}
    r = runs.groupBy("factor").agg(
        *(of(c).alias(c) for c in ("is_excess", "oos_excess", "excess", "calmar", "execution", "years", "rolling", "concentration")), F.avg(F.when(primary, F.col("walk"))).alias("walk"),
        of("excess", (F.col("top_n") == top_n) & (F.col("cost_bps") == 0)).alias("gross"), F.max(primary.cast("int")).alias("has"), *sized.values(),
    )
    t = tests.groupBy("factor").agg(*(F.median(c).alias(f"t_{c}") for c in ("ic", "icir", "oos_ic", "fdr_q", "structure")))
    x = basics.select("factor", "violations", "covered", "explained").join(r, "factor", "left").join(t, "factor", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    has = F.coalesce("has", F.lit(0)) == 1
    retention = F.when(F.col("is_excess") > 0, F.col("oos_excess") / F.col("is_excess")).otherwise(F.when(F.col("oos_excess") > 0, 1.0).otherwise(-1.0))
    oos = F.when(F.col("oos_excess") > 0, 8).otherwise(0) + band(retention, "retention") + band(F.col("walk"), "walk") + F.when(zero("t_oos_ic") > 0, 4).otherwise(0)
    gross = F.coalesce("gross", "excess")
    resilience = F.when(gross > 0, F.col("excess") / gross).otherwise(0.0)
    traded = band(F.col("excess"), "excess") + band(zero("calmar"), "calmar") + band(resilience, "resilience") + band(F.col("execution"), "execution")
    stable = band(F.col("years"), "years") + band(F.col("rolling"), "rolling") + band(1 - F.col("concentration"), "spread")
    curve = F.array_compact(F.array(*(F.col(f"top{n}") for n in SIZES)))
    falling = F.forall(F.sequence(F.lit(1), F.greatest(F.size(curve) - 1, F.lit(1))), lambda i: F.get(curve, i - 1) >= F.get(curve, i)) & F.forall(curve, lambda v: v > 0)
    ordered = F.when((F.size(curve) < 2) | ~F.coalesce(F.col("top2") > 0, F.lit(False)), 0).when(falling, 10).when(F.coalesce(F.col("top5") > 0, F.lit(False)), 7).otherwise(5)
    q = F.coalesce("t_fdr_q", F.lit(1.0))
    significant = band(zero("t_ic"), "ic") + band(zero("t_icir"), "icir") + F.when(q <= 0.05, 2).when(q <= 0.10, 1).otherwise(0) + band(zero("t_structure"), "structure")
    points = {
        "oos_effectiveness": F.when(has, oos).otherwise(0), "tradable_performance": F.when(has, traded).otherwise(0), "stability": F.when(has, stable).otherwise(0), "topn_structure": ordered, "statistical_evidence": significant,
        "independence_explanation": F.when(F.coalesce("explained", F.lit(False)), 2).otherwise(0),
    }
    reversed_ = has & (F.col("is_excess") > 0) & (F.col("oos_excess") < 0) & (zero("t_oos_ic") < 0)
    x = x.withColumns({n: v.cast("int") for n, v in points.items()} | {"_reversed": F.coalesce(reversed_, F.lit(False))}).withColumn("total", sum((F.col(n) for n in points), F.lit(0)))
    enough = F.lit(True)
    for n, least in LEAST.items():
        enough = enough & (F.col(n) >= least)
    bad = (F.coalesce("violations", F.lit(0)) > 0) | ~F.coalesce("covered", F.lit(False))
    total = F.col("total")
    cls = F.when(bad, "INVALID").when(F.col("_reversed") | (total <= REJECTED), "REJECTED").when(total <= WATCHED, "WATCHLIST").when(total <= CANDIDATE, "CANDIDATE").when(enough, "APPROVED").otherwise("CANDIDATE")
    return x.select("factor", *points, "total", cls.alias("classification"))
