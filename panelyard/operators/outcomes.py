"""How robust the outcomes of events are: without the best of them, by year, against the years before, by cost and by the share of a few days.

Rows are outcomes (one an event, a horizon), as ``paths.evaluate_paths`` gives them; no ledger is run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


def trimmed(rows: DataFrame, axes: list[str], value: str, fraction: float, width: float = 1e-3) -> DataFrame:
    """axes, n, dropped, mean, trimmed_mean: without the best ``fraction`` of each group (one row at least).

    Values are counted in bins of ``width`` first; running counts over the bins say which
    bin the cut falls in, and only that bin's rows are ranked.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*axes, F.col(value).cast("double").alias("_v")).withColumn("_bin", F.floor(F.col("_v") / width))
    bins = known.groupBy(*axes, "_bin").agg(F.count("*").alias("_n"), F.sum("_v").alias("_sum"))
    group, down = Window.partitionBy(*axes), Window.partitionBy(*axes).orderBy(F.desc("_bin"))
    bins = bins.withColumns({"n": F.sum("_n").over(group), "_above": F.sum("_n").over(down) - F.col("_n")})
    bins = bins.withColumn("dropped", F.greatest(F.ceil(F.col("n") * fraction), F.lit(1)))
    left = F.col("dropped") - F.col("_above")  # still to be dropped when the bin begins
    whole = bins.groupBy(*axes).agg(F.max("n").alias("n"), F.max("dropped").alias("dropped"), F.sum("_sum").alias("_all"), F.sum(F.when(left <= 0, F.col("_sum"))).alias("_kept"))
    cut = bins.filter((left > 0) & (left < F.col("_n"))).select(*axes, "_bin", left.alias("_left"))
    same = known.join(F.broadcast(cut) if not axes else cut, [*axes, "_bin"])
    place = F.row_number().over(Window.partitionBy(*axes, "_bin").orderBy(F.desc("_v")))
    rest = same.withColumn("_k", place).filter(F.col("_k") > F.col("_left")).groupBy(*axes).agg(F.sum("_v").alias("_rest"))
    out = whole.join(rest, axes, "left") if axes else whole.crossJoin(rest)  # one row each
    kept = F.coalesce("_kept", F.lit(0.0)) + F.coalesce("_rest", F.lit(0.0))
    return out.select(*axes, "n", "dropped", (F.col("_all") / F.col("n")).alias("mean"), frames.safe_ratio(kept, F.col("n") - F.col("dropped")).alias("trimmed_mean"))


def yearly(rows: DataFrame, axes: list[str], value: str, time: str = "trade_date", train: int = 3) -> DataFrame:
    """axes, year, n, mean, positive_ratio, and of years after the first ``train``: mean_before of all rows of the years before, and whether both have one sign."""
    x = F.col(value)
    y = rows.filter(x.isNotNull()).groupBy(*axes, F.year(time).alias("year")).agg(F.count("*").alias("n"), F.sum(x).alias("_sum"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("positive_ratio"))
    w = Window.partitionBy(*axes).orderBy("year")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tested = F.row_number().over(w) > train
    y = y.withColumn("mean_before", F.when(tested, frames.safe_ratio(F.sum("_sum").over(before), F.sum("n").over(before))))
    return y.withColumn("holds", F.col("mean_before") * F.col("mean") > 0).drop("_sum")


def day_concentration(rows: DataFrame, axes: list[str], value: str, best: int = 10, window: int = 252, least: int = 63, time: str = "trade_date", year: int = 252) -> DataFrame:
    """axes, days, annual_mean, without_best (annual, without the ``best`` days), best_share of all gains, rolling_positive_ratio, of the daily means."""
    daily = rows.filter(F.col(value).isNotNull()).groupBy(*axes, time).agg(F.avg(value).alias("_d"))
    w = Window.partitionBy(*axes).orderBy(time)
    gain = F.greatest("_d", F.lit(0.0))
    d = daily.withColumns({"_k": F.row_number().over(Window.partitionBy(*axes).orderBy(gain.desc(), time)), "_r": frames.rolling(F.col("_d"), window, "sum", least, w=w)})
    rest = F.col("_k") > best
    out = d.groupBy(*axes).agg(
        F.count("*").alias("days"), F.avg("_d").alias("_m"), F.avg(F.when(rest, F.col("_d"))).alias("_w"), F.sum(F.when(~rest, gain)).alias("_top"), F.sum(gain).alias("_all"), F.avg(F.when(F.col("_r").isNotNull(), (F.col("_r") > 0).cast("double"))).alias("rolling_positive_ratio"),
    )
    return out.select(*axes, "days", (F.col("_m") * year).alias("annual_mean"), (F.col("_w") * year).alias("without_best"), F.coalesce(frames.safe_ratio(F.col("_top"), F.col("_all")), F.lit(1.0)).alias("best_share"), "rolling_positive_ratio")


def break_even(gross: Column) -> Column:
    """The round-trip cost, in basis points, at which a gross return leaves nothing."""
    return F.when(gross > 0, 20_000.0 * gross / (2.0 + gross)).otherwise(0.0)


def cost_curve(rows: DataFrame, axes: list[str], gross: str, costs: list[float]) -> DataFrame:
    """axes, cost_bps, n, mean_net, median_net, positive_ratio, break_even_bps of the mean gross return, for each cost in one pass."""
    known = rows.filter(F.col(gross).isNotNull())
    each = known.select(*axes, gross, F.explode(F.array(*(F.lit(float(c)) for c in costs))).alias("cost_bps"))
    half = F.col("cost_bps") / 20_000.0
    net = (1 + F.col(gross)) * (1 - half) - 1 - half
    out = each.withColumn("_net", net).groupBy(*axes, "cost_bps").agg(F.count("*").alias("n"), F.avg("_net").alias("mean_net"), F.median("_net").alias("median_net"), F.avg((F.col("_net") > 0).cast("double")).alias("positive_ratio"), F.avg(gross).alias("_g"))
    return out.withColumn("break_even_bps", break_even(F.col("_g"))).drop("_g")
