"""How well a factor is doing, day by day and over trailing windows: correlations, deciles, spread, what the top holds and how it changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


def daily_health(rows: DataFrame, score: str, target: str, deciles: int = 10, least: int = 20, axes: list[str] | None = None, context: list[str] | None = None, time: str = "trade_date", code: str = "ts_code") -> DataFrame:
    """axes, time and the day's measures of a factor, on days with ``least`` pairs.

    Deciles lie between the quantiles of the scores' ranks, ties in the order of ``code``;
    the top are ranks above 1 - 1 / deciles.  Overlap is that of the top with the top of
    the last day that counts; concentration the largest share of the top's absolute
    scores; ``context`` columns come as their means.  One partitioning by day makes all
    but the overlap.
    """
    axes, context = axes or [], context or []
    key = [*axes, time]
    day = Window.partitionBy(*key)
    pairs = rows.filter(F.col(score).isNotNull() & F.col(target).isNotNull()).select(*key, code, F.col(score).cast("double").alias("_x"), F.col(target).cast("double").alias("_y"), *context)
    pairs = pairs.withColumn("_n", F.count("*").over(day)).filter(F.col("_n") >= least)
    place = F.row_number().over(day.orderBy("_x", code))
    pairs = pairs.withColumn("_k", place).withColumns({"_xr": frames.pct_rank(F.col("_x"), *axes, time=time), "_yr": frames.pct_rank(F.col("_y"), *axes, time=time)})
    pairs = pairs.withColumns({"_d": frames.quantile_bucket(F.col("_k"), F.col("_n"), deciles), "_top": F.col("_k") / F.col("_n") > 1.0 - 1.0 / deciles, "_low": F.col("_k") / F.col("_n") <= 1.0 / deciles})
    when = lambda test, x: F.when(test, x)
    top = F.col("_top")
    means = {f"decile_{d}_return": F.avg(when(F.col("_d") == d, F.col("_y"))) for d in range(1, deciles + 1)}
    by = pairs.groupBy(*key).agg(
        F.first("_n").alias("observation_count"), frames.correlation(F.col("_xr"), F.col("_yr")).alias("rank_ic"), frames.correlation(F.col("_x"), F.col("_y")).alias("pearson_ic"), *(v.alias(n) for n, v in means.items()),
        F.stddev_samp("_x").alias("score_dispersion"), (F.avg(when(top, F.col("_x"))) - F.avg(when(F.col("_low"), F.col("_x")))).alias("top_bottom_score_gap"),
        frames.safe_ratio(F.max(when(top, F.abs("_x"))), F.sum(when(top, F.abs("_x")))).alias("top_stock_concentration"), F.sum(top.cast("long")).alias("_held"), *(F.avg(F.col(c).cast("double")).alias(c) for c in context),
    )
    steps = Window.partitionBy(*axes).orderBy(time)
    by = by.withColumns({"_at": F.row_number().over(steps), "_had": F.lag("_held").over(steps)})  # one row a day
    held = pairs.filter("_top").select(*key, code).join(by.select(*key, "_at"), key)
    kept = held.withColumn("_again", F.lag("_at").over(Window.partitionBy(*axes, code).orderBy("_at")) == F.col("_at") - 1).groupBy(*key).agg(F.sum(F.coalesce("_again", F.lit(False)).cast("long")).alias("_kept"))
    out = by.join(kept, key, "left")
    overlap = F.when(F.col("_had").isNotNull(), frames.safe_ratio(F.coalesce("_kept", F.lit(0)), F.col("_held") + F.col("_had") - F.coalesce("_kept", F.lit(0))))
    spread = F.col(f"decile_{deciles}_return") - F.col("decile_1_return")
    return out.select(
        *key, "observation_count", "rank_ic", "pearson_ic", monotonicity([F.col(n) for n in means]).alias("decile_monotonicity"), F.col(f"decile_{deciles}_return").alias("top_decile_return"), F.col("decile_1_return").alias("bottom_decile_return"), spread.alias("decile_spread"),
        "score_dispersion", "top_bottom_score_gap", (1 - overlap).alias("top_decile_turnover"), overlap.alias("holding_overlap"), "top_stock_concentration", *means, *context,
    )


def monotonicity(values: list[Column]) -> Column:
    """Rank correlation of the values that are there, average ties, with their order; missing with fewer than three, or where nothing varies."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    there = [v.isNotNull().cast("int") for v in values]
    n = add(there)
    before = lambda i: add([F.lit(0), *there[:i]])
    rank = lambda i: add([F.lit(0.0)] + [F.coalesce((o < values[i]).cast("double") + 0.5 * (o == values[i]).cast("double"), F.lit(0.0)) for k, o in enumerate(values) if k != i])
    own = [(before(i).cast("double") - (n - 1) / 2, rank(i) - (n - 1) / 2) for i in range(len(values))]  # centred: both from 0 to n - 1
    total = lambda f: add([F.lit(0.0)] + [F.when(values[i].isNotNull(), f(*own[i])).otherwise(0.0) for i in range(len(values))])
    return F.when(n >= 3, frames.safe_ratio(total(lambda a, b: a * b), F.sqrt(total(lambda a, b: a * a) * total(lambda a, b: b * b))))


def rolling_health(daily: DataFrame, windows: tuple[int, ...] = (20, 60, 120), axes: list[str] | None = None, time: str = "trade_date") -> DataFrame:
    """``daily`` with trailing means of rank_ic and decile_spread, the IC's ratio of mean and deviation, and how shorter means differ from the next longer ones."""
    w = Window.partitionBy(*(axes or [])).orderBy(time)
    least = lambda size: max(5, min(size, size // 2))
    roll = lambda c, size, kind="mean": frames.rolling(F.col(c), size, kind, least(size), ddof=1, w=w)
    out = daily.withColumns({f"rolling_rank_ic_{k}": roll("rank_ic", k) for k in windows} | {f"icir_{k}": frames.safe_ratio(roll("rank_ic", k), roll("rank_ic", k, "std")) for k in windows} | {f"spread_{k}": roll("decile_spread", k) for k in windows})
    gaps = list(zip(windows, windows[1:]))
    return out.withColumns({f"spread_velocity_{a}_{b}": F.col(f"spread_{a}") - F.col(f"spread_{b}") for a, b in gaps} | {f"ic_velocity_{a}_{b}": F.col(f"rolling_rank_ic_{a}") - F.col(f"rolling_rank_ic_{b}") for a, b in gaps})
