"""Judging tests and scores: gates, composition effects, drift, buckets, conditions, year slices and labels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.operators import stats


def gate(tests: DataFrame, selector: Mapping[str, object], least_mean: float, least_positive: float, most_q: float | None = None, tail: bool = False) -> DataFrame:
    """One row: does the one test that the selector names pass?  tests: mean, positive_ratio, fdr_q, top_bottom_mean.

    No test or several of the selected name fail; missing evidence fails its check; a
    positive top-minus-bottom mean may stand in for the checks.
    """
    chosen = tests
    for column, value in selector.items():
        chosen = chosen.filter(F.col(column) == value)
    one = chosen.agg(F.count("*").alias("found"), *(F.max(c).alias(c) for c in ("mean", "positive_ratio", "fdr_q", "top_bottom_mean")))
    said = lambda c: F.coalesce(c, F.lit(False))
    checks = {"mean_ok": said(F.col("mean") >= least_mean), "positive_ok": said(F.col("positive_ratio") >= least_positive), "fdr_ok": F.lit(True) if most_q is None else said(F.col("fdr_q") <= most_q)}
    stood_in = F.lit(tail) & said(F.col("top_bottom_mean") > 0)
    all_ok = F.col("mean_ok") & F.col("positive_ok") & F.col("fdr_ok")
    return one.withColumns(checks).withColumns({"passed": (F.col("found") == 1) & (all_ok | stood_in), "tail_used": (F.col("found") == 1) & stood_in & ~all_ok})


def composition_effect(whole: DataFrame, within: DataFrame, horizon: int, p_of, least_days: int = 60, retained: float = 0.5, most_p: float = 0.1) -> DataFrame:
    """One row: how much of a factor's IC over the whole market (trade_date, ic) is left within industries, and what that says.

    The difference of the days that both have is tested under horizon - 1 lags; ``p_of`` turns t into p.
    """
    days = whole.select("trade_date", F.col("ic").alias("whole")).join(within.select("trade_date", F.col("ic").alias("within")), "trade_date").dropna()
    days = days.select("trade_date", "whole", "within", (F.col("within") - F.col("whole")).alias("delta"), F.lit("delta").alias("series"))
    means = days.groupBy("series").agg(F.count("*").alias("days"), F.avg("whole").alias("whole_mean"), F.avg("within").alias("within_mean"))
    tested = stats.newey_west_sums(days, ["series"], max(horizon - 1, 0), "delta").select("series", F.col("mean").alias("delta_mean"), "nw_t")
    out = means.join(tested, "series").withColumn("retention", F.when(F.col("whole_mean") > 0, F.col("within_mean") / F.col("whole_mean"))).withColumn("p_value", p_of(F.col("nw_t")))
    lost = (F.col("retention") < retained) & (F.col("delta_mean") < 0) & (F.col("p_value") <= most_p)
    said = F.when(F.col("days") < least_days, "insufficient_overlap").when(F.col("whole_mean") <= 0, "market_gate_not_supported").when(lost, "supports_cross_section_composition").when(F.col("retention") >= retained, "weakens_cross_section_composition")
    return out.withColumn("classification", said.otherwise("inconclusive")).drop("series")


def condition_membership(panel: DataFrame, value: str, universe: str, groups: int, chosen: Sequence[int], least: int) -> DataFrame:
    """trade_date, ts_code, condition_value, condition_quantile, selection_eligible for the rows of the universe that have a value."""
    rows = panel.filter(F.coalesce(F.col(universe), F.lit(False)) & F.col(value).isNotNull()).select("trade_date", "ts_code", F.col(value).alias("condition_value"))
    n = F.count("*").over(Window.partitionBy("trade_date"))
    ranked = rows.withColumn("_p", frames.pct_rank(F.col("condition_value"))).withColumn("_n", n)
    quantile = F.least(F.greatest(F.ceil(F.col("_p") * groups), F.lit(1)), F.lit(groups)).cast("int")
    return ranked.withColumn("condition_quantile", quantile).withColumn("selection_eligible", (F.col("_n") >= least) & F.col("condition_quantile").isin(list(chosen))).drop("_p", "_n")


def value_bucket(value: str, day: str = "trade_date", bins: int = 5) -> Column:
    """Bucket 1.. of a value between the date's linear quantiles, right-closed; equal quantiles are one."""
    edges = F.array_distinct(F.percentile(value, [k / bins for k in range(bins + 1)]).over(Window.partitionBy(day)))
    return F.greatest(F.size(F.filter(edges, lambda e: e < F.col(value))), F.lit(1))


def two_way_table(rows: DataFrame, row: str, column: str, target: str, bins: int = 5, least: int = 20) -> DataFrame:
    """row_bucket, column_bucket, mean_return, days: mean over dates of the daily means of cells of two independent bucketings."""
    clean = rows.select("trade_date", row, column, target).dropna().withColumn("_n", F.count("*").over(Window.partitionBy("trade_date"))).filter(F.col("_n") >= least)
    cells = clean.withColumns({"row_bucket": value_bucket(row, bins=bins), "column_bucket": value_bucket(column, bins=bins)})
    daily = cells.groupBy("trade_date", "row_bucket", "column_bucket").agg(F.avg(target).alias("_m"))
    return daily.groupBy("row_bucket", "column_bucket").agg(F.avg("_m").alias("mean_return"), F.count("*").alias("days"))


def decile_returns(rows: DataFrame, score: str, targets: Mapping[int, str]) -> DataFrame:
    """horizon, decile, average_return, annualized_return, days: mean of daily means by tenths of the score's rank, ties by security."""
    d = Window.partitionBy("trade_date")
    share = F.row_number().over(d.orderBy(score, "ts_code")) / F.count("*").over(d)
    ranked = rows.filter(F.col(score).isNotNull()).withColumn("decile", F.least(F.greatest(F.ceil(share * 10), F.lit(1)), F.lit(10)).cast("int"))
    each = ranked.select("trade_date", "decile", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y")) for h, c in targets.items()))).alias("t")).select("trade_date", "decile", "t.*")
    daily = each.groupBy("horizon", "decile", "trade_date").agg(F.avg("y").alias("m")).filter("m is not null")
    out = daily.groupBy("horizon", "decile").agg(F.avg("m").alias("average_return"), F.count("*").alias("days"))
    return out.withColumn("annualized_return", F.pow(1 + F.col("average_return"), 252 / F.col("horizon")) - 1)


def conditional_grid(rows: DataFrame, scores: Mapping[str, Column], conditions: Mapping[str, Column], targets: Mapping[int, str], least: int = 3) -> DataFrame:
    """score, condition, horizon, trade_date, n, ic: daily rank ICs of every score in every slice at every horizon, in one plan.

    Slices, scores and horizons are columns: a date's rows move once, and each column is
    sorted once for all slices.
    """
    flags = {n: f"_in{i}" for i, n in enumerate(conditions)}
    wide = rows.select("trade_date", *(c.alias(flags[n]) for n, c in conditions.items()), *(x.cast("double").alias(f"_x{i}") for i, x in enumerate(scores.values())), *(F.col(c).alias(f"_y{h}") for h, c in targets.items()))
    cells = [(n, h, f"_x{i}", f"_y{h}") for i, n in enumerate(scores) for h in targets]
    found = stats.rank_correlations(wide, [(x, y) for *_, x, y in cells], ["trade_date"], least, flags)
    each = F.array(*(F.struct(F.lit(n).alias("score"), F.lit(h).alias("horizon"), F.col(f"n{i}").alias("n"), F.round(f"r{i}", 12).alias("ic")) for i, (n, h, *_) in enumerate(cells)))
    return found.select("trade_date", F.col("slice").alias("condition"), F.explode(each).alias("c")).select("c.score", "condition", "c.horizon", "trade_date", "c.n", "c.ic").filter("n > 0")


def relation_drift(daily: DataFrame, axes: list[str], value: str, recent: int, baseline: int, smooth: int = 10, threshold: float = 2.0, persistence: int = 3, cusum: bool = False, medium: int = 60, least_recent: int = 1) -> DataFrame:
    """axes, days of both windows, their means and that of the last ``medium`` values, delta, robust_z, cusum, persistence_days, direction, is_drift of each series.

    A drift needs ``least_recent`` recent values, and the last ``persistence`` of them on its side.

    The scale is 1.4826 median absolute deviations of the baseline, or its deviation where that is none.
    """
    newest = Window.partitionBy(*axes).orderBy(F.desc("trade_date"))
    rows = daily.filter(F.col(value).isNotNull()).select(*axes, "trade_date", F.col(value).alias("v")).withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= max(recent + baseline, medium))
    whole, old = Window.partitionBy(*axes), F.when((F.col("k") > recent) & (F.col("k") <= recent + baseline), F.col("v"))
    rows = rows.withColumn("center", F.median(old).over(whole)).withColumn("mean", F.avg(old).over(whole))
    rows = rows.withColumn("mad", 1.4826 * F.median(F.abs(old - F.col("center"))).over(whole)).withColumn("scale", F.when(F.col("mad") > 1e-12, F.col("mad")).otherwise(F.stddev_pop(old).over(whole)))
    rows = rows.withColumns({"medium": F.avg(F.when(F.col("k") <= medium, F.col("v"))).over(whole), "old_days": F.count(old).over(whole)})
    now = rows.filter(F.col("k") <= recent).withColumn("delta", F.avg("v").over(whole) - F.col("mean")).withColumn("n", F.count("*").over(whole))
    time = Window.partitionBy(*axes).orderBy("trade_date")
    walk = F.abs(F.sum(frames.safe_ratio(F.col("v") - F.col("mean"), F.col("scale"))).over(time.rowsBetween(Window.unboundedPreceding, 0)))
    sign = F.when(F.col("delta") >= 0, 1).otherwise(-1)
    moved = F.coalesce((frames.rolling(F.col("v"), smooth, w=time) - F.col("mean")) * sign > F.col("scale") / math.sqrt(smooth), F.lit(False))
    now = now.withColumn("walk", walk).withColumn("moved", moved)
    out = now.groupBy(*axes).agg(
        F.first("old_days").alias("baseline_days"), F.count("*").alias("recent_days"), F.first("mean").alias("baseline_mean"), F.first("medium").alias("medium_mean"), F.avg("v").alias("recent_mean"), F.first("delta").alias("delta"), F.first("scale").alias("scale"), F.first("n").alias("n"), F.max("walk").alias("walk"),
        F.coalesce(F.min(F.when(~F.col("moved"), F.col("k"))) - 1, F.first("n")).cast("long").alias("persistence_days"),
    )
    out = out.withColumns({"robust_z": frames.safe_ratio(F.col("delta"), F.col("scale") / F.sqrt("n")), "cusum": F.col("walk") / F.sqrt("n")})
    drifts = F.coalesce((F.abs(F.col("cusum" if cusum else "robust_z")) >= threshold) & (F.col("persistence_days") >= persistence) & (F.col("recent_days") >= least_recent), F.lit(False))
    direction = F.when(F.col("delta") > 0, "strengthening").when(F.col("delta") < 0, "weakening").otherwise("none")
    return out.select(*axes, "baseline_days", "recent_days", "baseline_mean", "medium_mean", "recent_mean", "delta", "robust_z", "cusum", "persistence_days", direction.alias("direction"), drifts.alias("is_drift"))


def year_slices(daily: DataFrame, axes: list[str], strategy: str, benchmark: str, sessions: int = 252) -> DataFrame:
    """axes, year: compound returns, excess, Sharpe, drawdown and Calmar of each calendar year of daily returns."""
    rows = daily.withColumn("year", F.year("trade_date"))
    time = Window.partitionBy(*axes, "year").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumn("nav", F.product(1 + F.col(strategy)).over(time))
    grown = grown.withColumn("fall", F.col("nav") / F.max("nav").over(time) - 1)
    out = grown.groupBy(*axes, "year").agg(
        (F.product(1 + F.col(strategy)) - 1).alias("strategy_return"), (F.product(1 + F.col(benchmark)) - 1).alias("benchmark_return"), (F.stddev_samp(strategy) * math.sqrt(sessions)).alias("volatility"), F.min("fall").alias("max_drawdown"), F.count("*").alias("days"),
    )
    ratios = {"excess_return": F.col("strategy_return") - F.col("benchmark_return"), "sharpe": F.when(F.col("volatility") > 0, F.col("strategy_return") / F.col("volatility")), "calmar": F.when(F.col("max_drawdown") < 0, F.col("strategy_return") / F.abs("max_drawdown"))}
    return out.withColumns(ratios).drop("volatility")


def shrunk_utility(rows: DataFrame, axes: list[str], weight: str, value: str, strength: float) -> DataFrame:
    """axes, utility: weighted means drawn towards the mean of all rows as by ``strength`` more weight on it."""
    overall = rows.agg(F.avg(F.when(F.col(weight).isNotNull(), F.col(value))).alias("all"))  # one row
    sums = rows.filter(F.col(weight).isNotNull() & F.col(value).isNotNull()).groupBy(*axes).agg(F.sum(F.col(weight) * F.col(value)).alias("wy"), F.sum(weight).alias("w"))
    return sums.crossJoin(F.broadcast(overall)).select(*axes, ((F.col("wy") + strength * F.col("all")) / (F.col("w") + strength)).alias("utility"))


def relevance(value: str, grades: int = 5) -> Column:
    """Grade 0.. of a value by its rank within the date, ties by the row's concept; missing on dates with fewer than ``grades`` values."""
    d = Window.partitionBy("trade_date", F.col(value).isNotNull())
    n, r = F.count(value).over(d), F.row_number().over(d.orderBy(value, "concept_code"))
    return F.when(F.col(value).isNotNull() & (n >= grades), F.least(F.ceil(r / n * grades) - 1, F.lit(grades - 1)).cast("int"))


def basket_labels(concepts: DataFrame, members: DataFrame, candidates: int, stocks: int, least: int, least_candidates: int, cost_bps: float) -> DataFrame:
    """The best ``candidates`` concepts of a date with the forward return and relevance of baskets of their best ``stocks`` members.

    concepts: trade_date, concept_code, momentum; members: trade_date, concept_code, ts_code, momentum, forward.
    """
    best = Window.partitionBy("trade_date").orderBy(F.desc("momentum"), "concept_code")
    chosen = concepts.filter("momentum is not null").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= candidates).select("trade_date", "concept_code", F.col("momentum").alias("concept_momentum"))
    core = Window.partitionBy("trade_date", "concept_code").orderBy(F.desc("momentum"), "ts_code")
    picked = members.filter("momentum is not null").join(chosen, ["trade_date", "concept_code"], "left_semi").withColumn("_r", F.row_number().over(core)).filter(F.col("_r") <= stocks)
    baskets = picked.groupBy("trade_date", "concept_code").agg(F.count("*").alias("basket_stocks"), F.avg("momentum").alias("core_momentum"), F.stddev_pop("momentum").alias("core_spread"), F.when(F.count("forward") >= least, F.avg("forward") - cost_bps / 10_000).alias("net_forward"))
    out = chosen.join(baskets, ["trade_date", "concept_code"], "left").withColumn("relevance", relevance("net_forward"))
    usable = F.sum((F.coalesce("basket_stocks", F.lit(0)) >= least).cast("int")).over(Window.partitionBy("trade_date"))
    return out.withColumn("_usable", usable).filter(F.col("_usable") >= least_candidates).drop("_usable")


def blend_weights(rows: DataFrame, keys: list[str], price: str, parts: Sequence[str], most: float) -> DataFrame:
    """keys and weights that sum to one: negative coefficients count as none, and all ``parts`` together have at most ``most``."""
    positive = {c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in (price, *parts)}
    clipped = rows.select(*keys, *(v.alias(c) for c, v in positive.items()))
    total = sum((F.col(c) for c in parts), F.lit(0.0))
    share = F.when(total > 0, F.least(total / (F.col(price) + total), F.lit(most))).otherwise(0.0)
    shared = clipped.withColumn("_total", total).withColumn("_share", share)
    own = [F.when(F.col("_total") > 0, F.col(c) / F.col("_total") * F.col("_share")).otherwise(0.0).alias(f"w_{c}") for c in parts]
    return shared.select(*keys, (1 - F.col("_share")).alias(f"w_{price}"), *own)
