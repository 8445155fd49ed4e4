"""Event studies: labels and covariates, regimes, matching, cooldowns, paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.operators.stats import newey_west_sums, forward_open_return


def labels_and_covariates(panel: DataFrame, horizons: list[int]) -> DataFrame:
    """``panel`` with covariates known at the close and forward open returns with their maturity."""
    w = frames.history()
    change = lambda n: frames.safe_ratio(F.col("adj_close"), F.lag("adj_close", n).over(w)) - 1
    out = panel.withColumns({"prior_return_5d": change(5), "_step": change(1), "_amount": frames.rolling(F.col("amount_cny"), 20, "mean", 10)})
    out = out.withColumns({"volatility_20d": frames.rolling(F.col("_step"), 20, "std", 10), "log_avg_amount_20d": F.ln(F.when(F.col("_amount") > 0, F.col("_amount")))})
    for h in horizons:
        out = out.withColumn(f"forward_return_{h}", forward_open_return(h))
        out = out.withColumn(f"label_mature_{h}", F.lead("adj_open", 1).over(w).isNotNull() & F.lead("adj_open", h + 1).over(w).isNotNull())
    return out.drop("_step", "_amount")


def market_regimes(panel: DataFrame) -> DataFrame:
    """trade_date, market_return_20d, market_volatility_20d, market_direction, market_volatility: one row a session."""
    step = panel.withColumn("_r", frames.safe_ratio(F.col("adj_close"), F.lag("adj_close", 1).over(frames.history())) - 1)
    daily = step.filter(F.coalesce("is_liquid", F.lit(False))).groupBy("trade_date").agg(F.avg("_r").alias("market_daily_return"))
    w = Window.orderBy("trade_date")  # of one row a session
    r = F.col("market_daily_return")
    out = daily.withColumns({"market_return_20d": frames.rolling(r, 20, "sum", 10, w=w), "market_volatility_20d": frames.rolling(r, 20, "std", 10, w=w)})
    out = out.withColumn("_usual", frames.rolling(F.col("market_volatility_20d"), 252, "median", 60, shift=1, w=w))
    direction = F.when(F.coalesce(F.col("market_return_20d") >= 0, F.lit(False)), "up").otherwise("down")
    volatility = F.when(F.coalesce(F.col("market_volatility_20d") >= F.col("_usual"), F.lit(False)), "high").otherwise("low")
    return out.select("trade_date", "market_daily_return", "market_return_20d", "market_volatility_20d", direction.alias("market_direction"), volatility.alias("market_volatility"))


def nearest(codes: np.ndarray, event: np.ndarray, values: np.ndarray, neighbours: int, caliper: float, cells: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Event's row, control's row, distance and rank of one cell's neighbours; ``values`` are its rows' scaled controls.

    The cell's controls stand in order of the first column.  Events look to both sides of
    their places, ``cells`` differences at a time, and those twice as far again whose last
    neighbour is no nearer than the first column alone lets rows beyond be.  Of equal
    controls only the first codes can be neighbours.
    """
    places = np.unique(codes, return_inverse=True)[1]
    pool, asking = np.flatnonzero(~event), np.flatnonzero(event)
    pool = pool[np.lexsort((places[pool], *values[pool].T[::-1]))]
    at = np.arange(len(pool))
    new = np.r_[True, (values[pool[1:]] != values[pool[:-1]]).any(axis=1)] if len(pool) else np.zeros(0, bool)
    pool = pool[at - np.maximum.accumulate(np.where(new, at, 0)) < neighbours]
    first, found, reach = values[pool, 0], [], 4 * neighbours
    while len(asking) and len(pool):
        later = []
        for part in np.array_split(asking, len(asking) * 2 * reach // cells + 1):
            seen = np.searchsorted(first, values[part, 0])[:, None] + np.arange(-reach, reach)
            held = seen.clip(0, len(pool) - 1)
            distance = np.sqrt(sum((values[pool, k][held] - values[part, k][:, None]) ** 2 for k in range(values.shape[1])) / values.shape[1])
            distance[held != seen] = np.inf
            last = np.minimum(np.partition(distance, neighbours - 1, axis=1)[:, neighbours - 1], caliper)
            limit = last * values.shape[1] ** 0.5 * (1 + 1e-9)
            done = (seen[:, 0] <= 0) | (values[part, 0] - first[held[:, 0]] > limit)
            done &= (seen[:, -1] >= len(pool) - 1) | (first[held[:, -1]] - values[part, 0] > limit)
            later.append(part[~done])
            i, j = np.nonzero((distance <= last[:, None]) & done[:, None])
            found.append((part[i], pool[held[i, j]], distance[i, j]))
        asking, reach = np.concatenate(later), 2 * reach
    e, c, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    order = np.lexsort((places[c], d, e))
    e, c, d = e[order], c[order], d[order]
    rank = np.arange(len(e)) - np.searchsorted(e, e) + 1
    near = rank <= neighbours
    return e[near], c[near], d[near], rank[near]


def match_controls(rows: DataFrame, controls: list[str], neighbours: int = 3, caliper: float = 1.0, event: str = "is_event", group: str = "industry_l1_code") -> DataFrame:
    """trade_date, group, event_code, control_code, match_distance, rank.

    Events meet the non-events of their own date and group only; distances are root
    mean squares of robustly scaled differences; ties go to the smaller code.  Pairs
    are never formed but around an event's place in its cell (``nearest``), so what
    moves grows with the rows.
    """
    cell = Window.partitionBy("trade_date", group)
    d = rows.filter(F.col(group).isNotNull()).select("trade_date", group, "ts_code", event, *controls)
    d = d.withColumns({f"_c_{c}": F.median(c).over(cell) for c in controls})
    d = d.withColumns({f"_m_{c}": 1.4826 * F.median(F.abs(F.col(c) - F.col(f"_c_{c}"))).over(cell) for c in controls} | {f"_s_{c}": F.stddev_pop(c).over(cell) for c in controls})
    scale = lambda c: F.when(F.col(f"_m_{c}") > 1e-12, F.col(f"_m_{c}")).when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(1.0)
    names = [f"c{i}" for i in range(len(controls))]
    d = d.select("trade_date", group, F.col("ts_code").cast("string").alias("code"), F.col(event).alias("event"), *(((F.col(c) - F.col(f"_c_{c}")) / scale(c)).alias(n) for c, n in zip(controls, names))).dropna(subset=["event", *names])
    kinds = dict(rows.select("trade_date", group, "ts_code").dtypes)
    schema = f"trade_date {kinds['trade_date']}, `{group}` {kinds[group]}, event_code string, control_code string, match_distance double, rank int"

    def matched(key: tuple, sides: pd.DataFrame) -> pd.DataFrame:
        codes = sides["code"].fillna("").to_numpy(str)
        e, c, distance, rank = nearest(codes, sides["event"].to_numpy(bool), sides[names].to_numpy(float), neighbours, caliper)
        said = sides["code"].to_numpy(object)
        return pd.DataFrame({"trade_date": key[0], group: key[1], "event_code": said[e], "control_code": said[c], "match_distance": distance, "rank": rank})

    found = d.groupBy("trade_date", group).applyInPandas(matched, schema)
    return found.withColumns({c: F.col(c).cast(kinds["ts_code"]) for c in ("event_code", "control_code")})


def rotated_controls(rows: DataFrame, neighbours: int = 3, event: str = "is_event", group: str = "industry_l1_code") -> DataFrame:
    """Matching without covariates: the codes of the date and group, in order, from a place that a hash of date and event names."""
    cell = Window.partitionBy("trade_date", group)
    c = rows.filter(~F.col(event) & F.col(group).isNotNull()).select("trade_date", group, F.col("ts_code").cast("string").alias("control_code")).distinct()
    c = c.withColumn("_i", F.row_number().over(cell.orderBy("control_code")) - 1).withColumn("_n", F.count("*").over(cell))
    said = F.concat(F.date_format("trade_date", "yyyy-MM-dd HH:mm:ss"), F.lit("|"), F.col("event_code"))
    e = rows.filter(F.col(event)).select("trade_date", group, F.col("ts_code").cast("string").alias("event_code")).withColumn("_h", F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long"))
    turned = e.join(c, ["trade_date", group]).withColumn("rank", F.pmod(F.col("_i") - F.pmod(F.col("_h"), F.col("_n")), F.col("_n")) + 1)
    return turned.filter(F.col("rank") <= neighbours).select("trade_date", group, "event_code", "control_code", F.col("rank").cast("int").alias("rank"))


def first_in_window(flag, rows: int, w=None):
    """True where ``flag`` holds and held on none of the ``rows`` rows before."""
    return flag & (F.coalesce(F.max(flag.cast("int")).over((w or frames.history()).rowsBetween(-rows, -1)), F.lit(0)) == 0)


def greedy_cooldown(events: DataFrame, entity: str, ordinal: str, gap: int, inclusive: bool) -> DataFrame:
    """Events kept one after another: the next kept one is more than ``gap`` (``inclusive``: at least) after the last kept.

    The anchor moves on kept events only, which no window frame can say; each
    entity's events are walked in order.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordinal, kind="stable")
        kept, last = [], None
        for at in pdf[ordinal]:
            ok = last is None or (at - last >= gap if inclusive else at - last > gap)
            kept.append(ok)
            last = at if ok else last
        return pdf[kept]

    return events.groupBy(entity).applyInPandas(walk, events.schema)


def with_covariates(pairs: DataFrame, values: DataFrame, covariates: list[str]) -> DataFrame:
    """``pairs`` with event_<covariate> and control_<covariate> of both sides; values: trade_date, ts_code and the covariates."""
    side = lambda s: values.select("trade_date", F.col("ts_code").cast("string").alias(f"{s}_code"), *(F.col(c).cast("double").alias(f"{s}_{c}") for c in covariates))
    return pairs.join(side("event"), ["trade_date", "event_code"], "left").join(side("control"), ["trade_date", "control_code"], "left")


def balance(pairs: DataFrame, covariates: list[str], axes: list[str] | None = None) -> DataFrame:
    """axes, covariate, weighting, events, controls, event_mean, control_mean, smd, abs_smd: standardized mean differences of matched sides.

    weighting ``event_once`` counts an event once whatever its controls, ``all_pairs`` once
    for each of them; controls always count by pair.  The difference is over the root of
    the mean of both variances; missing where nothing varies.
    """
    axes = axes or []
    once = F.row_number().over(Window.partitionBy(*axes, "trade_date", "event_code").orderBy("control_code")) == 1
    each = F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(f"event_{c}").cast("double").alias("e"), F.col(f"control_{c}").cast("double").alias("c")) for c in covariates))
    rows = pairs.withColumn("_once", once).select(*axes, "_once", F.explode(each).alias("x")).select(*axes, "_once", "x.*")
    e = {"event_once": F.when(F.col("_once"), F.col("e")), "all_pairs": F.col("e")}
    sums = [f(v).alias(f"{n}_{k}") for k, v in e.items() for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))]
    by = rows.groupBy(*axes, "covariate").agg(*sums, F.count("c").alias("controls"), F.avg("c").alias("control_mean"), F.var_pop("c").alias("_var"))
    cells = F.array(*(F.struct(F.lit(k).alias("weighting"), F.col(f"n_{k}").alias("events"), F.col(f"mean_{k}").alias("event_mean"), frames.safe_ratio(F.col(f"mean_{k}") - F.col("control_mean"), F.sqrt((F.col(f"var_{k}") + F.col("_var")) / 2)).alias("smd")) for k in e))
    out = by.select(*axes, "covariate", "controls", "control_mean", F.explode(cells).alias("x"))
    return out.select(*axes, "covariate", "x.weighting", "x.events", "controls", "x.event_mean", "control_mean", "x.smd", F.abs("x.smd").alias("abs_smd"))


def paired(pairs: DataFrame, values: DataFrame, target: str, severity: str) -> DataFrame:
    """trade_date, event_code, severity, event_return, control_return, controls, paired_excess: each event against the mean of its controls.

    values: trade_date, ts_code, ``target`` and ``severity``; pairs of which a side has no return don't count.
    """
    own = values.select("trade_date", F.col("ts_code").alias("event_code"), F.col(target).alias("event_return"), F.col(severity).alias("severity"))
    other = values.select("trade_date", F.col("ts_code").alias("control_code"), F.col(target).alias("control_return"))
    both = pairs.select("trade_date", "event_code", "control_code").join(own, ["trade_date", "event_code"]).join(other, ["trade_date", "control_code"]).filter("event_return is not null and control_return is not null")
    out = both.groupBy("trade_date", "event_code").agg(F.first("severity").alias("severity"), F.first("event_return").alias("event_return"), F.avg("control_return").alias("control_return"), F.count_distinct("control_code").alias("controls"))
    return out.withColumn("paired_excess", F.col("event_return") - F.col("control_return"))


def paired_summary(rows: DataFrame, axes: list[str], lags: int, least: int = 1) -> DataFrame:
    """axes, events, means, median, win rate, daily mean, share of days in its direction and its HAC t of ``paired`` rows."""
    x = F.col("paired_excess")
    whole = rows.groupBy(*axes).agg(F.count("*").alias("events"), F.avg("event_return").alias("mean_event"), F.avg("control_return").alias("mean_control"), F.avg(x).alias("mean_excess"), F.median(x).alias("median_excess"), F.avg((x > 0).cast("double")).alias("win_rate"))
    daily = rows.groupBy(*axes, "trade_date").agg(F.avg(x).alias("day"))
    tested = newey_west_sums(daily, axes, lags, "day").select(*axes, F.col("mean").alias("daily_mean"), "nw_t")
    sides = daily.join(tested.select(*axes, "daily_mean"), axes).groupBy(*axes).agg(F.avg((F.col("day") * F.when(F.col("daily_mean") >= 0, 1).otherwise(-1) > 0).cast("double")).alias("direction_ratio"))
    return whole.join(tested, axes).join(sides, axes).filter(F.col("events") >= least)


def severity_groups(rows: DataFrame, groups: int = 3, least: int = 30) -> DataFrame:
    """severity_group, events, its bounds, mean and median excess, and whether the means rise or fall throughout.

    Groups lie between the severities' linear quantiles; equal severities stay together.
    """
    edges = rows.agg(F.percentile("severity", [k / groups for k in range(1, groups)]).alias("edges"), F.count("*").alias("n"))  # one row
    placed = rows.crossJoin(F.broadcast(edges)).filter(F.col("n") >= least).withColumn("severity_group", 1 + F.size(F.filter("edges", lambda e: e < F.col("severity"))))
    out = placed.groupBy("severity_group").agg(F.count("*").alias("events"), F.min("severity").alias("severity_min"), F.max("severity").alias("severity_max"), F.avg("paired_excess").alias("mean_excess"), F.median("paired_excess").alias("median_excess"))
    w = Window.orderBy("severity_group")  # of ``groups`` rows
    step = F.signum(F.col("mean_excess") - F.lag("mean_excess").over(w))
    whole = Window.partitionBy()
    return out.withColumn("_s", step).withColumn("monotonic", F.coalesce(F.min("_s").over(whole) == F.max("_s").over(whole), F.lit(True))).drop("_s")
