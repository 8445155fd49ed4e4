"""Cross-sectional residuals: one control by window regressions, several by small least squares per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_control(df: DataFrame, y: str, x: str, by: list[str], least: int, out: str) -> DataFrame:
    """``df`` with y minus its regression on x within each group of ``least`` or more pairs."""
    s = Window.partitionBy(*by)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    py, px = F.when(both, F.col(y)), F.when(both, F.col(x))
    n, sx, sy = F.count(px).over(s), F.avg(px).over(s), F.avg(py).over(s)
    slope = F.coalesce(F.try_divide(F.covar_pop(px, py).over(s), F.nullif(F.var_pop(px).over(s), F.lit(0.0))), F.lit(0.0))
    return df.withColumn(out, F.when(both & (n >= max(least, 3)), (F.col(y) - sy) - slope * (F.col(x) - sx)))


def industry_and_size(df: DataFrame, y: str, size: str, industry: str, out: str, time: str = "trade_date") -> DataFrame:
    """Residual of y on size and industry dummies with intercept, by date.

    Demeaning both sides within industries and one slope give the least-squares
    residual without building dummies: two window passes instead of a grouped solve.
    """
    both = F.col(y).isNotNull() & F.col(size).isNotNull() & F.col(industry).isNotNull()
    cell, day = Window.partitionBy(time, industry), Window.partitionBy(time)
    d = df.withColumn("_y", F.when(both, F.col(y)) - F.avg(F.when(both, F.col(y))).over(cell)).withColumn("_x", F.when(both, F.col(size)) - F.avg(F.when(both, F.col(size))).over(cell))
    groups = F.size(F.collect_set(industry).over(day))  # the day's industries, rows without a value included
    slope = F.coalesce(F.try_divide(F.sum(F.col("_x") * F.col("_y")).over(day), F.nullif(F.sum(F.col("_x") * F.col("_x")).over(day), F.lit(0.0))), F.lit(0.0))
    enough = F.count("_y").over(day) > groups + 1
    return d.withColumn(out, F.when(enough, F.col("_y") - slope * F.col("_x"))).drop("_y", "_x")


def fitted(values: np.ndarray, least: int, ridge: float = 0.0, standardize: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Residuals of the first column on an intercept and the others (NaN for rows that lack a value), and the slopes; no slopes from fewer than ``least`` rows.

    A standardized control that does not vary has the slope 0; the ridge leaves the intercept alone.
    """
    ok = np.isfinite(values).all(axis=1)
    res = np.full(len(values), np.nan)
    if ok.sum() < least:
        return res, None
    t, x = values[ok, 0], values[ok, 1:]
    scale, keep = np.ones(x.shape[1]), np.ones(x.shape[1], bool)
    if standardize:
        scale = x.std(axis=0)
        keep = scale > 1e-12
        x = (x[:, keep] - x[:, keep].mean(axis=0)) / scale[keep]
    design = np.column_stack([np.ones(len(t)), x])
    if ridge:
        penalty = ridge * np.eye(design.shape[1])
        penalty[0, 0] = 0.0
        beta = np.linalg.solve(design.T @ design + penalty, design.T @ t)
    else:
        beta = np.linalg.lstsq(design, t, rcond=None)[0]
    res[ok] = t - design @ beta
    slopes = np.zeros(len(keep))
    slopes[keep] = beta[1:] / scale[keep]
    return res, slopes


def missing(values: np.ndarray, index) -> pd.Series:
    """``values``, missing where they are not finite."""
    lost = ~np.isfinite(values)
    return pd.Series(pd.arrays.FloatingArray(np.where(lost, 0.0, values), lost), index=index)


def least_squares(df: DataFrame, y: str, controls: list[str], by: list[str], least: int, out: str, ridge: float = 0.0, standardize: bool = False, keep: list[str] | None = None, slopes: bool = False) -> DataFrame:
    """by, keep, out (and ``slopes``, an array, in one row of each group that has them): residual of y on several controls within each group (a date, or a date and industry: one cross-section)."""
    keep = keep or ["trade_date", "ts_code"]
    cols = list(dict.fromkeys([*by, *keep, y, *controls]))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = list(dict.fromkeys([*by, *keep]))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        res, found = fitted(pdf[[y, *controls]].to_numpy(float), max(least, len(controls) + 2), ridge, standardize)
        made = pdf[names].assign(**{out: missing(res, pdf.index)})
        return made.assign(slopes=[None if found is None else found.tolist(), *[None] * (len(pdf) - 1)]) if slopes else made

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{out}` double" + ", slopes array<double>" * slopes
    return df.select(*cols).groupBy(*by).applyInPandas(solve, schema)


def fama_macbeth(df: DataFrame, y: str, controls: list[str], time: str = "trade_date") -> DataFrame:
    """time, name, coefficient: of z-scored controls in each date's regression."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[[y, *controls]].to_numpy(float)
        values = values[np.isfinite(values).all(axis=1)]
        if len(values) < len(controls) + 5:
            return pdf[[time]].iloc[:0].assign(name="", coefficient=0.0)
        x, sd = values[:, 1:], values[:, 1:].std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1.0)
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), values[:, 0], rcond=None)[0]
        return pd.DataFrame({time: [pdf[time].iloc[0]] * len(controls), "name": controls, "coefficient": beta[1:]})

    return df.select(time, y, *controls).groupBy(time).applyInPandas(solve, f"`{time}` {kinds[time]}, name string, coefficient double")


def rolling_residual(df: DataFrame, y: str, controls: list[str], window: int, out: str, least: int | None = None, ridge: float = 1e-6, entity: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """entity, time, out: y at t minus a ridge fit on the ``window`` rows before t, by running sums of each security's history."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    need = least or window

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, ignore_index=True)
        v = pdf[[y, *controls]].to_numpy(float)
        ok = np.isfinite(v).all(axis=1)
        x = np.where(ok[:, None], np.column_stack([np.ones(len(v)), v[:, 1:]]), 0.0)
        t = np.where(ok, v[:, 0], 0.0)
        k = x.shape[1]
        xx = np.concatenate([np.zeros((1, k, k)), np.cumsum(x[:, :, None] * x[:, None, :], axis=0)])
        xy = np.concatenate([np.zeros((1, k)), np.cumsum(x * t[:, None], axis=0)])
        n = np.r_[0, np.cumsum(ok)]
        end = np.arange(len(v))
        start = np.maximum(end - window, 0)
        fit = ok & (n[end] - n[start] >= need) & (end - start == window)
        res = np.full(len(v), np.nan)
        if fit.any():
            beta = np.linalg.solve(xx[end[fit]] - xx[start[fit]] + ridge * np.eye(k), (xy[end[fit]] - xy[start[fit]])[..., None])[..., 0]
            res[fit] = t[fit] - (x[fit] * beta).sum(axis=1)
        return pdf[[entity, time]].assign(**{out: pd.Series(res).astype(object).where(np.isfinite(res), None)})

    return df.select(entity, time, y, *controls).groupBy(entity).applyInPandas(solve, f"`{entity}` {kinds[entity]}, `{time}` {kinds[time]}, `{out}` double")


def regime_residual(daily: DataFrame, axes: list[str], y: str, controls: list[str], baseline: int, recent: int, out: str, least: int = 60, order: str = "trade_date") -> DataFrame:
    """axes, order, out: y of a daily series minus what its controls say by a fit on the ``baseline`` rows before the last ``recent``.

    A series with too short a baseline comes back as it is; rows that lack a control have none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in daily.schema.fields}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        v = pdf[[y, *controls]].to_numpy(float)
        usable = np.flatnonzero(np.isfinite(v).all(axis=1))
        base = usable[-(baseline + recent) : -recent] if recent else usable[-baseline:]
        res = v[:, 0].copy()
        if len(base) >= max(least, len(controls) + 2):
            design = np.column_stack([np.ones(len(v)), v[:, 1:]])
            beta = np.linalg.lstsq(design[base], v[base, 0], rcond=None)[0]
            res = np.full(len(v), np.nan)
            res[usable] = v[usable, 0] - design[usable] @ beta
        return pdf[[*axes, order]].assign(**{out: pd.Series(res).astype(object).where(np.isfinite(res), None)})

    return daily.select(*axes, order, y, *controls).groupBy(*axes).applyInPandas(solve, ", ".join(f"`{c}` {kinds[c]}" for c in (*axes, order)) + f", `{out}` double")


def neutral_score(df: DataFrame, score: str, controls: list[str], out: str, group: str = "industry_l1_code", least: int = 5, spare: int = 4, time: str = "trade_date") -> DataFrame:
    """time, ts_code, out: a score without what controls and industries explain of it, by date.

    Missing controls count as the date's median, missing industries as one of their own.
    Where a date has no more than ``spare`` rows beyond its terms, the score is only
    centred; with fewer than ``least`` rows it is missing.
    """
    day = Window.partitionBy(time)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.filter(F.col(score).isNotNull()).select(time, "ts_code", F.coalesce(F.col(group).cast("string"), F.lit("UNKNOWN")).alias("_g"), F.col(score).cast("double").alias("_y"), *(F.coalesce(F.col(c), F.median(c).over(day)).cast("double").alias(c) for c in controls))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["_y"].to_numpy(float), pdf[controls].to_numpy(float)
        res = np.full(len(y), np.nan)
        if len(y) >= least:
            sd = x.std(axis=0)
            z = np.nan_to_num((x - x.mean(axis=0)) / np.where(sd > 0, sd, np.nan))
            dummies = pd.get_dummies(pdf["_g"], drop_first=True, dtype=float).to_numpy()
            design = np.column_stack([np.ones(len(y)), z, dummies])
            res = y - y.mean() if len(y) <= design.shape[1] + spare else y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        return pdf[[time, "ts_code"]].assign(**{out: pd.Series(res, index=pdf.index).astype(object).where(np.isfinite(res), None)})

    return rows.groupBy(time).applyInPandas(solve, f"`{time}` {kinds[time]}, ts_code {kinds['ts_code']}, `{out}` double")
