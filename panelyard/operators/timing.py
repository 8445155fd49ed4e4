"""Market timing: features of a single series, option pricing, positions, and a causal hidden Markov filter."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


def parse_date(c: Column) -> Column:
    """yyyyMMdd, yyyyMM (its first day) or ISO text as a date; anything else is missing."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")).when(t.rlike(r"^\d{6}$"), F.try_to_date(F.concat(t, F.lit("01")), "yyyyMMdd")).otherwise(F.try_to_date(t))


def number(c: Column) -> Column:
    """The value as a double; text that is no number, infinities and NaN are missing."""
    return frames.finite(c.try_cast("double"))


def first_existing(df: DataFrame, names: list[str]) -> Column:
    """The first of the candidate columns that the frame has, by any case."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n in df.columns or n.lower() in have:
            return F.col(n if n in df.columns else have[n.lower()])
    raise KeyError(f"none of {names} in {df.columns}")


def mad_z(df: DataFrame, column: str, size: int, least: int, out: str, w=None) -> DataFrame:
    """0.67448975 (x - median) / MAD over trailing windows; the deviations are from each row's own median."""
    w = w or Window.orderBy("trade_date")
    d = df.withColumn("_m", frames.rolling(F.col(column), size, "median", least, w=w)).withColumn("_d", F.abs(F.col(column) - F.col("_m")))
    d = d.withColumn("_mad", frames.rolling(F.col("_d"), size, "median", least, w=w))
    return d.withColumn(out, 0.67448975 * frames.safe_ratio(F.col(column) - F.col("_m"), F.col("_mad"))).drop("_m", "_d", "_mad")


def with_ewm(df: DataFrame, columns: dict[str, str], alpha: float, least: int = 1, entity: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """``df`` with recursive exponential means ``columns`` (out -> column); a missing value lets the past decay and adds nothing.

    y follows y = d y_before + (1 - d) x, where d = q / (q + alpha), q = (1 - alpha) ** rows
    since the value before.  With c the running sum of -ln d, y is a sum of (1 - d) x
    exp(c_then - c_now).  Rows are cut into blocks of 32 in c: within a block the sum runs
    on exponents of that size, the two blocks before add their last sums, and what lies
    further back weighs less than exp(-32) of exp(-32).  Windows of one partitioning only.
    """
    w, before = frames.history(entity, time), Window.partitionBy(entity).orderBy("_b")
    out = df.withColumn("_k", F.row_number().over(w))
    for name, column in columns.items():
        x = F.col(column).cast("double")
        last = F.last(F.when(x.isNotNull(), F.col("_k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        gap = (F.col("_k") - F.col("_last")).cast("double")
        q = F.pow(F.lit(1.0 - alpha), gap)
        first = F.col("_last").isNull()
        out = out.withColumn("_last", last)
        out = out.withColumns({"_c": F.when(x.isNotNull() & ~first, F.ln(q + alpha) - gap * math.log(max(1.0 - alpha, 1e-300))).otherwise(0.0), "_a": F.when(first, 1.0).otherwise(alpha / (q + alpha))})
        out = out.withColumns({"_c": F.sum("_c").over(w), "_n": F.count(x).over(w)}).withColumn("_b", F.floor(F.col("_c") / 32))
        block = Window.partitionBy(entity, "_b").orderBy(time)
        out = out.withColumn("_c0", F.first("_c").over(block))
        out = out.withColumn("_sum", F.exp(F.col("_c0") - F.col("_c")) * F.coalesce(F.sum(F.col("_a") * x * F.exp(F.col("_c") - F.col("_c0"))).over(block), F.lit(0.0)))
        ends = {f"_e{k}": F.max(F.struct("_k", "_c", "_sum")).over(before.rangeBetween(-k, -k)) for k in (1, 2)}
        out = out.withColumns(ends)
        past = sum((F.coalesce(F.col(f"{e}._sum") * F.exp(F.col(f"{e}._c") - F.col("_c")), F.lit(0.0)) for e in ends), F.lit(0.0))
        out = out.withColumn(name, F.when(F.col("_n") >= max(least, 1), F.col("_sum") + past)).drop("_last", "_c", "_a", "_n", "_b", "_c0", "_sum", *ends)
    return out.drop("_k")


def ewm(df: DataFrame, column: str, out: str, span: float | None = None, alpha: float | None = None, least: int = 1, entity: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """entity, time, out: recursive exponential mean of one column (``with_ewm``)."""
    return with_ewm(df.select(entity, time, column), {out: column}, alpha if alpha is not None else 2 / (span + 1), least, entity, time).select(entity, time, out)


def denoised(df: DataFrame, column: str, out: str, clip: tuple[float, float] = (0.05, 0.95), window: int = 3, least: int = 2, span: float = 3, entity: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """``df`` with ``out``: the column clipped to the date's quantiles, its trailing median, and the exponential mean of that."""
    day = Window.partitionBy(time)
    low, high = (F.percentile(column, q).over(day) for q in clip)
    rows = df.withColumn("_w", F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), low), high)))
    rows = rows.withColumn("_m", frames.rolling(F.col("_w"), window, "median", least, w=frames.history(entity, time)))
    return with_ewm(rows, {out: "_m"}, 2 / (span + 1), entity=entity, time=time).drop("_w", "_m")


def _phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function by the error function's rational form; good to about 1e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x) / np.sqrt(2))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * np.exp(-x * x / 2)
    return np.where(x >= 0, (1 + erf) / 2, (1 - erf) / 2)


def option_price(spot, strike, years, rate, sigma, call):
    with np.errstate(divide="ignore", invalid="ignore"):
        s = sigma * np.sqrt(years)
        d1 = (np.log(spot / strike) + (rate + sigma**2 / 2) * years) / s
        d2 = d1 - s
        value = spot * _phi(d1) - strike * np.exp(-rate * years) * _phi(d2)
    return np.where(call, value, value - spot + strike * np.exp(-rate * years))


def _implied(price: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, call: pd.Series) -> pd.Series:
    """By bisection on [1e-4, 5], a whole batch at once; missing where no volatility gives the price."""
    p, s, k, t, r = (x.to_numpy(float) for x in (price, spot, strike, years, rate))
    c = call.fillna(False).to_numpy(bool)
    low, high = np.full(len(p), 1e-4), np.full(len(p), 5.0)
    ok = (p > 0) & (s > 0) & (k > 0) & (t > 0) & (option_price(s, k, t, r, low, c) <= p) & (p <= option_price(s, k, t, r, high, c))
    for _ in range(80):
        middle = (low + high) / 2
        over = option_price(s, k, t, r, middle, c) > p
        low, high = np.where(over, low, middle), np.where(over, middle, high)
        if np.nanmax(high - low, initial=0.0) < 1e-8:
            break
    return pd.Series((low + high) / 2).where(ok)


def implied_volatility(price: Column, spot: Column, strike: Column, years: Column, rate: Column, call: Column) -> Column:
    """The Black-Scholes volatility of an option price, by Arrow batches."""
    return F.pandas_udf(_implied, "double")(price, spot, strike, years, rate, call)


def position(score: Column, low: float, high: float) -> Column:
    """0 at or below ``low``, 1 at or above ``high``, linear between."""
    return F.when(score.isNotNull(), F.least(F.greatest((score - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def smoothed_position(df: DataFrame, column: str, out: str, step: float, entity: str, time: str = "trade_date") -> DataFrame:
    """entity, time, out: follows the target by at most ``step`` a session; a missing target holds."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, ignore_index=True)
        at, path = 0.0, []
        for target in pdf[column].astype(float):
            at += float(np.clip((target if np.isfinite(target) else at) - at, -step, step))
            path.append(at)
        return pdf[[entity, time]].assign(**{out: path})

    return df.select(entity, time, column).groupBy(entity).applyInPandas(run, f"`{entity}` {kinds[entity]}, `{time}` {kinds[time]}, `{out}` double")


def hmm_filter(series: DataFrame, value: str, entity: str, states: int = 2, fit_rows: int = 120, refit: int = 21, iterations: int = 20, time: str = "trade_date") -> DataFrame:
    """entity, time, p0.. : filtered state probabilities of a Gaussian hidden Markov chain, states in order of their means.

    The chain is fitted on the ``fit_rows`` values before each refit only, so no
    probability reads the future.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    names = [f"p{k}" for k in range(states)]

    def fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = np.quantile(x, (np.arange(states) + 0.5) / states)
        mean, var, move = edges, np.full(states, x.var() + 1e-12), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        for _ in range(iterations):
            like = np.exp(-((x[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var) + 1e-300
            a = np.zeros_like(like)
            p = np.full(states, 1 / states)
            for i in range(len(x)):
                p = (p @ move if i else p) * like[i]
                p /= p.sum()
                a[i] = p
            b = np.ones(states)
            pair, post = np.zeros((states, states)), np.zeros_like(a)
            post[-1] = a[-1]
            for i in range(len(x) - 2, -1, -1):
                joint = a[i][:, None] * move * (like[i + 1] * b)[None, :]
                joint /= joint.sum()
                pair += joint
                post[i] = joint.sum(axis=1)
                b = move @ (like[i + 1] * b)
                b /= b.sum()
            mean = (post * x[:, None]).sum(axis=0) / post.sum(axis=0)
            var = (post * (x[:, None] - mean) ** 2).sum(axis=0) / post.sum(axis=0) + 1e-8 * x.var() + 1e-12
            move = pair / pair.sum(axis=1, keepdims=True)
        order = np.argsort(mean)
        return mean[order], var[order], move[np.ix_(order, order)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(time, ignore_index=True)
        x = pdf[value].to_numpy(float)
        out = np.full((len(x), states), np.nan)
        p, model = np.full(states, 1 / states), None
        for i in range(fit_rows, len(x)):
            if (i - fit_rows) % refit == 0:
                model = fit(x[i - fit_rows : i])
            mean, var, move = model
            p = (p @ move) * (np.exp(-((x[i] - mean) ** 2) / (2 * var)) / np.sqrt(var) + 1e-300)
            p /= p.sum()
            out[i] = p
        return pdf[[entity, time]].assign(**{n: out[:, k] for k, n in enumerate(names)}).iloc[fit_rows:]

    return series.select(entity, time, value).groupBy(entity).applyInPandas(run, f"`{entity}` {kinds[entity]}, `{time}` {kinds[time]}, " + ", ".join(f"{n} double" for n in names))


def rsi(df: DataFrame, window: int = 14) -> DataFrame:
    """ts_code, trade_date, rsi: Wilder's, from recursive means of gains and losses."""
    d = df.select("ts_code", "trade_date", (F.col("adj_close") - F.lag("adj_close").over(frames.history())).alias("_d"))
    d = d.withColumns({"_up": F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), "_down": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))})
    d = with_ewm(d, {"_g": "_up", "_l": "_down"}, 1 / window, window)
    share = F.when(F.col("_g") + F.col("_l") > 0, 100 * F.col("_g") / (F.col("_g") + F.col("_l"))).when(F.col("_g").isNotNull(), 50.0)
    return d.select("ts_code", "trade_date", share.alias("rsi"))


def dataset(base: DataFrame, groups: dict[str, DataFrame], lag: int = 1, window: int = 60, least: int = 20, changes: tuple[int, ...] = (1, 5), extreme: float = 0.9, interactions: tuple[tuple[str, str], ...] = (), time: str = "trade_date") -> DataFrame:
    """``base`` (one row a session) with the features of groups of daily measures, none known before its day.

    groups: name -> frame of ``time`` and measures, joined by session.  Each measure
    comes as ``<group>__<measure>``, ``lag`` sessions late, with its robust z, its share
    in the window, its changes, flags of high and low extremes, and products of the z of
    chosen pairs.  Windows need no partition: there is one series of one row a session.
    """
    w = Window.orderBy(time)
    out, names = base, []
    for group, frame in groups.items():
        measures = [c for c in frame.columns if c != time]
        out = out.join(frame.select(time, *(F.col(c).alias(f"{group}__{c}") for c in measures)), time, "left")
        names += [f"{group}__{c}" for c in measures]
    out = out.withColumns({n: F.lag(n, lag).over(w) for n in names}) if lag else out
    for n in names:
        out = mad_z(out, n, window, least, f"{n}__z", w)
    out = out.withColumns({f"{n}__pct": frames.trailing_share(F.col(n), window, least, w) for n in names} | {f"{n}__chg{k}": F.col(n) - F.lag(n, k).over(w) for n in names for k in changes})
    out = out.withColumns({f"{n}__high": (F.col(f"{n}__pct") >= extreme).cast("int") for n in names} | {f"{n}__low": (F.col(f"{n}__pct") <= 1 - extreme).cast("int") for n in names})
    return out.withColumns({f"{a}__x__{b}": F.col(f"{a}__z") * F.col(f"{b}__z") for a, b in interactions}) if interactions else out


def known_monthly(base: DataFrame, monthly: DataFrame, known: str, values: list[str], time: str = "trade_date") -> DataFrame:
    """``base`` with the last monthly values known at each session: an as-of join on the day they became available."""
    from panelyard.operators.joins import asof

    one = F.lit(1)
    return asof(base.withColumn("_all", one), monthly.withColumn("_all", one), ["_all"], time, known, values).drop("_all")
