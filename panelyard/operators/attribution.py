"""What known styles explain of a strategy's daily return: style returns, a regression with autocorrelation-robust errors, and resampled alphas.

Everything a regression needs of its rows are sums of products, so many series are
fitted at once: Spark adds up moment vectors (one row a series), and only these small
vectors are solved, in Arrow batches.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


def style_returns(panel: DataFrame, signals: list[str], universe: str, price: str = "adj_open", low: float = 1 / 3, high: float = 2 / 3, wait: int = 2) -> DataFrame:
    """trade_date and a column for each signal: mean return of what ranks from ``high`` on minus that of what ranks up to ``low``.

    The return runs from the next open to the one after, and stands at the session on
    which it is known, ``wait`` sessions after the signal's.
    """
    w, day = frames.history(), Window.partitionBy("trade_date")
    fwd = frames.safe_ratio(F.lead(price, 2).over(w), F.lead(price, 1).over(w)) - 1
    rows = panel.select("trade_date", universe, fwd.alias("_f"), *signals)
    usable = lambda s: F.when(F.coalesce(F.col(universe), F.lit(False)) & F.col("_f").isNotNull(), F.col(s))
    rows = rows.withColumns({f"_x{i}": usable(s) for i, s in enumerate(signals)})
    rows = rows.withColumns({f"_r{i}": frames.pct_rank(F.col(f"_x{i}")) for i in range(len(signals))})
    mean = lambda test: F.avg(F.when(test, F.col("_f")))
    daily = rows.groupBy("trade_date").agg(*((mean(F.col(f"_r{i}") >= high) - mean(F.col(f"_r{i}") <= low)).alias(s) for i, s in enumerate(signals)))
    calendar = Window.orderBy("trade_date")  # one row a session
    return daily.withColumn("trade_date", F.lead("trade_date", wait).over(calendar)).filter("trade_date is not null")


def _inverse(flat: pd.Series) -> pd.Series:
    """Inverse of each symmetric matrix, given and returned row by row; missing where it has none."""

    def one(values):
        size = int(np.sqrt(len(values))) if values is not None else 0
        m = np.array(values if size else [[np.nan]], float).reshape(max(size, 1), -1)
        if not np.isfinite(m).all() or np.linalg.matrix_rank(m) < len(m):
            return None
        return np.linalg.inv(m).ravel().tolist()

    return flat.map(one)


def _moments(names: list[str], y: str) -> dict[str, Column]:
    """Products whose sums make up a least-squares fit of ``y`` on ``names``, the first of which is the constant."""
    return {f"_m{i}_{j}": F.col(names[i]) * F.col(names[j]) for i, j in combinations_with_replacement(range(len(names)), 2)} | {f"_v{i}": F.col(n) * F.col(y) for i, n in enumerate(names)}


def _solved(sums: DataFrame, size: int) -> DataFrame:
    """``sums`` with _inv (inverse of the moment matrix, row by row) and _b (coefficients)."""
    inverse = F.pandas_udf(_inverse, "array<double>")
    at = lambda i, j: F.col(f"_m{min(i, j)}_{max(i, j)}")
    out = sums.withColumn("_inv", inverse(F.array(*(at(i, j) for i in range(size) for j in range(size)))))
    return out.withColumn("_b", F.when(F.col("_inv").isNotNull(), F.array(*(sum((F.get("_inv", i * size + j) * F.col(f"_v{j}") for j in range(size)), F.lit(0.0)) for i in range(size)))))


def hac_regression(daily: DataFrame, axes: list[str], y: str, controls: list[str], lags: int, order: str = "trade_date", least: int | None = None) -> DataFrame:
    """axes, term, n_obs, r_squared, coefficient, std_error, t_value of each term (``alpha`` and the controls) of each series' regression.

    The errors' covariance is the sandwich of the inverse moment matrix and the lagged
    outer products of the scores x u, weighted by 1 - lag / (lags + 1).  Rows that lack
    a value take no part; a series without enough rows or with dependent controls gives
    missing values.
    """
    names, size = ["_c", *controls], len(controls) + 1
    rows = daily.filter(" and ".join(f"`{c}` is not null" for c in (y, *controls))).select(*axes, order, y, *controls).withColumn("_c", F.lit(1.0))
    products = _moments(names, y)
    sums = rows.withColumns(products).groupBy(*axes).agg(F.count("*").alias("n_obs"), F.sum(F.col(y) * F.col(y)).alias("_yy"), *(F.sum(c).alias(c) for c in products))
    fit = _solved(sums, size)
    d = rows.join(fit.select(*axes, "_b"), axes) if axes else rows.crossJoin(F.broadcast(fit.select("_b")))  # one row
    d = d.withColumn("_u", F.col(y) - sum((F.get("_b", i) * F.col(n) for i, n in enumerate(names)), F.lit(0.0)))
    d = d.withColumns({f"_g{i}": F.col(n) * F.col("_u") for i, n in enumerate(names)})
    w = Window.partitionBy(*axes).orderBy(order)
    lagged = d.withColumns({f"_g{i}_{k}": F.lag(f"_g{i}", k).over(w) for i in range(size) for k in range(1, lags + 1)})

    def meat(i: int, j: int) -> Column:
        own = F.col(f"_g{i}") * F.col(f"_g{j}")
        return own + sum(((1 - k / (lags + 1)) * (F.coalesce(F.col(f"_g{i}") * F.col(f"_g{j}_{k}") + F.col(f"_g{i}_{k}") * F.col(f"_g{j}"), F.lit(0.0))) for k in range(1, lags + 1)), F.lit(0.0))

    s = lagged.groupBy(*axes).agg(F.sum(F.col("_u") * F.col("_u")).alias("_uu"), *(F.sum(meat(i, j)).alias(f"_s{i}_{j}") for i, j in combinations_with_replacement(range(size), 2)))
    both = fit.join(s, axes) if axes else fit.crossJoin(F.broadcast(s))  # one row each
    inv = lambda i, j: F.get("_inv", i * size + j)
    mid = lambda i, j: F.col(f"_s{min(i, j)}_{max(i, j)}")
    variance = lambda t: sum((inv(t, i) * mid(i, j) * inv(j, t) for i in range(size) for j in range(size)), F.lit(0.0))
    total = F.col("_yy") - F.col("_v0") * F.col("_v0") / F.col("n_obs")
    out = both.withColumn("r_squared", 1 - frames.safe_ratio(F.col("_uu"), total))
    terms = F.array(*(F.struct(F.lit(n).alias("term"), F.get("_b", i).alias("coefficient"), F.sqrt(F.greatest(variance(i), F.lit(0.0))).alias("std_error")) for i, n in enumerate(["alpha", *controls])))
    enough = F.col("n_obs") >= (least or size + 1)
    out = out.select(*axes, "n_obs", F.when(enough, F.col("r_squared")).alias("r_squared"), F.explode(terms).alias("_t")).select(*axes, "_t.term", "n_obs", "r_squared", *(F.when(enough, F.col(f"_t.{c}")).alias(c) for c in ("coefficient", "std_error")))
    return out.withColumn("t_value", frames.safe_ratio(F.col("coefficient"), F.col("std_error")))


def bootstrap_alpha(daily: DataFrame, axes: list[str], y: str, controls: list[str], block: int, draws: int = 1000, seed: int = 42, order: str = "trade_date", least: int = 10) -> DataFrame:
    """axes, alpha_low, alpha_high, draws: the middle 95 % of the regression's constant over moving-block resamples of each series.

    A resample is as many blocks of ``block`` rows as the series holds, at starts that a
    hash of seed, draw and place gives.  The sums of a block's products are a running
    frame, so a draw adds up as many vectors as it has blocks, and no rows are copied.
    """
    names, size = ["_c", *controls], len(controls) + 1
    rows = daily.filter(" and ".join(f"`{c}` is not null" for c in (y, *controls))).select(*axes, order, y, *controls).withColumn("_c", F.lit(1.0))
    products, w = _moments(names, y), Window.partitionBy(*axes).orderBy(order)
    ahead = w.rowsBetween(0, block - 1)
    blocks = rows.withColumns(products).select(*axes, (F.row_number().over(w) - 1).alias("_at"), *(F.sum(c).over(ahead).alias(c) for c in products))
    sizes = rows.groupBy(*axes).agg(F.count("*").alias("_n")).filter(F.col("_n") > block + 1)
    drawn = sizes.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("_n") / block), F.lit(1)).cast("int") - 1)))
    drawn = drawn.select(*axes, "_draw", F.pmod(_hash(F.lit(seed), "_draw", "_k"), F.col("_n") - block).cast("int").alias("_at"))
    sums = drawn.join(blocks, [*axes, "_at"]).groupBy(*axes, "_draw").agg(*(F.sum(c).alias(c) for c in products))
    alphas = _solved(sums, size).select(*axes, F.get("_b", F.lit(0)).alias("_a"))
    ends = alphas.groupBy(*axes).agg(F.count("_a").alias("draws"), F.percentile("_a", 0.025).alias("_low"), F.percentile("_a", 0.975).alias("_high"))
    return ends.select(*axes, "draws", *(F.when(F.col("draws") >= least, F.col(f"_{c}")).alias(f"alpha_{c}") for c in ("low", "high")))


def _hash(*parts) -> Column:
    """A whole number from 0 to 2^32 - 1 of the parts: the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(p) if isinstance(p, str) else p for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")
