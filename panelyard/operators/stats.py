"""Evaluation statistics: information coefficients, quantile returns, long-run variances, multiple tests."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


def forward_open_return(horizon: int, price: str = "adj_open") -> Column:
    """Return from the next row's open to the open ``horizon`` rows later: known at a close, entered at the next open."""
    w = frames.history()
    return frames.safe_ratio(F.lead(price, horizon + 1).over(w), F.lead(price, 1).over(w)) - 1


def forward_targets(panel: DataFrame, horizon: int, group: str = "industry_l1_code") -> DataFrame:
    """``panel`` with stock_return and stock_minus_peers (leave-one-out mean of the date's group)."""
    out = panel.withColumn("stock_return", forward_open_return(horizon))
    s = Window.partitionBy("trade_date", group)
    peers = F.when(F.col(group).isNotNull(), frames.leave_one_out(F.col("stock_return"), s))
    return out.withColumn("stock_minus_peers", F.col("stock_return") - peers)


def daily_ic(rows: DataFrame, factor: str = "factor_value", target: str = "stock_return", axes: Iterable[str] = (), method: str = "spearman", least: int = 3) -> DataFrame:
    """axes, trade_date, ic, n: correlation of factor and target over the pairs of a date; Spearman ranks pairs only.

    Rounded to twelve places, so that no correlation is no sign.
    """
    axes = list(axes)
    pairs = rows.filter(F.col(factor).isNotNull() & F.col(target).isNotNull()).select(*axes, "trade_date", F.col(factor).alias("_x"), F.col(target).alias("_y"))
    if method == "spearman":
        pairs = pairs.withColumns({f"{c}r": frames.pct_rank(F.col(c), *axes) for c in ("_x", "_y")})
        x, y = F.col("_xr"), F.col("_yr")
    else:
        x, y = F.col("_x"), F.col("_y")
    return pairs.groupBy(*axes, "trade_date").agg(F.count("*").alias("n"), F.round(frames.correlation(x, y), 12).alias("ic")).select(*axes, "trade_date", "n", F.when(F.col("n") >= least, F.col("ic")).alias("ic"))


def _rank_sums(known: np.ndarray, codes: np.ndarray, pairs: list[tuple[int, int]]) -> list[float]:
    """Rows with both, sums of the first side's ranks, of both sides' squares and of their product, for each pair of columns.

    known, codes: of each column which rows have a value and the values' ordinals; ranks of a pair count rows with both only.
    """

    def ranks(own: np.ndarray) -> np.ndarray:
        ties = np.bincount(own)
        return (np.cumsum(ties) - (ties - 1) / 2)[own]

    out = []
    for i, j in pairs:
        both = known[i] & known[j]
        a, b = ranks(codes[i][both]), ranks(codes[j][both])
        out += [float(len(a)), a.sum(), a @ a, b @ b, a @ b]
    return out


def rank_correlations(wide: DataFrame, pairs: list[tuple[str, str]], by: list[str], least: int = 3, slices: Mapping[str, str] | None = None) -> DataFrame:
    """by, ``values_<column>`` (rows with one) and, for the i-th pair of columns, ``n<i>`` (rows with both) and ``r<i>``: their Spearman correlation in groups with ``least`` of them.

    Ranks of a pair count only rows where both sides have a value.  The group's rows are
    shuffled once, as they are; a column's values are sorted once, and each pair's ranks
    are running counts of their ordinals.  A group (a date's section) is held as Arrow
    columns, some 20 bytes a value.  Ranks are halves of whole numbers, so the sums of
    their products are exact in any order up to some 190,000 rows a group.

    ``slices`` (boolean columns by name) give a group one row for each of them, named in
    ``slice``, of the rows where it is true: a row in several slices moves and is sorted once.
    """
    own = list(dict.fromkeys(c for p in pairs for c in p))
    at = [(own.index(a), own.index(b)) for a, b in pairs]
    sums = [f"{s}{i}" for i in range(len(pairs)) for s in ("_n", "_s", "_aa", "_bb", "_ab")]
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema.fields}
    names = by if slices is None else [*by, "slice"]
    kinds["slice"] = "string"
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), *(f"`values_{c}` long" for c in own), *(f"{c} double" for c in sums)])

    def group_sums(key: tuple, rows: pa.Table) -> pa.Table:
        known, codes = np.zeros((len(own), len(rows)), bool), np.zeros((len(own), len(rows)), np.int32)
        for k, c in enumerate(own):
            known[k] = rows.column(c).is_valid().to_numpy()
            codes[k][known[k]] = np.unique(rows.column(c).drop_null().to_numpy(), return_inverse=True)[1]
        inside = {None: slice(None)} if slices is None else {n: rows.column(c).to_numpy() for n, c in slices.items()}
        made = [(n, known[:, m], codes[:, m]) for n, m in inside.items()]
        head = [pa.array([k.as_py()] * len(made), rows.schema.field(c).type) for k, c in zip(key, by)]
        head += [] if slices is None else [pa.array([n for n, *_ in made], pa.string())]
        values = np.array([own_known.sum(axis=1) for _, own_known, _ in made], np.int64).T
        return pa.table([*head, *(pa.array(v) for v in values), *(pa.array(v) for v in np.array([_rank_sums(k, c, at) for _, k, c in made], float).T)], names=[*names, *(f"values_{c}" for c in own), *sums])

    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (slices or {}).values()]
    group = wide.select(*by, *flags, *(F.col(c).cast("double").alias(c) for c in own)).groupBy(*by).applyInArrow(group_sums, schema)
    group = group.withColumns({f"n{i}": F.col(f"_n{i}").cast("long") for i in range(len(pairs))})

    def r(i: int) -> Column:
        n, square = F.col(f"n{i}"), F.col(f"_s{i}") * F.col(f"_s{i}")  # both sides' ranks have one sum
        top, a, b = n * F.col(f"_ab{i}") - square, n * F.col(f"_aa{i}") - square, n * F.col(f"_bb{i}") - square
        return F.when((n >= least) & (a > 0) & (b > 0), top / F.sqrt(a) / F.sqrt(b))

    return group.select(*names, *(f"values_{c}" for c in own), *(c for i in range(len(pairs)) for c in (F.col(f"n{i}"), r(i).alias(f"r{i}"))))


def ic_summary(ic: DataFrame, axes: Iterable[str] = ()) -> DataFrame:
    """Mean, sample deviation, annual ratio, share of positive days and t of each series."""
    v = F.col("ic")
    out = ic.groupBy(*axes).agg(F.count(v).alias("days"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.avg((v > 0).cast("double")).alias("positive_ratio"))
    enough = F.col("days") >= 2
    ratio = frames.safe_ratio(F.col("mean"), F.col("std"))
    cols = {"mean": F.when(enough, F.col("mean")), "std": F.when(enough, F.col("std")), "positive_ratio": F.when(enough, F.col("positive_ratio"))}
    return out.withColumns(cols).withColumn("icir", ratio * math.sqrt(252)).withColumn("t_value", ratio * F.sqrt("days"))


def newey_west(values, lags: int | None, kernel: str = "bartlett", least: int = 2, truncate: bool = True, floor: float = 0.0) -> tuple[float | None, float | None]:
    """Mean and t of a series under a long-run variance.

    kernel "bartlett" weights lag k by 1 - k / (L + 1), where L is ``lags`` cut to the
    series if ``truncate`` and as given otherwise; "flat" gives every lag weight one.
    Without ``lags`` they follow from the length.
    """
    x = pd.Series(values, dtype="float64").dropna().to_numpy()
    n = len(x)
    if n < max(least, 1):
        return None, None
    given = int(4 * (n / 100) ** (2 / 9)) if lags is None else max(int(lags), 0)
    used = min(given, n - 1)
    d = x - x.mean()
    variance = d @ d / n
    for k in range(1, used + 1):
        share = 1.0 if kernel == "flat" else 1 - k / ((used if truncate else given) + 1)
        variance += 2 * share * (d[k:] @ d[:-k] / (n - k if kernel == "flat" else n))
    variance = max(variance, floor)
    return float(x.mean()), float(x.mean() / math.sqrt(variance / n)) if variance > 0 else None


#: The variants in use, by their settings.
NEWEY_WEST = {
    "l1": dict(kernel="bartlett", least=2),
    "auto": dict(lags=None, kernel="bartlett", least=3),
    "flat": dict(kernel="flat", least=3, floor=1e-12),
    "rotation": dict(kernel="bartlett", least=3),
    "untruncated": dict(kernel="bartlett", least=2, truncate=False),
}


def newey_west_sums(ic: DataFrame, axes: list[str], lags: int | None, value: str = "ic", order: str = "trade_date", kernel: str = "bartlett", least: int = 2, truncate: bool = True, floor: float = 0.0, most: int = 12) -> DataFrame:
    """axes, n, mean, nw_t of many series at once: sums of lagged products, no series leaves the cluster.

    The variants of ``newey_west``: a flat kernel divides lag k by n - k; without
    ``lags`` they follow from a series' length, up to ``most`` (some 14,000 values).
    """
    clean = ic.filter(F.col(value).isNotNull())
    d = clean.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*axes)))
    w = Window.partitionBy(*axes).orderBy(order)
    top = most if lags is None else lags
    d = d.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(top + 1)})
    s = d.groupBy(*axes).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *(F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(top + 1)))
    n = F.col("n")
    given = F.lit(lags) if lags is not None else F.least(F.floor(4 * F.pow(n / 100, F.lit(2 / 9))), F.lit(most))
    used = F.least(given, n - 1)
    share = lambda k: F.lit(1.0) if kernel == "flat" else 1 - k / ((used if truncate else given) + 1)
    over = lambda k: n - k if kernel == "flat" else n
    variance = F.col("_s0") / n + sum((F.when(F.lit(k) <= used, 2 * share(k) * F.col(f"_s{k}") / over(k)).otherwise(0.0) for k in range(1, top + 1)), F.lit(0.0))
    t = frames.safe_ratio(F.col("mean"), F.sqrt(F.greatest(variance, F.lit(floor)) / n))
    return s.select(*axes, "n", "mean", F.when(n >= max(least, 1), t).alias("nw_t"))


def fdr(tests: DataFrame, p: str = "p_value", axes: Iterable[str] = (), clip: bool = False) -> DataFrame:
    """``tests`` with ``fdr_q``: Benjamini-Hochberg over the tests that have a p-value (rows are tests, not panel rows)."""
    axes = list(axes) or [F.lit(0)]
    has = Window.partitionBy(*axes, F.col(p).isNotNull())
    rank = F.row_number().over(has.orderBy(p))
    ranked = tests.withColumn("_q", F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(has) / rank))
    running = F.min("_q").over(has.orderBy(F.col(p).desc(), F.col("_q").desc()).rowsBetween(Window.unboundedPreceding, 0))
    q = F.least(running, F.lit(1.0))
    return ranked.withColumn("fdr_q", F.when(F.col(p).isNotNull(), q)).drop("_q")


def quantile_returns(rows: DataFrame, factor: str, target: str, groups: int = 10) -> DataFrame:
    """quantile, mean_return, days: mean of the daily means of buckets by rank, ties in order of ts_code; thin days take five buckets or none."""
    pairs = rows.filter(F.col(factor).isNotNull() & F.col(target).isNotNull()).select("trade_date", "ts_code", F.col(factor).alias("_x"), F.col(target).alias("_y"))
    d = Window.partitionBy("trade_date")
    n, r = F.count("*").over(d), F.row_number().over(d.orderBy("_x", "ts_code"))
    ranked = pairs.withColumn("_n", n).withColumn("_r", r)
    few = min(groups, 5)
    thin = F.col("_n") < groups * 10
    bucket = F.when(thin, frames.quantile_bucket(F.col("_r"), F.col("_n"), few)).otherwise(frames.quantile_bucket(F.col("_r"), F.col("_n"), groups))
    enough = F.col("_n") >= F.when(thin, few * 2).otherwise(groups * 2)
    daily = ranked.filter(enough).withColumn("quantile", bucket).groupBy("trade_date", "quantile").agg(F.avg("_y").alias("_m"))
    return daily.groupBy("quantile").agg(F.avg("_m").alias("mean_return"), F.count("*").alias("days"))


def condition_bucket(rank: Column, values: Column, groups: int) -> Column:
    """Bucket 1..groups from a percent rank, on dates with enough values."""
    return F.when(values >= groups, F.least(F.greatest(F.ceil(rank * groups), F.lit(1)), F.lit(groups)))


def block_bootstrap(series: DataFrame, axes: list[str], value: str, order: str, block: int = 20, draws: int = 1000, seed: int = 20240101) -> DataFrame:
    """axes, mean, low, high: 95 % interval of each series' mean from moving blocks at starts that a hash names.

    A resample is as long as the series: its last block is cut.  Sums of blocks are
    differences of running sums, so a draw joins as many of them as it has blocks.
    """
    w = Window.partitionBy(*axes).orderBy(order)
    x = series.filter(F.col(value).isNotNull()).select(*axes, order, F.col(value).cast("double").alias("_x"))
    sums = x.select(*axes, F.row_number().over(w).alias("_at"), F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    whole = x.groupBy(*axes).agg(F.count("*").alias("_n"), F.avg("_x").alias("mean")).withColumn("_size", F.least(F.lit(block), F.col("_n").cast("int")))
    parts = F.ceil(F.col("_n") / F.col("_size")).cast("int")
    drawn = whole.filter("_n >= 2").withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0), parts - 1)))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_draw", "_k").cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = drawn.withColumn("_start", F.pmod(h, F.col("_n") - F.col("_size") + 1).cast("int"))
    drawn = drawn.withColumn("_end", F.col("_start") + F.least(F.col("_size"), F.col("_n") - F.col("_k") * F.col("_size")).cast("int"))
    ends = drawn.select(*axes, "_n", "_draw", F.explode(F.array(F.struct(F.col("_start").alias("_at"), F.lit(-1.0).alias("_sign")), F.struct(F.col("_end").alias("_at"), F.lit(1.0).alias("_sign")))).alias("e")).select(*axes, "_n", "_draw", "e.*").filter("_at > 0")
    means = ends.join(sums, [*axes, "_at"]).groupBy(*axes, "_draw").agg((F.sum(F.col("_sign") * F.col("_sum")) / F.first("_n")).alias("_m"))
    bounds = means.groupBy(*axes).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    return whole.join(bounds, axes, "left").select(*axes, "mean", "low", "high")
