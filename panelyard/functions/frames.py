"""Column builders over a panel: windows of one security in time, and cross-sections of one date.

Every builder skips missing values (NULL; scans turn NaN into NULL) and spans rows:
a row without a value takes a place in a window.  ``full`` windows give NULL until
they hold as many values as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ENTITY, TIME = "ts_code", "trade_date"


def history(entity: str = ENTITY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(time)


def section(*by: str, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(time, *by)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values have one spelling inside the engine: NULL."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def finite(x: Column) -> Column:
    """``x``, or NULL where it is infinite or NaN."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(x: Column, y: Column) -> Column:
    """x / y with the limits of floating point: a non-zero value over zero is infinite, 0 / 0 is missing."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y != 0, F.try_divide(x, y)).when((y == 0) & (x > 0), F.lit(float("inf"))).when((y == 0) & (x < 0), F.lit(float("-inf")))


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, missing where y is zero."""
    return F.try_divide(x.cast("double"), F.nullif(y.cast("double"), F.lit(0.0)))


def shown(x: Column) -> Column:
    """``x`` to six places, as results are compared; the nudge keeps exact halves on one side in every engine."""
    return F.round(x.cast("double") + 1e-9, 6)


def rolling(x: Column, size: int, kind: str = "mean", least: int | None = None, shift: int = 0, ddof: int = 0, w: WindowSpec | None = None) -> Column:
    """mean, std, sum, max, min, median or product of the ``size`` rows that end ``shift`` rows ago, if ``least`` of them have a value."""
    frame = (w or history()).rowsBetween(-(size - 1 + shift), -shift)
    by = {
        "mean": F.avg(x), "sum": F.sum(x), "max": F.max(x), "min": F.min(x), "median": F.percentile(x, 0.5), "product": F.product(x),
        "std": F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x), "count": F.count(x),
    }
    return F.when(F.count(x).over(frame) >= (size if least is None else least), by[kind].over(frame))


def rolling_quantile(x: Column, size: int, q: float, least: int, shift: int = 1, w: WindowSpec | None = None) -> Column:
    frame = (w or history()).rowsBetween(-(size - 1 + shift), -shift)
    return F.when(F.count(x).over(frame) >= least, F.percentile(x, q).over(frame))


def slope(x: Column, ordinal: Column, size: int, w: WindowSpec | None = None) -> Column:
    """Least-squares slope of ``x`` on the row's ordinal over a full window."""
    frame = (w or history()).rowsBetween(1 - size, 0)
    return F.when(F.count(x).over(frame) >= size, F.regr_slope(x, ordinal).over(frame))


def rolling_corr(x: Column, y: Column, size: int, least: int, w: WindowSpec | None = None) -> Column:
    frame = (w or history()).rowsBetween(1 - size, 0)
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    a, b = F.when(both == 1, x), F.when(both == 1, y)
    spread = F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)
    return F.when(F.count(both).over(frame) >= least, safe_ratio(F.covar_pop(a, b).over(frame), spread))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over complete pairs; missing where a side does not vary."""
    return safe_ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a window that is named several times is computed as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _share(seen: Column, x: Column, least: int, less: float, same: float, plus: float = 0.0) -> Column:
    """Share of the values ``seen`` that lie below ``x``, those below and equal to it weighing ``less`` and ``same``."""

    def of(values: Column) -> Column:
        total = F.aggregate(values, F.lit(plus), lambda a, z: a + F.when(z < x, less).when(z == x, same).otherwise(0.0))
        return F.when(x.isNotNull() & (F.size(values) >= least), total / F.size(values))

    return once(seen, of)


def prior_percentile(x: Column, size: int, least: int, w: WindowSpec | None = None) -> Column:
    """Mid-rank share of ``x`` among the values of the ``size`` rows before it."""
    return _share(F.collect_list(x).over((w or history()).rowsBetween(-size, -1)), x, least, 1.0, 0.5)


def trailing_rank(x: Column, size: int, least: int, w: WindowSpec | None = None) -> Column:
    """Average-tie percent rank of ``x`` among the last ``size`` rows, itself included."""
    return _share(F.collect_list(x).over((w or history()).rowsBetween(1 - size, 0)), x, least, 1.0, 0.5, 0.5)


def trailing_share(x: Column, size: int, least: int, w: WindowSpec | None = None) -> Column:
    """Share of the values of the last ``size`` rows, this one included, that are at most ``x``."""
    return _share(F.collect_list(x).over((w or history()).rowsBetween(1 - size, 0)), x, least, 1.0, 1.0)


def forward(x: Column, size: int, kind: str = "max", w: WindowSpec | None = None) -> Column:
    """max, min or mean of the next ``size`` rows, if all have a value."""
    frame = (w or history()).rowsBetween(1, size)
    return F.when(F.count(x).over(frame) >= size, {"max": F.max, "min": F.min, "mean": F.avg}[kind](x).over(frame))


def compound(r: Column, size: int, w: WindowSpec | None = None) -> Column:
    """Compound return of ``size`` rows, from logarithms floored just above a total loss."""
    frame = (w or history()).rowsBetween(1 - size, 0)
    return F.when(F.count(r).over(frame) >= size, F.expm1(F.sum(F.log1p(F.greatest(r, F.lit(-0.999999)))).over(frame)))


def true_range(high: Column, low: Column, previous: Column, strict: bool) -> Column:
    """Largest of the day's range and its gaps; ``strict`` is missing without a previous close, else gaps are skipped."""
    widest = F.greatest(high - low, F.abs(high - previous), F.abs(low - previous))
    return F.when(previous.isNotNull(), widest) if strict else widest


def run_length(flag: Column, island: Column, w: WindowSpec) -> Column:
    """Rows in the current run of true ``flag``; ``island`` counts the false rows so far."""
    return F.when(flag, F.sum(flag.cast("int")).over(w)).otherwise(0)


# Cross-sections


def pct_rank(x: Column, *by: str, time: str = TIME) -> Column:
    """Average-tie rank over the number of values of the date (and group); ``x`` is a column of the frame."""
    ordered = section(*by, time=time).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(Window.partitionBy(time, *by, x))
    return F.when(x.isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2) / F.count(x).over(section(*by, time=time)))


def zscore(x: Column, *by: str, time: str = TIME) -> Column:
    """Population z-score within the date (and group); missing where nothing varies."""
    s = section(*by, time=time)
    return safe_ratio(x - F.avg(x).over(s), F.stddev_pop(x).over(s))


def large_group(result: Column, x: Column, by: str, least: int, time: str = TIME) -> Column:
    """``result`` only in named groups with ``least`` values or more."""
    return F.when(F.col(by).isNotNull() & (F.count(x).over(section(by, time=time)) >= least), result)


def leave_one_out(x: Column, s: WindowSpec) -> Column:
    """Mean of the others of the group."""
    return safe_ratio(F.coalesce(F.sum(x).over(s), F.lit(0.0)) - x, F.count(x).over(s) - 1)


def winsorize_mad(df: DataFrame, columns: str | Sequence[str], scale: float = 5.0, time: str = TIME) -> DataFrame:
    """Clips each of ``columns`` to the date's median plus or minus ``scale`` median absolute deviations (plain, not normalised); no spread, no clip."""
    d = section(time=time)
    names = [columns] if isinstance(columns, str) else list(columns)
    df = df.withColumns({f"_median{i}": F.median(c).over(d) for i, c in enumerate(names)})
    df = df.withColumns({f"_mad{i}": F.median(F.abs(F.col(c) - F.col(f"_median{i}"))).over(d) for i, c in enumerate(names)})

    def clipped(c: str, median: Column, mad: Column) -> Column:
        held = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), median - scale * mad), median + scale * mad))
        return F.when(mad > 0, held).otherwise(F.col(c))

    made = {c: clipped(c, F.col(f"_median{i}"), F.col(f"_mad{i}")) for i, c in enumerate(names)}
    return df.withColumns(made).drop(*(f"{kind}{i}" for kind in ("_median", "_mad") for i in range(len(names))))


def quantile_bucket(rank: Column, n: Column, q: int) -> Column:
    """Bucket 1..q of the ``rank``-th of ``n`` distinct ordered values: linear quantile edges, right-closed."""
    bucket = F.lit(1)
    for k in range(1, q):
        share = (k * (1.0 / q)) * 100 / 100
        x = (n - 1) * F.lit(share)
        low = F.floor(x) + 1
        high, part = F.least(low + 1, n), x - F.floor(x)
        edge = F.when(part < 0.5, low + (high - low) * part).otherwise(high - (high - low) * (1 - part))
        bucket = bucket + (edge < rank).cast("int")
    return bucket
