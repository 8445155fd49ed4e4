"""Factor combination: each component normalized by date, signed, weighted; filters exclude or subtract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


@dataclass(frozen=True)
class Component:
    column: str
    weight: float = 1.0
    direction: str = "positive"


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str  # gt, gte, lt, lte
    value: float
    action: str = "exclude"  # or "penalize"
    penalty: float = 0.0


def normalize(df: DataFrame, column: str, out: str, scope: Column | None = None, winsor: tuple[float, float] | None = None, method: str = "cs_zscore", least: int = 10, time: str = "trade_date") -> DataFrame:
    """``df`` with the column clipped to the date's percentiles and then z-scored, ranked or percent-ranked, on dates with ``least`` values."""
    day = Window.partitionBy(time)
    df = df.withColumn(out, F.when(scope, F.col(column)) if scope is not None else F.col(column))
    if winsor:
        low, high = F.percentile(out, winsor[0]).over(day), F.percentile(out, winsor[1]).over(day)
        df = df.withColumn(out, F.when(F.col(out).isNotNull(), F.least(F.greatest(F.col(out), low), high)))
    n = F.count(out).over(day)
    x = F.col(out)
    value = {"cs_zscore": lambda: frames.zscore(x, time=time), "cs_percentile": lambda: frames.pct_rank(x, time=time), "cs_rank": lambda: frames.pct_rank(x, time=time) * n}[method]()
    return df.withColumn(out, F.when(n >= least, value))


def combine(df: DataFrame, components: list[Component], missing: str = "intersection", minimum: int = 1, fill: float = 0.0, equal: bool = False, normalize_weights: bool = True, out: str = "factor_value") -> DataFrame:
    """``df`` with the weighted score of normalized component columns; what counts as missing is a parameter."""
    signed = [(-F.col(c.column) if c.direction == "negative" else F.col(c.column), F.lit(1.0 if equal else float(c.weight))) for c in components]
    valid = sum((x.isNotNull().cast("int") for x, _ in signed), F.lit(0))
    weight = [F.when(x.isNotNull(), w).otherwise(0.0) for x, w in signed]
    total = sum((F.coalesce(x, F.lit(fill)) * w for (x, _), w in zip(signed, weight)), F.lit(0.0))
    if equal or normalize_weights:
        total = frames.safe_ratio(total, sum((F.abs(w) for w in weight), F.lit(0.0)))
    needed = {"intersection": len(components), "require_minimum_components": min(minimum, len(components)), "zero_fill": 0}[missing]
    return df.withColumn(out, F.when(valid >= needed, total))


def apply_filters(df: DataFrame, filters: list[Filter], out: str = "factor_value") -> DataFrame:
    for f in filters:
        hit = F.coalesce({"gt": F.col(f.column) > f.value, "gte": F.col(f.column) >= f.value, "lt": F.col(f.column) < f.value, "lte": F.col(f.column) <= f.value}[f.operator], F.lit(False))
        df = df.withColumn(out, F.when(~hit, F.col(out)) if f.action == "exclude" else F.when(hit, F.col(out) - f.penalty).otherwise(F.col(out)))
    return df


def leave_one_out(df: DataFrame, components: list[Component], **params) -> DataFrame:
    """``df`` with one score column ``without_<component>`` for each component left out (eight components at most)."""
    if len(components) > 8:
        raise ValueError("leave-one-out takes eight components at most")
    for c in components:
        df = combine(df, [x for x in components if x != c], out=f"without_{c.column}", **params)
    return df


def top_overlap(df: DataFrame, a: str, b: str, n: int, time: str = "trade_date") -> DataFrame:
    """time, jaccard: of the top ``n`` codes of two scores."""
    rank = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy(time).orderBy(F.col(c).desc_nulls_last(), "ts_code")))
    flags = df.withColumn("_a", F.coalesce(rank(a) <= n, F.lit(False))).withColumn("_b", F.coalesce(rank(b) <= n, F.lit(False)))
    both, either = F.sum((F.col("_a") & F.col("_b")).cast("int")), F.sum((F.col("_a") | F.col("_b")).cast("int"))
    return flags.groupBy(time).agg(F.try_divide(both.cast("double"), F.nullif(either, F.lit(0))).alias("jaccard"))
