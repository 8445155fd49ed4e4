"""How alike the components of a combination are: by their values, by their information coefficients and by what they pick.

All pairs of components come from one pass over a wide table (a column a component),
partitioned once by date (``stats.rank_correlations``).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.operators import stats


def _long(one: DataFrame, pairs: list[tuple[str, str]], names: tuple[str, ...]) -> DataFrame:
    """component_a, component_b, ``names`` in both orders, of one row that has ``<name><i>`` for the i-th pair."""
    rows = [F.struct(F.lit(a).alias("component_a"), F.lit(b).alias("component_b"), *(F.col(f"{n}{i}").alias(n) for n in names)) for i, p in enumerate(pairs) for a, b in dict.fromkeys((p, p[::-1]))]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def value_correlation(wide: DataFrame, components: list[str], least: int = 3, time: str = "trade_date") -> DataFrame:
    """component_a, component_b, mean_daily_spearman, days for each ordered pair; a component and itself: 1, on the dates where it has ``least`` values."""
    pairs = list(combinations(components, 2))
    day = stats.rank_correlations(wide, pairs, [time], least)
    enough = lambda c: F.sum((F.col(f"values_{c}") >= least).cast("long"))
    each = [*((F.avg(f"r{i}"), F.count(f"r{i}")) for i in range(len(pairs))), *((F.lit(1.0), enough(c)) for c in components)]
    one = day.agg(*(c for i, (mean, days) in enumerate(each) for c in (mean.alias(f"mean_daily_spearman{i}"), days.alias(f"days{i}"))))
    return _long(one, [*pairs, *((c, c) for c in components)], ("mean_daily_spearman", "days"))


def ic_correlation(wide: DataFrame, components: list[str], target: str, least: int = 3, time: str = "trade_date") -> DataFrame:
    """component_a, component_b, ic_series_correlation: of the daily rank correlations with ``target``, over dates on which both have one."""
    ic = stats.rank_correlations(wide, [(c, target) for c in components], [time], least)
    pairs = [(i, j) for i in range(len(components)) for j in range(i, len(components))]
    both = lambda i, j: F.col(f"r{i}").isNotNull() & F.col(f"r{j}").isNotNull()
    one = ic.agg(*(frames.correlation(F.when(both(i, j), F.col(f"r{i}")), F.when(both(i, j), F.col(f"r{j}"))).alias(f"ic_series_correlation{k}") for k, (i, j) in enumerate(pairs)))
    return _long(one, [(components[i], components[j]) for i, j in pairs], ("ic_series_correlation",))


def top_overlap(wide: DataFrame, components: list[str], sizes: tuple[int, ...] = (2, 5, 10, 20), time: str = "trade_date", code: str = "ts_code") -> DataFrame:
    """component_a, component_b, top_n, mean_jaccard of what both pick, over dates on which both have a value; ties by ``code``."""
    each = F.array(*(F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(components)))
    long = wide.select(time, code, F.explode(each).alias("_c")).select(time, code, "_c.*").filter("_v is not null")
    place = F.row_number().over(Window.partitionBy(time, "_i").orderBy(F.desc("_v"), code))
    picked = long.withColumn("_p", place).filter(F.col("_p") <= max(sizes))  # Spark cuts each task's rows to the largest size before it shuffles them
    first = picked.groupBy(time, code).agg(*(F.min(F.when(F.col("_i") == i, F.col("_p"))).alias(f"_p{i}") for i in range(len(components))))
    pairs = list(combinations(range(len(components)), 2))
    top = lambda i, n: F.coalesce(F.col(f"_p{i}") <= n, F.lit(False))
    count = lambda test: F.sum(test.cast("long"))
    counts = [count(top(i, n)).alias(f"_t{i}_{n}") for i in range(len(components)) for n in sizes] + [count(top(i, n) & top(j, n)).alias(f"_b{k}_{n}") for k, (i, j) in enumerate(pairs) for n in sizes]
    by_day = first.groupBy(time).agg(*counts)

    def jaccard(k: int, n: int) -> Column:
        a, b, both = (F.col(f"_t{pairs[k][0]}_{n}"), F.col(f"_t{pairs[k][1]}_{n}"), F.col(f"_b{k}_{n}"))
        return F.when((a > 0) & (b > 0), both / (a + b - both))

    one = by_day.agg(*(F.avg(jaccard(k, n)).alias(f"_j{k}_{n}") for k in range(len(pairs)) for n in sizes))
    rows = [F.struct(F.lit(components[i]).alias("component_a"), F.lit(components[j]).alias("component_b"), F.lit(n).alias("top_n"), F.col(f"_j{k}_{n}").alias("mean_jaccard")) for k, (i, j) in enumerate(pairs) for n in sizes]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
