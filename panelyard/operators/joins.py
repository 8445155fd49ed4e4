"""Joins that a panel needs: checked keys, intervals, and as-of joins in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class CardinalityError(ValueError):
    """A join's keys are not what was promised."""


def assert_unique(df: DataFrame, keys: list[str], what: str = "frame") -> DataFrame:
    """``df``, after a check that no key repeats."""
    if (found := df.groupBy(*keys).count().filter("count > 1").limit(1).collect()):
        raise CardinalityError(f"{what}: {found[0].asDict()} repeats")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    if validate in ("one_to_one", "one_to_many"):
        assert_unique(left, on, "left")
    if validate in ("one_to_one", "many_to_one"):
        assert_unique(right, on, "right")
    return left.join(right, on, how)


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of one side alone, and which side."""
    sides = left.select(*on).distinct().withColumn("_l", F.lit(1)).join(right.select(*on).distinct().withColumn("_r", F.lit(1)), on, "full_outer")
    return sides.filter("_l is null or _r is null").select(*on, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side"))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], exact: bool = True, tolerance_days: int | None = None, expires: str | None = None) -> DataFrame:
    """``left`` with the latest row of ``right`` of the same ``by`` at or before its time.

    Both sides are put into one column of events and carried forward by a window: one
    shuffle, no range join.  ``tolerance_days`` drops what is older; ``expires`` names
    the right side's end date, at and after which it no longer holds.
    """
    kept = [right_on, *values, *([expires] if expires and expires not in values else [])]
    order = F.lit(0 if exact else 1)
    payload = F.struct(*(F.col(c).alias(f"r_{c}") for c in kept))
    r = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_at"), order.alias("_side"), payload.alias("_payload"))
    row = F.struct(*left.columns)
    l = left.select(*by, F.col(left_on).alias("_at"), F.lit(1 if exact else 0).alias("_side"), row.alias("_row"))  # noqa: E741
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l, allowMissingColumns=True).withColumn("_found", F.last("_payload", ignorenulls=True).over(w)).filter("_row is not null")
    holds = F.lit(True)
    if tolerance_days is not None:
        holds = holds & (F.datediff("_at", F.col(f"_found.r_{right_on}")) <= tolerance_days)
    if expires:
        holds = holds & (F.col(f"_found.r_{expires}").isNull() | (F.col("_at") < F.col(f"_found.r_{expires}")))
    return both.select("_row.*", *(F.when(holds, F.col(f"_found.r_{c}")).alias(c) for c in values))


def asof_lagged(left: DataFrame, right: DataFrame, calendar: DataFrame, by: list[str], on: str, right_on: str, values: list[str], sessions: int = 1) -> DataFrame:
    """As-of where only what was known ``sessions`` sessions earlier counts; ``calendar`` has the sessions in column ``on``."""
    known = calendar.select(on).distinct().withColumn("_known", F.lag(on, sessions).over(Window.orderBy(on)))  # one row a session
    shifted = left.join(F.broadcast(known), on, "left")
    return asof(shifted, right, by, "_known", right_on, values).drop("_known")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the interval [start, end) that holds its date; of overlapping ones the latest start wins.

    The latest interval that began is found by an as-of join.  If it has ended while an
    earlier one still runs, that one holds: such overlaps are first cut into pieces.
    """
    pieces = disjoint(right, by, start, end, values)
    return asof(left, pieces, by, at, start, values, expires=end)


def disjoint(right: DataFrame, by: list[str], start: str, end: str, values: list[str]) -> DataFrame:
    """The intervals cut so that none overlap: between two neighbouring bounds the one of the latest start holds."""
    bounds = right.select(*by, F.explode(F.array(start, end)).alias("_b")).filter("_b is not null").distinct()
    spans = bounds.withColumn("_e", F.lead("_b").over(Window.partitionBy(*by).orderBy("_b")))
    inside = (F.col(start) <= F.col("_b")) & (F.col(end).isNull() | (F.col("_b") < F.col(end)))
    held = spans.join(right, by).filter(inside)
    best = held.groupBy(*by, "_b", "_e").agg(F.max_by(F.struct(*values), F.struct(start, *values)).alias("_v"))
    return best.select(*by, F.col("_b").alias(start), F.col("_e").alias(end), "_v.*")


def overlaps(right: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Intervals that begin before the previous one of the key has ended."""
    w = Window.partitionBy(*by).orderBy(start)
    before = right.withColumn("_end", F.lag(F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))).over(w))
    return before.filter(F.col(start) < F.col("_end")).drop("_end")


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def event_paths(events: DataFrame, panel: DataFrame, by: str, ordinal: str, horizon: int, values: list[str]) -> DataFrame:
    """The rows 1 to ``horizon`` after each event of the same ``by``, as one row per (event, offset)."""
    steps = events.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_row", F.col(ordinal) + F.col("offset"))
    return steps.join(panel.select(F.col(by).alias("_by"), F.col(ordinal).alias("_at"), *values), (F.col(by) == F.col("_by")) & (F.col("_row") == F.col("_at"))).drop("_by", "_at", "_row")


def stitched_interval_join(left: DataFrame, right: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, values: list[str], edition: str) -> DataFrame:
    """``interval_join`` over several editions of a classification, each of which holds only in its own span.

    spans: edition, valid_from, valid_to (open if null), a few rows; an edition's
    intervals are cut to its span, so at any date the edition of that date decides.
    """
    cut = right.join(F.broadcast(spans), edition)
    first, last = F.greatest(start, "valid_from"), F.least(end, "valid_to")  # nulls, open ends, give way
    cut = cut.withColumn("_first", first).withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("_first") < F.col("_last")))
    return interval_join(left, cut.select(*by, F.col("_first").alias(start), F.col("_last").alias(end), *values), by, at, start, end, values)
