"""Breakout boxes: a quiet range is frozen, then breaks upward, fails downward or expires.

A row on which a box may open says by itself how that box would end: its bounds are
those of the rows before, and the end is the first of the next ``max_active`` rows that
leaves them.  So all candidates are windows; only which of them are taken depends on the
box before, and that is one fold over a security's candidates (an opening row and an
ending row each).  Measures of a breakout are columns of the row on which it happened.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions import frames


@dataclass(frozen=True)
class BoxRules:
    lookback: int = 20
    atr_window: int = 14
    short_window: int = 5
    long_window: int = 20
    process_window: int = 5
    acceleration_window: int = 2
    volume_window: int = 10
    max_width_atr: float = 6.0
    max_slope_atr: float = 0.2
    max_volatility_ratio: float | None = None
    breakout_atr: float = 0.25
    failure_atr: float = 0.25
    max_active: int = 20

    def past(self) -> int:
        """Rows before a breakout that its measures may read."""
        return max(self.process_window + 1, 2 * self.acceleration_window + 1, self.volume_window, self.lookback)


def prepared(panel: DataFrame, r: BoxRules) -> DataFrame:
    """``panel`` with its ordinal and what is known the row before: b_atr, b_upper, b_lower, b_slope, b_ratio."""
    w = frames.history()
    past = F.lag("adj_close", 1).over(w)
    d = panel.withColumns({"_tr": frames.true_range(F.col("adj_high"), F.col("adj_low"), past, strict=True), "_step": frames.safe_ratio(F.col("adj_close"), past) - 1, "_ordinal": F.row_number().over(w)})
    d = d.withColumns({
        "_atr": frames.rolling(F.col("_tr"), r.atr_window), "_up": frames.rolling(F.col("adj_high"), r.lookback, "max"), "_low": frames.rolling(F.col("adj_low"), r.lookback, "min"),
        "_slope": frames.slope(F.col("adj_close"), F.col("_ordinal"), r.lookback), "_short": frames.rolling(F.col("_step"), r.short_window, "std"), "_long": frames.rolling(F.col("_step"), r.long_window, "std"),
    })
    ratio = F.when((F.col("_short") == 0) & (F.col("_long") == 0), 0.0).otherwise(frames.safe_ratio(F.col("_short"), F.col("_long")))
    d = d.withColumn("_ratio", ratio)
    return d.withColumns({f"b_{n}": F.lag(f"_{c}", 1).over(w) for n, c in (("atr", "atr"), ("upper", "up"), ("lower", "low"), ("slope", "slope"), ("ratio", "ratio"))}).withColumn("ordinal", F.col("_ordinal") - 1)


@dataclass(frozen=True)
class Row:
    """A row counted back from the one on which the box broke out."""

    back: int = 0

    def __sub__(self, rows: int) -> Row:
        return Row(self.back + rows)


@dataclass(frozen=True)
class Values:
    """A column of the rows up to the breakout: ``values[m.at - 1]`` is the row before."""

    name: str

    def __getitem__(self, row: Row) -> Column:
        return F.try_element_at("_past", F.lit(-1 - row.back))[self.name]


@dataclass(frozen=True)
class Moment:
    """What a measure of a breakout sees: the box (upper, lower, atr, slope, ratio, age in rows) and the rows up to it, all as columns."""

    box: Mapping[str, Column]
    rules: BoxRules
    at: Row = Row()
    open: Values = Values("open")
    close: Values = Values("close")
    volume: Values = Values("volume")

    def moves(self, n: int) -> list[Column]:
        """The last ``n`` changes of the close before the breakout, the oldest first."""
        return [self.close[self.at - k] - self.close[self.at - k - 1] for k in range(n, 0, -1)]


def _mean(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs) / len(xs)


def _trend(y: list[Column]) -> Column:
    """Least-squares slope on 0, 1, 2, ..."""
    x = [k - (len(y) - 1) / 2 for k in range(len(y))]
    return reduce(lambda a, b: a + b, (v * k for k, v in zip(x, y))) / sum(k * k for k in x)


def _median(xs: list[Column]) -> Column:
    """Median of the values, missing if one is."""
    ordered, n = F.array_sort(F.array(*xs)), len(xs)
    known = reduce(lambda a, b: a & b, (x.isNotNull() for x in xs))
    return F.when(known, (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2)


def _acceleration(m: Moment) -> Column:
    a = m.rules.acceleration_window
    moves = m.moves(2 * a)
    return (_mean(moves[a:]) - _mean(moves[:a])) / a / m.box["atr"]


def _relative_volume(m: Moment) -> Column:
    now, usual = m.volume[m.at], _median([m.volume[m.at - k] for k in range(m.rules.volume_window, 0, -1)])
    return F.when((usual > 0) & (now > 0), F.ln(now / usual))


MEASURES: dict[str, Callable[[Moment], Column]] = {
    "range_compactness": lambda m: -(m.box["upper"] - m.box["lower"]) / m.box["atr"],
    "volatility_contraction": lambda m: F.when(m.box["ratio"] == 0, float("inf")).otherwise(-F.ln(m.box["ratio"])),
    "trend_flatness": lambda m: -F.abs(m.box["slope"]) / m.box["atr"],
    "approach_velocity": lambda m: _trend([m.close[m.at - k] for k in range(m.rules.process_window, 0, -1)]) / m.box["atr"],
    "pre_acceleration": _acceleration,
    "direction_persistence": lambda m: _mean([(x > 0).cast("double") for x in m.moves(m.rules.process_window)]),
    "consolidation_age": lambda m: (m.box["age"] + m.rules.lookback).cast("double"),
    "breakout_strength": lambda m: (m.close[m.at] - m.box["upper"]) / m.box["atr"],
    "breakout_velocity": lambda m: (m.close[m.at] - m.close[m.at - 1]) / m.box["atr"],
    "breakout_acceleration": lambda m: (m.close[m.at] - m.close[m.at - 1] - _mean(m.moves(m.rules.acceleration_window))) / m.box["atr"],
    "relative_volume": _relative_volume,
    "gap_atr": lambda m: (m.open[m.at] - m.close[m.at - 1]) / m.box["atr"],
}


@dataclass
class Registry:
    """Named event measures; more can be registered."""

    measures: dict[str, Callable[[Moment], Column]] = field(default_factory=lambda: dict(MEASURES))

    def register(self, name: str, measure: Callable[[Moment], Column]) -> None:
        if name in self.measures:
            raise ValueError(f"measure {name!r} is registered already")
        self.measures[name] = measure


REASONS = ("breakout", "downside_failure", "expired")


def candidates(panel: DataFrame, r: BoxRules) -> DataFrame:
    """ts_code, created and ended (ordinals; ended is null for a box that stays open), the box and how it ends, of each row on which a box may open."""
    w = frames.history()
    upper, lower, atr = (F.col(f"b_{c}") for c in ("upper", "lower", "atr"))
    quiet = (atr > 0) & ((upper - lower) / atr <= r.max_width_atr) & (F.abs("b_slope") / atr <= r.max_slope_atr) & (F.col("ordinal") >= max(r.lookback, r.atr_window + 1, r.long_window + 1))
    if r.max_volatility_ratio is not None:
        quiet = quiet & (F.col("b_ratio") <= r.max_volatility_ratio)
    ahead = {f"_c{i}": F.lead("adj_close", i).over(w) for i in range(1, r.max_active + 1)}
    rows = prepared(panel, r).withColumns(ahead | {"_c0": F.col("adj_close"), "_whole": F.lead("ordinal", r.max_active).over(w).isNotNull(), "_source": F.lag("trade_date").over(w)}).filter(F.coalesce(quiet, F.lit(False)))
    high, low, step = upper + r.breakout_atr * atr, lower - r.failure_atr * atr, len(REASONS) + 1
    # Rows from the opening one, and the number of the reason: the first row that leaves the bounds, or the last that the box may see.
    left = [F.when(F.col(f"_c{i}") > high, i * step + 1).when(F.col(f"_c{i}") < low, i * step + 2) for i in range(r.max_active + 1)]
    rows = rows.withColumn("_end", F.coalesce(*left, F.when(F.col("_whole"), r.max_active * step + 3)))
    reason = F.get(F.array(*(F.lit(x) for x in REASONS)), F.col("_end") % step - 1)
    return rows.select(
        "ts_code", F.col("ordinal").alias("created"), (F.col("ordinal") + F.floor(F.col("_end") / step)).cast("int").alias("ended"), upper.alias("upper"), lower.alias("lower"), atr.alias("atr"), F.col("b_slope").alias("slope"), F.col("b_ratio").alias("ratio"),
        F.col("_source").alias("source_end"), F.col("trade_date").alias("created_at"), reason.alias("reason"),
    )


def taken(found: DataFrame) -> DataFrame:
    """The candidates that open: the first, and each first one after the box before has ended; one fold over a security's candidates."""
    own = ["created", *(c for c in found.columns if c not in ("ts_code", "created"))]
    each = found.groupBy("ts_code").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("c"))
    start = F.struct(F.lit(-1).alias("until"), F.slice("c", F.lit(1), F.lit(0)).alias("kept"))

    def step(a: Column, c: Column) -> Column:
        opens = c["created"] > a["until"]
        return F.when(opens, F.struct(F.coalesce(c["ended"], F.lit((1 << 31) - 1)).alias("until"), F.concat(a["kept"], F.array(c)).alias("kept"))).otherwise(a)

    return each.select("ts_code", F.explode(F.aggregate("c", start, step, lambda a: a["kept"])).alias("b")).select("ts_code", "b.*")


def boxes(panel: DataFrame, rules: BoxRules = BoxRules(), registry: Registry | None = None) -> DataFrame:
    """box_id, ts_code, bounds, dates, state and reason of every box; measures where it broke out."""
    measures = (registry or Registry()).measures
    found = taken(candidates(panel, rules))
    broke = F.col("reason") == "breakout"
    # The rows that a box's end needs: its own, and those before where it broke out.
    back = F.sequence(F.lit(0), F.when(broke, F.lit(rules.past())).otherwise(0))
    wanted = found.withColumn("_back", F.explode(back)).withColumn("_row", F.col("ended") - F.col("_back"))
    rows = panel.select("ts_code", (F.row_number().over(frames.history()) - 1).alias("_row"), F.col("trade_date").alias("day"), F.col("adj_open").alias("open"), F.col("adj_close").alias("close"), F.col("volume_shares").alias("volume"))
    met = wanted.join(rows, ["ts_code", "_row"], "left")
    key = found.columns
    out = met.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("day").isNotNull(), F.struct("_row", "open", "close", "volume")))).alias("_past"), F.max("day").alias("closed_at"))
    moment = Moment({c: F.col(c) for c in ("upper", "lower", "atr", "slope", "ratio")} | {"age": F.col("ended") - F.col("created")}, rules)
    state = F.when(broke, "triggered").when(F.col("reason").isNotNull(), "closed").otherwise("active")
    box_id = F.concat(F.col("ts_code").cast("string"), F.lit(":"), F.date_format("source_end", "yyyyMMdd"))
    return out.select(box_id.alias("box_id"), "ts_code", "upper", "lower", "atr", "source_end", "created_at", state.alias("state"), "closed_at", "reason", *(F.when(broke, f(moment)).cast("double").alias(n) for n, f in measures.items()))
