"""Paths after a signal: delayed exits, extremes on the way, first touches, pivots, variable ranges, states of a holding.

Rows of a security are numbered from 1 in time (``ordinal``); a path is a frame of
rows or a join by security and ordinal, never a loop over prices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames

CODE, TIME, ROW = "ts_code", "trade_date", "ordinal"


def numbered(panel: DataFrame) -> DataFrame:
    return panel.withColumn(ROW, F.row_number().over(frames.history()))


def net_of(gross: Column, cost_bps: float) -> Column:
    """A return after half of the round-trip cost at the entry and half at the exit's value."""
    half = cost_bps / 20_000.0
    return (1 + gross) * (1 - half) - 1 - half


def evaluate_paths(panel: DataFrame, signal: Column, horizons: Sequence[int], cost_bps: float, group: str = "industry_l1_code") -> DataFrame:
    """One row per signal and horizon: entry at the next open, exit at the first open from the planned one on at which the security can be sold.

    ``panel`` has is_buyable and is_sellable.  Signals that can't be bought, whose plan
    lies beyond the data or that are never sold again have no row.  The benchmark is
    the mean planned return of the date's group: an aggregate of prices alone, joined to
    the signals, so no group of whole rows is sorted.
    """
    w, back = frames.history(), Window.partitionBy(CODE).orderBy(F.desc(TIME))
    ratio = lambda h: frames.safe_ratio(F.lead("adj_open", h + 1).over(w), F.lead("adj_open", 1).over(w)) - 1
    means = panel.select(F.col(TIME).alias("_on"), F.col(group).alias("_in"), *(ratio(h).alias(f"_m{h}") for h in horizons))
    means = means.groupBy("_on", "_in").agg(F.array(*(F.avg(f"_m{h}") for h in horizons)).alias("_means"))
    sold = F.when(F.col("is_sellable"), F.struct("_back", TIME, "adj_open"))
    rows = panel.withColumn("_back", F.row_number().over(back))  # both windows back in time first: each order is sorted once
    rows = rows.withColumns({f"_x{h}": F.last(sold, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -(h + 1))) for h in horizons})
    price = F.col("_entry.adj_open")
    ahead = lambda h: w.rowsBetween(1, h + 1)
    rows = rows.withColumns({"_signal": signal, "_entry": F.struct(*(F.lead(c, 1).over(w).alias(c) for c in (TIME, "adj_open", "is_buyable")))} | {
        f"_{h}": F.struct(
            F.lit(h).alias("horizon"), F.lead(TIME, h + 1).over(w).alias("planned_exit_date"), F.lead("adj_open", h + 1).over(w).alias("planned_open"), F.col(f"_x{h}").alias("exit"),
            F.max("adj_high").over(ahead(h)).alias("high"), F.min("adj_low").over(ahead(h)).alias("low"),
        ) for h in horizons
    })
    bought = rows.filter(F.col("_signal") & F.col("_entry.is_buyable") & (price > 0)).select(TIME, CODE, group, "_back", "_entry", *(f"_{h}" for h in horizons))
    bought = bought.join(means, F.col(TIME).eqNullSafe(F.col("_on")) & F.col(group).eqNullSafe(F.col("_in")))
    each = bought.select(TIME, CODE, group, "_back", "_entry", F.explode(F.array(*(F.col(f"_{h}").withField("benchmark", F.get("_means", F.lit(i))) for i, h in enumerate(horizons)))).alias("p"))
    made = each.filter(F.col("p.planned_open").isNotNull() & F.col("p.exit").isNotNull())
    planned = frames.safe_ratio(F.col("p.planned_open"), price) - 1
    gross = frames.safe_ratio(F.col("p.exit.adj_open"), price) - 1
    return made.select(
        TIME, CODE, group, "p.horizon", F.col(f"_entry.{TIME}").alias("entry_date"), "p.planned_exit_date", F.col(f"p.exit.{TIME}").alias("actual_exit_date"),
        (F.col("_back") - F.col("p.exit._back") - F.col("p.horizon") - 1).alias("exit_delay"), gross.alias("gross_return"), planned.alias("planned_gross_return"), (planned - F.col("p.benchmark")).alias("group_excess"),
        (F.col("p.high") / price - 1).alias("mfe"), (F.col("p.low") / price - 1).alias("mae"), net_of(gross, cost_bps).alias("net_return"),
    )


def first_touch(panel: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """The first row in T+1..T+horizon of each event (ts_code, trade_date, level, zone) whose range meets level ± zone.

    The rows that an event may meet are joined by ordinal, so each event moves ``horizon`` small rows.
    """
    rows = numbered(panel).select(CODE, TIME, ROW, "adj_high", "adj_low", "adj_close")
    at = events.join(rows.select(CODE, TIME, ROW), [CODE, TIME]).select(CODE, F.col(TIME).alias("origin_date"), F.col(ROW).alias("origin"), "level", "zone")
    later = at.withColumn("age", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(ROW, F.col("origin") + F.col("age"))
    met = later.join(rows, [CODE, ROW]).filter((F.col("adj_low") <= F.col("level") + F.col("zone")) & (F.col("adj_high") >= F.col("level") - F.col("zone")))
    first = met.groupBy(CODE, "origin_date").agg(F.min_by(F.struct(TIME, "age", "level", "zone", "adj_low", "adj_close"), "age").alias("t")).select(CODE, "origin_date", "t.*")
    reclaimed = F.col("adj_close") > F.col("level")
    return first.select(
        CODE, "origin_date", TIME, "age", "level", "zone", frames.safe_ratio(F.col("level") - F.col("adj_low"), F.col("zone")).alias("penetration"), frames.safe_ratio(F.col("adj_close") - F.col("level"), F.col("zone")).alias("reclaim"),
        reclaimed.alias("reclaimed"), (reclaimed & (F.col("adj_low") < F.col("level"))).alias("false_break"),
    )


def causal_pivots(panel: DataFrame, current: int = 5, lookback: int = 20, separation: int = 5) -> DataFrame:
    """trade_date, ts_code, ordinal and b, a, p: the trough of the last ``current`` rows, the one before it, and the one before that.

    A trough before row x is the lowest low of x-lookback..x-separation; the earliest
    of equal lows counts.  A chain ends where a window is not full.
    """
    w = frames.history()
    low = F.when(F.col("adj_low").isNotNull(), F.struct("adj_low", ROW))
    rows = numbered(panel).select(CODE, TIME, ROW, "adj_low")
    recent, before = F.min(low).over(w.rowsBetween(1 - current, 0)), F.min(low).over(w.rowsBetween(-lookback, -separation))
    rows = rows.select(CODE, TIME, ROW, F.when(F.col(ROW) >= current, recent[ROW]).alias("b"), F.when(F.col(ROW) > lookback, before[ROW]).alias("before"))
    step = lambda name, of: rows.select(CODE, F.col(ROW).alias(of), F.col("before").alias(name))
    return rows.drop("before").join(step("a", "b"), [CODE, "b"], "left").join(step("p", "a"), [CODE, "a"], "left").select(CODE, TIME, ROW, "b", "a", "p")


def range_maximum(panel: DataFrame, value: str, spans: DataFrame, longest: int, out: str) -> DataFrame:
    """``spans`` (ts_code, start, end) with the largest ``value`` of the rows start < ordinal < end, up to ``longest`` of them.

    Every row holds the maxima of the 1, 2, 4, ... rows from it on; two of them cover any range.
    """
    w = frames.history()
    levels = range(longest.bit_length())
    table = numbered(panel).select(CODE, ROW, F.array(*(F.max(value).over(w.rowsBetween(0, (1 << k) - 1)) for k in levels)).alias("maxima"))
    size = F.col("end") - F.col("start") - 1
    level = F.floor(F.log2(size.cast("double"))).cast("int")
    asked = spans.withColumn("_level", F.when(size > 0, level)).withColumn("_left", F.col("start") + 1).withColumn("_right", F.col("end") - F.pow(F.lit(2), F.col("_level")).cast("int"))
    side = lambda name: table.select(CODE, F.col(ROW).alias(name), F.col("maxima").alias(f"{name}_maxima"))
    both = asked.join(side("_left"), [CODE, "_left"], "left").join(side("_right"), [CODE, "_right"], "left")
    most = F.greatest(F.get("_left_maxima", F.col("_level")), F.get("_right_maxima", F.col("_level")))
    return both.select(*spans.columns, most.alias(out))


def held_states(panel: DataFrame, positions: DataFrame, holding: int, tail: int, cost_bps: float, tail_loss: float) -> DataFrame:
    """A row per day that a position (ts_code, trade_date of its signal) is held, but the last: what leaving at the next open would have saved.

    remaining_return runs from the next open to the planned exit; tail_worst is the
    lowest open of the next ``tail`` sessions, no later than that exit, against the next
    open; both labels carry the date on which they are known.
    """
    w = frames.history()
    rows = numbered(panel)
    worst = F.array(*(F.struct(F.min("adj_open").over(w.rowsBetween(1, n)).alias("low"), F.lead(TIME, n).over(w).alias("date")) for n in range(1, tail + 1)))
    opens = rows.select(CODE, ROW, TIME, "adj_open", worst.alias("worst"))
    entry = positions.join(rows.select(CODE, TIME, ROW), [CODE, TIME]).select(CODE, F.col(TIME).alias("signal_date"), (F.col(ROW) + 1).alias("entered"))
    ages = entry.withColumn("holding_age", F.explode(F.sequence(F.lit(1), F.lit(holding - 1)))).withColumn("next", F.col("entered") + F.col("holding_age")).withColumn("exit", F.col("entered") + holding)
    after = opens.select(CODE, F.col(ROW).alias("next"), F.col(TIME).alias("next_open_date"), F.col("adj_open").alias("next_open"), "worst")
    leave = opens.select(CODE, F.col(ROW).alias("exit"), F.col(TIME).alias("label_available_date"), F.col("adj_open").alias("exit_open"))
    state = ages.join(after, [CODE, "next"]).join(leave, [CODE, "exit"])
    remaining = frames.safe_ratio(F.col("exit_open"), F.col("next_open")) - 1
    rest = F.get("worst", F.least(F.lit(tail), F.lit(holding) - F.col("holding_age")) - 1)
    state = state.withColumn("remaining_return", remaining).withColumn("_tail", rest).withColumn("tail_worst", frames.safe_ratio(F.col("_tail.low"), F.col("next_open")) - 1)
    return state.filter("remaining_return is not null").select(
        CODE, "signal_date", "holding_age", (F.lit(holding) - F.col("holding_age")).alias("days_remaining"), "next_open_date", "label_available_date", "remaining_return",
        (-F.col("remaining_return") - cost_bps / 10_000).alias("exit_advantage"), "tail_worst", (F.col("tail_worst") <= tail_loss).alias("tail_event"), F.col("_tail.date").alias("tail_available_date"),
    )
