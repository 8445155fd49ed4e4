"""What a book holds: spells of holding, daily counts and weights, and how often a signal comes while its code is held.

The input is a table of positions (lots of a code on a date), not a ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


def numbered(calendar: DataFrame, time: str = "trade_date") -> DataFrame:
    """time, session: ordinals of the calendar's dates."""
    return calendar.select(time).distinct().withColumn("session", F.row_number().over(Window.orderBy(time)))  # one row a session


def lots(signals: DataFrame, calendar: DataFrame, wait: int, holding: int, code: str = "ts_code") -> DataFrame:
    """trade_date, code, signal_date for each session on which a signal's lot is held: ``holding`` sessions from ``wait`` after the signal."""
    days = numbered(calendar)
    s = signals.join(days, "trade_date").select(code, F.col("trade_date").alias("signal_date"), F.explode(F.sequence(F.col("session") + wait, F.col("session") + wait + holding - 1)).alias("session"))
    return s.join(days, "session").select("trade_date", code, "signal_date")


def spells(positions: DataFrame, calendar: DataFrame, code: str = "ts_code") -> DataFrame:
    """code, entry_date, last_date, sessions, open: unbroken runs of sessions on which a code is held; open at the calendar's end."""
    days = numbered(calendar)
    held = positions.select("trade_date", code).distinct().join(days, "trade_date")
    island = F.col("session") - F.row_number().over(Window.partitionBy(code).orderBy("session"))
    runs = held.withColumn("_i", island).groupBy(code, "_i").agg(F.min("trade_date").alias("entry_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("sessions"))
    end = days.agg(F.max("trade_date").alias("_end"))
    return runs.crossJoin(F.broadcast(end)).select(code, "entry_date", "last_date", "sessions", (F.col("last_date") == F.col("_end")).alias("open"))  # one row


def daily_holdings(positions: DataFrame, calendar: DataFrame, value: str, group: str, code: str = "ts_code") -> DataFrame:
    """trade_date, holding_count (lots), unique_holding_count, group_count, largest_weight, entries, exits, turnover for each date of the calendar.

    Weights are shares of the date's value; turnover is half the sum of their changes
    since the session before, where a code that is not held weighs nothing.
    """
    days = numbered(calendar)
    own = positions.groupBy("trade_date", code).agg(F.sum(value).alias("_v"), F.count("*").alias("_lots"), F.max(group).alias("_g"))
    own = own.withColumn("_w", frames.safe_ratio(F.col("_v"), F.sum("_v").over(Window.partitionBy("trade_date")))).join(days, "trade_date")
    w = Window.partitionBy(code).orderBy("session")
    gap = lambda ahead: F.coalesce((F.lead if ahead else F.lag)("session").over(w) == F.col("session") + (1 if ahead else -1), F.lit(False))
    own = own.withColumns({"_before": F.when(gap(False), F.lag("_w").over(w)).otherwise(0.0), "_kept": gap(False), "_stays": gap(True)})
    left = own.filter(~F.col("_stays")).select((F.col("session") + 1).alias("session"), F.lit(0).alias("_lots"), F.lit(0.0).alias("_w"), F.col("_w").alias("_before"), F.lit(True).alias("_gone"))
    rows = own.select("session", "_lots", code, "_g", "_w", "_before", (~F.col("_kept")).alias("_new"), F.lit(False).alias("_gone")).unionByName(left, allowMissingColumns=True)
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    by_day = rows.groupBy("session").agg(F.sum("_lots").alias("holding_count"), F.count(code).alias("unique_holding_count"), F.count_distinct("_g").alias("group_count"), F.max(F.when(~F.col("_gone"), F.col("_w"))).alias("largest_weight"), count("_new").alias("entries"), count("_gone").alias("exits"), (F.sum(F.abs(F.col("_w") - F.col("_before"))) / 2).alias("turnover"))
    zero = ("holding_count", "unique_holding_count", "group_count", "entries", "exits", "turnover")
    return days.join(by_day, "session", "left").select("trade_date", *(F.coalesce(c, F.lit(0)).alias(c) for c in zero), "largest_weight")


def duplicate_signals(signals: DataFrame, calendar: DataFrame, wait: int, holding: int, code: str = "ts_code") -> DataFrame:
    """``signals`` with duplicate: the code is still held, by an earlier signal's interval, on the session on which this one's would begin."""
    w = Window.partitionBy(code).orderBy("session")
    s = signals.join(numbered(calendar), "trade_date")
    until = F.max(F.col("session") + wait + holding - 1).over(w.rangeBetween(Window.unboundedPreceding, -1))
    return s.withColumn("duplicate", F.coalesce(until >= F.col("session") + wait, F.lit(False))).drop("session")


def holding_statistics(positions: DataFrame, calendar: DataFrame, signals: DataFrame, value: str, group: str, wait: int, holding: int, code: str = "ts_code") -> DataFrame:
    """One row: counts of lots and codes, mean weight, sessions of ended spells, and the share of signals that come while their code is held."""
    daily = daily_holdings(positions, calendar, value, group, code)
    counts = daily.agg(*(f(c).alias(f"{n}_{c}") for c in ("holding_count", "unique_holding_count") for n, f in (("average", F.avg), ("median", F.median), ("max", F.max))), F.avg("turnover").alias("average_turnover"))
    own = positions.groupBy("trade_date", code).agg(F.sum(value).alias("_v"))
    weight = own.select(frames.safe_ratio(F.col("_v"), F.sum("_v").over(Window.partitionBy("trade_date"))).alias("_w")).agg(F.avg("_w").alias("average_position_weight"))
    ended = spells(positions, calendar, code).filter(~F.col("open")).agg(F.avg("sessions").alias("average_holding_sessions"), F.count("*").alias("ended_spells"))
    doubled = duplicate_signals(signals, calendar, wait, holding, code).agg(F.coalesce(F.avg(F.col("duplicate").cast("double")), F.lit(0.0)).alias("duplicate_signal_rate"))
    return counts.crossJoin(weight).crossJoin(ended).crossJoin(doubled)  # one row each
