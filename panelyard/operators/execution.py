"""A ledger of target weights with costs that depend on the trade: participation cap, square-root impact, lots, pending orders.

Targets change on rebalance dates only; an order that a day cannot fill stays
pending.  Sales come before purchases, codes in order.  A scenario (here: a set of
rules) is one grouped function over the rows of the codes it ever wants.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


@dataclass(frozen=True)
class Costs:
    initial_cash: float = 10_000_000.0
    lot_size: int = 100
    participation: float = 0.05
    slippage_bps: float = 5.0
    eta: float = 0.5
    most_impact_bps: float = 100.0
    commission_bps: float = 2.5
    least_commission: float = 5.0
    transfer_bps: float = 0.1
    stamp_bps: float = 5.0
    multiplier: float = 1.0

    def impact(self, volatility: float, share: float) -> float:
        vol = volatility if np.isfinite(volatility) and volatility > 0 else 0.02
        return min(self.slippage_bps + self.eta * vol * math.sqrt(max(share, 0.0)) * 10_000, self.most_impact_bps)

    def of(self, notional: float, sell: bool, impact_bps: float) -> float:
        bps = self.transfer_bps + impact_bps + (self.stamp_bps if sell else 0.0)
        return self.multiplier * (max(self.least_commission, notional * self.commission_bps / 10_000) + notional * bps / 10_000)


def prepared(panel: DataFrame) -> DataFrame:
    """``panel`` with amount_ma20 and volatility_20d, both known the day before."""
    w = frames.history()
    step = frames.safe_ratio(F.col("adj_close"), F.lag("adj_close").over(w)) - 1
    d = panel.withColumn("_step", step)
    return d.withColumns({"amount_ma20": frames.rolling(F.col("amount_cny"), 20, "mean", 10, shift=1), "volatility_20d": frames.rolling(F.col("_step"), 20, "std", 10, shift=1, ddof=1)}).drop("_step")


def _lots(money: float, price: float, lot: int) -> float:
    return math.floor(money / (price * lot)) * lot * price


class Book:
    """Cash, units and pending orders of one ledger."""

    def __init__(self, rules: Costs):
        self.rules, self.cash, self.units, self.pending, self.marks = rules, rules.initial_cash, {}, {}, {}

    def value(self) -> float:
        return self.cash + sum(u * self.marks.get(c, 0.0) for c, u in self.units.items())

    def want(self, weights: dict[str, float]) -> None:
        nav, self.pending = self.value(), {}
        for c in self.units.keys() | weights.keys():
            mark = self.marks.get(c, 0.0)
            gap = nav * weights.get(c, 0.0) / mark - self.units.get(c, 0.0) if mark > 0 else 0.0
            if abs(gap * mark) >= 1.0:
                self.pending[c] = gap

    def trade(self, code, row) -> tuple[float, float] | None:
        """Fills what the day allows of a pending order: notional and cost."""
        r, sell = self.rules, self.pending[code] < 0
        mark, price, usual = row.adj_open, row.raw_open, row.amount_ma20
        if not usual > 0:
            return None
        wanted = abs(self.pending[code]) * mark
        notional = min(wanted, r.participation * usual)
        leaving = sell and wanted >= self.units.get(code, 0.0) * mark - 1.0 and notional >= wanted
        if not leaving:
            notional = _lots(notional, price, r.lot_size)  # odd lots may only be sold out
        cost = r.of(notional, sell, r.impact(row.volatility_20d, notional / usual))
        if not sell and notional + cost > self.cash:
            notional = _lots(max(self.cash - r.least_commission, 0.0), price, r.lot_size)
            cost = r.of(notional, sell, r.impact(row.volatility_20d, notional / usual))
        if notional <= 0 or not sell and notional + cost > self.cash:
            return None
        moved = min(notional / mark, self.units.get(code, 0.0)) if sell else notional / mark
        sign = -1 if sell else 1
        self.units[code] = self.units.get(code, 0.0) + sign * moved
        self.cash -= sign * notional + cost
        self.pending[code] -= sign * moved
        if self.units[code] * mark < 1.0:
            del self.units[code]
        if abs(self.pending[code] * mark) < price * r.lot_size:
            del self.pending[code]
        return notional, cost


def _walk(rows: pd.DataFrame, rules: Costs) -> list[dict]:
    book, out, last = Book(rules), [], rules.initial_cash
    for day, today in rows.sort_values("trade_date").groupby("trade_date"):
        lines = {r.ts_code: r for r in today.itertuples(index=False)}
        book.marks.update({c: r.adj_open for c, r in lines.items() if np.isfinite(r.adj_open)})
        if today["rebalance"].any():
            book.want({c: r.target for c, r in lines.items() if r.target > 0})
        turnover = cost = 0.0
        blocked = 0
        for sell in (True, False):
            for code in sorted(c for c, u in book.pending.items() if (u < 0) == sell):
                if code not in lines or not (lines[code].can_sell if sell else lines[code].can_buy):
                    blocked += 1
                elif done := book.trade(code, lines[code]):
                    turnover, cost = turnover + done[0], cost + done[1]
        nav = book.value()
        out.append({"trade_date": day, "nav": nav, "cash": book.cash, "holdings": len(book.units), "turnover": turnover / last if last > 0 else 0.0, "cost": cost, "blocked": blocked, "pending": len(book.pending)})
        last = nav
    return out


def ledgers(panel: DataFrame, targets: DataFrame, rules: dict[str, Costs]) -> DataFrame:
    """scenario and its days. ``panel`` is executable and prepared; ``targets`` has entry_date, ts_code, target_weight."""
    spark = panel.sparkSession
    wanted = targets.select("ts_code").distinct()
    dates = targets.select(F.col("entry_date").alias("trade_date")).distinct().withColumn("rebalance", F.lit(True))
    rows = panel.join(wanted, "ts_code", "left_semi").join(targets.withColumnRenamed("entry_date", "trade_date"), ["trade_date", "ts_code"], "left").join(F.broadcast(dates), "trade_date", "left")  # a row a rebalance
    rows = rows.select("trade_date", "ts_code", "raw_open", "adj_open", "amount_ma20", "volatility_20d", "can_buy", "can_sell", F.coalesce("target_weight", F.lit(0.0)).alias("target"), F.coalesce("rebalance", F.lit(False)).alias("rebalance"))
    grid = spark.createDataFrame([(name,) for name in rules], "scenario string")
    known = {name: asdict(r) for name, r in rules.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["scenario"].iloc[0]
        return pd.DataFrame(_walk(pdf, Costs(**known[name]))).assign(scenario=name)

    schema = "scenario string, trade_date date, nav double, cash double, holdings int, turnover double, cost double, blocked int, pending int"
    return rows.join(F.broadcast(grid)).groupBy("scenario").applyInPandas(run, schema)  # scenarios are a stated grid


def equal_targets(scores: DataFrame, calendar: DataFrame, every: int, n: int, cap: float = 1.0) -> DataFrame:
    """entry_date, ts_code, target_weight: the best ``n`` of each ``every``-th session, entered on the next."""
    w = Window.orderBy("trade_date")  # one row a session
    dates = calendar.select("trade_date").distinct().select("trade_date", F.lead("trade_date").over(w).alias("entry_date"), (F.row_number().over(w) - 1).alias("_n")).filter((F.col("_n") % every == 0) & F.col("entry_date").isNotNull())
    rank = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("factor_value"), "ts_code"))
    best = scores.filter("factor_value is not null").withColumn("_r", rank).filter(F.col("_r") <= n).join(F.broadcast(dates), "trade_date")
    return best.select("entry_date", "ts_code", F.least(F.lit(1.0) / F.count("*").over(Window.partitionBy("entry_date")), F.lit(cap)).alias("target_weight"))


def exit_states(flags: DataFrame, confirm: int = 2, severe_rank: int = 10, entity: str = "ts_code") -> DataFrame:
    """``flags`` (price_weak, diffusion_weak, relative_weak, breakdown, rank) with the streaks of weakness and a state.

    A streak is the rows since the last false flag: all of them in one order of rows.
    """
    w = Window.partitionBy(entity).orderBy("trade_date")
    true = lambda c: F.coalesce(c, F.lit(False))
    dual = true(F.col("price_weak")) & true(F.col("diffusion_weak"))
    severe = dual & true(F.col("relative_weak")) & true(F.col("rank") > severe_rank)
    out, so_far = flags.withColumn("_k", F.row_number().over(w)), w.rowsBetween(Window.unboundedPreceding, 0)
    streaks = {}
    for name, flag in (("price", true(F.col("price_weak"))), ("dual", dual), ("severe", severe)):
        last = F.coalesce(F.max(F.when(~flag, F.col("_k"))).over(so_far), F.lit(0))
        streaks[f"{name}_streak"] = F.when(flag, F.col("_k") - last).otherwise(0).cast("int")
    out = out.withColumns(streaks)
    weak: Column = true(F.col("price_weak")) | true(F.col("diffusion_weak")) | true(F.col("relative_weak"))
    state = F.when(true(F.col("breakdown")) | (F.col("severe_streak") >= confirm), "SELL").when(F.col("dual_streak") >= confirm, "REDUCE").when(weak, "WATCH").otherwise("HOLD")
    return out.withColumn("state", state).drop("_k")
