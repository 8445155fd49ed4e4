"""Portfolio ledgers: cash sleeves bought at the open after the signal and sold a holding period later.

A ledger is a state machine over sessions, so a scenario is one grouped function;
a grid of scenarios runs in parallel.  Before that Spark cuts the panel down to what
a ledger can touch: the best candidates of each date and their prices up to the sale.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


@dataclass(frozen=True)
class Rules:
    """Costs are basis points: ``cost_bps`` for a round trip, or the parts of the model where it is None."""

    initial_cash: float = 1_000_000.0
    lot_size: int = 100
    commission_bps: float = 3.0
    slippage_bps: float = 5.0
    stamp_bps: float = 5.0
    fully_invest: bool = False
    blocked_exit: str = "reinvest"  # or "skip": a sleeve that still holds something buys nothing
    min_listing_days: int = 0


FLAGS = {"is_suspended": True, "is_limit_up_open": False, "is_limit_down_open": False, "is_st": False, "is_delisting_period": False}


def executable(panel: DataFrame, rules: Rules) -> DataFrame:
    """``panel`` with can_buy and can_sell at the open; a missing suspension flag counts as suspended, others as clear."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(FLAGS[c])) if c in panel.columns else F.lit(False)
    priced = F.col("raw_open").isNotNull()
    age = F.coalesce("listing_trade_days", F.lit(0)) >= rules.min_listing_days if "listing_trade_days" in panel.columns else F.lit(True)
    buy = priced & ~flag("is_suspended") & ~flag("is_limit_up_open") & ~flag("is_st") & ~flag("is_delisting_period") & age
    return panel.withColumn("can_buy", buy).withColumn("can_sell", priced & ~flag("is_suspended") & ~flag("is_limit_down_open"))


def _walk(rows: pd.DataFrame, top_n: int, holding: int, cost_bps: float | None, rules: Rules, multiplier: dict) -> tuple[list[dict], list[dict]]:
    """Days and trades of one scenario; ``rows`` has a row per session and touched code."""
    days = sorted(rows["trade_date"].unique())
    by_day = {d: g.set_index("ts_code") for d, g in rows.groupby("trade_date")}
    fee = lambda value, sell: value * ((cost_bps / 2) if cost_bps is not None else rules.commission_bps + rules.slippage_bps + (rules.stamp_bps if sell else 0)) / 10_000
    cash = [rules.initial_cash / holding] * holding
    held: list[list[dict]] = [[] for _ in range(holding)]
    marks: dict = {}
    out, trades, last_nav = [], [], rules.initial_cash

    def worth(p: dict, price: float) -> float:
        return p["shares"] * p["raw"] * (price if np.isfinite(price) else p["adj"]) / p["adj"]

    for i, day in enumerate(days):
        now = by_day[day]
        buys = sells = wanted = 0
        turnover = costs = 0.0
        for s in range(holding):
            kept = []
            for p in held[s]:
                if p["due"] > i or p["code"] not in now.index or not now.at[p["code"], "can_sell"]:
                    kept.append(p)
                    continue
                value = worth(p, now.at[p["code"], "adj_open"])
                cost = fee(value, True)
                cash[s] += value - cost
                sells, turnover, costs = sells + 1, turnover + value, costs + cost
                trades.append({"trade_date": day, "signal_date": p["signal"], "sleeve": s, "ts_code": p["code"], "side": "SELL", "shares": p["shares"], "gross": value, "cost": cost})
            held[s] = kept
        s = (i - 1) % holding
        if i and cash[s] > 0 and not (rules.blocked_exit == "skip" and held[s]):
            before = by_day[days[i - 1]]
            own = {p["code"] for p in held[s]}
            ranked = before[before["candidate"]].sort_values("rank")
            chosen = [c for c in ranked.index if c not in own][:top_n]
            if len(chosen) < top_n and len(ranked) and ranked["cut"].iloc[0]:
                raise ValueError(f"{day}: {len(ranked)} candidates are too few beside {len(own)} held codes; raise the buffer")
            wanted = len(chosen)
            money = cash[s] * min(max(multiplier.get(day, 1.0), 0.0), 1.0)
            ready = [c for c in chosen if c in now.index and now.at[c, "can_buy"]]
            share = money / (len(ready) if rules.fully_invest else top_n) if ready else 0.0
            for c in ready:
                price = float(now.at[c, "raw_open"])
                n = int(share // (price * rules.lot_size)) * rules.lot_size
                gross = n * price
                cost = fee(gross, False)
                if n <= 0 or gross + cost > cash[s]:
                    continue
                cash[s] -= gross + cost
                held[s].append({"code": c, "shares": n, "raw": price, "adj": float(now.at[c, "adj_open"]), "due": i + holding, "signal": days[i - 1]})
                buys, turnover, costs = buys + 1, turnover + gross, costs + cost
                trades.append({"trade_date": day, "signal_date": days[i - 1], "sleeve": s, "ts_code": c, "side": "BUY", "shares": n, "gross": gross, "cost": cost})
        marks.update(now["adj_close"].dropna().to_dict())
        value = sum(worth(p, marks.get(p["code"], np.nan)) for own in held for p in own)
        nav = sum(cash) + value
        out.append({"trade_date": day, "nav": nav, "cash": sum(cash), "gross_exposure": value, "new_signals": wanted, "buys": buys, "sells": sells, "holdings": sum(map(len, held)), "turnover": turnover / last_nav if last_nav > 0 else 0.0, "cost": costs})
        last_nav = nav
    return out, trades


def touched(panel: DataFrame, scores: DataFrame, scenarios: DataFrame, universe: str, rules: Rules, buffer: int) -> DataFrame:
    """What the ledger of each scenario can meet: a date's candidates, and a candidate's rows from then on to the first at which any of the scenarios must have sold it.

    This grows with sessions and depth, not with securities.
    """
    data = executable(panel, rules)
    inside = F.coalesce(universe, F.lit(False)) & F.col("factor_value").isNotNull()
    sized = scenarios.withColumn("depth", F.col("top_n") * buffer)
    deepest, longest = sized.agg(F.max("depth"), F.max("holding_days")).first()
    scored = data.join(scores.select("trade_date", "ts_code", "factor_value"), ["trade_date", "ts_code"]).filter(inside)
    rank = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col("factor_value").desc(), "ts_code"))
    picks = scored.select("trade_date", "ts_code", rank.alias("rank")).filter(F.col("rank") <= deepest + 1)  # the one too many tells that a date has more
    depths = picks.groupBy("trade_date").agg(F.max("rank").alias("deep"))
    picks = picks.filter(F.col("rank") <= deepest)
    rows = data.join(picks.select("ts_code").distinct(), "ts_code").join(picks, ["trade_date", "ts_code"], "left").select("trade_date", "ts_code", "raw_open", "adj_open", "adj_close", "can_buy", "can_sell", "rank")
    calendar = rows.select("trade_date").distinct().withColumn("day", F.row_number().over(Window.orderBy("trade_date")))  # one row a session
    w = frames.history().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(calendar, "trade_date").withColumns({
        "adj_close": F.last(F.when(~F.isnan("adj_close"), F.col("adj_close")), ignorenulls=True).over(w),  # as the ledger marks what it holds
        "picked": F.max(F.when(F.col("rank").isNotNull(), F.col("day"))).over(w),
        "sellable": F.max(F.when(F.col("can_sell"), F.col("day"))).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "head": F.min("ts_code").over(Window.partitionBy("trade_date")) == F.col("ts_code"),  # every session has a row
    })
    open_ = F.col("picked").isNotNull() & ~F.coalesce(F.col("sellable") > F.col("picked") + longest, F.lit(False))
    rows = rows.filter(open_ | F.col("head")).drop("day", "picked", "sellable", "head").join(depths, "trade_date", "left")
    each = rows.join(F.broadcast(sized))  # scenarios are a stated grid
    return each.withColumn("cut", F.coalesce(F.col("deep") > F.col("depth"), F.lit(False))).withColumn("candidate", F.coalesce(F.col("rank") <= F.col("depth"), F.lit(False))).drop("deep")


def ledgers(panel: DataFrame, scores: DataFrame, scenarios: DataFrame, universe: str = "is_liquid", rules: Rules = Rules(), buffer: int = 4, multiplier: dict | None = None, what: str = "days") -> DataFrame:
    """The days (or trades) of each of ``scenarios`` (scenario, top_n, holding_days, cost_bps).

    ``panel`` has trade_date, ts_code, raw_open, adj_open, adj_close and flags; ``scores``
    trade_date, ts_code, factor_value.  A ledger sees, of each date, ``buffer`` times
    top_n candidates (and fails rather than run short of them), and the rows ``touched``.
    """
    each = touched(panel, scores, scenarios, universe, rules, buffer)
    day_schema = "scenario string, trade_date date, nav double, cash double, gross_exposure double, new_signals int, buys int, sells int, holdings int, turnover double, cost double"
    code = panel.schema["ts_code"].dataType.simpleString()
    trade_schema = f"scenario string, trade_date date, signal_date date, sleeve int, ts_code {code}, side string, shares long, gross double, cost double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        days, trades = _walk(pdf, int(first["top_n"]), int(first["holding_days"]), None if pd.isna(first["cost_bps"]) else float(first["cost_bps"]), rules, multiplier or {})
        names = [f.split()[0] for f in (day_schema if what == "days" else trade_schema).split(", ")]
        return pd.DataFrame(days if what == "days" else trades, columns=names).assign(scenario=first["scenario"])

    return each.groupBy("scenario").applyInPandas(run, day_schema if what == "days" else trade_schema)


def metrics(days: DataFrame, axes: list[str] | None = None) -> DataFrame:
    """Total and annual return, volatility, Sharpe, drawdown of each ledger."""
    axes = axes or ["scenario"]
    w = Window.partitionBy(*axes).orderBy("trade_date")
    d = days.withColumn("_r", frames.safe_ratio(F.col("nav"), F.lag("nav").over(w)) - 1)
    d = d.withColumn("_r", F.coalesce("_r", F.lit(0.0))).withColumn("_dd", F.col("nav") / F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    s = d.groupBy(*axes).agg(F.min_by("nav", "trade_date").alias("_first"), F.max_by("nav", "trade_date").alias("_last"), F.count("*").alias("days"), F.stddev_samp("_r").alias("_sd"), F.min("_dd").alias("max_drawdown"), F.sum("buys").alias("executed_buys"), F.sum("new_signals").alias("generated_signals"))
    total = F.col("_last") / F.col("_first") - 1
    annual = F.when(total > -1, F.pow(1 + total, F.lit(252.0) / F.greatest(F.col("days") - 1, F.lit(1))) - 1).otherwise(-1.0)
    vol = F.coalesce(F.col("_sd") * (252**0.5), F.lit(0.0))
    return s.select(*axes, "days", total.alias("total_return"), annual.alias("annualized_return"), vol.alias("annualized_volatility"), F.when(vol > 0, annual / vol).alias("sharpe"), "max_drawdown", F.when(F.col("max_drawdown") < 0, annual / F.abs("max_drawdown")).alias("calmar"), "executed_buys", "generated_signals", frames.safe_ratio(F.col("executed_buys"), F.col("generated_signals")).alias("execution_rate"))


def universe_benchmark(panel: DataFrame, universe: str = "is_liquid") -> DataFrame:
    """trade_date, benchmark_return: mean of members known at a close, entered at the next open, seen at the open after."""
    w = frames.history()
    r = panel.withColumn("_r", frames.safe_ratio(F.lead("adj_open", 2).over(w), F.lead("adj_open", 1).over(w)) - 1)
    means = r.groupBy("trade_date").agg(F.avg(F.when(F.coalesce(universe, F.lit(False)), F.col("_r"))).alias("_m"))
    cal = Window.orderBy("trade_date")  # one row a session
    return means.select("trade_date", F.coalesce(F.lag("_m", 2).over(cal), F.lit(0.0)).alias("benchmark_return"))


def capped_weights(scores: DataFrame, by: list[str], weight: str, cap: float, code: str = "ts_code") -> DataFrame:
    """``scores`` with weights (capped) of each group that sum to one and are at most ``cap`` (or equal, where the cap can't hold): excess goes to the rest in proportion.

    From the largest weight down, one is capped if its share of what is left of the sum,
    after a cap for each before it, is above the cap; the rest share what then remains.
    """
    whole = Window.partitionBy(*by)
    down = whole.orderBy(F.desc("_v"), *([code] if code in scores.columns else [])).rowsBetween(Window.unboundedPreceding, -1)
    d = scores.withColumn("_v", F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0)).cast("double"))
    d = d.withColumn("_n", F.count("*").over(whole)).withColumn("_v", F.when(F.sum("_v").over(whole) > 0, F.col("_v")).otherwise(1.0))
    d = d.withColumn("_left", F.sum("_v").over(whole) - F.coalesce(F.sum("_v").over(down), F.lit(0.0))).withColumn("_k", F.count("*").over(down))
    d = d.withColumn("_full", F.coalesce(F.col("_v") * (1 - cap * F.col("_k")) > (cap + 1e-12) * F.col("_left"), F.lit(False)))
    full = F.sum(F.col("_full").cast("int")).over(whole)
    rest = F.sum(F.when(~F.col("_full"), F.col("_v"))).over(whole)
    share = (1 - cap * full) * F.when(rest > 0, F.try_divide(F.col("_v"), rest)).otherwise(F.try_divide(F.lit(1.0), F.col("_n") - full))  # what weighs nothing shares alike
    capped = F.when(cap * F.col("_n") <= 1, 1 / F.col("_n")).when(F.col("_full"), F.lit(cap)).otherwise(share)
    return d.withColumn("capped", capped).drop("_v", "_n", "_left", "_k", "_full")

