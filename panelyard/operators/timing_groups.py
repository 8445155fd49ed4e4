"""The groups of the timing table: valuation, breadth, funding, options, futures, money flow, macro; and the table they make.

Each group is an aggregate of its raw tables to one row a session; what is known
``lag`` sessions late stands that late.  Raw tables have the vendor's columns by any of
their names, dates in any of their spellings, numbers as text or not.  Windows need no
partition: a group is one series of one row a session.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.operators import timing
from panelyard.operators.timing import first_existing, implied_volatility, known_monthly, number, parse_date

T = "trade_date"
# The vendor's names of a column, the first that a table has.
NAMES = {
    "close": ["close", "adj_close", "index_close"], "pe": ["pe_ttm", "pe"], "yield": ["yield", "yield_rate", "curve_value", "value"], "change": ["pct_chg", "pct_change"], "amount": ["amount_cny", "amount", "amt"],
    "margin_buy": ["rzmre", "margin_buy", "fin_buy"], "margin_balance": ["rzye", "margin_balance", "fin_balance"], "option": ["ts_code", "opt_code", "code"], "strike": ["exercise_price", "strike_price", "strike"],
    "maturity": ["maturity_date", "expire_date", "delist_date", "last_ddate"], "kind": ["call_put", "option_type", "opt_type"], "option_price": ["close", "settle"], "option_amount": ["amount", "amt"], "future": ["ts_code", "symbol"],
    "future_price": ["close", "settle"], "future_maturity": ["maturity_date", "delist_date", "last_ddate"], "long": ["long_hld", "long_holding"], "short": ["short_hld", "short_holding"],
    "flow": ["main_net_inflow", "net_mf_amount", "main_net_amount", "net_amount"], "known": ["available_date", "ann_date", "trade_date", "month", "date"], "cpi": ["cpi_yoy", "nt_yoy", "value"], "pmi": ["pmi010000", "pmi", "value"], "epu": ["epu", "value", "index"],
}
PUTS, CALLS = ("p", "put", "认沽"), ("c", "call", "认购")


@dataclass(frozen=True)
class Options:
    """Which options make up the implied volatility at the money."""

    least_days: int = 7
    moneyness: float = 0.05
    least_amount: float = 0.0
    rate: float = 0.02
    low: float = 0.01
    high: float = 1.50


def _w() -> Window:
    return Window.orderBy(T)  # one row a session


def _of(df: DataFrame, kind: str) -> Column:
    return number(first_existing(df, NAMES[kind]))


def _dated(df: DataFrame, column: str = T) -> DataFrame:
    return df.withColumn(T, parse_date(F.col(column))).filter(F.col(T).isNotNull())


def _mean(c: str, size: int, least: int, kind: str = "mean") -> Column:
    return frames.rolling(F.col(c), size, kind, least, ddof=1, w=_w())


def _moved(c: str, k: int) -> Column:
    return frames.safe_ratio(F.col(c), F.lag(c, k).over(_w())) - 1


def index_frame(index_daily: DataFrame, code: str | None = None) -> DataFrame:
    """trade_date, index_close of one index; of rows that share a date the greatest close counts."""
    d = _dated(index_daily)
    d = d.filter(F.col("ts_code") == code) if code is not None and "ts_code" in d.columns else d
    return d.groupBy(T).agg(F.max(_of(d, "close")).alias("index_close")).filter("index_close is not null")


def market_amount(stocks: DataFrame) -> DataFrame:
    d = _dated(stocks)
    return d.groupBy(T).agg(F.coalesce(F.sum(_of(d, "amount")), F.lit(0.0)).alias("market_amount"))


def valuation(dailybasic: DataFrame, bond: DataFrame | None = None, fallback: float | None = None) -> DataFrame:
    """pe_ttm, earnings_yield, bond_10y_yield (of the ten-year term, as a share) and erp: what equity yields above bonds."""
    d = _dated(dailybasic)
    out = d.groupBy(T).agg(F.max(_of(d, "pe")).alias("pe_ttm")).withColumn("earnings_yield", F.when(F.col("pe_ttm") > 0, 1 / F.col("pe_ttm")))
    own = F.lit(fallback).cast("double")
    if bond is not None:
        b = bond.withColumn(T, parse_date(first_existing(bond, ["trade_date", "date", "cal_date"])))
        b = b.filter(F.round(number(F.col("curve_term")), 6) == 10.0) if "curve_term" in b.columns else b
        out = out.join(b.groupBy(T).agg((F.max(_of(b, "yield")) / 100).alias("_b")), T, "left")
        own = F.coalesce("_b", own)
    return out.withColumn("bond_10y_yield", own).withColumn("erp", F.col("earnings_yield") - F.col("bond_10y_yield")).select(T, "pe_ttm", "earnings_yield", "bond_10y_yield", "erp")


def breadth(index: DataFrame, stocks: DataFrame | None = None) -> DataFrame:
    """Returns, volatility, drawdown and trend of the index (trade_date, index_close), and how many securities rise."""
    out = index.withColumn("_r", F.ln("index_close") - F.ln(F.lag("index_close").over(_w())))
    trend = lambda size: F.when(_mean("index_close", size, max(5, size // 2)).isNotNull(), (F.col("index_close") > _mean("index_close", size, max(5, size // 2))).cast("double"))
    out = out.select(
        T, _moved("index_close", 20).alias("index_ret_20d"), _moved("index_close", 60).alias("index_ret_60d"), _mean("_r", 20, 10, "std").alias("index_vol_20d"),
        (frames.safe_ratio(F.col("index_close"), _mean("index_close", 60, 20, "max")) - 1).alias("index_drawdown_60d"), trend(20).alias("index_above_ma20"), trend(60).alias("index_above_ma60"),
    )
    if stocks is None:
        return out
    d = _dated(stocks)
    known = [c for c in NAMES["change"] if c in d.columns]
    change = number(F.col(known[0])) if known else frames.safe_ratio(_of(d, "close"), number(F.col("pre_close"))) - 1
    n = d.groupBy(T).agg(*(F.coalesce(F.sum(test.cast("long")), F.lit(0)).alias(name) for name, test in (("_up", change > 0), ("_down", change < 0))))
    n = n.withColumns({"up_ratio": frames.safe_ratio(F.col("_up"), F.col("_up") + F.col("_down")), "adv_dec_log": F.ln((F.col("_up") + 0.5) / (F.col("_down") + 0.5))})
    n = n.withColumns({"up_ratio_ma5": _mean("up_ratio", 5, 3), "up_ratio_ma20": _mean("up_ratio", 20, 10)}).withColumn("breadth_thrust", F.col("up_ratio_ma5") - F.col("up_ratio_ma20"))
    return out.join(n.drop("_up", "_down"), T, "left")


def funding(margin: DataFrame, stocks: DataFrame | None = None, bands: tuple[int, ...] = (20, 60)) -> DataFrame:
    """rzmre_ratio (margin purchases, of the market's amount if stocks are given), changes of the balance, and where the ratio stands in its bands."""
    d = _dated(margin)
    total = lambda k: F.coalesce(F.sum(_of(d, k)), F.lit(0.0)) if any(c in d.columns for c in NAMES[k]) else F.lit(None).cast("double")
    out = d.groupBy(T).agg(total("margin_buy").alias("_buy"), total("margin_balance").alias("_left"))
    if stocks is not None:
        out = out.join(market_amount(stocks), T, "left").withColumn("_buy", frames.safe_ratio(F.col("_buy"), F.col("market_amount")))
    out = out.withColumn("rzmre_ratio", F.col("_buy")).withColumns({f"rzye_chg_{k}d": _moved("_left", k) for k in (5, 20, 60)})
    for k in bands:
        mean, sd = _mean("rzmre_ratio", k, max(5, k // 2)), _mean("rzmre_ratio", k, max(5, k // 2), "std")
        out = out.withColumns({f"rzmre_boll_pos_{k}": frames.safe_ratio(F.col("rzmre_ratio") - mean, sd), f"rzmre_boll_pct_{k}": frames.safe_ratio(F.col("rzmre_ratio") - (mean - 2 * sd), 4 * sd)})
    return out.drop("_buy", "_left", "market_amount")


def _quotes(basic: DataFrame, daily: DataFrame) -> DataFrame:
    b = basic.select(first_existing(basic, NAMES["option"]).alias("_code"), parse_date(first_existing(basic, NAMES["maturity"])).alias("maturity"), _of(basic, "strike").alias("strike"), F.lower(first_existing(basic, NAMES["kind"])).alias("kind"))
    d = _dated(daily)
    price = _of(d, "option_price")
    return d.select(T, first_existing(d, NAMES["option"]).alias("_code"), price.alias("price"), _of(d, "option_amount").alias("amount")).join(b, "_code", "left")


def put_call(basic: DataFrame, daily: DataFrame) -> DataFrame:
    """put_call_log: logarithm of put over call amounts."""
    total = lambda kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("amount"))), F.lit(0.0)) + 1.0
    return _quotes(basic, daily).groupBy(T).agg(F.ln(total(PUTS) / total(CALLS)).alias("put_call_log"))


def at_the_money(basic: DataFrame, daily: DataFrame, index: DataFrame, o: Options = Options()) -> DataFrame:
    """iv_atm: mean implied volatility of the nearest month's options close to the money that have one."""
    q = _quotes(basic, daily).join(F.broadcast(index), T)  # one row a session
    days = F.datediff("maturity", T)
    q = q.withColumn("days", days).filter((F.col("days") > o.least_days) & (F.col("price") > 0) & (F.coalesce("amount", F.lit(0.0)) >= o.least_amount) & (F.abs(F.ln(frames.safe_ratio(F.col("strike"), F.col("index_close")))) <= o.moneyness))
    call = F.col("kind").isin(*CALLS)
    q = q.withColumn("iv", implied_volatility(F.col("price"), F.col("index_close"), F.col("strike"), F.col("days") / 365.0, F.lit(o.rate), call)).filter(F.col("iv").between(o.low, o.high))
    near = q.withColumn("_near", F.min("days").over(Window.partitionBy(T))).filter("days = _near")
    return near.groupBy(T).agg(F.avg("iv").alias("iv_atm"))


def option_sentiment(basic: DataFrame, daily: DataFrame, index: DataFrame, iv: DataFrame | None = None, o: Options = Options()) -> DataFrame:
    """put_call_log, iv_atm (of ``iv``, trade_date and iv_atm, if given) and its spread over realized volatility."""
    surface = at_the_money(basic, daily, index, o) if iv is None else _dated(iv).groupBy(T).agg(F.avg(number(first_existing(iv, ["iv_atm", "iv", "implied_volatility"]))).alias("iv_atm"))
    real = index.withColumn("_r", F.ln("index_close") - F.ln(F.lag("index_close").over(_w()))).select(T, (_mean("_r", 20, 10, "std") * 252.0**0.5).alias("_real"))
    both = put_call(basic, daily).join(surface, T, "full").join(real, T, "left")
    return both.select(T, "put_call_log", "iv_atm", (F.col("iv_atm") - F.col("_real")).alias("iv_realized_spread"))


def futures_sentiment(index: DataFrame, prefix: str, holding: DataFrame | None = None, daily: DataFrame | None = None, basic: DataFrame | None = None, roll_days: int = 5, year: int = 365) -> DataFrame:
    """fut_ls_log (short over long holdings) and the annual basis of the nearest and the next contract that does not mature within ``roll_days``; contracts begin with ``prefix``."""
    parts = []
    if holding is not None:
        h = _dated(holding).filter(first_existing(holding, ["symbol", "ts_code"]).startswith(prefix))
        total = lambda k: F.coalesce(F.sum(_of(h, k)), F.lit(0.0)) + 1.0
        parts.append(h.groupBy(T).agg(F.ln(total("short") / total("long")).alias("fut_ls_log")))
    if daily is not None and basic is not None:
        b = basic.filter(first_existing(basic, ["symbol", "name", "ts_code"]).rlike(f"^{prefix}[0-9]{{4}}")).select(first_existing(basic, NAMES["future"]).alias("_code"), parse_date(first_existing(basic, NAMES["future_maturity"])).alias("_end"))
        d = _dated(daily)
        d = d.select(T, first_existing(d, NAMES["future"]).alias("_code"), _of(d, "future_price").alias("_p")).filter(F.col("_code").rlike(f"^{prefix}[0-9]{{4}}"))
        d = d.join(b, "_code").join(F.broadcast(index), T).withColumn("_days", F.datediff("_end", T)).filter(F.col("_days") > roll_days)  # index: one row a session
        d = d.withColumn("_basis", frames.safe_ratio(F.col("_p") - F.col("index_close"), F.col("index_close")) * year / F.col("_days")).filter("_basis is not null")
        place = F.row_number().over(Window.partitionBy(T).orderBy("_days", "_code"))
        d = d.withColumn("_k", place).filter("_k <= 2")
        parts.append(d.groupBy(T).agg(*(F.max(F.when(F.col("_k") == k, F.col("_basis"))).alias(n) for k, n in ((1, "fut_near_basis_ann"), (2, "fut_next_basis_ann")))))
    if not parts:
        raise ValueError("futures need holdings, or quotes and contracts")
    return reduce(lambda a, b: a.join(b, T, "full"), parts)


def money_flow(flow: DataFrame, stocks: DataFrame | None = None) -> DataFrame:
    """main_net_ratio (net inflow, of the market's amount if stocks are given), its means and sums of 5 and 20 sessions."""
    d = _dated(flow)
    out = d.groupBy(T).agg(F.coalesce(F.sum(_of(d, "flow")), F.lit(0.0)).alias("main_net_ratio"))
    if stocks is not None:
        out = out.join(market_amount(stocks), T, "left").select(T, frames.safe_ratio(F.col("main_net_ratio"), F.col("market_amount")).alias("main_net_ratio"))
    return out.withColumns({f"main_net_ratio_{n}": _mean("main_net_ratio", k, k // 2 + 1 if k == 5 else k // 2, kind) for n, k, kind in (("ma5", 5, "mean"), ("ma20", 20, "mean"), ("sum_5d", 5, "sum"), ("sum_20d", 20, "sum"))})


def macro(cpi: DataFrame | None = None, pmi: DataFrame | None = None, epu: DataFrame | None = None) -> DataFrame:
    """Releases by the day on which they are known: values, changes over releases and three scores; the last known value of each stays."""

    def releases(df: DataFrame, name: str, changes: tuple[int, ...]) -> DataFrame:
        d = df.select(parse_date(first_existing(df, NAMES["known"])).alias(T), _of(df, name).alias("_v")).filter(F.col(T).isNotNull())
        d = d.groupBy(T).agg(F.max("_v").alias("_v"))
        value = F.when(F.col("_v") > 0, F.ln("_v")) if name == "epu" else F.col("_v")
        own = {"cpi": "cpi_yoy", "pmi": "pmi", "epu": "epu_log"}[name]
        return d.select(T, value.alias(own)).withColumns({f"{own}_chg_{k}m": F.col(own) - F.lag(own, k).over(_w()) for k in changes})

    given = [(cpi, "cpi", (1, 3)), (pmi, "pmi", (1, 3)), (epu, "epu", (1,))]
    parts = [releases(df, name, changes) for df, name, changes in given if df is not None]
    if not parts:
        raise ValueError("no macro series")
    out = reduce(lambda a, b: a.join(b, T, "full"), parts)
    until = _w().rowsBetween(Window.unboundedPreceding, 0)
    out = out.select(T, *(F.last(c, ignorenulls=True).over(until).alias(c) for c in out.columns if c != T))
    if "pmi" in out.columns:
        out = out.withColumn("pmi_above_50", (F.col("pmi") > 50).cast("double"))
    col = lambda c: F.col(c) if c in out.columns else F.lit(None).cast("double")
    return out.withColumns({"macro_growth_score": col("pmi") + col("pmi_chg_3m"), "macro_inflation_score": col("cpi_yoy") + col("cpi_yoy_chg_3m"), "macro_uncertainty_score": col("epu_log")})


def decorated(frame: DataFrame, extremes: tuple[str, ...] = (), z: int = 252, pct: int = 756, changes: tuple[int, ...] = (5, 20, 60), z_clip: float = 3.0, pct_clip: tuple[float, float] = (0.01, 0.99), low: tuple[float, ...] = (0.05, 0.10), high: tuple[float, ...] = (0.90, 0.95)) -> DataFrame:
    """``frame`` (one row a session) with each measure's clipped robust z and share in the window, its changes, and flags of ``extremes``."""
    names = [c for c in frame.columns if c != T]
    least = lambda size: min(size, max(20, size // 4))
    bound = lambda x, a, b: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(a)), F.lit(b)))
    out = frame
    for c in names:
        out = timing.mad_z(out, c, z, least(z), f"{c}_z_{z}", _w())
    out = out.withColumns({f"{c}_z_{z}": bound(F.col(f"{c}_z_{z}"), -z_clip, z_clip) for c in names} | {f"{c}_pct_{pct}": bound(frames.trailing_share(F.col(c), pct, least(pct), _w()), *pct_clip) for c in names} | {f"{c}_chg_{k}d": F.col(c) - F.lag(c, k).over(_w()) for c in names for k in changes})
    flags = {f"{c}_low_{int(k * 100)}": (F.col(f"{c}_pct_{pct}") < k).cast("double") for c in extremes for k in low} | {f"{c}_high_{int(k * 100)}": (F.col(f"{c}_pct_{pct}") > k).cast("double") for c in extremes for k in high}
    return out.withColumns(flags) if flags else out


#: Measures of each group whose extremes are flagged.
EXTREMES = {
    "valuation": ("erp", "pe_ttm"), "market_breadth": ("up_ratio", "adv_dec_log"), "leverage_funding": ("rzmre_ratio",), "option_sentiment": ("put_call_log", "iv_atm", "iv_realized_spread"),
    "futures_sentiment": ("fut_ls_log", "fut_near_basis_ann", "fut_next_basis_ann"), "main_moneyflow": ("main_net_ratio",), "macro": ("pmi", "cpi_yoy", "epu_log"),
}


def interactions(pct: int = 756) -> dict[str, tuple[tuple[str, str], Column]]:
    """Products of states: name -> the columns it needs and its value."""
    p = lambda c: f"{c}_pct_{pct}"
    c = F.col
    return {
        "cheap_and_panic": ((p("erp"), p("iv_atm")), c(p("erp")) * c(p("iv_atm"))), "cheap_and_breadth_repair": ((p("erp"), "breadth_thrust"), c(p("erp")) * c("breadth_thrust")), "panic_and_breadth_repair": ((p("iv_atm"), "breadth_thrust"), c(p("iv_atm")) * c("breadth_thrust")),
        "high_leverage_and_weak_breadth": ((p("rzmre_ratio"), p("up_ratio")), c(p("rzmre_ratio")) * (1 - c(p("up_ratio")))), "basis_discount_and_panic": ((p("fut_near_basis_ann"), p("iv_atm")), (1 - c(p("fut_near_basis_ann"))) * c(p("iv_atm"))),
        "pmi_down_and_epu_high": (("pmi_chg_3m", p("epu_log")), F.abs(F.least(c("pmi_chg_3m"), F.when(c("pmi_chg_3m").isNotNull(), F.lit(0.0)))) * c(p("epu_log"))),
    }


def timing_table(index: DataFrame, groups: dict[str, DataFrame], lag: int | dict[str, int] = 1, horizons: tuple[int, ...] = (20,), benchmark: DataFrame | None = None, z: int = 252, pct: int = 756, **decoration) -> DataFrame:
    """The index's sessions with all measures of ``groups`` (decorated on their own days, then ``lag`` sessions late), interactions and future excess returns as labels.

    Macro releases join by the last day on which one was known, the other groups by session.
    """
    out = index.select(T, "index_close")
    for name, frame in groups.items():
        own = decorated(frame, tuple(c for c in EXTREMES.get(name, ()) if c in frame.columns), z, pct, **decoration)
        names = [c for c in own.columns if c != T]
        late = lag.get(name, 1) if isinstance(lag, dict) else lag
        if name == "macro":
            there = known_monthly(index.select(T), own.withColumnRenamed(T, "_known"), "_known", names)
        else:
            there = index.select(T).join(own, T, "left")
        out = out.join(there.select(T, *(F.lag(c, late).over(_w()).alias(c) if late else F.col(c) for c in names)), T)
    for c in ("index_vol_20d", "index_drawdown_60d"):  # the state of risk, of what is known by then
        if c in out.columns:
            out = decorated(out.select(T, c), z=z, pct=pct, changes=(), **{k: v for k, v in decoration.items() if k != "changes"}).select(T, F.col(f"{c}_z_{z}").alias("_z"), F.col(f"{c}_pct_{pct}").alias("_p")).join(out.drop(f"{c}_z_{z}", f"{c}_pct_{pct}"), T).withColumnsRenamed({"_z": f"{c}_z_{z}", "_p": f"{c}_pct_{pct}"})
    made = {n: value for n, (needs, value) in interactions(pct).items() if set(needs) <= set(out.columns)}
    out = out.withColumns(made) if made else out
    ahead = lambda c, h: frames.safe_ratio(F.lead(c, h).over(_w()), F.col(c)) - 1
    if benchmark is not None:
        out = out.join(benchmark.select(T, F.col("index_close").alias("_bench")), T, "left")
    labels = {f"label_{h}d_excess_return": ahead("index_close", h) - (ahead("_bench", h) if benchmark is not None else F.lit(0.0)) for h in horizons}
    out = out.withColumns(labels)
    return out.drop("_bench")
