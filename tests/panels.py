"""Small panels that tests build by hand."""

import datetime
from itertools import product

import pandas as pd

# A bar's columns as multiples of its price or constants, and flags of an ordinary day.
SHAPE = {"raw_open": 1.0, "raw_close": 1.0, "adj_open": 1.0, "adj_close": 1.0, "raw_high": 1.02, "adj_high": 1.02, "raw_low": 0.98, "adj_low": 0.98, "pre_close": 0.995}
CONSTANT = {"adj_factor": 1.0, "volume_shares": 2e6, "amount_cny": 8e7, "pct_change": 0.5, "turnover_rate": 1.5}
FALSE = ("is_suspended", "is_limit_up_open", "is_limit_down_open", "is_st", "is_delisting_period")
TRUE = ("is_factor_eligible", "is_tradeable", "is_liquid")


def day(text):
    return datetime.date.fromisoformat(text)


def sessions(n, start="2024-01-02"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def make_panel(days=8, stocks=4):
    """Every security on every session; prices rise by a quarter a session, from a level of the security's own."""
    panel = pd.DataFrame(list(product(range(stocks), range(days))), columns=["k", "i"])
    price = 20 + 3 * panel["k"] + 0.25 * panel["i"] * (1 + panel["k"] / 8)
    cells = {"trade_date": panel["i"].map(dict(enumerate(sessions(days)))), "ts_code": panel["k"].map("{:06d}.SZ".format)}
    cells |= {c: price * m for c, m in SHAPE.items()} | CONSTANT
    cells |= {"total_mv_cny": 5e8 * (panel["k"] + 2), "industry_l1_code": "I" + (panel["k"] % 2).astype(str), "listing_trade_days": 200 + panel["i"]}
    return pd.DataFrame(cells | dict.fromkeys(FALSE, False) | dict.fromkeys(TRUE, True))


def one_stock(opens, start="2024-01-02"):
    """One security with the given opens, old enough and free to trade."""
    prices = dict.fromkeys(("raw_open", "adj_open", "adj_close"), opens)
    return pd.DataFrame({"trade_date": sessions(len(opens), start), "ts_code": "000001.SZ", "listing_trade_days": 100, **prices, **dict.fromkeys(FALSE, False), **dict.fromkeys(TRUE, True)})
