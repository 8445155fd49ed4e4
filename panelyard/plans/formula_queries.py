"""Every element of the formula language as a query over the weekly panel, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import frames
from panelyard.plans.factor import Factor, compute
from panelyard.sources.market import PANEL_SQL, weekly_panel

W = "(PARTITION BY ts_code ORDER BY trade_date)"


def _full(expr: str, n: int, of: str = "adj_close") -> str:
    frame = f"(PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({of}) OVER {frame} >= {n} THEN {expr} OVER {frame} END"


def _rank(x: str, by: str = "") -> str:
    keys = f"trade_date{by}"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {keys}) END"


def _z(x: str, by: str = "") -> str:
    s = f"(PARTITION BY trade_date{by})"
    return f"({x} - avg({x}) OVER {s}) / nullif(stddev_pop({x}) OVER {s}, 0)"


RET = f"adj_close / lag(adj_close, 1) OVER {W} - 1"

#: name: (formula, fields, rows of history, inner SQL columns, SQL of the value, features)
FORMULAS = {
    "dsl_arithmetic": ("(high - low) / close + 2 * 3 - close ** 0", ["high", "low", "close"], 0, "", "(adj_high - adj_low) / adj_close + 5", {}),
    "dsl_ret": ("ret(close, 4)", ["close"], 4, "", f"adj_close / lag(adj_close, 4) OVER {W} - 1", {}),
    "dsl_lag": ("lag(close, 3)", ["close"], 3, "", f"lag(adj_close, 3) OVER {W}", {}),
    "dsl_delta": ("delta(volume, 2)", ["volume"], 2, "", f"volume_shares - lag(volume_shares, 2) OVER {W}", {}),
    "dsl_mean": ("mean(close, 8)", ["close"], 7, "", _full("avg(adj_close)", 8), {}),
    "dsl_std": ("std(close, window=8)", ["close"], 7, "", _full("stddev_pop(adj_close)", 8), {}),
    "dsl_max": ("max(close, 6)", ["close"], 5, "", _full("max(adj_close)", 6), {}),
    "dsl_min": ("min(close, 6)", ["close"], 5, "", _full("min(adj_close)", 6), {}),
    "dsl_slope": ("slope(close, 10)", ["close"], 9, f", row_number() OVER {W} AS o", _full("regr_slope(adj_close, o)", 10), {}),
    "dsl_cs_rank": ("cs_rank(volume)", ["volume"], 0, "", _rank("volume_shares"), {}),
    "dsl_cs_rank_by": ("cs_rank(close, by=industry)", ["close", "industry"], 0, "", f"CASE WHEN count(adj_close) OVER (PARTITION BY trade_date, industry_l1_code) >= 10 THEN {_rank('adj_close', ', industry_l1_code')} END", {}),
    "dsl_cs_zscore": ("cs_zscore(close)", ["close"], 0, "", _z("adj_close"), {}),
    "dsl_cs_zscore_by": ("cs_zscore(close, by=industry)", ["close", "industry"], 0, "", f"CASE WHEN count(adj_close) OVER (PARTITION BY trade_date, industry_l1_code) >= 10 THEN {_z('adj_close', ', industry_l1_code')} END", {}),
    "dsl_group_mean": ("group_mean(close, by=industry)", ["close", "industry"], 0, "", "CASE WHEN count(adj_close) OVER (PARTITION BY trade_date, industry_l1_code) >= 10 THEN avg(adj_close) OVER (PARTITION BY trade_date, industry_l1_code) END", {}),
    "dsl_scalar": ("clip(log(abs(close - 1500)), 2, upper=6)", ["close"], 0, "", "least(greatest(CASE WHEN abs(adj_close - 1500) > 0 THEN ln(abs(adj_close - 1500)) END, 2), 6)", {}),
    "dsl_where": ("where(ret(close, 1) > 0 and not volume <= 20, close, -close)", ["close", "volume"], 1, f", {RET} AS r", "CASE WHEN coalesce(r > 0, false) AND NOT volume_shares <= 20 THEN adj_close ELSE -adj_close END", {}),
    "dsl_compare": ("where(volume != 20, 1, 0) + where(volume == 30, 1, 0) + where(volume >= 40 or volume < 15, 1, 0)", ["volume"], 0, "", "(CASE WHEN volume_shares <> 20 THEN 1 ELSE 0 END) + (CASE WHEN volume_shares = 30 THEN 1 ELSE 0 END) + (CASE WHEN volume_shares >= 40 OR volume_shares < 15 THEN 1 ELSE 0 END)", {}),
    "dsl_nested": ("cs_rank(mean(step, 4)) - cs_rank(volume)", ["close", "volume"], 4, f", {RET} AS step", None, {"step": "ret(close, 1)"}),
}


def _spec(name: str) -> Factor:
    formula, fields, history, _, _, features = FORMULAS[name]
    return Factor(name, formula, tuple(fields), history, dict(features))


def _query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compute(weekly_panel(spark, sf_dir), _spec(name))
        return out.select("trade_date", "ts_code", frames.shown(F.col("factor_value")).alias("factor_value"), "factor_valid", "invalid_reason")

    return query


def _oracle(name: str) -> str:
    _, _, _, inner, value, _ = FORMULAS[name]
    if name == "dsl_nested":
        source = f"(SELECT *, {_full('avg(step)', 4, 'step')} AS m FROM (SELECT *{inner} FROM panel))"
        value = f"{_rank('m')} - {_rank('volume_shares')}"
    else:
        source = f"(SELECT *{inner} FROM panel)"
    return f"""{PANEL_SQL}, v AS (SELECT trade_date, ts_code, CAST({value} AS DOUBLE) AS x FROM {source})
SELECT trade_date, ts_code, round(x + 1e-9, 6) AS factor_value, x IS NOT NULL AS factor_valid, CASE WHEN x IS NULL THEN 'MISSING_INPUT_OR_LOOKBACK' END AS invalid_reason FROM v"""


#: Declarations of full factors; direction, winsorizing, standardizing and universes are theirs.
MOMENTUM = Factor("momentum", "ret(lagged, window)", ("close",), 5, {"lagged": "lag(close, skip)"}, {"window": 4, "skip": 1}, winsorize="mad", standardize="zscore")
ELIGIBLE = Factor("reversal_eligible", "cs_rank(ret(close, 1))", ("close",), 1, universe="factor_eligible", direction="negative")
INDUSTRY = Factor("industry_liquid", "cs_zscore(ret(close, 2), by=industry_l1_code)", ("close", "industry"), 2, universe="liquid", cross_section="industry", min_group_size=5)


def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(weekly_panel(spark, sf_dir), MOMENTUM).select("trade_date", "ts_code", frames.shown(F.col("factor_value")).alias("factor_value"))


def reversal_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(weekly_panel(spark, sf_dir), ELIGIBLE).select("trade_date", "ts_code", frames.shown(F.col("factor_value")).alias("factor_value"))


def industry_liquid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(weekly_panel(spark, sf_dir), INDUSTRY).select("trade_date", "ts_code", frames.shown(F.col("factor_value")).alias("factor_value"), "group_code")


MOMENTUM_SQL = f"""{PANEL_SQL},
a AS (SELECT *, lag(adj_close, 1) OVER {W} AS lagged FROM panel),
b AS (SELECT *, lagged / lag(lagged, 4) OVER {W} - 1 AS x FROM a),
c AS (SELECT *, median(x) OVER (PARTITION BY trade_date) AS md FROM b),
d AS (SELECT *, median(abs(x - md)) OVER (PARTITION BY trade_date) AS mad FROM c),
e AS (SELECT *, CASE WHEN mad > 0 AND x IS NOT NULL THEN least(greatest(x, md - 5 * mad), md + 5 * mad) ELSE x END AS y FROM d),
f AS (SELECT trade_date, ts_code, {_z('y')} AS z FROM e)"""

QUERIES = {name: _query(name) for name in FORMULAS} | {"factor_momentum": momentum, "factor_eligible_mask": reversal_eligible, "factor_industry_liquid": industry_liquid}

ORACLES = {name: _oracle(name) for name in FORMULAS} | {
    "factor_momentum": f"{MOMENTUM_SQL} SELECT trade_date, ts_code, round(z + 1e-9, 6) AS factor_value FROM f",
    "factor_eligible_mask": f"""{PANEL_SQL}, a AS (SELECT *, CASE WHEN is_factor_eligible THEN {RET} END AS x FROM panel)
SELECT trade_date, ts_code, round(CASE WHEN is_factor_eligible THEN -({_rank('x')}) END + 1e-9, 6) AS factor_value FROM a""",
    "factor_industry_liquid": f"""{PANEL_SQL}, a AS (SELECT *, adj_close / lag(adj_close, 2) OVER {W} - 1 AS x FROM panel),
b AS (SELECT *, CASE WHEN count(x) OVER (PARTITION BY trade_date, industry_l1_code) >= 5 THEN {_z('x', ', industry_l1_code')} END AS z FROM a)
SELECT trade_date, ts_code, round(CASE WHEN is_liquid THEN z END + 1e-9, 6) AS factor_value, industry_l1_code AS group_code FROM b""",
}
