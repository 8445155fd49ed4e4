"""Supply features, composite recipes and a whole experiment as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import frames
from panelyard.functions.frames import shown
from panelyard.operators import events, execution, models, portfolio, recipes, stats, supply
from panelyard.plans import experiment
from panelyard.plans.formula_queries import MOMENTUM
from panelyard.plans.panel_queries import RETURNS_SQL, W, future, r6, rows
from panelyard.sources import files
from panelyard.sources.market import PANEL_SQL, weekly_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRICES_SQL = f"""{PANEL_SQL}, s0 AS (SELECT *, lag(adj_close) OVER {W} AS previous FROM panel),
s1 AS (SELECT *, ln(adj_close) - ln(previous) AS log_return, adj_close / lag(adj_close, 5) OVER {W} - 1 AS ret_5, adj_close / previous - 1 AS ret_1, ln(1 + turnover_rate / 100) AS lt FROM s0)"""
STAGE_ONE = {
    "log_return": "log_return", "ret_5": "ret_5", "lt": "lt", "close_location": "CASE WHEN adj_high - adj_low > 1e-12 THEN (adj_close - adj_low) / (adj_high - adj_low + 1e-12) ELSE 0.5 END",
    "upper_shadow_ratio": "(adj_high - greatest(adj_open, adj_close)) / (adj_high - adj_low + 1e-12)", "body_ratio": "abs(adj_close - adj_open) / (adj_high - adj_low + 1e-12)", "tick_return": "0.01 / adj_close",
    "intraday_range": "(adj_high - adj_low) / (previous + 1e-12)", "gap_return": "adj_open / previous - 1",
    "log_avg_amount_20": f"CASE WHEN count(amount_cny) OVER {rows('19 PRECEDING', 'CURRENT ROW')} >= 15 THEN ln(1 + avg(amount_cny) OVER {rows('19 PRECEDING', 'CURRENT ROW')}) END",
    "turnover_5": f"CASE WHEN count(turnover_rate) OVER {rows('4 PRECEDING', 'CURRENT ROW')} >= 5 THEN sum(turnover_rate / 100) OVER {rows('4 PRECEDING', 'CURRENT ROW')} END",
}


def supply_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = supply.prices(weekly_panel(spark, sf_dir))
    return p.select("trade_date", "ts_code", *(shown(F.col(c)).alias(c) for c in STAGE_ONE))


def _z(x: str, size: int, least: int) -> str:
    f = rows(f"{size - 1} PRECEDING", "CURRENT ROW")
    return f"CASE WHEN count({x}) OVER {f} >= {least} THEN ({x} - avg({x}) OVER {f}) / nullif(stddev_pop({x}) OVER {f}, 0) END"


def _std(size: int, least: int) -> str:
    f = rows(f"{size - 1} PRECEDING", "CURRENT ROW")
    return f"CASE WHEN count(log_return) OVER {f} >= {least} THEN stddev_samp(log_return) OVER {f} END"


STAGE_TWO = {
    "excess_ret_5": "ret_5 - (coalesce(sum(ret_5) OVER c, 0) - ret_5) / nullif(count(ret_5) OVER c - 1, 0)", "volatility_20": _std(20, 15), "turnover_z_60": _z("lt", 60, 45),
    "market_breadth": "coalesce(avg(CASE WHEN log_return > 0 THEN 1.0 WHEN log_return IS NOT NULL THEN 0.0 END) OVER (PARTITION BY trade_date), 0)",
    "amihud_20": f"CASE WHEN count(log_return) OVER {rows('19 PRECEDING', 'CURRENT ROW')} >= 10 THEN 1e8 * avg(abs(log_return) / (amount_cny + 1e-12)) OVER {rows('19 PRECEDING', 'CURRENT ROW')} END",
}


def supply_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = supply.activity(supply.prices(weekly_panel(spark, sf_dir)))
    return p.select("trade_date", "ts_code", *(shown(F.col(c)).alias(c) for c in STAGE_TWO))


def supply_scarcity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = supply.scarcity(supply.activity(supply.prices(weekly_panel(spark, sf_dir))), window=60, least=40)
    return p.select("trade_date", "ts_code", "volume_residual", "scarcity", "scarcity_slope_5", "volume_residual_mean_5", "conditional_scarcity", "close_quality_scarcity", "persistent_scarcity", "low_volume_rise")


def _recipe(name: str):
    def fn(spark, sf_dir):
        return recipes.scan(weekly_panel(spark, sf_dir), name).withColumn("severity", shown(F.col("severity")))

    return fn


FAILED_SQL = f"""{RETURNS_SQL}, a AS (SELECT *, CASE WHEN count(adj_close) OVER f >= 20 THEN max(adj_close) OVER f END AS hi FROM ret WINDOW f AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, adj_close / nullif(hi, 0) - 1 AS strength FROM a), c AS (SELECT *, max(strength) OVER {rows('5 PRECEDING', '1 PRECEDING')} AS recent FROM b)
SELECT trade_date, ts_code, CAST(NULL AS VARCHAR) AS event_subtype, CASE WHEN recent IS NOT NULL AND strength IS NOT NULL THEN {r6('greatest(recent - strength, 0)')} END AS severity, coalesce(recent > 0 AND strength < 0, false) AS is_event FROM c"""


def _experiment(spark, sf_dir):
    calm = lambda c: frames.rolling(F.col(c), 26, "mean", 1)
    p = weekly_panel(spark, sf_dir).withColumns({"adj_open": calm("adj_open"), "adj_close": calm("adj_close")})
    p = p.withColumn("raw_open", F.col("adj_open")).withColumn("is_suspended", F.lit(False))
    scenarios = spark.createDataFrame([("top5", 5, 2, 20.0), ("top10", 10, 2, 20.0)], "scenario string, top_n int, holding_days int, cost_bps double")
    return experiment.run(p, MOMENTUM, [1, 4], ["is_liquid", "is_tradeable"], scenarios, portfolio.Rules(lot_size=1))


def experiment_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experiment(spark, sf_dir)["tests"]


def experiment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experiment(spark, sf_dir)["quality"]


def experiment_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experiment(spark, sf_dir)["robustness"]


def execution_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calm = lambda c: frames.rolling(F.col(c), 26, "mean", 1)
    p = weekly_panel(spark, sf_dir).withColumns({"adj_open": calm("adj_open"), "adj_close": calm("adj_close")}).withColumn("raw_open", F.col("adj_open")).withColumn("is_suspended", F.lit(False))
    scores = p.select("trade_date", "ts_code", F.pmod(F.xxhash64("trade_date", "ts_code"), F.lit(1000)).cast("double").alias("factor_value"))
    rules = {"cheap": execution.Costs(initial_cash=1e6, lot_size=1, multiplier=0.0), "dear": execution.Costs(initial_cash=1e6, lot_size=1, multiplier=2.0)}
    return execution.ledgers(execution.prepared(portfolio.executable(p, portfolio.Rules())), execution.equal_targets(scores, p, 8, 10), rules)


def exit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weekly_panel(spark, sf_dir)
    v, c = F.col("volume_shares"), F.col("adj_close")
    flags = p.select("trade_date", "ts_code", (v < 30).alias("price_weak"), (c < 1500).alias("diffusion_weak"), (v < 20).alias("relative_weak"), (v < 5).alias("breakdown"), F.rank().over(frames.section().orderBy(F.desc("amount_cny"))).alias("rank"))
    return execution.exit_states(flags).select("trade_date", "ts_code", "price_streak", "dual_streak", "severe_streak", "state")


def _learned(spark, sf_dir, kind: str, label: str = "fwd") -> DataFrame:
    p = future(spark, sf_dir).withColumn("r4", frames.rolling(F.col("step"), 4, "sum")).withColumn("up", (F.col("fwd") > 0).cast("double"))
    rows_ = files.written(p.filter("fwd is not null and r4 is not null").select("trade_date", "ts_code", "step", "r4", "turnover_rate", "log_total_mv", "fwd", "up"), "learned")
    plan = files.written(models.folds(rows_, 150, 100, 2, embargo=1), "folds")
    return models.walk_forward(rows_, ["step", "r4", "turnover_rate", "log_total_mv"], label, plan, kind)


def model_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.daily_ic(_learned(spark, sf_dir, "ridge"), "prediction", "fwd", ["fold"])


def model_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.calibration(_learned(spark, sf_dir, "logistic", "up"), "up")


def model_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.folds(weekly_panel(spark, sf_dir), 100, 50, 2, embargo=1, length=80)


def model_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events.market_regimes(weekly_panel(spark, sf_dir))
    return models.mixture_regimes(m.select("trade_date", "market_return_20d", "market_volatility_20d"), ["market_return_20d", "market_volatility_20d"])


def model_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weekly_panel(spark, sf_dir)
    return models.adjusted_rand(p.select((F.col("volume_shares") > 30).alias("a"), (F.col("amount_cny") > 50000).alias("b")), "a", "b").withColumn("ari", shown(F.col("ari")))


FOLDS_SQL = f"""{PANEL_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS s FROM (SELECT DISTINCT trade_date FROM panel)),
g AS (SELECT CAST(range AS INTEGER) AS fold, 100 + 50 * range AS t FROM range(100) WHERE 100 + 50 * range < (SELECT count(*) FROM cal))
SELECT fold, trade_date, CASE WHEN s >= t AND s < t + 50 THEN 'test' ELSE 'train' END AS part FROM cal, g WHERE (s >= t AND s < t + 50) OR (s < t - 4 AND s >= t - 84)"""
STABILITY_SQL = f"""{PANEL_SQL}, c AS (SELECT volume_shares > 30 AS a, amount_cny > 50000 AS b, CAST(count(*) AS DOUBLE) AS n FROM panel GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS sa, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
SELECT {r6('(s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)')} AS ari FROM s"""

EXIT_SQL = f"""{PANEL_SQL}, a AS (SELECT trade_date, ts_code, volume_shares < 30 AS p, volume_shares < 30 AND adj_close < 1500 AS d, volume_shares < 30 AND adj_close < 1500 AND volume_shares < 20 AND rank() OVER (PARTITION BY trade_date ORDER BY amount_cny DESC) > 10 AS s,
 volume_shares < 5 AS b, volume_shares < 30 OR adj_close < 1500 OR volume_shares < 20 AS weak FROM panel),
i AS (SELECT *, sum(CAST(NOT p AS INTEGER)) OVER {W} AS ip, sum(CAST(NOT d AS INTEGER)) OVER {W} AS id, sum(CAST(NOT s AS INTEGER)) OVER {W} AS iss FROM a),
k AS (SELECT *, CAST(CASE WHEN p THEN sum(CAST(p AS INTEGER)) OVER (PARTITION BY ts_code, ip ORDER BY trade_date) ELSE 0 END AS INTEGER) AS price_streak, CAST(CASE WHEN d THEN sum(CAST(d AS INTEGER)) OVER (PARTITION BY ts_code, id ORDER BY trade_date) ELSE 0 END AS INTEGER) AS dual_streak,
 CAST(CASE WHEN s THEN sum(CAST(s AS INTEGER)) OVER (PARTITION BY ts_code, iss ORDER BY trade_date) ELSE 0 END AS INTEGER) AS severe_streak FROM i)
SELECT trade_date, ts_code, price_streak, dual_streak, severe_streak, CASE WHEN b OR severe_streak >= 2 THEN 'SELL' WHEN dual_streak >= 2 THEN 'REDUCE' WHEN weak THEN 'WATCH' ELSE 'HOLD' END AS state FROM k"""


QUERIES |= {f.__name__: f for f in (supply_prices, supply_activity, supply_scarcity, execution_ledgers, exit_states, model_walk_forward, model_calibration, model_folds, model_regimes, model_stability, experiment_tests, experiment_quality, experiment_robustness)} | {f"recipe_{name}": _recipe(name) for name in recipes.RECIPES}
ORACLES |= {
    "supply_prices": f"{PRICES_SQL} SELECT trade_date, ts_code, {', '.join(f'{r6(x)} AS {n}' for n, x in STAGE_ONE.items())} FROM s1",
    "supply_activity": f"{PRICES_SQL} SELECT trade_date, ts_code, {', '.join(f'{r6(x)} AS {n}' for n, x in STAGE_TWO.items())} FROM s1 WINDOW c AS (PARTITION BY trade_date, industry_l1_code)",
    "recipe_failed_breakout": FAILED_SQL,
    "exit_states": EXIT_SQL,
    "model_folds": FOLDS_SQL,
    "model_stability": STABILITY_SQL,
}
