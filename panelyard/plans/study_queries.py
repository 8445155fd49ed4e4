"""Paths, regimes, gates, slices, drift, baskets and buckets as queries over the driver's tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelyard.functions import frames, text
from panelyard.functions.frames import shown
from panelyard.operators import events, gates, joins, paths, regimes, residual, stats, timing, value
from panelyard.plans import panel_queries as base
from panelyard.plans import research_queries as research
from panelyard.plans.experiment import two_sided_p
from panelyard.plans.panel_queries import FUTURE_SQL, IC_SQL, RETURNS_SQL, W, _avg_rank, future, r6, returns
from panelyard.sources.market import PANEL_SQL, table, weekly_panel

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query and its SQL under its function's name."""

    def register(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return register


def said(df, *names: str):
    """``df`` with ``names`` as results are compared."""
    return df.withColumns({n: shown(F.col(n)) for n in names})


NUMBERED_SQL = f"{PANEL_SQL}, num AS (SELECT *, row_number() OVER {W} AS ordinal FROM panel)"


# Paths

_PATH = """, pth{h} AS (SELECT trade_date, ts_code, industry_l1_code, ordinal, {h} AS horizon, signal, is_tradeable, lead(trade_date, 1) OVER {W} AS entry_date, lead(adj_open, 1) OVER {W} AS entry, lead(is_tradeable, 1) OVER {W} AS buyable,
 lead(trade_date, {p}) OVER {W} AS planned_exit_date, lead(adj_open, {p}) OVER {W} AS planned_open,
 min(CASE WHEN is_liquid THEN ordinal END) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {p} FOLLOWING AND UNBOUNDED FOLLOWING) AS sold,
 max(adj_high) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {p} FOLLOWING) AS high, min(adj_low) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {p} FOLLOWING) AS low FROM sig)"""


@query(
    f"{RETURNS_SQL}, sig AS (SELECT *, row_number() OVER {W} AS ordinal, coalesce(step > 0.2, false) AS signal FROM ret)"
    + "".join(_PATH.format(h=h, p=h + 1, W=W) for h in (2, 5))
    + f""", pth AS (SELECT * FROM pth2 UNION ALL SELECT * FROM pth5), b AS (SELECT *, planned_open / entry - 1 AS planned, avg(planned_open / entry - 1) OVER (PARTITION BY trade_date, industry_l1_code, horizon) AS bench FROM pth)
SELECT b.trade_date, b.ts_code, b.industry_l1_code, horizon, entry_date, planned_exit_date, s.trade_date AS actual_exit_date, sold - b.ordinal - horizon - 1 AS exit_delay, {r6('s.adj_open / entry - 1')} AS gross_return, {r6('planned')} AS planned_gross_return,
 {r6('planned - bench')} AS group_excess, {r6('high / entry - 1')} AS mfe, {r6('low / entry - 1')} AS mae, {r6('(s.adj_open / entry) * (1 - 0.001) - 1 - 0.001')} AS net_return
FROM b JOIN sig s ON s.ts_code = b.ts_code AND s.ordinal = b.sold WHERE b.signal AND b.buyable AND planned IS NOT NULL"""
)
def path_evaluation(spark, sf_dir):
    p = returns(spark, sf_dir).withColumn("is_buyable", F.col("is_tradeable")).withColumn("is_sellable", F.col("is_liquid"))
    found = paths.evaluate_paths(p, F.coalesce(F.col("step") > 0.2, F.lit(False)), [2, 5], 20.0)
    return said(found, "gross_return", "planned_gross_return", "group_excess", "mfe", "mae", "net_return")


_LOWEST = "min(adj_low) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query(f"""{NUMBERED_SQL}, ev AS (SELECT ts_code, trade_date AS origin_date, ordinal AS origin, adj_low AS level, adj_low * 0.05 AS zone FROM (SELECT *, {_LOWEST} AS lowest FROM num) WHERE adj_low = lowest),
hit AS (SELECT ev.*, n.trade_date, n.ordinal - origin AS age, adj_low, adj_close, row_number() OVER (PARTITION BY ev.ts_code, origin ORDER BY n.ordinal) AS k FROM ev JOIN num n ON n.ts_code = ev.ts_code AND n.ordinal > origin AND n.ordinal <= origin + 15 AND n.adj_low <= level + zone AND n.adj_high >= level - zone)
SELECT ts_code, origin_date, trade_date, age, {r6('level')} AS level, {r6('zone')} AS zone, {r6('(level - adj_low) / zone')} AS penetration, {r6('(adj_close - level) / zone')} AS reclaim, adj_close > level AS reclaimed, adj_close > level AND adj_low < level AS false_break FROM hit WHERE k = 1""")
def path_first_touch(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    lows = p.withColumn("lowest", frames.rolling(F.col("adj_low"), 12, "min", 1)).filter("adj_low = lowest")
    found = paths.first_touch(p, lows.select("ts_code", "trade_date", F.col("adj_low").alias("level"), (F.col("adj_low") * 0.05).alias("zone")), 15)
    return said(found, "level", "zone", "penetration", "reclaim")


PIVOT_SQL = f"""{NUMBERED_SQL}, piv AS (SELECT trade_date, ts_code, ordinal, CASE WHEN ordinal >= 5 THEN (min(struct_pack(l := adj_low, o := ordinal)) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)).o END AS b,
 CASE WHEN ordinal > 20 THEN (min(struct_pack(l := adj_low, o := ordinal)) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 5 PRECEDING)).o END AS before FROM num),
chain AS (SELECT x.trade_date, x.ts_code, x.ordinal, x.b, y.before AS a, z.before AS p FROM piv x LEFT JOIN piv y ON y.ts_code = x.ts_code AND y.ordinal = x.b LEFT JOIN piv z ON z.ts_code = x.ts_code AND z.ordinal = y.before)"""


@query(f"{PIVOT_SQL} SELECT * FROM chain")
def path_causal_pivots(spark, sf_dir):
    return paths.causal_pivots(weekly_panel(spark, sf_dir))


@query(f"{PIVOT_SQL} SELECT trade_date, ts_code, a AS start, b AS \"end\", (SELECT max(adj_high) FROM num n WHERE n.ts_code = c.ts_code AND n.ordinal > a AND n.ordinal < b) AS neckline FROM chain c WHERE a IS NOT NULL")
def path_range_maximum(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    spans = paths.causal_pivots(p).filter("a is not null").select("trade_date", "ts_code", F.col("a").alias("start"), F.col("b").alias("end"))
    return paths.range_maximum(p, "adj_high", spans, 32, "neckline")


@query(f"""{RETURNS_SQL}, num AS (SELECT *, row_number() OVER {W} AS ordinal FROM ret), pos AS (SELECT ts_code, trade_date AS signal_date, ordinal + 1 AS entered FROM num WHERE step < -0.25),
st AS (SELECT ts_code, signal_date, entered, k AS holding_age, entered + k AS nx, entered + 6 AS ex FROM pos, (VALUES (1), (2), (3), (4), (5)) v(k)),
j AS (SELECT st.*, n.trade_date AS next_open_date, n.adj_open AS p0, e.trade_date AS label_available_date, e.adj_open / n.adj_open - 1 AS rem, (SELECT min(t.adj_open) FROM num t WHERE t.ts_code = st.ts_code AND t.ordinal > nx AND t.ordinal <= least(nx + 3, ex)) / n.adj_open - 1 AS worst, a.trade_date AS tail_available_date
 FROM st JOIN num n ON n.ts_code = st.ts_code AND n.ordinal = nx JOIN num e ON e.ts_code = st.ts_code AND e.ordinal = ex JOIN num a ON a.ts_code = st.ts_code AND a.ordinal = least(nx + 3, ex))
SELECT ts_code, signal_date, holding_age, 6 - holding_age AS days_remaining, next_open_date, label_available_date, {r6('rem')} AS remaining_return, {r6('-rem - 0.002')} AS exit_advantage, {r6('worst')} AS tail_worst, worst <= -0.1 AS tail_event, tail_available_date FROM j""")
def path_held_states(spark, sf_dir):
    p = returns(spark, sf_dir)
    return said(paths.held_states(p, p.filter("step < -0.25").select("ts_code", "trade_date"), 6, 3, 20.0, -0.1), "remaining_return", "exit_advantage", "tail_worst")


# Regimes

STOCKS_SQL = f"{RETURNS_SQL}, st AS (SELECT *, step AS one, adj_close / lag(adj_close, 20) OVER {W} - 1 AS many, lag(total_mv_cny, 1) OVER {W} AS cap_before FROM ret)"


def _grown(x: str, n: int) -> str:
    frame = f"(ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} >= {n} THEN exp(sum(ln(1 + greatest({x}, -0.999999))) OVER {frame}) - 1 END"


@query(f"""{STOCKS_SQL}, dd AS (SELECT trade_date, avg(CASE WHEN many > 0 THEN 1.0 WHEN many IS NOT NULL THEN 0.0 END) AS market_breadth, sum(one * cap_before) FILTER (cap_before > 0) / nullif(sum(cap_before) FILTER (cap_before > 0 AND one IS NOT NULL), 0) AS step FROM st WHERE is_tradeable GROUP BY 1),
m AS (SELECT trade_date, market_breadth, market_breadth - lag(market_breadth, 5) OVER (ORDER BY trade_date) AS breadth_change, {_grown('step', 20)} AS market_return FROM dd)
SELECT trade_date, {r6('market_breadth')} AS market_breadth, {r6('breadth_change')} AS breadth_change, {r6('market_return')} AS market_return,
 CASE WHEN market_return > 0 AND breadth_change > 0 AND market_breadth >= 0.3 AND market_breadth < 0.7 THEN 'repair' WHEN market_return > 0 AND market_breadth >= 0.7 THEN 'overheat' ELSE 'retreat' END AS regime FROM m""")
def regime_breadth(spark, sf_dir):
    return said(regimes.breadth_regimes(weekly_panel(spark, sf_dir), cap="total_mv_cny"), "market_breadth", "breadth_change", "market_return")


def _edge(k: int) -> str:
    share = k * (1.0 / 3) * 100 / 100
    x = f"((n - 1) * {share!r}::DOUBLE)"
    low, high = f"(floor({x}) + 1)", f"least(floor({x}) + 2, n)"
    part = f"({x} - floor({x}))"
    return f"CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part} ELSE {high} - ({high} - {low}) * (1 - {part}) END"


@query(f"""{STOCKS_SQL}, am AS (SELECT *, avg(amount_cny) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(amount_cny) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ar, row_number() OVER {W} AS k FROM st),
br AS (SELECT trade_date, avg(CASE WHEN many > 0 THEN 1.0 ELSE 0.0 END) AS market_breadth, median(CASE WHEN k >= 20 THEN ar END) AS amount_ratio FROM am WHERE is_tradeable AND many IS NOT NULL GROUP BY 1),
o0 AS (SELECT trade_date, ts_code, one, lag(total_mv_cny, 1) OVER {W} AS cap FROM st WHERE is_tradeable AND one IS NOT NULL AND total_mv_cny > 0),
o1 AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY cap, ts_code) AS r, count(*) OVER (PARTITION BY trade_date) AS n FROM o0 WHERE cap > 0),
o2 AS (SELECT *, 1 + CAST(({_edge(1)}) < r AS INT) + CAST(({_edge(2)}) < r AS INT) AS third FROM o1),
dy AS (SELECT trade_date, sum(one * cap) / sum(cap) AS cap_step, avg(one) FILTER (third = 1) - avg(one) FILTER (third = 3) AS size_step FROM o2 GROUP BY 1),
m0 AS (SELECT trade_date, market_breadth, amount_ratio, cap_step, size_step FROM br FULL JOIN dy USING (trade_date)),
m AS (SELECT *, market_breadth - lag(market_breadth, 5) OVER (ORDER BY trade_date) AS breadth_change, {_grown('cap_step', 20)} AS market_return, {_grown('size_step', 10)} AS size_spread,
 CASE WHEN count(market_breadth) OVER pr >= 60 THEN quantile_cont(market_breadth, 0.8) OVER pr END AS breadth_high FROM m0 WINDOW pr AS (ORDER BY trade_date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING))
SELECT trade_date, {r6('market_breadth')} AS market_breadth, {r6('amount_ratio')} AS amount_ratio, {r6('breadth_change')} AS breadth_change, {r6('market_return')} AS market_return, {r6('size_spread')} AS size_spread,
 CASE WHEN market_return > 0 AND market_breadth >= breadth_high AND amount_ratio >= 1.15 THEN 'overheat' WHEN market_return <= 0 AND breadth_change <= 0 THEN 'retreat' WHEN market_return > 0 AND breadth_change > 0 AND size_spread > 0 THEN 'repair' WHEN market_return > 0 AND size_spread <= 0 THEN 'divergence' ELSE 'neutral' END AS regime FROM m""")
def regime_document(spark, sf_dir):
    return said(regimes.document_regimes(weekly_panel(spark, sf_dir), cap="total_mv_cny"), "market_breadth", "amount_ratio", "breadth_change", "market_return", "size_spread")


# Judging

TESTS_SQL = f"""{IC_SQL}, tests AS (SELECT year(trade_date) AS year, avg(ic) AS mean, avg(CASE WHEN ic > 1e-12 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS positive_ratio, count(ic) / 1000.0 AS fdr_q, stddev_samp(ic) AS top_bottom_mean FROM ic GROUP BY 1)"""


def _tests(spark, sf_dir):
    ic = base._ic(spark, sf_dir).withColumn("year", F.year("trade_date"))
    return ic.groupBy("year").agg(F.avg("ic").alias("mean"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"), (F.count("ic") / 1000.0).alias("fdr_q"), F.stddev_samp("ic").alias("top_bottom_mean"))


def _gate_sql(where: str, mean: str, positive: str, q: str, tail: str) -> str:
    ok = f"coalesce(mean >= {mean}, false) AND coalesce(positive_ratio >= {positive}, false) AND {'true' if q == 'null' else f'coalesce(fdr_q <= {q}, false)'}"
    return f"""SELECT count(*) AS found, {r6('max(mean)')} AS mean, {r6('max(positive_ratio)')} AS positive_ratio, {r6('max(fdr_q)')} AS fdr_q, coalesce(bool_or(coalesce(mean >= {mean}, false)), false) AS mean_ok, coalesce(bool_or(coalesce(positive_ratio >= {positive}, false)), false) AS positive_ok,
 count(*) = 1 AND bool_or(({ok}) OR ({tail} AND top_bottom_mean > 0)) AS passed, count(*) = 1 AND bool_or(NOT ({ok}) AND {tail} AND top_bottom_mean > 0) AS tail_used FROM tests {where}"""


@query(f"{TESTS_SQL} {_gate_sql('WHERE year = 1995', '-1', '0.1', '0.06', 'false')} UNION ALL {_gate_sql('WHERE year = 1996', '0.9', '0.1', '0.06', 'true')} UNION ALL {_gate_sql('', '-1', '0', 'null', 'false')}")
def gate_evaluation(spark, sf_dir):
    t = _tests(spark, sf_dir)
    made = [gates.gate(t, {"year": 1995}, -1.0, 0.1, 0.06), gates.gate(t, {"year": 1996}, 0.9, 0.1, 0.06, tail=True), gates.gate(t, {}, -1.0, 0.0)]
    whole = made[0].unionByName(made[1]).unionByName(made[2])
    return said(whole.select("found", "mean", "positive_ratio", "fdr_q", "mean_ok", "positive_ok", "passed", "tail_used"), "mean", "positive_ratio", "fdr_q")


@query(f"""{IC_SQL}, wi AS (SELECT trade_date, ic * 0.4 - 0.01 AS w FROM ic WHERE ic IS NOT NULL), al AS (SELECT trade_date, ic, w, w - ic AS delta FROM ic JOIN wi USING (trade_date)), c AS (SELECT *, delta - avg(delta) OVER () AS d FROM al),
pp AS (SELECT ic, w, delta, d * d AS p0, d * lag(d, 1) OVER (ORDER BY trade_date) AS p1 FROM c),
s AS (SELECT count(*) AS days, avg(ic) AS whole_mean, avg(w) AS within_mean, avg(delta) AS delta_mean, avg(delta) / sqrt((sum(p0) + 2 * 0.5 * coalesce(sum(p1), 0)) / count(*) / count(*)) AS nw_t FROM pp)
SELECT days, {r6('whole_mean')} AS whole_mean, {r6('within_mean')} AS within_mean, {r6('delta_mean')} AS delta_mean, {r6('nw_t')} AS nw_t, {r6('CASE WHEN whole_mean > 0 THEN within_mean / whole_mean END')} AS retention,
 CASE WHEN days < 60 THEN 'insufficient_overlap' WHEN whole_mean <= 0 THEN 'market_gate_not_supported' WHEN within_mean / whole_mean < 0.5 AND delta_mean < 0 AND abs(nw_t) >= 1.6448536 THEN 'supports_cross_section_composition' WHEN within_mean / whole_mean >= 0.5 THEN 'weakens_cross_section_composition' ELSE 'inconclusive' END AS classification FROM s""")
def composition_effect(spark, sf_dir):
    ic = base._ic(spark, sf_dir)
    found = gates.composition_effect(ic, ic.withColumn("ic", F.col("ic") * 0.4 - 0.01), 2, two_sided_p)
    return said(found.drop("p_value"), "whole_mean", "within_mean", "delta_mean", "nw_t", "retention")


@query(f"""{RETURNS_SQL}, e AS (SELECT trade_date, ts_code, step AS condition_value, count(*) OVER (PARTITION BY trade_date) AS n, ({_avg_rank('step')}) / count(*) OVER (PARTITION BY trade_date) AS p FROM ret WHERE is_liquid AND step IS NOT NULL), q AS (SELECT *, CAST(least(greatest(ceil(p * 5), 1), 5) AS INT) AS condition_quantile FROM e)
SELECT trade_date, ts_code, {r6('condition_value')} AS condition_value, condition_quantile, n >= 20 AND condition_quantile IN (1, 5) AS selection_eligible FROM q""")
def condition_membership(spark, sf_dir):
    return said(gates.condition_membership(returns(spark, sf_dir), "step", "is_liquid", 5, [1, 5], 20), "condition_value")


def _bucket_sql(x: str) -> str:
    return f"greatest(len(list_filter(list_distinct(quantile_cont({x}, [0, 0.2, 0.4, 0.6, 0.8, 1]) OVER (PARTITION BY trade_date)), lambda e: e < {x})), 1)"


@query(f"""{FUTURE_SQL}, cl AS (SELECT trade_date, step, turnover_rate, fwd, count(*) OVER (PARTITION BY trade_date) AS n FROM fut WHERE step IS NOT NULL AND turnover_rate IS NOT NULL AND fwd IS NOT NULL), bk AS (SELECT trade_date, fwd, {_bucket_sql('step')} AS a, {_bucket_sql('turnover_rate')} AS b FROM cl WHERE n >= 20),
dm AS (SELECT trade_date, a, b, avg(fwd) AS m FROM bk GROUP BY ALL) SELECT CAST(a AS INT) AS row_bucket, CAST(b AS INT) AS column_bucket, {r6('avg(m)')} AS mean_return, count(*) AS days FROM dm GROUP BY a, b""")
def two_way_quantiles(spark, sf_dir):
    return said(gates.two_way_table(future(spark, sf_dir), "step", "turnover_rate", "fwd"), "mean_return")


@query(f"""{FUTURE_SQL}, f2 AS (SELECT *, lead(adj_open, 6) OVER {W} / lead(adj_open, 1) OVER {W} - 1 AS fwd5 FROM fut), rk AS (SELECT trade_date, fwd, fwd5, CAST(least(greatest(ceil(row_number() OVER (PARTITION BY trade_date ORDER BY step, ts_code) / count(*) OVER (PARTITION BY trade_date) * 10), 1), 10) AS INT) AS decile FROM f2 WHERE step IS NOT NULL),
l AS (SELECT trade_date, decile, 2 AS horizon, fwd AS y FROM rk UNION ALL SELECT trade_date, decile, 5, fwd5 FROM rk), dm AS (SELECT horizon, decile, trade_date, avg(y) AS m FROM l GROUP BY ALL HAVING avg(y) IS NOT NULL)
SELECT horizon, decile, {r6('avg(m)')} AS average_return, count(*) AS days, {r6('ln(pow(1 + avg(m), 252.0 / horizon))')} AS log_annualized FROM dm GROUP BY horizon, decile""")
def decile_returns(spark, sf_dir):
    p = future(spark, sf_dir).withColumn("fwd5", base.stats.forward_open_return(5))
    found = gates.decile_returns(p, "step", {2: "fwd", 5: "fwd5"})
    return said(found.withColumn("log_annualized", F.ln(F.col("annualized_return") + 1)).drop("annualized_return"), "average_return", "log_annualized")


_SCORES = {"single_step": "step", "single_turnover": "turnover_rate", "pair": "step + turnover_rate"}
_SLICES = {"all": "true", "rising": "step > 0", "falling": "step <= 0", "liquid": "is_liquid", "large": "log_total_mv >= 15"}


@query(f"""{FUTURE_SQL}, f2 AS (SELECT *, lead(adj_open, 6) OVER {W} / lead(adj_open, 1) OVER {W} - 1 AS fwd5 FROM fut), sc AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS score, {x} AS x FROM f2" for n, x in _SCORES.items())}),
sl AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS condition FROM sc WHERE {x}" for n, x in _SLICES.items())}), ho AS (SELECT trade_date, score, condition, x, 2 AS horizon, fwd AS y FROM sl UNION ALL SELECT trade_date, score, condition, x, 5, fwd5 FROM sl),
pr AS (SELECT trade_date, score, condition, horizon, {_avg_rank('x', 'trade_date, score, condition, horizon')} AS a, {_avg_rank('y', 'trade_date, score, condition, horizon')} AS b FROM ho WHERE x IS NOT NULL AND y IS NOT NULL),
di AS (SELECT score, condition, horizon, trade_date, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM pr GROUP BY ALL)
SELECT score, condition, horizon, count(ic) AS days, {r6('avg(ic)')} AS mean FROM di GROUP BY ALL""")
def conditional_grid(spark, sf_dir):
    p = future(spark, sf_dir).withColumn("fwd5", base.stats.forward_open_return(5))
    made = gates.conditional_grid(p, {n: F.expr(x) for n, x in _SCORES.items()}, {n: F.expr(x) for n, x in _SLICES.items()}, {2: "fwd", 5: "fwd5"})
    return said(made.groupBy("score", "condition", "horizon").agg(F.count("ic").alias("days"), F.avg("ic").alias("mean")), "mean")


@query(f"""{FUTURE_SQL}, pr AS (SELECT industry_l1_code AS g, trade_date, {_avg_rank('step', 'trade_date, industry_l1_code')} AS a, {_avg_rank('fwd', 'trade_date, industry_l1_code')} AS b FROM fut WHERE step IS NOT NULL AND fwd IS NOT NULL), di AS (SELECT g, trade_date, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS v FROM pr GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY trade_date DESC) AS k FROM di WHERE v IS NOT NULL QUALIFY k <= 150), ba AS (SELECT g, avg(v) AS mean, median(v) AS center, stddev_pop(v) AS sd FROM k WHERE k > 30 GROUP BY 1),
ma AS (SELECT g, 1.4826 * median(abs(v - center)) AS mad FROM k JOIN ba USING (g) WHERE k > 30 GROUP BY 1), sc AS (SELECT g, mean, CASE WHEN mad > 1e-12 THEN mad ELSE sd END AS scale FROM ba JOIN ma USING (g)),
re AS (SELECT *, avg(v) OVER (PARTITION BY g) - mean AS delta, count(*) OVER (PARTITION BY g) AS n, abs(sum((v - mean) / scale) OVER (PARTITION BY g ORDER BY trade_date)) AS walk, CASE WHEN count(*) OVER t >= 10 THEN avg(v) OVER t END AS smooth FROM k JOIN sc USING (g) WHERE k <= 30 WINDOW t AS (PARTITION BY g ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
mo AS (SELECT *, coalesce((smooth - mean) * CASE WHEN delta >= 0 THEN 1 ELSE -1 END > scale / {math.sqrt(10)!r}, false) AS moved FROM re),
ou AS (SELECT g AS industry_l1_code, any_value(mean) AS baseline_mean, avg(v) AS recent_mean, count(*) AS recent_days, any_value(delta) AS delta, any_value(delta) / (any_value(scale) / sqrt(any_value(n))) AS robust_z, max(walk) / sqrt(any_value(n)) AS cusum, coalesce(min(CASE WHEN NOT moved THEN k END) - 1, any_value(n)) AS persistence_days FROM mo GROUP BY 1), md AS (SELECT g AS industry_l1_code, avg(v) FILTER (k <= 60) AS medium_mean, count(*) FILTER (k > 30) AS baseline_days FROM k GROUP BY 1)
SELECT industry_l1_code, baseline_days, recent_days, {r6('baseline_mean')} AS baseline_mean, {r6('medium_mean')} AS medium_mean, {r6('recent_mean')} AS recent_mean, {r6('delta')} AS delta, {r6('robust_z')} AS robust_z, {r6('cusum')} AS cusum, persistence_days,
 CASE WHEN delta > 0 THEN 'strengthening' WHEN delta < 0 THEN 'weakening' ELSE 'none' END AS direction, coalesce(abs(robust_z) >= 0.2 AND persistence_days >= 1 AND recent_days >= 20, false) AS is_drift FROM ou JOIN md USING (industry_l1_code)""")
def relation_drift(spark, sf_dir):
    ic = base.stats.daily_ic(future(spark, sf_dir), "step", "fwd", ["industry_l1_code"])
    return said(gates.relation_drift(ic, ["industry_l1_code"], "ic", 30, 120, threshold=0.2, persistence=1, least_recent=20), "baseline_mean", "medium_mean", "recent_mean", "delta", "robust_z", "cusum")


@query(f"""{RETURNS_SQL}, dd AS (SELECT industry_l1_code, trade_date, coalesce(avg(CASE WHEN step IS NOT NULL THEN greatest(least(step, 0.05), -0.05) END), 0) AS s, coalesce(avg(CASE WHEN step IS NOT NULL THEN greatest(least(step, 0.01), -0.01) END), 0) AS b FROM ret GROUP BY ALL), nv AS (SELECT *, year(trade_date) AS year, exp(sum(ln(1 + s)) OVER y) AS nav FROM dd WINDOW y AS (PARTITION BY industry_l1_code, year(trade_date) ORDER BY trade_date)),
fl AS (SELECT *, nav / max(nav) OVER (PARTITION BY industry_l1_code, year ORDER BY trade_date) - 1 AS fall FROM nv),
ys AS (SELECT industry_l1_code, year, exp(sum(ln(1 + s))) - 1 AS strategy_return, exp(sum(ln(1 + b))) - 1 AS benchmark_return, stddev_samp(s) * sqrt(252) AS vol, min(fall) AS max_drawdown, count(*) AS days FROM fl GROUP BY ALL)
SELECT industry_l1_code, year, {r6('strategy_return')} AS strategy_return, {r6('benchmark_return')} AS benchmark_return, {r6('max_drawdown')} AS max_drawdown, days, {r6('strategy_return - benchmark_return')} AS excess_return, {r6('CASE WHEN vol > 0 THEN strategy_return / vol END')} AS sharpe, {r6('CASE WHEN max_drawdown < -1e-12 THEN strategy_return / abs(max_drawdown) END')} AS calmar FROM ys""")
def year_slices(spark, sf_dir):
    clip = lambda k: F.coalesce(F.avg(F.when(F.col("step").isNotNull(), F.greatest(F.least("step", F.lit(k)), F.lit(-k)))), F.lit(0.0))
    daily = returns(spark, sf_dir).groupBy("industry_l1_code", "trade_date").agg(clip(0.05).alias("s"), clip(0.01).alias("b"))
    return said(gates.year_slices(daily, ["industry_l1_code"], "s", "b"), "strategy_return", "benchmark_return", "max_drawdown", "excess_return", "sharpe", "calmar")


@query(f"{FUTURE_SQL} SELECT industry_l2_code, {r6('(sum(turnover_rate * fwd) + 50 * (SELECT avg(fwd) FROM fut)) / (sum(turnover_rate) + 50)')} AS utility FROM fut WHERE fwd IS NOT NULL GROUP BY 1")
def shrunk_utility(spark, sf_dir):
    return said(gates.shrunk_utility(future(spark, sf_dir), ["industry_l2_code"], "turnover_rate", "fwd", 50.0), "utility")


@query(f"""{FUTURE_SQL}, me AS (SELECT trade_date, industry_l2_code AS concept_code, ts_code, adj_close / lag(adj_close, 8) OVER {W} - 1 AS momentum, fwd FROM fut), co AS (SELECT trade_date, concept_code, round(avg(momentum), 9) AS momentum FROM me GROUP BY ALL),
ch AS (SELECT trade_date, concept_code, momentum AS concept_momentum FROM co WHERE momentum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY momentum DESC, concept_code) <= 10),
pk AS (SELECT me.* FROM me JOIN ch USING (trade_date, concept_code) WHERE momentum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date, concept_code ORDER BY momentum DESC, ts_code) <= 3),
bs AS (SELECT trade_date, concept_code, count(*) AS basket_stocks, avg(momentum) AS core_momentum, stddev_pop(momentum) AS core_spread, CASE WHEN count(fwd) >= 2 THEN avg(fwd) - 0.003 END AS net FROM pk GROUP BY ALL),
al AS (SELECT ch.*, basket_stocks, core_momentum, core_spread, net, row_number() OVER v AS r, count(net) OVER (PARTITION BY trade_date) AS n, sum(CASE WHEN basket_stocks >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY trade_date) AS usable FROM ch LEFT JOIN bs USING (trade_date, concept_code) WINDOW v AS (PARTITION BY trade_date, net IS NOT NULL ORDER BY net, concept_code))
SELECT trade_date, concept_code, {r6('concept_momentum')} AS concept_momentum, basket_stocks, {r6('core_momentum')} AS core_momentum, {r6('core_spread')} AS core_spread, {r6('net')} AS net_forward, CASE WHEN net IS NOT NULL AND n >= 5 THEN CAST(least(ceil(r / n * 5) - 1, 4) AS INT) END AS relevance FROM al WHERE usable >= 5""")
def basket_labels(spark, sf_dir):
    p = future(spark, sf_dir).withColumn("momentum", frames.safe_ratio(F.col("adj_close"), F.lag("adj_close", 8).over(frames.history())) - 1)
    members = p.select("trade_date", F.col("industry_l2_code").alias("concept_code"), "ts_code", "momentum", F.col("fwd").alias("forward"))
    concepts = members.groupBy("trade_date", "concept_code").agg(F.round(F.avg("momentum"), 9).alias("momentum"))
    return said(gates.basket_labels(concepts, members, 10, 3, 2, 5, 30.0), "concept_momentum", "core_momentum", "core_spread", "net_forward")


@query(f"""WITH c AS (SELECT c_custkey, greatest(c_acctbal, 0) AS price, greatest(c_custkey % 7 - 2, 0) * 100.0 AS x, greatest(c_nationkey - 10, 0) * 50.0 AS y FROM customer), s AS (SELECT *, CASE WHEN x + y > 0 THEN least((x + y) / (price + x + y), 0.35) ELSE 0.0 END AS share FROM c)
SELECT c_custkey, {r6('1 - share')} AS w_price, {r6('CASE WHEN x + y > 0 THEN x / (x + y) * share ELSE 0.0 END')} AS w_x, {r6('CASE WHEN x + y > 0 THEN y / (x + y) * share ELSE 0.0 END')} AS w_y FROM s""")
def blend_weights(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("price"), ((F.col("c_custkey") % 7 - 2) * 100.0).alias("x"), ((F.col("c_nationkey") - 10) * 50.0).alias("y"))
    return said(gates.blend_weights(c, ["c_custkey"], "price", ["x", "y"], 0.35), "w_price", "w_x", "w_y")


# Long-run variances, regimes of a relation, names, editions, value features


def _hac_sql(terms: str, n: str = "sum(1)") -> str:
    lags = ", ".join(f"d * lag(d, {k}) OVER (PARTITION BY g ORDER BY trade_date) AS p{k}" for k in range(1, 13))
    return f"""{IC_SQL}, v AS (SELECT year(trade_date) AS g, trade_date, ic FROM ic WHERE ic IS NOT NULL), c AS (SELECT *, ic - avg(ic) OVER (PARTITION BY g) AS d FROM v), p AS (SELECT g, ic, d * d AS p0, {lags} FROM c),
s AS (SELECT g, count(*) AS n, avg(ic) AS mean, sum(p0) AS s0, {', '.join(f'coalesce(sum(p{k}), 0) AS s{k}' for k in range(1, 13))} FROM p GROUP BY 1) SELECT g AS year, n, {r6('mean')} AS mean, {r6(f'CASE WHEN n >= 3 THEN mean / nullif(sqrt(greatest({terms}, 1e-12) / n), 0) END')} AS nw_t FROM s"""


_AUTO = "least(floor(4 * pow(n / 100.0, 2.0 / 9)), 12, n - 1)"


def _hac(spark, sf_dir, **params):
    ic = base._ic(spark, sf_dir).withColumn("year", F.year("trade_date"))
    return said(stats.newey_west_sums(ic, ["year"], least=3, floor=1e-12, **params), "mean", "nw_t")


@query(_hac_sql("s0 / n + " + " + ".join(f"CASE WHEN {k} <= {_AUTO} THEN 2 * (1 - {k} / ({_AUTO} + 1)) * s{k} / n ELSE 0 END" for k in range(1, 13))))
def stat_newey_west_auto(spark, sf_dir):
    return _hac(spark, sf_dir, lags=None)


@query(_hac_sql("s0 / n + " + " + ".join(f"CASE WHEN {k} <= n - 1 THEN 2 * s{k} / (n - {k}) ELSE 0 END" for k in range(1, 5))))
def stat_newey_west_flat(spark, sf_dir):
    return _hac(spark, sf_dir, lags=4, kernel="flat")


@query(_hac_sql("s0 / n + " + " + ".join(f"CASE WHEN {k} <= n - 1 THEN 2 * (1 - {k} / 11.0) * s{k} / n ELSE 0 END" for k in range(1, 11))))
def stat_newey_west_untruncated(spark, sf_dir):
    return _hac(spark, sf_dir, lags=10, truncate=False)


@query(f"""{FUTURE_SQL}, d AS (SELECT industry_l1_code, trade_date, avg(fwd) AS y, avg(turnover_rate) AS x FROM fut GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY industry_l1_code ORDER BY trade_date DESC) AS k FROM d WHERE y IS NOT NULL AND x IS NOT NULL),
f AS (SELECT industry_l1_code, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM u WHERE k > 30 AND k <= 180 GROUP BY 1)
SELECT d.industry_l1_code, d.trade_date, {r6('CASE WHEN n >= 60 THEN y - a - b * x ELSE y END')} AS residual FROM d LEFT JOIN f USING (industry_l1_code)""")
def residual_regime(spark, sf_dir):
    d = future(spark, sf_dir).groupBy("industry_l1_code", "trade_date").agg(F.avg("fwd").alias("y"), F.avg("turnover_rate").alias("x"))
    return said(residual.regime_residual(d, ["industry_l1_code"], "y", ["x"], 150, 30, "residual"), "residual")


_THEMES = (("metal", ("STEEL", "TIN", "COPPER")), ("coated", ("PLATED", "ANODIZED")), ("plain", ("BRUSHED", "BURNISHED", "POLISHED")))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(upper(p_type), {k!r})' for k in ks)} THEN '{n}'" for n, ks in _THEMES) + " ELSE 'other_theme' END AS theme, regexp_replace(replace(replace(replace(upper(p_name), '100%', ''), '(', ''), ')', ''), '[^0-9A-Z]', '', 'g') AS name_key FROM part")
def text_themes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.theme(F.upper("p_type"), _THEMES).alias("theme"), text.benchmark_key(F.col("p_name")).alias("name_key"))


@query(f"""{PANEL_SQL}, {base.MEMBERS_SQL}, ed AS (SELECT * FROM (VALUES (0, DATE '1990-01-01', DATE '1997-01-01'), (1, DATE '1997-01-01', CAST(NULL AS DATE))) e(edition, valid_from, valid_to)),
cu AS (SELECT ts_code, slice, greatest(in_date, valid_from) AS a, least(out_date, valid_to) AS b FROM members JOIN ed ON ed.edition = slice % 2)
SELECT p.trade_date, p.ts_code, (SELECT arg_max(slice, a) FROM cu WHERE cu.ts_code = p.ts_code AND p.trade_date >= a AND (b IS NULL OR p.trade_date < b)) AS slice FROM panel p""")
def join_stitched_editions(spark, sf_dir):
    spans = spark.createDataFrame([(0, "1990-01-01", "1997-01-01"), (1, "1997-01-01", None)], "edition int, f string, t string").select("edition", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"))
    members = base._members(spark, sf_dir).withColumn("edition", (F.col("slice") % 2).cast("int"))
    p = weekly_panel(spark, sf_dir).select("trade_date", "ts_code")
    return joins.stitched_interval_join(p, members, spans, ["ts_code"], "trade_date", "in_date", "out_date", ["slice"], "edition").select("trade_date", "ts_code", "slice")


@query(f"""{FUTURE_SQL}, y0 AS (SELECT trade_date, ts_code, industry_l1_code AS g, fwd AS y, coalesce(x, median(x) OVER (PARTITION BY trade_date)) AS x FROM (SELECT *, CASE WHEN ts_code % 4 > 0 THEN turnover_rate END AS x FROM fut) WHERE fwd IS NOT NULL),
y1 AS (SELECT *, y - avg(y) OVER c AS cy, x - avg(x) OVER c AS cx, y - avg(y) OVER d AS dy, count(*) OVER d AS n, dense_rank() OVER (PARTITION BY trade_date ORDER BY g) + dense_rank() OVER (PARTITION BY trade_date ORDER BY g DESC) - 1 AS k, stddev_pop(x) OVER d AS sd FROM y0 WINDOW c AS (PARTITION BY trade_date, g), d AS (PARTITION BY trade_date)),
y2 AS (SELECT *, coalesce(sum(cx * cy) OVER (PARTITION BY trade_date) / nullif(sum(cx * cx) OVER (PARTITION BY trade_date), 0), 0) AS b FROM y1)
SELECT trade_date, ts_code, {r6('CASE WHEN n < 5 THEN NULL WHEN n <= 2 + k - 1 + 4 THEN dy ELSE cy - b * cx END')} AS neutral FROM y2""")
def residual_score(spark, sf_dir):
    p = future(spark, sf_dir).withColumn("x", F.when(F.col("ts_code") % 4 > 0, F.col("turnover_rate")))
    return said(residual.neutral_score(p, "fwd", ["x"], "neutral"), "neutral")


_MARKET = {"breadth": ("rising", "avg(CASE WHEN step > 0 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END)"), "money": ("amount", "avg(amount_cny)")}


def _series_sql(n: str) -> str:
    f = lambda k: f"(ORDER BY trade_date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    past = f"list_filter(list({n}) OVER {f(60)}, lambda z: z IS NOT NULL)"
    return f"""{n}, CASE WHEN {n} IS NOT NULL AND len({past}) >= 20 THEN len(list_filter({past}, lambda z: z <= {n})) / len({past}) END AS {n}__pct, {n} - lag({n}, 1) OVER (ORDER BY trade_date) AS {n}__chg1, {n} - lag({n}, 5) OVER (ORDER BY trade_date) AS {n}__chg5, CASE WHEN count({n}) OVER {f(60)} >= 20 THEN median({n}) OVER {f(60)} END AS {n}__m"""


_TIMED = [f"{g}__{c}" for g, (c, _) in _MARKET.items()]


@query(f"""{RETURNS_SQL}, d0 AS (SELECT trade_date, {', '.join(f'{x} AS raw_{g}' for g, (_, x) in _MARKET.items())} FROM ret GROUP BY 1), d1 AS (SELECT trade_date, {', '.join(f'lag(raw_{g}, 1) OVER (ORDER BY trade_date) AS {g}__{c}' for g, (c, _) in _MARKET.items())} FROM d0),
d2 AS (SELECT trade_date, {', '.join(map(_series_sql, _TIMED))} FROM d1), d3 AS (SELECT *, {', '.join(f'abs({n} - {n}__m) AS {n}__e' for n in _TIMED)} FROM d2),
d4 AS (SELECT *, {', '.join(f'0.67448975 * ({n} - {n}__m) / nullif(CASE WHEN count({n}__e) OVER w >= 20 THEN median({n}__e) OVER w END, 0) AS {n}__z' for n in _TIMED)} FROM d3 WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT trade_date, {', '.join(f'{r6(n + s)} AS {n}{s}' for n in _TIMED for s in ('', '__z', '__pct', '__chg1', '__chg5'))}, {', '.join(f'CAST({n}__pct >= 0.9 AS INT) AS {n}__high, CAST({n}__pct <= {1 - 0.9!r} AS INT) AS {n}__low' for n in _TIMED)}, {r6(f'{_TIMED[0]}__z * {_TIMED[1]}__z')} AS {_TIMED[0]}__x__{_TIMED[1]} FROM d4""")
def timing_dataset(spark, sf_dir):
    r = returns(spark, sf_dir)
    groups = {"breadth": r.groupBy("trade_date").agg(F.avg((F.col("step") > 0).cast("double")).alias("rising")), "money": r.groupBy("trade_date").agg(F.avg("amount_cny").alias("amount"))}
    made = timing.dataset(r.select("trade_date").distinct(), groups, interactions=(tuple(_TIMED),))
    return said(made, *(n + s for n in _TIMED for s in ("", "__z", "__pct", "__chg1", "__chg5")), f"{_TIMED[0]}__x__{_TIMED[1]}")


@query(f"""{PANEL_SQL}, mo AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS v FROM orders GROUP BY 1), kn AS (SELECT CAST(month + INTERVAL 45 DAY AS DATE) AS known, v FROM mo), d AS (SELECT DISTINCT trade_date FROM panel)
SELECT trade_date, {r6('v')} AS v FROM d ASOF LEFT JOIN kn ON d.trade_date >= kn.known""")
def join_asof_macro(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("v")).select(F.date_add("month", 45).alias("known"), "v")
    return said(timing.known_monthly(weekly_panel(spark, sf_dir).select("trade_date").distinct(), m, "known", ["v"]), "v")


# Matched events

PAIRED_SQL = f"""WITH m AS ({research.ORACLES['event_matching']}), fw AS ({FUTURE_SQL} SELECT trade_date, ts_code, fwd, volume_shares FROM fut),
pa AS (SELECT m.trade_date, m.event_code, any_value(e.volume_shares) AS severity, any_value(e.fwd) AS event_return, avg(c.fwd) AS control_return, count(DISTINCT m.control_code) AS controls, any_value(e.fwd) - avg(c.fwd) AS x
 FROM m JOIN fw e ON e.trade_date = m.trade_date AND e.ts_code = m.event_code JOIN fw c ON c.trade_date = m.trade_date AND c.ts_code = m.control_code WHERE e.fwd IS NOT NULL AND c.fwd IS NOT NULL GROUP BY 1, 2)"""


def _paired(spark, sf_dir):
    p = future(spark, sf_dir)
    pairs = events.match_controls(p.withColumn("is_event", F.col("volume_shares") > 100).withColumn("size", F.col("log_total_mv")), ["size"], 3, 1.0)
    return events.paired(pairs, p, "fwd", "volume_shares")


@query(f"""{PAIRED_SQL}, r AS ({research.ORACLES['event_market_regimes']}), z AS (SELECT pa.*, market_direction AS g FROM pa JOIN r USING (trade_date)), dy AS (SELECT g, trade_date, avg(x) AS day FROM z GROUP BY ALL), c AS (SELECT *, avg(day) OVER (PARTITION BY g) AS m, day - avg(day) OVER (PARTITION BY g) AS d FROM dy),
p AS (SELECT g, m, day, d * d AS p0, d * lag(d, 1) OVER (PARTITION BY g ORDER BY trade_date) AS p1 FROM c), t AS (SELECT g, any_value(m) AS daily_mean, any_value(m) / nullif(sqrt(greatest(sum(p0) + 2 * 0.5 * coalesce(sum(p1), 0), 0) / count(*) / count(*)), 0) AS nw_t, count(*) AS days, avg(CASE WHEN day * CASE WHEN m >= 0 THEN 1 ELSE -1 END > 0 THEN 1.0 ELSE 0.0 END) AS direction_ratio FROM p GROUP BY 1),
w AS (SELECT g, count(*) AS events, avg(event_return) AS me, avg(control_return) AS mc, avg(x) AS mx, median(x) AS md, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS wr FROM z GROUP BY 1)
SELECT g AS market_direction, events, {r6('me')} AS mean_event, {r6('mc')} AS mean_control, {r6('mx')} AS mean_excess, {r6('md')} AS median_excess, {r6('wr')} AS win_rate, {r6('daily_mean')} AS daily_mean, {r6('CASE WHEN days >= 2 THEN nw_t END')} AS nw_t, {r6('direction_ratio')} AS direction_ratio FROM w JOIN t USING (g)""")
def event_paired_regimes(spark, sf_dir):
    regime = events.market_regimes(weekly_panel(spark, sf_dir)).select("trade_date", "market_direction")
    found = events.paired_summary(_paired(spark, sf_dir).join(regime, "trade_date"), ["market_direction"], 1)
    return said(found, *(c for c in found.columns if c not in ("market_direction", "events")))


@query(f"""{PAIRED_SQL}, e AS (SELECT quantile_cont(severity, [{1 / 3!r}, {2 / 3!r}]) AS edges, count(*) AS n FROM pa), g AS (SELECT pa.*, CAST(1 + len(list_filter(edges, lambda q: q < severity)) AS INT) AS severity_group FROM pa, e WHERE n >= 30),
o AS (SELECT severity_group, count(*) AS events, min(severity) AS severity_min, max(severity) AS severity_max, avg(x) AS m, median(x) AS md FROM g GROUP BY 1), s AS (SELECT *, sign(m - lag(m) OVER (ORDER BY severity_group)) AS s FROM o)
SELECT severity_group, events, severity_min, severity_max, {r6('m')} AS mean_excess, {r6('md')} AS median_excess, coalesce(min(s) OVER () = max(s) OVER (), true) AS monotonic FROM s""")
def event_severity_groups(spark, sf_dir):
    return said(events.severity_groups(_paired(spark, sf_dir)), "mean_excess", "median_excess")


def value_features(spark, sf_dir):
    """No SQL: the chain of regressions is held against plain least squares in the tests."""
    p = weekly_panel(spark, sf_dir)
    w = frames.history()
    amount = F.avg("amount_cny").over(w.rowsBetween(-12, 0))
    year = F.avg("amount_cny").over(w.rowsBetween(-64, -52))
    p = p.withColumns({
        "revenue_ttm": amount * 52, "net_assets": F.col("total_mv_cny") / (1 + F.col("ts_code") % 3), "roe_ttm": amount / F.col("total_mv_cny"), "revenue_growth_yoy": frames.safe_ratio(amount, year) - 1,
        "log_circ_mv": F.ln(F.col("total_mv_cny") * (1 - (F.col("ts_code") % 5) / 10.0)), "roe_change_yoy": (amount - year) / F.col("total_mv_cny"), "debt_to_assets": (F.col("ts_code") % 7) / 10.0, "net_profit_ttm": amount - year,
    })
    return value.value_features(p, value.Parameters(revision=4, formation=12, skip=4, delay_window=26, delay_change=4, least=12))


QUERIES["value_features"] = value_features


@query(f"""{FUTURE_SQL}, lb AS (SELECT trade_date, ts_code, is_tradeable, fwd, lead(adj_open, 6) OVER {W} / lead(adj_open, 1) OVER {W} - 1 AS f5 FROM fut)
SELECT trade_date, ts_code, {r6('fwd - avg(fwd) FILTER (is_tradeable) OVER (PARTITION BY trade_date)')} AS label_2d, {r6('f5 - avg(f5) FILTER (is_tradeable) OVER (PARTITION BY trade_date)')} AS label_5d FROM lb""")
def value_labels(spark, sf_dir):
    return said(value.value_labels(weekly_panel(spark, sf_dir), (2, 5)), "label_2d", "label_5d")
