"""Radar, event studies, rotation, boxes, fundamentals, timing and streams as queries, with SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.functions.frames import shown
from panelyard.operators import boxes, events, radar, rotation, statements, stats, timing
from panelyard.plans.panel_queries import FUTURE_SQL, RETURNS_SQL, W, future, r6, returns, rows
from panelyard.sources import files
from panelyard.sources import panel as panels
from panelyard.sources.market import PANEL_SQL, table, weekly_panel
from panelyard.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# Radar


def _prior(x: str, size: int = 60, least: int = 20) -> str:
    a = f"list_filter(list({x}) OVER {rows(f'{size} PRECEDING', '1 PRECEDING')}, lambda z: z IS NOT NULL)"
    return f"CASE WHEN {x} IS NOT NULL AND len({a}) >= {least} THEN (len(list_filter({a}, lambda z: z < {x})) + 0.5 * len(list_filter({a}, lambda z: z = {x}))) / len({a}) END"


def _change(n: int) -> str:
    return f"adj_close / nullif(lag(adj_close, {n}) OVER {W}, 0) - 1"


def _event_sql(measures: dict[str, str], history: list[str], tests: list[tuple[str, str, float]]) -> str:
    excess = " + ".join(f"({c} - {t}) / {max(1 - t, 1e-9)}" if side == "ge" else f"({t} - {c}) / {max(t, 1e-9)}" for c, side, t in tests)
    holds = " AND ".join(f"coalesce({c} {'>=' if side == 'ge' else '<='} {t}, false)" for c, side, t in tests)
    return f"""{PANEL_SQL}, m AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in measures.items())} FROM panel),
p AS (SELECT *, {', '.join(f'{_prior(n)} AS {n}_pct' for n in history)} FROM m)
SELECT trade_date, ts_code, CASE WHEN ({excess}) IS NOT NULL THEN {r6(f'greatest({excess}, 0)')} END AS severity, {holds} AS is_event FROM p"""


RADAR_SQL = {
    "price_drop_without_volume": _event_sql({"return_h": _change(5), "volume": "volume_shares"}, ["return_h", "volume"], [("return_h_pct", "le", 0.2), ("volume_pct", "le", 0.4)]),
    "volume_surge_without_impact": _event_sql({"abs_return": f"abs({_change(1)})", "volume": "volume_shares"}, ["abs_return", "volume"], [("volume_pct", "ge", 0.8), ("abs_return_pct", "le", 0.4)]),
    "low_liquidity_large_displacement": _event_sql({"abs_return": f"abs({_change(1)})", "amount": "amount_cny"}, ["abs_return", "amount"], [("abs_return_pct", "ge", 0.8), ("amount_pct", "le", 0.4)]),
    "long_lower_wick_strong_close": _event_sql(
        {"wick": "(least(adj_open, adj_close) - adj_low) / nullif(adj_high - adj_low, 0)", "close_position": "(adj_close - adj_low) / nullif(adj_high - adj_low, 0)", "return_3": _change(3)},
        ["wick", "return_3"], [("wick_pct", "ge", 0.7), ("close_position", "ge", 0.5), ("return_3_pct", "le", 0.4)],
    ),
    "trend_exhaustion": _event_sql({"return_long": _change(10), "return_short": _change(2)}, ["return_long", "return_short"], [("return_long_pct", "ge", 0.8), ("return_short_pct", "le", 0.4)]),
}


def _radar(kind: str):
    def fn(spark, sf_dir):
        s = radar.scan(weekly_panel(spark, sf_dir), radar.templates()[kind])
        return s.select("trade_date", "ts_code", shown(F.col("severity")).alias("severity"), "is_event")

    fn.__name__ = f"radar_{kind}"
    query(RADAR_SQL.get(kind))(fn)


for _kind in ("price_drop_without_volume", "volume_surge_without_impact", "high_turnover_low_displacement", "low_liquidity_large_displacement", "long_lower_wick_strong_close", "stock_industry_divergence", "volatility_compression_breakout", "trend_exhaustion"):
    _radar(_kind)


@query()
def radar_observation(spark, sf_dir):
    return radar.observation(radar.scan(weekly_panel(spark, sf_dir), radar.templates()["trend_exhaustion"]), 52)


@query(f"""{FUTURE_SQL}, d AS (SELECT trade_date, avg(step) AS v FROM fut GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY trade_date DESC) AS back FROM d WHERE v IS NOT NULL),
u AS (SELECT *, median(CASE WHEN back > 20 THEN v END) OVER () AS mid FROM k WHERE back <= 140),
s AS (SELECT avg(CASE WHEN back > 20 THEN v END) AS b, avg(CASE WHEN back <= 20 THEN v END) AS r, count(CASE WHEN back <= 20 THEN 1 END) AS n, 1.4826 * median(abs(CASE WHEN back > 20 THEN v END - mid)) AS mad FROM u)
SELECT {r6('b')} AS baseline_mean, {r6('r')} AS recent_mean, n AS recent_days, {r6('r - b')} AS delta, {r6('(r - b) / (mad / sqrt(n))')} AS robust_z FROM s""")
def radar_drift(spark, sf_dir):
    d = returns(spark, sf_dir).groupBy("trade_date").agg(F.avg("step").alias("v"))
    out = radar.drift(d, "v", 120, 20)
    return out.select(shown(F.col("baseline_mean")).alias("baseline_mean"), shown(F.col("recent_mean")).alias("recent_mean"), "recent_days", shown(F.col("delta")).alias("delta"), shown(F.col("robust_z")).alias("robust_z"))


# Events


@query(f"""{RETURNS_SQL}, d AS (SELECT trade_date, avg(step) AS m FROM ret WHERE is_liquid GROUP BY 1),
w AS (SELECT *, CASE WHEN count(m) OVER f >= 10 THEN sum(m) OVER f END AS r, CASE WHEN count(m) OVER f >= 10 THEN stddev_pop(m) OVER f END AS v FROM d WINDOW f AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
u AS (SELECT *, CASE WHEN count(v) OVER g >= 60 THEN median(v) OVER g END AS usual FROM w WINDOW g AS (ORDER BY trade_date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
SELECT trade_date, {r6('r')} AS market_return_20d, {r6('v')} AS market_volatility_20d, CASE WHEN r >= 0 THEN 'up' ELSE 'down' END AS market_direction, CASE WHEN v >= usual THEN 'high' ELSE 'low' END AS market_volatility FROM u""")
def event_market_regimes(spark, sf_dir):
    m = events.market_regimes(weekly_panel(spark, sf_dir))
    return m.select("trade_date", shown(F.col("market_return_20d")).alias("market_return_20d"), shown(F.col("market_volatility_20d")).alias("market_volatility_20d"), "market_direction", "market_volatility")


def _flagged(spark, sf_dir):
    return returns(spark, sf_dir).withColumn("is_event", F.col("volume_shares") > 100).withColumn("size", F.col("log_total_mv"))


@query(f"""{RETURNS_SQL}, e0 AS (SELECT *, volume_shares > 100 AS is_event, median(log_total_mv) OVER c AS mid, stddev_pop(log_total_mv) OVER c AS sd FROM ret WINDOW c AS (PARTITION BY trade_date, industry_l1_code)),
e1 AS (SELECT *, 1.4826 * median(abs(log_total_mv - mid)) OVER c AS mad FROM e0 WINDOW c AS (PARTITION BY trade_date, industry_l1_code)),
e2 AS (SELECT trade_date, industry_l1_code, ts_code, is_event, (log_total_mv - mid) / CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd ELSE 1 END AS z FROM e1),
p AS (SELECT e.trade_date, e.industry_l1_code, e.ts_code AS event_code, c.ts_code AS control_code, abs(c.z - e.z) AS dist FROM e2 e JOIN e2 c ON e.trade_date = c.trade_date AND e.industry_l1_code = c.industry_l1_code WHERE e.is_event AND NOT c.is_event)
SELECT trade_date, industry_l1_code, event_code, control_code, {r6('dist')} AS match_distance, CAST(row_number() OVER (PARTITION BY trade_date, industry_l1_code, event_code ORDER BY dist, CAST(control_code AS VARCHAR)) AS INTEGER) AS rank FROM p WHERE dist <= 1 QUALIFY rank <= 3""")
def event_matching(spark, sf_dir):
    return events.match_controls(_flagged(spark, sf_dir), ["size"], 3, 1.0).withColumn("match_distance", shown(F.col("match_distance")))


@query(f"""{PANEL_SQL}, f AS (SELECT trade_date, industry_l1_code, CAST(ts_code AS VARCHAR) AS code, volume_shares > 100 AS is_event FROM panel),
c AS (SELECT trade_date, industry_l1_code, code AS control_code, row_number() OVER (PARTITION BY trade_date, industry_l1_code ORDER BY code) - 1 AS i, count(*) OVER (PARTITION BY trade_date, industry_l1_code) AS n FROM f WHERE NOT is_event),
e AS (SELECT trade_date, industry_l1_code, code AS event_code, CAST('0x' || substr(sha256(strftime(trade_date, '%Y-%m-%d %H:%M:%S') || '|' || code), 1, 8) AS BIGINT) AS h FROM f WHERE is_event)
SELECT trade_date, industry_l1_code, event_code, control_code, CAST((i - h % n + n) % n + 1 AS INTEGER) AS rank FROM e JOIN c USING (trade_date, industry_l1_code) WHERE (i - h % n + n) % n < 3""")
def event_rotated_controls(spark, sf_dir):
    return events.rotated_controls(_flagged(spark, sf_dir))


@query()
def event_cooldown(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).withColumn("n", F.row_number().over(frames.history())).filter("volume_shares > 60").select("ts_code", "trade_date", "n")
    return events.greedy_cooldown(p, "ts_code", "n", 10, inclusive=True)


@query(f"""{FUTURE_SQL}, q AS (SELECT trade_date, ts_code, {r6(f'adj_close / lag(adj_close, 5) OVER {W} - 1')} AS prior_return_5d, {r6(f"CASE WHEN count(step) OVER {rows('19 PRECEDING', 'CURRENT ROW')} >= 10 THEN stddev_pop(step) OVER {rows('19 PRECEDING', 'CURRENT ROW')} END")} AS volatility_20d, {r6('fwd')} AS forward_return_2, fwd IS NOT NULL AS label_mature_2 FROM fut) SELECT * FROM q""")
def event_labels(spark, sf_dir):
    p = events.labels_and_covariates(weekly_panel(spark, sf_dir), [2])
    return p.select("trade_date", "ts_code", *(shown(F.col(c)).alias(c) for c in ("prior_return_5d", "volatility_20d", "forward_return_2")), "label_mature_2")


# Rotation


@query(f"""{PANEL_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS s FROM (SELECT DISTINCT trade_date FROM panel)), b AS (SELECT s, trade_date, industry_l2_code AS g, ts_code FROM panel JOIN cal USING (trade_date)),
n AS (SELECT s + 5 AS s, g, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT a.trade_date, a.s, a.g, count(*) AS members, count(z.ts_code) AS common FROM b a LEFT JOIN b z ON z.s + 5 = a.s AND z.g = a.g AND z.ts_code = a.ts_code GROUP BY ALL)
SELECT trade_date, g AS concept_code, members, common, {r6('1 - common / (members + n - common)')} AS churn FROM m JOIN n USING (s, g)""")
def rotation_churn(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    bridge = p.select("trade_date", F.col("industry_l2_code").alias("concept_code"), "ts_code")
    return rotation.churn(bridge, p, 5).withColumn("churn", shown(F.col("churn")))


def _industry_returns(spark, sf_dir):
    return returns(spark, sf_dir).groupBy("trade_date", F.col("industry_l2_code").alias("code")).agg(F.avg("step").alias("r"))


@query(f"""{RETURNS_SQL}, i AS (SELECT trade_date, industry_l2_code AS code, avg(step) AS r FROM ret GROUP BY ALL), a AS (SELECT *, r - avg(r) OVER (PARTITION BY trade_date) AS rel FROM i),
b AS (SELECT *, CASE WHEN count(rel) OVER f >= 10 THEN sum(rel) OVER f END AS rs FROM a WINDOW f AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, 100 + 10 * (rs - avg(rs) OVER d) / nullif(stddev_pop(rs) OVER d, 0) AS q FROM b WINDOW d AS (PARTITION BY trade_date)), e AS (SELECT *, q - lag(q, 5) OVER (PARTITION BY code ORDER BY trade_date) AS m FROM c)
SELECT trade_date, code, {r6('q')} AS rs_ratio, {r6('m')} AS rs_momentum, CASE WHEN q >= 100 AND m >= 0 THEN 'leading' WHEN q >= 100 THEN 'weakening' WHEN m >= 0 THEN 'improving' WHEN m IS NOT NULL THEN 'lagging' END AS quadrant FROM e""")
def rotation_relative(spark, sf_dir):
    out = rotation.relative_rotation(_industry_returns(spark, sf_dir), "code", "r")
    return out.select("trade_date", "code", shown(F.col("rs_ratio")).alias("rs_ratio"), shown(F.col("rs_momentum")).alias("rs_momentum"), "quadrant")


@query(f"""{PANEL_SQL}, s AS (SELECT trade_date, ts_code, CASE WHEN volume_shares > 60 THEN 'high' WHEN volume_shares > 25 THEN 'mid' ELSE 'low' END AS state FROM panel),
a AS (SELECT *, lag(state) OVER {W} AS previous, row_number() OVER {W} AS n FROM s), b AS (SELECT *, n = 1 OR state IS DISTINCT FROM previous AS changed FROM a), c AS (SELECT *, sum(CAST(changed AS INTEGER)) OVER {W} AS run FROM b)
SELECT trade_date, ts_code, state, previous, changed, CAST(row_number() OVER (PARTITION BY ts_code, run ORDER BY trade_date) AS INTEGER) AS days FROM c""")
def rotation_transitions(spark, sf_dir):
    v = F.col("volume_shares")
    s = weekly_panel(spark, sf_dir).select("trade_date", "ts_code", F.when(v > 60, "high").when(v > 25, "mid").otherwise("low").alias("state"))
    return rotation.transitions(s, "ts_code", "state")


@query()
def rotation_greedy(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).groupBy("trade_date", F.col("industry_l2_code").alias("concept_code")).agg(F.sum("amount_cny").alias("score"), F.collect_set(F.col("ts_code") % 5).alias("members"))
    return rotation.greedy_distinct(p, ["trade_date"], "score", "members", 3)


@query()
def rotation_retained(spark, sf_dir):
    r = F.rank().over(Window.partitionBy("trade_date").orderBy(F.desc("amount_cny"), "ts_code"))
    return rotation.retained(weekly_panel(spark, sf_dir).select("trade_date", "ts_code", r.alias("rank")), "ts_code", 10, 20)


@query(f"""{PANEL_SQL}, k AS (SELECT ts_code, coalesce(lead(ts_code) OVER (ORDER BY ts_code), min(ts_code) OVER ()) AS nxt FROM (SELECT DISTINCT ts_code FROM panel))
SELECT p.trade_date, p.ts_code, {r6('p.adj_close')} AS score, {r6('o.adj_close')} AS placebo FROM panel p JOIN k USING (ts_code) LEFT JOIN panel o ON o.trade_date = p.trade_date AND o.ts_code = k.nxt""")
def rotation_placebo_ring(spark, sf_dir):
    out = rotation.placebo_ring(weekly_panel(spark, sf_dir).select("trade_date", "ts_code", F.col("adj_close").alias("score")), "score")
    return out.select("trade_date", "ts_code", shown(F.col("score")).alias("score"), shown(F.col("placebo")).alias("placebo"))


@query(f"""{PANEL_SQL}, r AS (SELECT trade_date, ts_code, adj_close AS score, row_number() OVER (PARTITION BY trade_date ORDER BY md5('placebo:' || trade_date || ':' || ts_code), ts_code) AS too, row_number() OVER (PARTITION BY trade_date ORDER BY ts_code) AS fro FROM panel)
SELECT a.trade_date, a.ts_code, {r6('a.score')} AS score, {r6('b.score')} AS placebo FROM r a JOIN r b ON a.trade_date = b.trade_date AND a.too = b.fro""")
def rotation_shuffle_placebo(spark, sf_dir):
    out = rotation.shuffle_placebo(weekly_panel(spark, sf_dir).select("trade_date", "ts_code", F.col("adj_close").alias("score")), "score")
    return out.withColumns({c: shown(F.col(c)) for c in ("score", "placebo")})


# Boxes and fundamentals


def _last(x: str, size: int, f: str, least: int | None = None) -> str:
    frame = f"(PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} >= {size} THEN {f} OVER {frame} END"


_BACK = ", ".join(f"lag(adj_close, {k}) OVER {W} AS c{k}" for k in range(1, 7))
_BOX_MEASURES = {
    "range_compactness": "-(upper - lower) / atr", "volatility_contraction": "CASE WHEN ratio = 0 THEN 'inf'::DOUBLE ELSE -ln(ratio) END", "trend_flatness": "-abs(slope) / atr", "approach_velocity": "(-2 * c5 - c4 + c2 + 2 * c1) / 10 / atr",
    "pre_acceleration": "((c1 - c3) / 2 - (c3 - c5) / 2) / 2 / atr", "direction_persistence": f"({' + '.join(f'CAST(c{k} > c{k + 1} AS INT)' for k in range(1, 6))}) / 5", "consolidation_age": "20 + ended - created", "breakout_strength": "(c0 - upper) / atr",
    "breakout_velocity": "(c0 - c1) / atr", "breakout_acceleration": "(c0 - c1 - (c1 - c3) / 2) / atr", "relative_volume": "CASE WHEN usual > 0 AND v0 > 0 THEN ln(v0 / usual) END", "gap_atr": "(o0 - c1) / atr",
}
_BOX_SHOWN = ("upper", "lower", "atr", *_BOX_MEASURES)


@query(f"""WITH RECURSIVE {PANEL_SQL.strip().removeprefix('WITH')}, sm AS (SELECT * REPLACE ({', '.join(f'avg(adj_{c}) OVER s AS adj_{c}' for c in ('open', 'high', 'low', 'close'))}) FROM panel WINDOW s AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
n0 AS (SELECT *, row_number() OVER {W} - 1 AS n, lag(adj_close) OVER {W} AS pc FROM sm), n1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(adj_high - adj_low, abs(adj_high - pc), abs(adj_low - pc)) END AS tr, adj_close / pc - 1 AS step FROM n0),
n2 AS (SELECT *, {_last('tr', 14, 'avg(tr)')} AS a, {_last('adj_high', 20, 'max(adj_high)')} AS u, {_last('adj_low', 20, 'min(adj_low)')} AS l, {_last('adj_close', 20, 'regr_slope(adj_close, n)')} AS sl, {_last('step', 5, 'stddev_pop(step)')} AS s5, {_last('step', 20, 'stddev_pop(step)')} AS s20 FROM n1),
n3 AS (SELECT *, lag(a) OVER {W} AS atr, lag(u) OVER {W} AS upper, lag(l) OVER {W} AS lower, lag(sl) OVER {W} AS slope, lag(CASE WHEN s5 = 0 AND s20 = 0 THEN 0 ELSE s5 / nullif(s20, 0) END) OVER {W} AS ratio, lag(trade_date) OVER {W} AS src, {_BACK}, median(volume_shares) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS usual FROM n2),
ca AS (SELECT ts_code, n AS created, trade_date AS created_at, src AS source_end, upper, lower, atr, slope, ratio FROM n3 WHERE n >= 21 AND atr > 0 AND (upper - lower) / atr <= 12 AND abs(slope) / atr <= 0.8),
en AS (SELECT ca.ts_code, created, min(n3.n) AS ended FROM ca JOIN n3 ON n3.ts_code = ca.ts_code AND n3.n BETWEEN created AND created + 20 AND (n3.adj_close > ca.upper + 0.25 * ca.atr OR n3.adj_close < ca.lower - 0.25 * ca.atr OR n3.n = created + 20) GROUP BY ALL),
ce AS (SELECT ca.*, ended FROM ca LEFT JOIN en USING (ts_code, created)), st AS (SELECT ts_code, min(created) AS created FROM ce GROUP BY 1), ch AS (SELECT ts_code, created FROM st UNION ALL SELECT k.ts_code, (SELECT min(x.created) FROM ce x WHERE x.ts_code = k.ts_code AND x.created > e.ended) AS created FROM ch k JOIN ce e ON e.ts_code = k.ts_code AND e.created = k.created WHERE e.ended IS NOT NULL),
bx AS (SELECT ce.*, n3.trade_date AS closed_at, CASE WHEN n3.adj_close > ce.upper + 0.25 * ce.atr THEN 'breakout' WHEN n3.adj_close < ce.lower - 0.25 * ce.atr THEN 'downside_failure' WHEN n3.n IS NOT NULL THEN 'expired' END AS reason, n3.adj_close AS c0, n3.adj_open AS o0, n3.volume_shares AS v0, usual, {', '.join(f'n3.c{k}' for k in range(1, 7))}
 FROM ce JOIN ch ON ch.ts_code = ce.ts_code AND ch.created = ce.created LEFT JOIN n3 ON n3.ts_code = ce.ts_code AND n3.n = ce.ended)
SELECT ts_code || ':' || strftime(source_end, '%Y%m%d') AS box_id, ts_code, {r6('upper')} AS upper, {r6('lower')} AS lower, {r6('atr')} AS atr, source_end, created_at, CASE WHEN reason = 'breakout' THEN 'triggered' WHEN reason IS NOT NULL THEN 'closed' ELSE 'active' END AS state, closed_at, reason,
 {', '.join(f"{r6(f'CASE WHEN reason = {chr(39)}breakout{chr(39)} THEN {x} END')} AS {m}" for m, x in _BOX_MEASURES.items())} FROM bx""")
def breakout_boxes(spark, sf_dir):
    smooth = lambda c: frames.rolling(F.col(c), 8, "mean", 1)
    p = weekly_panel(spark, sf_dir).withColumns({c: smooth(c) for c in ("adj_open", "adj_high", "adj_low", "adj_close")})
    out = boxes.boxes(p, boxes.BoxRules(max_width_atr=12.0, max_slope_atr=0.8))
    return out.withColumns({c: shown(F.col(c)) for c in _BOX_SHOWN})


def _statements(spark, sf_dir):
    """Quarterly statements of each customer from the orders: cumulative revenue of the year, announced 45 days after the quarter."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("ts_code"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    q = o.groupBy("ts_code", F.date_sub(F.to_date(F.add_months(F.date_trunc("quarter", "d"), 3)), 1).alias("end")).agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    w = Window.partitionBy("ts_code", F.year("end")).orderBy("end")
    q = q.withColumn("ytd", F.sum("v").over(w).cast("double")).withColumn("n", F.sum("n").over(w).cast("double"))
    day = lambda c: F.date_format(c, "yyyyMMdd")
    base = [F.col("ts_code"), day(F.date_add("end", 45)).alias("ann_date"), day(F.date_add("end", 45)).alias("f_ann_date"), day("end").alias("end_date"), F.lit("1").alias("report_type"), F.lit("0").alias("update_flag")]
    income = q.select(*base, F.col("ytd").alias("total_revenue"), (F.col("ytd") / 10).alias("n_income_attr_p"))
    balance = q.select(*base, (F.col("n") * 1000).alias("total_hldr_eqy_exc_min_int"), (F.col("n") * 2500).alias("total_assets"), (F.col("n") * 1500).alias("total_liab"))
    return income, balance


def _ttm(x: str, end: str, own: str, before: str, year_end: str) -> str:
    return f"CASE WHEN month({end}) = 12 THEN {own}.{x} ELSE {own}.{x} + {year_end}.{x} - {before}.{x} END"


_MEAN = "(coalesce({0}, {1}) + coalesce({1}, {0})) / 2"
_FUNDAMENTALS = ("revenue_ttm", "net_assets", "roe_ttm", "revenue_growth_yoy", "roe_change_yoy", "debt_to_assets", "net_profit_ttm")


@query(f"""{PANEL_SQL}, o AS (SELECT o_custkey % 50 AS ts_code, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS e, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders), q0 AS (SELECT ts_code, e, sum(v) AS v, count(*) AS n FROM o GROUP BY ALL),
q AS (SELECT ts_code, e, CAST(sum(v) OVER y AS DOUBLE) AS rev, CAST(sum(v) OVER y AS DOUBLE) / 10 AS pro, CAST(sum(n) OVER y AS DOUBLE) AS n FROM q0 WINDOW y AS (PARTITION BY ts_code, year(e) ORDER BY e)),
t AS (SELECT q.ts_code, q.e, q.n, a.n AS n1, b.n AS n2, {_ttm('rev', 'q.e', 'q', 'a', 'c')} AS r0, {_ttm('rev', 'q.e', 'a', 'b', 'd')} AS r1, {_ttm('pro', 'q.e', 'q', 'a', 'c')} AS p0, {_ttm('pro', 'q.e', 'a', 'b', 'd')} AS p1
 FROM q LEFT JOIN q a ON a.ts_code = q.ts_code AND a.e = CAST(q.e - INTERVAL 12 MONTH AS DATE) LEFT JOIN q b ON b.ts_code = q.ts_code AND b.e = CAST(q.e - INTERVAL 24 MONTH AS DATE) LEFT JOIN q c ON c.ts_code = q.ts_code AND c.e = make_date(year(q.e) - 1, 12, 31) LEFT JOIN q d ON d.ts_code = q.ts_code AND d.e = make_date(year(q.e) - 2, 12, 31)),
u AS (SELECT ts_code, CAST(e + 45 AS DATE) AS source_event_date, e AS report_period, r0 AS revenue_ttm, n * 1000 AS net_assets, p0 / ({_MEAN.format('n * 1000', 'n1 * 1000')}) AS roe_ttm, r0 / CASE WHEN r1 > 0 THEN r1 END - 1 AS revenue_growth_yoy, p0 / ({_MEAN.format('n * 1000', 'n1 * 1000')}) - p1 / ({_MEAN.format('n1 * 1000', 'n2 * 1000')}) AS roe_change_yoy, n * 1500 / (n * 2500) AS debt_to_assets, p0 AS net_profit_ttm FROM t),
s AS (SELECT DISTINCT trade_date FROM panel), w AS (SELECT *, (SELECT min(trade_date) FROM s WHERE trade_date > source_event_date) AS available_date FROM u)
SELECT ts_code, available_date, source_event_date, report_period, {', '.join(f'{r6(c)} AS {c}' for c in _FUNDAMENTALS)} FROM w WHERE available_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts_code, available_date ORDER BY source_event_date DESC) = 1""")
def fundamentals_pit(spark, sf_dir):
    income, balance = _statements(spark, sf_dir)
    out = statements.fundamentals(income, balance, weekly_panel(spark, sf_dir).select("trade_date").distinct())
    return out.withColumns({c: shown(F.col(c)) for c in _FUNDAMENTALS})


def _vendor(spark, sf_dir):
    """The weekly panel in the vendor's units and column names; written once, as eight tables are made of it."""
    path = files.shared_folder(spark, "vendor")
    weekly_panel(spark, sf_dir).write.parquet(path)
    p = spark.read.parquet(path)
    day = F.date_format("trade_date", "yyyyMMdd").alias("trade_date")
    code = F.col("ts_code").cast("string").alias("ts_code")
    daily = p.select(day, code, F.col("adj_open").alias("open"), F.col("adj_high").alias("high"), F.col("adj_low").alias("low"), F.col("adj_close").alias("close"), F.lag("adj_close").over(frames.history()).alias("pre_close"), (F.col("volume_shares") / 100).alias("vol"), (F.col("amount_cny") / 1000).alias("amount"), F.lit(0.0).alias("pct_chg"))
    members = p.groupBy(code).agg(F.max("industry_l1_code").alias("industry_code")).select("ts_code", "industry_code", F.concat(F.lit("Industry "), "industry_code").alias("industry_name"), F.lit("19950101").alias("in_date"), F.lit(None).cast("string").alias("out_date"))
    return {
        "daily": daily, "adj_factor": p.select(day, code, F.lit(2.0).alias("adj_factor")), "daily_basic": p.select(day, code, (F.col("total_mv_cny") / 10000).alias("total_mv"), (F.col("total_mv_cny") / 20000).alias("circ_mv"), "turnover_rate"),
        "stk_limit": p.select(day, code, (F.col("adj_close") * 1.1).alias("up_limit"), (F.col("adj_close") * 0.9).alias("down_limit")), "stock_basic": p.select(code).distinct(), "industry_membership": members,
        "st_status": p.filter("ts_code % 17 = 0").select(day, code, F.lit("ST").alias("name")), "st_status_coverage": p.select(day).distinct(),
    }


PANEL_POLICY = panels.FlagPolicy(listing_age=10, window=5, least_mean_amount=40000, least_traded=5)


@query(f"""{PANEL_SQL}, a AS (SELECT *, row_number() OVER {W} AS age, count(amount_cny) OVER f AS traded, avg(amount_cny) OVER f AS mean FROM panel WINDOW f AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT trade_date, CAST(ts_code AS VARCHAR) AS ts_code, {r6('adj_close * 2')} AS adj_close, {r6('volume_shares')} AS volume_shares, {r6('total_mv_cny')} AS total_mv_cny, industry_l1_code, adj_open >= adj_close * 1.1 - 0.001 AS is_limit_up_open, ts_code % 17 = 0 AS is_st, age AS listing_trade_days,
 age >= 10 AS is_factor_eligible, age >= 10 AND ts_code % 17 <> 0 AS is_tradeable, age >= 10 AND ts_code % 17 <> 0 AND traded >= 5 AND mean >= 40000 AS is_liquid FROM a""")
def panel_build(spark, sf_dir):
    p = panels.build_panel(_vendor(spark, sf_dir), PANEL_POLICY)
    return p.select("trade_date", "ts_code", *(shown(F.col(c)).alias(c) for c in ("adj_close", "volume_shares", "total_mv_cny")), "industry_l1_code", "is_limit_up_open", "is_st", "listing_trade_days", "is_factor_eligible", "is_tradeable", "is_liquid")


@query(f"{PANEL_SQL} SELECT 'valid_ohlc' AS rule, 'BLOCKING' AS severity, count(*) AS n FROM panel WHERE adj_close < 0 HAVING count(*) > 0")
def panel_quality(spark, sf_dir):
    return panels.quality_issues(panels.build_panel(_vendor(spark, sf_dir), PANEL_POLICY))


# Timing


@query(f"""{PANEL_SQL}, d AS (SELECT trade_date, avg(adj_close) AS v FROM panel GROUP BY 1), a AS (SELECT *, CASE WHEN count(v) OVER f >= 10 THEN median(v) OVER f END AS m FROM d WINDOW f AS (ORDER BY trade_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, abs(v - m) AS e FROM a), c AS (SELECT *, CASE WHEN count(e) OVER f >= 10 THEN median(e) OVER f END AS mad FROM b WINDOW f AS (ORDER BY trade_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT trade_date, {r6('0.67448975 * (v - m) / nullif(mad, 0)')} AS z FROM c""")
def timing_mad_z(spark, sf_dir):
    d = weekly_panel(spark, sf_dir).groupBy("trade_date").agg(F.avg("adj_close").alias("v"))  # one row a session
    return timing.mad_z(d, "v", 30, 10, "z").select("trade_date", shown(F.col("z")).alias("z"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE) WHEN o_orderkey % 3 = 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS day, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price FROM orders""")
def timing_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyyMM")).otherwise("none")
    amount = F.when(k % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", timing.parse_date(text).alias("day"), timing.number(amount).alias("price"))


@query()
def timing_implied_volatility(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (80 + F.col("o_orderkey") % 40).cast("double").alias("strike"), (0.1 + (F.col("o_orderkey") % 9) / 10).alias("years"), (F.col("o_orderkey") % 2 == 0).alias("call"))
    price = F.greatest(F.when(F.col("call"), 100 - F.col("strike")).otherwise(F.col("strike") - 100), F.lit(0.0)) + 6.0
    return o.select("o_orderkey", timing.implied_volatility(price, F.lit(100.0), F.col("strike"), F.col("years"), F.lit(0.02), F.col("call")).alias("sigma"))


@query()
def timing_ewm(spark, sf_dir):
    return timing.ewm(weekly_panel(spark, sf_dir), "adj_close", "ewm", span=12, least=5)


@query()
def timing_rsi(spark, sf_dir):
    return timing.rsi(weekly_panel(spark, sf_dir))


@query()
def timing_hmm(spark, sf_dir):
    return timing.hmm_filter(_industry_returns(spark, sf_dir), "r", "code")


@query()
def timing_positions(spark, sf_dir):
    d = weekly_panel(spark, sf_dir).groupBy("trade_date").agg(F.avg("turnover_rate").alias("v")).withColumn("series", F.lit("market")).withColumn("target", timing.position(F.col("v"), 0.03, 0.06))
    return timing.smoothed_position(d, "target", "position", 0.1, "series")


# Factor health, and a model


@query(f"""{FUTURE_SQL}, k AS (SELECT trade_date, ts_code, row_number() OVER (PARTITION BY trade_date ORDER BY step DESC, ts_code) <= 10 AS top FROM fut WHERE step IS NOT NULL), t AS (SELECT trade_date, list(ts_code) AS codes FROM k WHERE top GROUP BY 1)
SELECT trade_date, CASE WHEN before IS NOT NULL THEN {r6('1 - len(list_intersect(codes, before)) / 10.0')} END AS turnover FROM (SELECT *, lag(codes) OVER (ORDER BY trade_date) AS before FROM t)""")
def health_turnover(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("step"), "ts_code"))
    t = future(spark, sf_dir).filter("step is not null").withColumn("r", r).filter("r <= 10").groupBy("trade_date").agg(F.collect_set("ts_code").alias("codes"))
    before = F.lag("codes").over(Window.orderBy("trade_date"))  # one row a session
    return t.select("trade_date", shown(1 - F.size(F.array_intersect("codes", before)) / 10.0).alias("turnover")).withColumn("turnover", F.when(F.lag("trade_date").over(Window.orderBy("trade_date")).isNotNull(), F.col("turnover")))


@query()
def model_elastic_net(spark, sf_dir):
    """Purged walk-forward: fit on dates before a cut less the label's horizon, score the dates after."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    p = future(spark, sf_dir).withColumns({"r1": F.col("step"), "r4": frames.rolling(F.col("step"), 4, "sum")}).dropna(subset=["r1", "r4", "fwd"])
    x = VectorAssembler(inputCols=["r1", "r4", "turnover_rate", "log_total_mv"], outputCol="features").transform(p)
    model = LinearRegression(labelCol="fwd", regParam=0.01, elasticNetParam=0.5).fit(x.filter("trade_date < date'2000-01-01' - interval 21 days"))
    scored = model.transform(x.filter("trade_date >= date'2000-01-01'"))
    return stats.daily_ic(scored, "prediction", "fwd")


# Streams (on static frames: what the stream gives once all data have come)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return streams.tumbling(table(spark, sf_dir, "events"))


@query("""WITH a AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS fresh FROM events), b AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS "end", count(*) AS n FROM b GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))


@query("SELECT CAST(s AS TIMESTAMP) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM events) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return streams.sliding(table(spark, sf_dir, "events")).drop("users")
