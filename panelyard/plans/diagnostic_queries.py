"""Component diagnostics, attribution, placebos, holdings and robustness as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.operators import attribution, diagnostics, events, health, holdings, models, outcomes, regimes, rotation, scoring, stats, timing
from panelyard.plans import research_queries, study_queries
from panelyard.plans.panel_queries import FUTURE_SQL, RETURNS_SQL, W, future, r6, returns
from panelyard.plans.study_queries import said
from panelyard.sources.market import weekly_panel

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query and its SQL under its function's name."""

    def register(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return register


# Components: by value, by information coefficient, by what they pick

COMPONENTS = ("step", "change4", "change12", "turnover_rate", "cap", "spread", "amount", "quiet")
COMPONENTS_SQL = f"""{FUTURE_SQL}, comp AS (SELECT trade_date, ts_code, fwd, is_liquid, step, adj_close / lag(adj_close, 4) OVER {W} - 1 AS change4, adj_close / lag(adj_close, 12) OVER {W} - 1 AS change12, turnover_rate,
 CASE WHEN is_liquid THEN -log_total_mv END AS cap, CASE WHEN adj_high > adj_low THEN adj_high / adj_low - 1 END AS spread, round(amount_cny / 10000) AS amount, CASE WHEN volume_shares < 100 THEN -volume_shares END AS quiet FROM fut),
long AS (UNPIVOT (SELECT trade_date, ts_code, fwd, is_liquid, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in COMPONENTS)} FROM comp) ON {', '.join(COMPONENTS)} INTO NAME c VALUE v)"""
_AVG = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def _components(spark, sf_dir):
    w, close = frames.history(), F.col("adj_close")
    change = lambda k: frames.safe_ratio(close, F.lag(close, k).over(w)) - 1
    p = future(spark, sf_dir)
    return p.select(
        "trade_date", "ts_code", "fwd", "is_liquid", "step", change(4).alias("change4"), change(12).alias("change12"), "turnover_rate", F.when(F.col("is_liquid"), -F.col("log_total_mv")).alias("cap"),
        F.when(F.col("adj_high") > F.col("adj_low"), F.col("adj_high") / F.col("adj_low") - 1).alias("spread"), F.round(F.col("amount_cny") / 10000).alias("amount"), F.when(F.col("volume_shares") < 100, -F.col("volume_shares")).alias("quiet"),
    )


_BOTH = "SELECT trade_date, a.c AS component_a, b.c AS component_b, a.v AS x, b.v AS y FROM long a JOIN long b USING (trade_date, ts_code)"


@query(f"""{COMPONENTS_SQL}, both_ AS ({_BOTH}), rk AS (SELECT trade_date, component_a, component_b, {_AVG.format(by='trade_date, component_a, component_b', x='x')} AS rx, {_AVG.format(by='trade_date, component_a, component_b', x='y')} AS ry FROM both_),
dd AS (SELECT trade_date, component_a, component_b, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS r FROM rk GROUP BY ALL),
sm AS (SELECT component_a, component_b, avg(r) FILTER (n >= 3) AS m, count(r) FILTER (n >= 3) AS k, count(*) FILTER (n >= 3) AS own FROM dd GROUP BY ALL)
SELECT component_a, component_b, {r6('CASE WHEN component_a = component_b THEN 1.0 ELSE m END')} AS mean_daily_spearman, CASE WHEN component_a = component_b THEN own ELSE k END AS days FROM sm""")
def diagnostic_value_correlation(spark, sf_dir):
    return said(diagnostics.value_correlation(_components(spark, sf_dir), list(COMPONENTS)), "mean_daily_spearman")


@query(f"""{COMPONENTS_SQL}, s AS (SELECT trade_date, c, {_AVG.format(by='trade_date, c', x='v')} AS rx, {_AVG.format(by='trade_date, c', x='fwd')} AS ry FROM long WHERE is_liquid AND fwd IS NOT NULL),
ic AS (SELECT trade_date, c, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM s GROUP BY ALL HAVING count(*) >= 5)
SELECT a.c AS component_a, b.c AS component_b, {r6('corr(a.ic, b.ic)')} AS ic_series_correlation FROM ic a JOIN ic b USING (trade_date) WHERE a.ic IS NOT NULL AND b.ic IS NOT NULL GROUP BY ALL""")
def diagnostic_ic_correlation(spark, sf_dir):
    return said(diagnostics.ic_correlation(_components(spark, sf_dir).filter("is_liquid"), list(COMPONENTS), "fwd", 5), "ic_series_correlation")


@query(f"""{COMPONENTS_SQL}, pl AS (SELECT trade_date, ts_code, c, row_number() OVER (PARTITION BY trade_date, c ORDER BY v DESC, ts_code) AS p FROM long), sz AS (SELECT unnest([2, 5, 10, 20]) AS top_n),
t AS (SELECT trade_date, c, top_n, count(*) AS n FROM pl JOIN sz ON p <= top_n GROUP BY ALL), b AS (SELECT trade_date, x.c AS component_a, y.c AS component_b, top_n, count(*) AS n FROM pl x JOIN pl y USING (trade_date, ts_code) JOIN sz ON x.p <= top_n AND y.p <= top_n GROUP BY ALL)
SELECT x.c AS component_a, y.c AS component_b, x.top_n, {r6('avg(coalesce(b.n, 0) / (x.n + y.n - coalesce(b.n, 0)))')} AS mean_jaccard FROM t x JOIN t y ON x.trade_date = y.trade_date AND x.top_n = y.top_n
LEFT JOIN b ON b.trade_date = x.trade_date AND b.top_n = x.top_n AND b.component_a = x.c AND b.component_b = y.c WHERE list_position({list(COMPONENTS)!r}, x.c) < list_position({list(COMPONENTS)!r}, y.c) GROUP BY ALL""")
def diagnostic_top_overlap(spark, sf_dir):
    return said(diagnostics.top_overlap(_components(spark, sf_dir), list(COMPONENTS)), "mean_jaccard")


# Attribution

_SIGNALS = ("small", "steady")
_SQL_SIGNALS = f"""{FUTURE_SQL}, sg AS (SELECT *, -log_total_mv AS small, CASE WHEN count(step) OVER s8 >= 8 THEN -stddev_pop(step) OVER s8 END AS steady, lead(adj_open, 2) OVER {W} / lead(adj_open, 1) OVER {W} - 1 AS f FROM fut WINDOW s8 AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""
_STYLE_SQL = _SQL_SIGNALS + "".join(
    f""", r_{s} AS (SELECT trade_date, f, ({_AVG.format(by='trade_date', x=s)}) / count(*) OVER (PARTITION BY trade_date) AS r FROM sg WHERE is_liquid AND f IS NOT NULL AND {s} IS NOT NULL), d_{s} AS (SELECT trade_date, avg(f) FILTER (r >= 2.0::DOUBLE / 3) - avg(f) FILTER (r <= 1.0::DOUBLE / 3) AS {s} FROM r_{s} GROUP BY 1)"""
    for s in _SIGNALS
) + """, cal AS (SELECT trade_date AS was, lead(trade_date, 2) OVER (ORDER BY trade_date) AS trade_date FROM (SELECT DISTINCT trade_date FROM sg)),
style AS (SELECT cal.trade_date, small, steady FROM cal LEFT JOIN d_small ON d_small.trade_date = was LEFT JOIN d_steady ON d_steady.trade_date = was WHERE cal.trade_date IS NOT NULL)"""
_HELD_SQL = _STYLE_SQL + """, y AS (SELECT industry_l1_code, trade_date, avg(step) AS y FROM sg WHERE is_liquid AND step IS NOT NULL GROUP BY ALL), x AS (SELECT industry_l1_code, trade_date, y, small, steady FROM y JOIN style USING (trade_date) WHERE y IS NOT NULL AND small IS NOT NULL AND steady IS NOT NULL)"""


def _styles(spark, sf_dir):
    p = future(spark, sf_dir)
    p = p.withColumns({"small": -F.col("log_total_mv"), "steady": -frames.rolling(F.col("step"), 8, "std")})
    held = p.filter("is_liquid and step is not null").groupBy("industry_l1_code", "trade_date").agg(F.avg("step").alias("y"))
    return p, attribution.style_returns(p, list(_SIGNALS), "is_liquid"), held


@query(f"{_STYLE_SQL} SELECT trade_date, {r6('small')} AS small, {r6('steady')} AS steady FROM style")
def attribution_style_returns(spark, sf_dir):
    return said(_styles(spark, sf_dir)[1], *_SIGNALS)


def _det(a: str) -> str:
    return f"({a}00 * ({a}11 * {a}22 - {a}12 * {a}12) - {a}01 * ({a}01 * {a}22 - {a}12 * {a}02) + {a}02 * ({a}01 * {a}12 - {a}11 * {a}02))"


_X = ("1.0", "small", "steady")
_INV = {"00": "m11 * m22 - m12 * m12", "01": "m02 * m12 - m01 * m22", "02": "m01 * m12 - m02 * m11", "11": "m00 * m22 - m02 * m02", "12": "m01 * m02 - m00 * m12", "22": "m00 * m11 - m01 * m01"}
_SUMS = ", ".join([f"sum({_X[i]} * {_X[j]}) AS m{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum({_X[i]} * y) AS v{i}" for i in range(3)])
_INVERSE = ", ".join(f"({v}) / {_det('m')} AS i{k}" for k, v in _INV.items())


def _i(a: int, b: int) -> str:
    return f"i{min(a, b)}{max(a, b)}"


_BETA = ", ".join(f"{' + '.join(f'{_i(a, b)} * v{b}' for b in range(3))} AS b{a}" for a in range(3))
_LAGS = 5
_FIT_SQL = _HELD_SQL + f""", su AS (SELECT industry_l1_code, count(*) AS n_obs, sum(y * y) AS yy, {_SUMS} FROM x GROUP BY 1), iv AS (SELECT *, {_INVERSE} FROM su), ft AS (SELECT *, {_BETA} FROM iv),
u AS (SELECT x.*, y - b0 - b1 * small - b2 * steady AS u FROM x JOIN ft USING (industry_l1_code)), g AS (SELECT *, u AS g0, u * small AS g1, u * steady AS g2, row_number() OVER (PARTITION BY industry_l1_code ORDER BY trade_date) AS k FROM u),
s0 AS (SELECT industry_l1_code, sum(u * u) AS uu, {', '.join(f'sum(g{i} * g{j}) AS o{i}{j}' for i in range(3) for j in range(i, 3))} FROM g GROUP BY 1),
s1 AS (SELECT a.industry_l1_code, {', '.join(f'sum((1 - (a.k - b.k) / {_LAGS + 1}.0::DOUBLE) * (a.g{i} * b.g{j} + b.g{i} * a.g{j})) AS l{i}{j}' for i in range(3) for j in range(i, 3))} FROM g a JOIN g b ON a.industry_l1_code = b.industry_l1_code AND a.k - b.k BETWEEN 1 AND {_LAGS} GROUP BY 1),
al AS (SELECT *, {', '.join(f'o{i}{j} + l{i}{j} AS s{i}{j}' for i in range(3) for j in range(i, 3))}, 1 - uu / (yy - v0 * v0 / n_obs) AS r2 FROM ft JOIN s0 USING (industry_l1_code) JOIN s1 USING (industry_l1_code)),
tm AS (""" + " UNION ALL ".join(
    f"SELECT industry_l1_code, '{name}' AS term, n_obs, r2, b{t} AS coefficient, sqrt({' + '.join(f'{_i(t, i)} * s{min(i, j)}{max(i, j)} * {_i(j, t)}' for i in range(3) for j in range(3))}) AS std_error FROM al" for t, name in enumerate(("alpha", *_SIGNALS))
) + ")"


@query(f"{_FIT_SQL} SELECT industry_l1_code, term, n_obs, {r6('r2')} AS r_squared, {r6('coefficient')} AS coefficient, {r6('std_error')} AS std_error, {r6('coefficient / std_error')} AS t_value FROM tm")
def attribution_regression(spark, sf_dir):
    _, style, held = _styles(spark, sf_dir)
    return said(attribution.hac_regression(held.join(style, "trade_date"), ["industry_l1_code"], "y", list(_SIGNALS), _LAGS), "r_squared", "coefficient", "std_error", "t_value")


@query(f"""{_HELD_SQL}, nb AS (SELECT industry_l1_code, row_number() OVER o - 1 AS spot, {', '.join(f'sum({_X[i]} * {_X[j]}) OVER f AS m{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'sum({_X[i]} * y) OVER f AS v{i}' for i in range(3))} FROM x
 WINDOW o AS (PARTITION BY industry_l1_code ORDER BY trade_date), f AS (PARTITION BY industry_l1_code ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
sz AS (SELECT industry_l1_code, count(*) AS n FROM x GROUP BY 1), dr AS (SELECT industry_l1_code, n, d.draw, unnest(range(greatest(n // 10, 1))) AS k FROM sz, range(200) d(draw)),
st AS (SELECT industry_l1_code, draw, ('0x' || substr(md5('42:' || draw || ':' || k), 1, 8))::BIGINT % (n - 10) AS spot FROM dr), sm AS (SELECT industry_l1_code, draw, {', '.join(f'sum(m{i}{j}) AS m{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'sum(v{i}) AS v{i}' for i in range(3))} FROM st JOIN nb USING (industry_l1_code, spot) GROUP BY ALL),
iv AS (SELECT *, {_INVERSE} FROM sm), ft AS (SELECT *, {_BETA} FROM iv)
SELECT industry_l1_code, count(b0) AS draws, {r6('quantile_cont(b0, 0.025)')} AS alpha_low, {r6('quantile_cont(b0, 0.975)')} AS alpha_high FROM ft GROUP BY 1""")
def attribution_bootstrap(spark, sf_dir):
    _, style, held = _styles(spark, sf_dir)
    return said(attribution.bootstrap_alpha(held.join(style, "trade_date"), ["industry_l1_code"], "y", list(_SIGNALS), 10, 200), "alpha_low", "alpha_high")


# Placebos that keep states


def _dealt(of: str, by: str, value: str, salt: str, known: str = "true") -> str:
    key = f"md5('{salt}:' || " + " || ':' || ".join(f"{c}::VARCHAR" for c in (*by.split(", "), "ts_code")) + ")"
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY {by}, {known} ORDER BY {key}, ts_code) AS too, row_number() OVER (PARTITION BY {by}, {known} ORDER BY ts_code) AS fro, {known} AS known FROM {of}),
pl AS (SELECT a.*, b.{value} AS placebo FROM rk a LEFT JOIN rk b ON {' AND '.join(f'a.{c} = b.{c}' for c in by.split(', '))} AND a.too = b.fro AND a.known AND b.known)"""


_STATE_SQL = f"{RETURNS_SQL}, st AS (SELECT trade_date, ts_code, step, CASE WHEN volume_shares > 60 THEN 'high' WHEN volume_shares > 25 THEN 'mid' END AS state FROM ret)"


def _states(spark, sf_dir):
    v = F.col("volume_shares")
    return returns(spark, sf_dir).select("trade_date", "ts_code", "step", F.when(v > 60, "high").when(v > 25, "mid").alias("state"))


@query(f"{_STATE_SQL}, {_dealt('st', 'trade_date, state', 'step', 'rrg', 'step IS NOT NULL AND state IS NOT NULL')} SELECT trade_date, ts_code, state, {r6('step')} AS step, {r6('placebo')} AS placebo FROM pl")
def placebo_within_state(spark, sf_dir):
    return said(rotation.shuffle_placebo(_states(spark, sf_dir), "step", ("trade_date", "state"), salt="rrg"), "step", "placebo")


@query(f"{_STATE_SQL}, {_dealt('st', 'trade_date', 'step', 'label')} SELECT trade_date, ts_code, state, {r6('step')} AS step, {r6('placebo')} AS placebo FROM pl")
def placebo_labels(spark, sf_dir):
    return said(rotation.shuffle_placebo(_states(spark, sf_dir), "step", salt="label", missing="move"), "step", "placebo")


# States of refits


@query(f"""{RETURNS_SQL}, raw AS (SELECT industry_l1_code, year(trade_date) * 4 + quarter(trade_date) AS period, CAST(('0x' || substr(md5((ts_code % 3) || ':' || (year(trade_date) * 4 + quarter(trade_date))), 1, 8))::BIGINT AS BIGINT) AS h, ts_code % 3 AS own, avg(turnover_rate) AS a, avg(log_total_mv) AS b FROM ret GROUP BY ALL),
f AS (SELECT industry_l1_code, period, list([round(a, 9), round(b, 9)] ORDER BY h) AS means FROM raw GROUP BY ALL HAVING count(*) = 3), n AS (SELECT *, row_number() OVER (PARTITION BY industry_l1_code ORDER BY period) AS k FROM f),
pm AS (SELECT unnest([[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]) AS p),
r AS (WITH RECURSIVE w AS (SELECT n.industry_l1_code, k, period, means, list_transform(list_sort(list_transform([0, 1, 2], lambda i: [means[i + 1][1], i::DOUBLE])), lambda x: x[2]::INT) AS aligned FROM n WHERE k = 1
 UNION ALL SELECT n.industry_l1_code, n.k, n.period, n.means, arg_min(p, (pow(w.means[w.aligned[1] + 1][1] - n.means[p[1] + 1][1], 2) + pow(w.means[w.aligned[1] + 1][2] - n.means[p[1] + 1][2], 2) + pow(w.means[w.aligned[2] + 1][1] - n.means[p[2] + 1][1], 2) + pow(w.means[w.aligned[2] + 1][2] - n.means[p[2] + 1][2], 2) + pow(w.means[w.aligned[3] + 1][1] - n.means[p[3] + 1][1], 2) + pow(w.means[w.aligned[3] + 1][2] - n.means[p[3] + 1][2], 2)))
 FROM w JOIN n ON n.industry_l1_code = w.industry_l1_code AND n.k = w.k + 1, pm GROUP BY ALL) SELECT * FROM w)
SELECT industry_l1_code, period, array_to_string(aligned, ',') AS aligned, {r6('means[aligned[1] + 1][2]')} AS size_0, {r6('means[aligned[2] + 1][2]')} AS size_1, {r6('means[aligned[3] + 1][2]')} AS size_2 FROM r""")
def regime_state_alignment(spark, sf_dir):
    period = F.year("trade_date") * 4 + F.quarter("trade_date")
    raw = returns(spark, sf_dir).groupBy("industry_l1_code", period.alias("period"), (F.col("ts_code") % 3).alias("own")).agg(F.round(F.avg("turnover_rate"), 9).alias("a"), F.round(F.avg("log_total_mv"), 9).alias("b"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "own", "period").cast("binary")), 1, 8), 16, 10).cast("long")
    fits = raw.groupBy("industry_l1_code", "period").agg(F.sort_array(F.collect_list(F.struct(h.alias("h"), F.array("a", "b").alias("m")))).alias("all")).filter("size(all) = 3")
    fits = fits.select("industry_l1_code", "period", F.transform("all", lambda x: x["m"]).alias("means"))
    out = models.align_states(fits, ["industry_l1_code"], "means", "period", 3)
    size = lambda i: F.get(F.get("means", F.get("aligned", F.lit(i))), F.lit(1))
    return said(out.select("industry_l1_code", "period", F.array_join("aligned", ",").alias("aligned"), *(size(i).alias(f"size_{i}") for i in range(3))), "size_0", "size_1", "size_2")


def regime_mixture_walk(spark, sf_dir):
    daily = regimes.breadth_regimes(weekly_panel(spark, sf_dir), cap="total_mv_cny").select("trade_date", "market_breadth", (F.col("market_return") * 10).alias("market_return"))
    return models.mixture_walk_forward(daily, ["market_breadth", "market_return"], 3, 104, 4)


QUERIES["regime_mixture_walk"] = regime_mixture_walk  # a fit: tests hold it against plain loops


# Holdings

_HOLD_SQL = f"""{RETURNS_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS s FROM (SELECT DISTINCT trade_date FROM ret)), sg AS (SELECT trade_date, ts_code FROM ret WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY step DESC, ts_code) <= 5),
po AS (SELECT c.trade_date, c.s, ts_code, sg.trade_date AS signal_date FROM sg JOIN cal b ON b.trade_date = sg.trade_date JOIN cal c ON c.s BETWEEN b.s + 1 AND b.s + 4),
pv AS (SELECT po.*, industry_l1_code, coalesce(adj_close, 1) AS v FROM po LEFT JOIN ret ON ret.trade_date = po.trade_date AND ret.ts_code = po.ts_code), ow AS (SELECT trade_date, s, ts_code, sum(v) AS v, count(*) AS lots, max(industry_l1_code) AS g FROM pv GROUP BY ALL), wt AS (SELECT *, v / sum(v) OVER (PARTITION BY trade_date) AS w FROM ow),
isl AS (SELECT *, s - row_number() OVER (PARTITION BY ts_code ORDER BY s) AS i FROM ow), sp AS (SELECT ts_code, min(trade_date) AS entry_date, max(trade_date) AS last_date, count(*) AS sessions FROM isl GROUP BY ts_code, i),
ch AS (SELECT coalesce(a.s, b.s + 1) AS s, a.ts_code AS own, a.lots, a.g, a.w, coalesce(a.w, 0) - coalesce(b.w, 0) AS d, a.ts_code IS NOT NULL AND b.ts_code IS NULL AS fresh, a.ts_code IS NULL AS gone FROM wt a FULL JOIN wt b ON a.ts_code = b.ts_code AND a.s = b.s + 1),
dy AS (SELECT cal.trade_date, coalesce(sum(lots), 0)::BIGINT AS holding_count, count(own) AS unique_holding_count, count(DISTINCT g) AS group_count, count(*) FILTER (fresh) AS entries, count(*) FILTER (gone) AS exits, coalesce(sum(abs(d)) / 2, 0) AS turnover, max(w) AS largest_weight FROM cal LEFT JOIN ch USING (s) GROUP BY 1)"""


def _book(spark, sf_dir):
    r = returns(spark, sf_dir)
    best = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("step"), "ts_code"))
    signals = r.filter("step is not null").withColumn("_k", best).filter("_k <= 5").select("trade_date", "ts_code")
    held = holdings.lots(signals, r, 1, 4).join(r.select("trade_date", "ts_code", "industry_l1_code", "adj_close"), ["trade_date", "ts_code"], "left")
    return r.select("trade_date"), signals, held.withColumn("value", F.coalesce("adj_close", F.lit(1.0)))


@query(f"{_HOLD_SQL} SELECT ts_code, entry_date, last_date, sessions, last_date = (SELECT max(trade_date) FROM cal) AS open FROM sp")
def holding_spells(spark, sf_dir):
    calendar, _, held = _book(spark, sf_dir)
    return holdings.spells(held, calendar)


@query(f"{_HOLD_SQL} SELECT trade_date, holding_count, unique_holding_count, group_count, entries, exits, {r6('turnover')} AS turnover, {r6('largest_weight')} AS largest_weight FROM dy")
def holding_daily(spark, sf_dir):
    calendar, _, held = _book(spark, sf_dir)
    return said(holdings.daily_holdings(held, calendar, "value", "industry_l1_code"), "turnover", "largest_weight")


@query(f"""{_HOLD_SQL}, du AS (SELECT EXISTS (SELECT 1 FROM sg e JOIN cal d ON d.trade_date = e.trade_date WHERE e.ts_code = sg.ts_code AND d.s < c.s AND d.s + 4 >= c.s + 1) AS dup FROM sg JOIN cal c USING (trade_date))
SELECT {r6('avg(holding_count)')} AS average_holding_count, {r6('median(holding_count)')} AS median_holding_count, max(holding_count) AS max_holding_count, {r6('avg(unique_holding_count)')} AS average_unique_holding_count, {r6('median(unique_holding_count)')} AS median_unique_holding_count, max(unique_holding_count) AS max_unique_holding_count,
 {r6('avg(turnover)')} AS average_turnover, {r6('(SELECT avg(w) FROM wt)')} AS average_position_weight, {r6('(SELECT avg(sessions) FROM sp WHERE last_date < (SELECT max(trade_date) FROM cal))')} AS average_holding_sessions, (SELECT count(*) FROM sp WHERE last_date < (SELECT max(trade_date) FROM cal)) AS ended_spells,
 {r6('(SELECT avg(CAST(dup AS INT)) FROM du)')} AS duplicate_signal_rate FROM dy""")
def holding_statistics(spark, sf_dir):
    calendar, signals, held = _book(spark, sf_dir)
    out = holdings.holding_statistics(held, calendar, signals, "value", "industry_l1_code", 1, 4)
    return said(out, *(c for c in out.columns if not c.startswith(("max", "ended"))))


# Filters


@query(f"""{RETURNS_SQL}, q AS (SELECT trade_date, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM (SELECT trade_date, CASE WHEN is_liquid THEN step END AS v FROM ret) GROUP BY 1),
cl AS (SELECT trade_date, ts_code, CASE WHEN is_liquid AND step IS NOT NULL THEN least(greatest(step, lo), hi) END AS v FROM ret JOIN q USING (trade_date)), md AS (SELECT *, CASE WHEN count(v) OVER f >= 2 THEN median(v) OVER f END AS m, row_number() OVER {W} AS k FROM cl WINDOW f AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ew AS (WITH RECURSIVE r AS (SELECT ts_code, k, trade_date, m, m AS y, CASE WHEN m IS NULL THEN 0 ELSE 1 END::DOUBLE AS weight FROM md WHERE k = 1
 UNION ALL SELECT n.ts_code, n.k, n.trade_date, n.m, CASE WHEN n.m IS NULL THEN r.y WHEN r.y IS NULL THEN n.m ELSE (r.weight * 0.5 * r.y + 0.5 * n.m) / (r.weight * 0.5 + 0.5) END, CASE WHEN n.m IS NULL THEN r.weight * 0.5 ELSE 1 END FROM r JOIN md n ON n.ts_code = r.ts_code AND n.k = r.k + 1) SELECT * FROM r)
SELECT trade_date, ts_code, {r6('y')} AS denoised FROM ew""")
def timing_denoised(spark, sf_dir):
    rows = returns(spark, sf_dir).select("trade_date", "ts_code", F.when(F.col("is_liquid"), F.col("step")).alias("v"))
    return said(timing.denoised(rows, "v", "denoised").select("trade_date", "ts_code", "denoised"), "denoised")


# Memberships: what a backfill would leak, and bridges from members to concepts

_MEMBERS_SQL = f"""{RETURNS_SQL}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS s FROM (SELECT DISTINCT trade_date FROM ret)), mem AS (SELECT DISTINCT trade_date, 'c' || CASE WHEN k = 0 THEN '0' ELSE industry_l2_code END AS concept_code, ts_code
 FROM ret, range(2) g(k) WHERE k = 0 AND is_tradeable OR k = 1 AND volume_shares > 20 + ts_code % 40), lst AS (SELECT max(trade_date) AS latest FROM mem), lat AS (SELECT concept_code, ts_code FROM mem, lst WHERE trade_date = latest),
lk AS (SELECT cal.trade_date, concept_code, ts_code, 'leaked' AS kind FROM lat, cal WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.trade_date = cal.trade_date AND m.concept_code = lat.concept_code AND m.ts_code = lat.ts_code)
 UNION ALL SELECT trade_date, concept_code, ts_code, 'lost' FROM mem WHERE NOT EXISTS (SELECT 1 FROM lat WHERE lat.concept_code = mem.concept_code AND lat.ts_code = mem.ts_code))"""


def _members(spark, sf_dir, repeats=False):
    r = returns(spark, sf_dir)
    own = r.filter(F.col("volume_shares") > 20 + F.col("ts_code") % 40).select("trade_date", F.concat(F.lit("c"), "industry_l2_code").alias("concept_code"), "ts_code")
    both = r.filter("is_tradeable").select("trade_date", F.lit("c0").alias("concept_code"), "ts_code").unionByName(own)
    return r, both if repeats else both.distinct()


@query(f"{_MEMBERS_SQL} SELECT trade_date, concept_code, ts_code, kind FROM lk")
def membership_leaks(spark, sf_dir):
    r, m = _members(spark, sf_dir, repeats=True)
    return rotation.membership_leaks(m, r.select("trade_date"))


@query(f"""{_MEMBERS_SQL}, fl AS (SELECT trade_date, concept_code, ts_code, true AS was, NOT EXISTS (SELECT 1 FROM lk WHERE kind = 'lost' AND lk.trade_date = mem.trade_date AND lk.concept_code = mem.concept_code AND lk.ts_code = mem.ts_code) AS now FROM mem UNION ALL SELECT trade_date, concept_code, ts_code, false, true FROM lk WHERE kind = 'leaked')
SELECT fl.trade_date, concept_code, count(*) FILTER (was) AS members_then, count(*) FILTER (now) AS members_backfilled, count(*) FILTER (now AND NOT was) AS leaked, count(*) FILTER (was AND NOT now) AS lost, {r6('avg(step) FILTER (was)')} AS mean_then, {r6('avg(step) FILTER (now)')} AS mean_backfilled
FROM fl LEFT JOIN ret ON ret.trade_date = fl.trade_date AND ret.ts_code = fl.ts_code GROUP BY 1, 2""")
def membership_lookahead(spark, sf_dir):
    r, m = _members(spark, sf_dir)
    return said(rotation.lookahead_effect(m, rotation.membership_leaks(m, r.select("trade_date")), r, "step"), "mean_then", "mean_backfilled")


@query(f"""{_MEMBERS_SQL}, sk AS (SELECT trade_date, ts_code, total_mv_cny AS mv, amount_cny AS amount, adj_close / lag(adj_close, 4) OVER {W} - 1 > 0 AS up, step, lag(total_mv_cny) OVER {W} AS mv_before FROM ret WHERE ts_code % 10 <> 3),
sk2 AS (SELECT trade_date, ts_code, mv, amount, CASE WHEN up THEN 1.0 ELSE 0.0 END AS up, step, mv_before FROM sk), held AS (SELECT * FROM mem WHERE ts_code IN (SELECT ts_code FROM sk)), src AS (SELECT trade_date, concept_code, count(*) AS n FROM mem GROUP BY ALL),
nw AS (SELECT trade_date, concept_code, count(DISTINCT ts_code) AS matched, sum(mv) AS mv, sum(mv * up) AS upmv, avg(up) AS be, sum(amount) AS amount FROM held JOIN sk2 USING (trade_date, ts_code) GROUP BY ALL),
nx AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT trade_date FROM sk)), mv AS (SELECT nxt AS trade_date, concept_code, sum(mv_before * step) / nullif(sum(mv_before), 0) AS r FROM held JOIN nx USING (trade_date) JOIN sk2 ON sk2.trade_date = nxt AND sk2.ts_code = held.ts_code GROUP BY ALL)
SELECT trade_date, concept_code, n AS source_member_count, coalesce(matched, 0) AS matched_member_count, {r6('coalesce(matched, 0) / n')} AS member_match_coverage, {r6('nw.mv')} AS concept_mv, {r6('amount')} AS concept_amount, {r6('be')} AS breadth_equal, {r6('upmv / nullif(nw.mv, 0)')} AS breadth_capital, {r6('r')} AS concept_return, coalesce(matched, 0) BETWEEN 3 AND 50 AS usable
FROM src LEFT JOIN nw USING (trade_date, concept_code) LEFT JOIN mv USING (trade_date, concept_code)""")
def concept_bridge(spark, sf_dir):
    r, m = _members(spark, sf_dir)
    w = frames.history()
    up = frames.safe_ratio(F.col("adj_close"), F.lag("adj_close", 4).over(w)) - 1 > 0
    stocks = r.filter("ts_code % 10 <> 3").select("trade_date", "ts_code", F.col("total_mv_cny").alias("mv"), F.col("amount_cny").alias("amount"), up.alias("up"), "step", F.lag("total_mv_cny").over(w).alias("mv_before"))
    return said(rotation.bridge(m, stocks, least=3, most=50), "member_match_coverage", "concept_mv", "concept_amount", "breadth_equal", "breadth_capital", "concept_return")


# Events: balance of both sides, robustness of outcomes

_PAIRS_SQL = research_queries.ORACLES["event_matching"]
_COVARIATES = ("log_total_mv", "turnover_rate", "step", "amount_cny")


@query(f"""WITH pairs AS ({_PAIRS_SQL}), src AS ({RETURNS_SQL} SELECT trade_date, CAST(ts_code AS VARCHAR) AS code, {', '.join(_COVARIATES)} FROM ret), j AS (SELECT p.*, row_number() OVER (PARTITION BY p.trade_date, event_code ORDER BY control_code) = 1 AS once, {', '.join(f'e.{c} AS e_{c}, c.{c} AS c_{c}' for c in _COVARIATES)}
 FROM pairs p LEFT JOIN src e ON e.trade_date = p.trade_date AND e.code = p.event_code::VARCHAR LEFT JOIN src c ON c.trade_date = p.trade_date AND c.code = p.control_code::VARCHAR),
""" + "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS covariate, once, e_{c} AS e, c_{c} AS c FROM j" for c in _COVARIATES) + f"""), a AS (SELECT covariate, 'event_once' AS weighting, count(e) FILTER (once) AS events, avg(e) FILTER (once) AS em, var_pop(e) FILTER (once) AS ev, count(c) AS controls, avg(c) AS cm, var_pop(c) AS cv FROM u GROUP BY 1
 UNION ALL SELECT covariate, 'all_pairs', count(e), avg(e), var_pop(e), count(c), avg(c), var_pop(c) FROM u GROUP BY 1), s AS (SELECT *, (em - cm) / nullif(sqrt((ev + cv) / 2), 0) AS smd FROM a)
SELECT covariate, weighting, events, controls, {r6('em')} AS event_mean, {r6('cm')} AS control_mean, {r6('smd')} AS smd, {r6('abs(smd)')} AS abs_smd FROM s""")
def event_balance(spark, sf_dir):
    rows = research_queries._flagged(spark, sf_dir)
    pairs = events.with_covariates(events.match_controls(rows, ["size"], 3, 1.0), rows, list(_COVARIATES))
    return said(events.balance(pairs, list(_COVARIATES)), "event_mean", "control_mean", "smd", "abs_smd")


_OUT_SQL = f"SELECT * FROM ({study_queries.ORACLES['path_evaluation']})"


def _outcomes(spark, sf_dir):
    return study_queries.path_evaluation(spark, sf_dir)  # shown values: both sides start from the same


@query(f"""WITH o AS ({_OUT_SQL}), r AS (SELECT horizon, net_return AS v, row_number() OVER (PARTITION BY horizon ORDER BY net_return DESC) AS k, count(*) OVER (PARTITION BY horizon) AS n FROM o), d AS (SELECT *, greatest(ceil(n * 0.05), 1)::BIGINT AS dropped FROM r)
SELECT horizon, any_value(n) AS n, any_value(dropped) AS dropped, {r6('avg(v)')} AS mean, {r6('avg(v) FILTER (k > dropped)')} AS trimmed_mean FROM d GROUP BY 1""")
def outcome_trimmed(spark, sf_dir):
    return said(outcomes.trimmed(_outcomes(spark, sf_dir), ["horizon"], "net_return", 0.05), "mean", "trimmed_mean")


@query(f"""WITH o AS ({_OUT_SQL}), y AS (SELECT horizon, year(trade_date) AS year, count(*) AS n, sum(net_return) AS s, avg(net_return) AS m, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS p FROM o GROUP BY ALL),
b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY horizon ORDER BY year) > 3 THEN sum(s) OVER w / sum(n) OVER w END AS mb FROM y WINDOW w AS (PARTITION BY horizon ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT horizon, year, n, {r6('m')} AS mean, {r6('p')} AS positive_ratio, {r6('mb')} AS mean_before, mb * m > 0 AS holds FROM b""")
def outcome_years(spark, sf_dir):
    return said(outcomes.yearly(_outcomes(spark, sf_dir), ["horizon"], "net_return"), "mean", "positive_ratio", "mean_before")


@query(f"""WITH o AS ({_OUT_SQL}), d AS (SELECT horizon, trade_date, avg(net_return) AS d FROM o GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY greatest(d, 0) DESC, trade_date) AS k, CASE WHEN count(*) OVER w >= 20 THEN sum(d) OVER w END AS r FROM d WINDOW w AS (PARTITION BY horizon ORDER BY trade_date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
SELECT horizon, count(*) AS days, {r6('avg(d) * 52')} AS annual_mean, {r6('avg(d) FILTER (k > 10) * 52')} AS without_best, {r6('sum(greatest(d, 0)) FILTER (k <= 10) / sum(greatest(d, 0))')} AS best_share, {r6('avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END)')} AS rolling_positive_ratio FROM k GROUP BY 1""")
def outcome_days(spark, sf_dir):
    return said(outcomes.day_concentration(_outcomes(spark, sf_dir), ["horizon"], "net_return", window=52, least=20, year=52), "annual_mean", "without_best", "best_share", "rolling_positive_ratio")


@query(f"""WITH o AS ({_OUT_SQL}), c AS (SELECT horizon, cost_bps, gross_return AS g, (1 + gross_return) * (1 - cost_bps / 20000) - 1 - cost_bps / 20000 AS net FROM o, (SELECT unnest([0.0, 10.0, 20.0, 50.0]::DOUBLE[]) AS cost_bps))
SELECT horizon, cost_bps, count(*) AS n, {r6('avg(net)')} AS mean_net, {r6('median(net)')} AS median_net, {r6('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_ratio, {r6('CASE WHEN avg(g) > 0 THEN 20000 * avg(g) / (2 + avg(g)) ELSE 0 END')} AS break_even_bps FROM c GROUP BY ALL""")
def outcome_costs(spark, sf_dir):
    return said(outcomes.cost_curve(_outcomes(spark, sf_dir), ["horizon"], "gross_return", [0, 10, 20, 50]), "mean_net", "median_net", "positive_ratio", "break_even_bps")


# Health of a factor


def _decile_edges(q: int) -> str:
    parts = []
    for k in range(1, q):
        x = f"((n - 1) * {(k * (1.0 / q)) * 100 / 100!r}::DOUBLE)"
        low, high, part = f"(floor({x}) + 1)", f"least(floor({x}) + 2, n)", f"({x} - floor({x}))"
        parts.append(f"CAST((CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part} ELSE {high} - ({high} - {low}) * (1 - {part}) END) < k AS INT)")
    return " + ".join(["1", *parts])


_HEALTH = ("rank_ic", "pearson_ic", "decile_monotonicity", "top_decile_return", "bottom_decile_return", "decile_spread", "score_dispersion", "top_bottom_score_gap", "top_decile_turnover", "holding_overlap", "top_stock_concentration", "amount_cny")
_HEALTH_SQL = f"""{FUTURE_SQL}, pr AS (SELECT trade_date, ts_code, step AS x, fwd AS y, amount_cny, count(*) OVER (PARTITION BY trade_date) AS n FROM fut WHERE step IS NOT NULL AND fwd IS NOT NULL), rk AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY x, ts_code) AS k, {_AVG.format(by='trade_date', x='x')} AS xr, {_AVG.format(by='trade_date', x='y')} AS yr FROM pr WHERE n >= 10),
bk AS (SELECT *, {_decile_edges(5)} AS d, k / n > 1.0::DOUBLE - 1.0::DOUBLE / 5 AS top, k / n <= 1.0::DOUBLE / 5 AS low FROM rk), dm AS (SELECT trade_date, d, avg(y) AS m FROM bk GROUP BY ALL), dr AS (SELECT *, {_AVG.format(by='trade_date', x='m')} AS r FROM dm), mono AS (SELECT trade_date, CASE WHEN count(*) >= 3 THEN corr(d, r) END AS decile_monotonicity, max(m) FILTER (d = 5) AS t, max(m) FILTER (d = 1) AS b FROM dr GROUP BY 1),
ag AS (SELECT trade_date, any_value(n) AS observation_count, corr(xr, yr) AS rank_ic, corr(x, y) AS pearson_ic, stddev_samp(x) AS score_dispersion, avg(x) FILTER (top) - avg(x) FILTER (low) AS top_bottom_score_gap, max(abs(x)) FILTER (top) / sum(abs(x)) FILTER (top) AS top_stock_concentration, count(*) FILTER (top) AS held, avg(amount_cny) AS amount_cny FROM bk GROUP BY 1),
st AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS s, lag(held) OVER (ORDER BY trade_date) AS had FROM ag), tp AS (SELECT s, ts_code FROM bk JOIN st USING (trade_date) WHERE top), kp AS (SELECT a.s, count(*) AS kept FROM tp a JOIN tp b ON a.ts_code = b.ts_code AND a.s = b.s + 1 GROUP BY 1),
dh AS (SELECT st.*, decile_monotonicity, t AS top_decile_return, b AS bottom_decile_return, t - b AS decile_spread, CASE WHEN had IS NOT NULL THEN coalesce(kept, 0) / (held + had - coalesce(kept, 0)) END AS holding_overlap FROM st JOIN mono USING (trade_date) LEFT JOIN kp USING (s)), hd AS (SELECT *, 1 - holding_overlap AS top_decile_turnover FROM dh)"""


def _daily_health(spark, sf_dir):
    return health.daily_health(future(spark, sf_dir), "step", "fwd", 5, 10, context=["amount_cny"])


@query(f"{_HEALTH_SQL} SELECT trade_date, observation_count, {', '.join(f'{r6(c)} AS {c}' for c in _HEALTH)} FROM hd")
def health_daily(spark, sf_dir):
    return said(_daily_health(spark, sf_dir).select("trade_date", "observation_count", *_HEALTH), *_HEALTH)


def _trail(x: str, size: int, f: str = "avg") -> str:
    frame = f"(ORDER BY trade_date ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {frame} >= {max(5, size // 2)} THEN {f}({x}) OVER {frame} END)"


_ROLLED = tuple(f"{n}_{k}" for n in ("rolling_rank_ic", "icir", "spread") for k in (20, 60, 120)) + tuple(f"{n}_velocity_{a}_{b}" for n in ("spread", "ic") for a, b in ((20, 60), (60, 120)))


@query(f"""{_HEALTH_SQL}, rl AS (SELECT trade_date, {', '.join(f"{_trail('rank_ic', k)} AS rolling_rank_ic_{k}, {_trail('rank_ic', k)} / nullif({_trail('rank_ic', k, 'stddev_samp')}, 0) AS icir_{k}, {_trail('decile_spread', k)} AS spread_{k}" for k in (20, 60, 120))} FROM hd),
rv AS (SELECT *, {', '.join(f'spread_{a} - spread_{b} AS spread_velocity_{a}_{b}, rolling_rank_ic_{a} - rolling_rank_ic_{b} AS ic_velocity_{a}_{b}' for a, b in ((20, 60), (60, 120)))} FROM rl) SELECT trade_date, {', '.join(f'{r6(c)} AS {c}' for c in _ROLLED)} FROM rv""")
def health_rolling(spark, sf_dir):
    return said(health.rolling_health(_daily_health(spark, sf_dir)).select("trade_date", *_ROLLED), *_ROLLED)


# What state models of the market read


def _m20(x: str, size: int, f: str = "avg") -> str:
    frame = f"(ORDER BY trade_date ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} >= {size} THEN {f}({x}) OVER {frame} END"


@query(f"""{RETURNS_SQL}, s AS (SELECT * FROM ret WHERE is_factor_eligible), d AS (SELECT trade_date, avg(step) AS r, avg(CASE WHEN step > 0 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END) AS b, sum(amount_cny) AS t FROM s GROUP BY 1),
ii AS (SELECT trade_date, industry_l1_code, avg(step) AS m FROM s GROUP BY ALL), i AS (SELECT trade_date, avg(CASE WHEN m > 0 THEN 1.0 WHEN m IS NOT NULL THEN 0.0 END) AS industry_breadth, stddev_pop(m) AS industry_dispersion FROM ii GROUP BY 1),
k AS (SELECT *, row_number() OVER o AS k, CASE WHEN r IS NOT NULL THEN sum(ln(1 + greatest(r, -0.999))) OVER o END AS path FROM d JOIN i USING (trade_date) WINDOW o AS (ORDER BY trade_date)),
f AS (SELECT trade_date, CASE WHEN count(r) OVER w >= 20 THEN product(1 + r) OVER w - 1 END AS market_return_20d, CASE WHEN count(path) OVER w >= 20 THEN regr_slope(path, k) OVER w END AS market_return_slope_20d, {_m20('r', 20, 'stddev_pop')} AS market_volatility_20d, {_m20('b', 5)} AS market_breadth_5d, {_m20('b', 20)} AS market_breadth_20d,
 industry_breadth, industry_dispersion, ({_m20('t', 5)}) / ({_m20('t', 20)}) - 1 AS market_turnover_change_5_20 FROM k WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT trade_date, {', '.join(f'{r6(c)} AS {c}' for c in regimes.MARKET)} FROM f""")
def regime_market_features(spark, sf_dir):
    return said(regimes.market_features(weekly_panel(spark, sf_dir)), *regimes.MARKET)


# Points and classes of factors

_SCORED = {"reversal": "-step", "momentum": "step", "small": "-log_total_mv", "busy": "turnover_rate"}


def _factor_runs(spark, sf_dir):
    """Daily returns of the best codes of each factor at several sizes, holdings and costs, as means over the picks."""
    p = future(spark, sf_dir).withColumn("fwd4", stats.forward_open_return(4))
    each = F.array(*(F.struct(F.lit(n).alias("factor"), F.expr(x).cast("double").alias("x")) for n, x in _SCORED.items()))
    held = F.array(*(F.struct(F.lit(h).alias("holding"), (F.col(c) / h).alias("y")) for h, c in ((2, "fwd"), (4, "fwd4"))))
    known = F.filter(F.array(*(F.struct(F.lit(n).alias("factor"), F.lit(h).alias("holding"), F.when(F.expr(x).isNotNull(), F.col(c) / h).alias("y")) for n, x in _SCORED.items() for h, c in ((2, "fwd"), (4, "fwd4")))), lambda s: s["y"].isNotNull())
    means = p.select("trade_date", F.explode(known).alias("k")).groupBy("trade_date", "k.factor", "k.holding").agg(F.avg("k.y").alias("all"))  # in partial sums: no section is sorted for it
    rows = p.select("trade_date", "ts_code", "is_tradeable", held.alias("h"), each.alias("f")).select("trade_date", "ts_code", "is_tradeable", F.explode("f").alias("f"), "h").select("trade_date", "ts_code", "is_tradeable", "f.*", F.explode("h").alias("h"))
    rows = rows.select("trade_date", "ts_code", "is_tradeable", "factor", "x", "h.*").filter("x is not null and y is not null")
    day = Window.partitionBy("trade_date", "factor", "holding")
    rows = rows.withColumn("k", F.row_number().over(day.orderBy(F.desc("x"), "ts_code"))).filter("k <= 20").join(means, ["trade_date", "factor", "holding"])  # cut before the shuffle
    sizes = rows.withColumn("top_n", F.explode(F.array(*(F.lit(n) for n in scoring.SIZES)))).filter("k <= top_n")
    daily = sizes.groupBy("factor", "top_n", "holding", "trade_date").agg(F.avg("y").alias("gross"), F.first("all").alias("all"), F.avg(F.col("is_tradeable").cast("double")).alias("executed"))
    costed = daily.withColumn("cost_bps", F.explode(F.array(F.lit(0.0), F.lit(20.0)))).withColumn("return", (F.col("gross") - F.col("cost_bps") / 10_000 / F.col("holding")) / 50)
    return costed.select("factor", "top_n", "holding", "cost_bps", "trade_date", "return", (F.col("return") - F.col("all") / 50).alias("excess"), "executed")


_RUN_SQL = f"""{FUTURE_SQL}, f4 AS (SELECT *, lead(adj_open, 5) OVER {W} / lead(adj_open, 1) OVER {W} - 1 AS fwd4 FROM fut), ff AS ({' UNION ALL '.join(f"SELECT trade_date, ts_code, is_tradeable, fwd, fwd4, '{n}' AS factor, {x} AS x FROM f4" for n, x in _SCORED.items())}),
hh AS (SELECT trade_date, ts_code, is_tradeable, factor, x, 2 AS holding, fwd / 2 AS y FROM ff UNION ALL SELECT trade_date, ts_code, is_tradeable, factor, x, 4, fwd4 / 4 FROM ff), rk AS (SELECT *, row_number() OVER (PARTITION BY trade_date, factor, holding ORDER BY x DESC, ts_code) AS k, avg(y) OVER (PARTITION BY trade_date, factor, holding) AS a FROM hh WHERE x IS NOT NULL AND y IS NOT NULL),
dy AS (SELECT factor, top_n, holding, trade_date, avg(y) AS g, any_value(a) AS a, avg(CASE WHEN is_tradeable THEN 1.0 ELSE 0.0 END) AS executed FROM rk JOIN (SELECT unnest([2, 5, 10, 20]) AS top_n) ON k <= top_n GROUP BY ALL),
ru AS (SELECT factor, top_n, holding, cost_bps, trade_date, (g - cost_bps / 10000 / holding) / 50 AS ret, (g - cost_bps / 10000 / holding) / 50 - a / 50 AS excess, executed FROM dy, (SELECT unnest([0.0, 20.0]::DOUBLE[]) AS cost_bps)),
rn AS (SELECT *, row_number() OVER t AS k, count(*) OVER r AS n, exp(sum(ln(1 + greatest(ret, -0.999999))) OVER t) AS nav, CASE WHEN count(*) OVER w >= 63 THEN sum(excess) OVER w END AS roll, row_number() OVER (PARTITION BY factor, top_n, holding, cost_bps ORDER BY greatest(excess, 0) DESC, trade_date) <= 10 AS best FROM ru
 WINDOW r AS (PARTITION BY factor, top_n, holding, cost_bps), t AS (PARTITION BY factor, top_n, holding, cost_bps ORDER BY trade_date), w AS (PARTITION BY factor, top_n, holding, cost_bps ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
rf AS (SELECT *, k <= greatest(floor(n * (1 - 0.2::DOUBLE)), 1) AS old, nav / max(nav) OVER (PARTITION BY factor, top_n, holding, cost_bps ORDER BY trade_date) - 1 AS fall FROM rn), yr AS (SELECT factor, top_n, holding, cost_bps, year(trade_date) AS y, sum(excess) AS e, sum(excess) FILTER (NOT old) AS l FROM rf GROUP BY ALL),
ys AS (SELECT factor, top_n, holding, cost_bps, avg(CASE WHEN e > 0 THEN 1.0 WHEN e IS NOT NULL THEN 0.0 END) AS years, coalesce(avg(CASE WHEN l > 0 THEN 1.0 WHEN l IS NOT NULL THEN 0.0 END), 0) AS walk FROM yr GROUP BY ALL),
ms AS (SELECT factor, top_n, holding, cost_bps, coalesce(avg(excess) FILTER (old) * 252, 0) AS is_excess, coalesce(avg(excess) FILTER (NOT old) * 252, 0) AS oos_excess, avg(excess) * 252 AS excess, avg(executed) AS execution, avg(ret) * 252 / nullif(abs(min(fall)), 0) AS calmar, coalesce(avg(CASE WHEN roll > 0 THEN 1.0 WHEN roll IS NOT NULL THEN 0.0 END), 0) AS rolling,
 coalesce(sum(greatest(excess, 0)) FILTER (best) / nullif(sum(greatest(excess, 0)), 0), 1) AS concentration FROM rf GROUP BY ALL), mr AS (SELECT * FROM ms JOIN ys USING (factor, top_n, holding, cost_bps))"""
_RUN_COLUMNS = ("is_excess", "oos_excess", "excess", "execution", "calmar", "rolling", "concentration", "years", "walk")


@query(f"{_RUN_SQL} SELECT factor, top_n, holding, cost_bps, {', '.join(f'{r6(c)} AS {c}' for c in _RUN_COLUMNS)} FROM mr")
def score_runs(spark, sf_dir):
    return said(scoring.run_measures(_factor_runs(spark, sf_dir)), *_RUN_COLUMNS)


def _points(value: str, name: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {least} THEN {points}" for least, points in scoring.BANDS[name]) + " ELSE 0 END"


_IC_AXES = "SELECT factor, trade_date, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 12) END AS ic FROM (SELECT factor, trade_date, " + _AVG.format(by="factor, trade_date", x="x") + " AS a, " + _AVG.format(by="factor, trade_date", x="fwd") + " AS b FROM ff WHERE x IS NOT NULL AND fwd IS NOT NULL) GROUP BY ALL"


@query(f"""{_RUN_SQL}, ic AS ({_IC_AXES}), la AS (SELECT *, percent_rank() OVER (PARTITION BY factor ORDER BY trade_date) >= 0.8 AS late FROM ic), te AS (SELECT factor, avg(ic) AS ic, avg(ic) / stddev_samp(ic) * sqrt(252) AS icir, avg(ic) FILTER (late) AS oos_ic FROM la GROUP BY 1),
pr AS (SELECT factor, {', '.join(f'median({c}) FILTER (top_n = 2 AND cost_bps = 20) AS {c}' for c in _RUN_COLUMNS if c != 'walk')}, avg(walk) FILTER (top_n = 2 AND cost_bps = 20) AS walk, median(excess) FILTER (top_n = 2 AND cost_bps = 0) AS gross, {', '.join(f'median(excess) FILTER (top_n = {n} AND cost_bps = 20) AS top{n}' for n in scoring.SIZES)} FROM mr GROUP BY 1),
jo AS (SELECT pr.*, ic, icir, oos_ic, CASE WHEN is_excess > 0 THEN oos_excess / is_excess WHEN oos_excess > 0 THEN 1.0 ELSE -1.0 END AS retention, CASE WHEN gross > 0 THEN excess / gross ELSE 0.0 END AS resilience FROM pr JOIN te USING (factor)),
po AS (SELECT factor, CASE WHEN oos_excess > 0 THEN 8 ELSE 0 END + {_points('retention', 'retention')} + {_points('walk', 'walk')} + CASE WHEN oos_ic > 0 THEN 4 ELSE 0 END AS oos_effectiveness, {_points('excess', 'excess')} + {_points('coalesce(calmar, 0)', 'calmar')} + {_points('resilience', 'resilience')} + {_points('execution', 'execution')} AS tradable_performance,
 {_points('years', 'years')} + {_points('rolling', 'rolling')} + {_points('(1 - concentration)', 'spread')} AS stability, CASE WHEN NOT coalesce(top2 > 0, false) THEN 0 WHEN top2 >= top5 AND top5 >= top10 AND top10 >= top20 AND top20 > 0 THEN 10 WHEN top5 > 0 THEN 7 ELSE 5 END AS topn_structure, {_points('ic', 'ic')} + {_points('icir', 'icir')} AS statistical_evidence,
 CASE WHEN factor <> 'busy' THEN 2 ELSE 0 END AS independence_explanation, is_excess > 0 AND oos_excess < 0 AND oos_ic < 0 AS rev FROM jo), tt AS (SELECT *, oos_effectiveness + tradable_performance + stability + topn_structure + statistical_evidence + independence_explanation AS total FROM po)
SELECT factor, oos_effectiveness, tradable_performance, stability, topn_structure, statistical_evidence, independence_explanation, total, CASE WHEN factor = 'small' THEN 'INVALID' WHEN rev OR total <= 49 THEN 'REJECTED' WHEN total <= 64 THEN 'WATCHLIST' WHEN total <= 79 THEN 'CANDIDATE' WHEN oos_effectiveness >= 17 AND tradable_performance >= 17 AND stability >= 12 THEN 'APPROVED' ELSE 'CANDIDATE' END AS classification FROM tt""")
def score_factors(spark, sf_dir):
    p = future(spark, sf_dir)
    found = stats.rank_correlations(p.select("trade_date", "fwd", *(F.expr(x).cast("double").alias(n) for n, x in _SCORED.items())), [(n, "fwd") for n in _SCORED], ["trade_date"])
    each = F.array(*(F.struct(F.lit(n).alias("factor"), F.col(f"n{i}").alias("n"), F.round(f"r{i}", 12).alias("ic")) for i, n in enumerate(_SCORED)))
    ic = found.select("trade_date", F.explode(each).alias("c")).select("c.factor", "trade_date", "c.n", "c.ic").filter("n > 0").repartition("factor")  # a row a factor and session, made once for both summaries
    late = F.percent_rank().over(Window.partitionBy("factor").orderBy("trade_date")) >= 0.8
    tests = stats.ic_summary(ic, ["factor"]).join(ic.withColumn("late", late).filter("late").groupBy("factor").agg(F.avg("ic").alias("oos_ic")), "factor", "left")
    tests = tests.select("factor", F.col("mean").alias("ic"), "icir", "oos_ic", F.lit(None).cast("double").alias("fdr_q"), F.lit(None).cast("double").alias("structure"))
    basics = tests.select("factor", (F.col("factor") == "small").cast("int").alias("violations"), F.lit(True).alias("covered"), (F.col("factor") != "busy").alias("explained"))
    return scoring.score(scoring.run_measures(_factor_runs(spark, sf_dir)), tests, basics)
