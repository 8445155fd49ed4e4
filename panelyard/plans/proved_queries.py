"""SQL for queries of the other modules that take more than a line or two of it; their results are rounded as SQL's are."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.frames import shown
from panelyard.operators import recipes
from panelyard.plans import feature_queries, panel_queries, research_queries
from panelyard.plans.formula_queries import MOMENTUM_SQL
from panelyard.plans.panel_queries import FUTURE_SQL, RETURNS_SQL, W, _avg_rank, r6, rows
from panelyard.plans.research_queries import _change, _prior
from panelyard.sources.market import PANEL_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_OLD = panel_queries.QUERIES | research_queries.QUERIES | feature_queries.QUERIES


def proved(name: str, sql: str, *rounded: str) -> None:
    """Gives a query its SQL; ``rounded`` columns are shown to six places."""

    def run(spark, sf_dir):
        df = _OLD[name](spark, sf_dir)
        return df.withColumns({c: shown(F.col(c)) for c in rounded}) if rounded else df

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


# Radar and recipes


def _events(stages: list[dict[str, str]], tests: list[tuple[str, str, float]]) -> str:
    """Stages of columns over the panel, then severity and event of a template."""
    ctes, last = [], "panel"
    for k, stage in enumerate(stages):
        ctes.append(f"g{k} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM {last})")
        last = f"g{k}"
    excess = " + ".join(f"({c} - {t}) / {max(1 - t, 1e-9)!r}" if side == "ge" else f"({t} - {c}) / {max(t, 1e-9)!r}" for c, side, t in tests)
    holds = " AND ".join(f"coalesce({c} {'>=' if side == 'ge' else '<='} {t}, false)" for c, side, t in tests)
    return f"{PANEL_SQL}, {', '.join(ctes)} SELECT trade_date, ts_code, CASE WHEN ({excess}) IS NOT NULL THEN {r6(f'greatest({excess}, 0)')} END AS severity, {holds} AS is_event FROM {last}"


def _one_control(y: str, x: str, least: int, by: str = "trade_date") -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = f"CASE WHEN {both} THEN {y} END", f"CASE WHEN {both} THEN {x} END"
    o = f"OVER (PARTITION BY {by})"
    slope = f"coalesce(covar_pop({a}, {b}) {o} / nullif(var_pop({b}) {o}, 0), 0)"
    return f"CASE WHEN {both} AND count({b}) {o} >= {least} THEN ({y} - avg({a}) {o}) - {slope} * ({x} - avg({b}) {o}) END"


_MEAN_OF_PEERS = "avg(return_h) OVER (PARTITION BY trade_date, industry_l1_code)"
proved("radar_high_turnover_low_displacement", _events([{"abs_return": f"abs({_change(1)})", "turnover": "turnover_rate"}, {"turnover_pct": _prior("turnover")}, {"resid": _one_control("abs_return", "turnover_pct", 5)}, {"resid_pct": _prior("resid")}], [("turnover_pct", "ge", 0.8), ("resid_pct", "le", 0.3)]))
proved("radar_stock_industry_divergence", _events([{"return_h": _change(5)}, {"gap": f"return_h - {_MEAN_OF_PEERS}"}, {"gap_pct": _prior("gap")}], [("gap_pct", "ge", 0.9)]))
proved(
    "radar_volatility_compression_breakout",
    _events(
        [
            {"step": _change(1), "prior_high": f"max(adj_high) OVER {rows('10 PRECEDING', '1 PRECEDING')}"},
            {"volatility": f"CASE WHEN count(step) OVER {rows('5 PRECEDING', '1 PRECEDING')} >= 5 THEN stddev_pop(step) OVER {rows('5 PRECEDING', '1 PRECEDING')} END", "brk": "CASE WHEN prior_high IS NOT NULL THEN CAST(adj_close > prior_high AS DOUBLE) END"},
            {"volatility_pct": _prior("volatility")},
        ],
        [("volatility_pct", "le", 0.4), ("brk", "ge", 1.0)],
    ),
)

_EXHAUSTED = research_queries.RADAR_SQL["trend_exhaustion"]
proved(
    "radar_observation",
    f"""WITH scanned AS ({_EXHAUSTED}), d AS (SELECT trade_date, count(*) AS n, sum(is_event::INT) AS e, row_number() OVER (ORDER BY trade_date DESC) <= 52 AS recent FROM scanned GROUP BY 1),
s AS (SELECT sum(e) AS events, avg(CASE WHEN recent THEN e / n END) AS now, avg(CASE WHEN NOT recent THEN e / n END) AS past, stddev_samp(CASE WHEN NOT recent THEN e / n END) AS sd FROM d),
t AS (SELECT max(k) AS most FROM (SELECT count(*) AS k FROM scanned WHERE is_event GROUP BY ts_code))
SELECT CAST(events AS BIGINT) AS events, {r6('now')} AS recent_rate, {r6('past')} AS past_rate, {r6('(now - past) / nullif(sd, 0)')} AS rate_z, {r6('now / nullif(past, 0)')} AS rate_ratio, {r6('most / nullif(events, 0)')} AS top_share FROM s, t""",
    "recent_rate", "past_rate", "rate_z", "rate_ratio", "top_share",
)

_BASE_SQL = f"{PANEL_SQL}, b0 AS (SELECT *, {_change(1)} AS r1, {_change(5)} AS rs, {_change(20)} AS rl FROM panel)"
S = recipes.Settings()


def _pct(x: str, *by: str) -> str:
    d = ", ".join(("trade_date", *by))
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {d} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {d}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {d}) END"


def _recipe(name: str, stages: list[dict[str, str]], event: str, severity: str, subtype: str = "CAST(NULL AS VARCHAR)", base: str = _BASE_SQL, last: str = "b0") -> None:
    ctes = []
    for k, stage in enumerate(stages):
        ctes.append(f"h{k} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM {last})")
        last = f"h{k}"
    sql = f"{base}, {', '.join(ctes)} SELECT trade_date, ts_code, {subtype} AS event_subtype, CASE WHEN ({severity}) IS NOT NULL THEN {r6(f'greatest({severity}, 0)')} END AS severity, coalesce({event}, false) AS is_event FROM {last}"
    proved(f"recipe_{name}", sql)


_DAILY = """, dy0 AS (SELECT trade_date, median(rs) AS market, avg(CASE WHEN coalesce(r1 > 0, false) THEN 1.0 ELSE 0.0 END) AS adv FROM b0 GROUP BY 1), dy AS (SELECT *, adv - lag(adv, 5) OVER (ORDER BY trade_date) AS bc FROM dy0), b1 AS (SELECT b0.*, market, bc, rs * greatest(amount_cny, 0) AS contribution FROM b0 JOIN dy USING (trade_date))"""
_recipe("index_up_breadth_down", [{"cp": _pct("contribution"), "mp": _prior("market")}], f"mp >= {S.upper} AND bc <= -{S.step} AND cp >= 0.9", f"mp - {S.upper} - bc - {S.step}", base=_BASE_SQL + _DAILY, last="b1")
_recipe("turnover_concentration", [{"ap": _pct("amount_cny")}, {"ts": "sum(CASE WHEN ap >= 0.95 THEN amount_cny ELSE 0.0 END) OVER (PARTITION BY trade_date) / nullif(sum(amount_cny) OVER (PARTITION BY trade_date), 0)"}, {"cp": _prior("ts")}], f"cp >= {S.upper} AND ap >= 0.95", f"cp - {S.upper} + ap - 0.95")
_recipe("turnover_displacement_close", [{"ar": "abs(r1)"}, {"tp": _prior("turnover_rate"), "dp": _prior("ar")}], f"tp >= {S.upper} AND dp <= {S.lower}", f"tp - {S.upper} + {S.lower} - dp", "CASE WHEN (adj_close - adj_low) / nullif(adj_high - adj_low, 0) >= 0.7 THEN 'strong_close_absorption' ELSE 'weak_close_pressure' END")
_recipe(
    "price_volume_residual", [{"ar": "abs(r1)", "lv": "ln(1 + greatest(volume_shares, 0))"}, {"vr": _one_control("lv", "ar", 5)}, {"mp": _prior("ar"), "rp": _prior("vr")}],
    f"(mp >= {S.upper} AND rp <= {S.lower}) OR (mp <= {S.lower} AND rp >= {S.upper})", "abs(mp - rp)",
    f"CASE WHEN mp >= {S.upper} AND rp <= {S.lower} THEN 'large_move_low_volume_residual' WHEN mp <= {S.lower} AND rp >= {S.upper} THEN 'high_volume_low_displacement' ELSE 'none' END",
)
_CELL = "OVER (PARTITION BY trade_date, industry_l1_code)"
_recipe("leader_decoupling", [{"sp": _pct("log_total_mv", "industry_l1_code"), "gap": f"rs - median(rs) {_CELL}", "ia": f"avg(CASE WHEN coalesce(r1 > 0, false) THEN 1.0 ELSE 0.0 END) {_CELL}"}, {"gp": _prior("gap")}], f"sp >= 0.9 AND gp >= {S.upper} AND ia <= {0.5 - S.step / 2}", f"gp - {S.upper} + 0.5 - ia")
_recipe("participation_deterioration", [{"up": f"CASE WHEN count(*) OVER {rows('19 PRECEDING', 'CURRENT ROW')} >= 20 THEN avg(CASE WHEN coalesce(r1 > 0, false) THEN 1.0 ELSE 0.0 END) OVER {rows('19 PRECEDING', 'CURRENT ROW')} END"}, {"pc": f"up - lag(up, 5) OVER {W}", "mp": _prior("rl")}], f"mp >= {S.upper} AND pc <= -{S.step}", f"mp - {S.upper} - pc - {S.step}")
_recipe(
    "percentile_migration", [{"tr": f"greatest(adj_high - adj_low, abs(adj_high - lag(adj_close) OVER {W}), abs(adj_low - lag(adj_close) OVER {W}))"}, {"atr": f"CASE WHEN count(tr) OVER {rows('19 PRECEDING', 'CURRENT ROW')} >= 20 THEN avg(tr) OVER {rows('19 PRECEDING', 'CURRENT ROW')} END / adj_close"}, {"atrp": _prior("atr")}, {"ve": f"atrp - lag(atrp, 5) OVER {W}"}],
    f"abs(ve) >= {S.step}", f"abs(ve) - {S.step}", "CASE WHEN ve >= 0 THEN 'rapid_rise' ELSE 'rapid_fall' END",
)
_recipe("short_long_conflict", [{"sp": _prior("amount_cny", 20, 10), "lp": _prior("amount_cny")}, {"gap": "sp - lp"}], f"abs(gap) >= {S.step}", f"abs(gap) - {S.step}", "CASE WHEN gap >= 0 THEN 'recent_only_extreme' ELSE 'long_term_only_extreme' END")


_RC = """, c0 AS (SELECT *, CASE WHEN amount_cny > 0 THEN ln(amount_cny) END AS la FROM b0), c1 AS (SELECT *, CASE WHEN count(la) OVER f >= 10 THEN avg(la) OVER f END AS usual, CASE WHEN is_liquid THEN la END AS own FROM c0 WINDOW f AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), src AS (SELECT * FROM c1), {fit}, ex AS (SELECT c1.*, {res} AS excess FROM c1 LEFT JOIN fit USING (trade_date, ts_code)),
m0 AS (SELECT *, {pct} AS ep, CASE WHEN excess IS NOT NULL THEN exp(greatest(excess, 0)) - 1 END AS mass FROM ex), m1 AS (SELECT *, coalesce(excess > 0 AND ep >= {upper}, false) AS con FROM m0),
dy0 AS (SELECT trade_date, sum(CASE WHEN con THEN mass END) / nullif(sum(mass), 0) AS share FROM m1 GROUP BY 1), dy1 AS (SELECT trade_date, share, list_filter(list(share) OVER (ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), lambda z: z IS NOT NULL) AS past FROM dy0),
dy AS (SELECT trade_date, CASE WHEN share IS NOT NULL AND len(past) >= 20 THEN (len(list_filter(past, lambda z: z < share)) + 0.5 * len(list_filter(past, lambda z: z = share))) / len(past) END AS sp FROM dy1), fin AS (SELECT m1.*, sp FROM m1 JOIN dy USING (trade_date))"""


# Residuals and buckets: two controls by their normal equations


def _two(y: str, a: str, b: str, by: str, least: int, ridge: float = 0.0, z: bool = False) -> tuple[str, str]:
    """CTEs over ``src`` that end in ``fit`` (centred values and both slopes), and the residual."""
    o = f"OVER (PARTITION BY {by})"
    scale = lambda x: f"stddev_pop({x}) {o}" if z else "1.0"
    ctes = f"""ok AS (SELECT *, count(*) {o} AS n FROM src WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL), cen AS (SELECT *, {y} - avg({y}) {o} AS cy, ({a} - avg({a}) {o}) / {scale(a)} AS ca, ({b} - avg({b}) {o}) / {scale(b)} AS cb FROM ok WHERE n >= {least}),
sums AS (SELECT *, sum(ca * ca) {o} + {ridge} AS aa, sum(cb * cb) {o} + {ridge} AS bb, sum(ca * cb) {o} AS ab, sum(ca * cy) {o} AS ay, sum(cb * cy) {o} AS yb FROM cen), fit AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b_b FROM sums)"""
    return ctes, "cy - ba * ca - b_b * cb"


_FIT, _RES = _two("own", "usual", "log_total_mv", "trade_date", S.least_section)
_recipe("residual_concentration", [{"same": "con"}], f"con AND sp >= {S.upper}", f"ep - {S.upper} + sp - {S.upper}", base=_BASE_SQL + _RC.format(fit=_FIT, res=_RES.replace("ba ", "fit.ba ").replace("b_b", "fit.b_b"), pct=_pct("excess"), upper=S.upper), last="fin")
_FIT, _RES = _two("rs", "log_total_mv", "vol", "trade_date, industry_l1_code", S.least_section)
_recipe(
    "enhanced_residual", [{"rp": _pct("residual", "industry_l1_code")}], f"rp >= {S.upper} OR rp <= {1 - S.upper!r}", f"greatest(rp - {S.upper}, {1 - S.upper!r} - rp)",
    f"CASE WHEN rp >= {S.upper} THEN 'positive_residual' WHEN rp <= {1 - S.upper!r} THEN 'negative_residual' ELSE 'none' END",
    base=f"{_BASE_SQL}, src AS (SELECT *, CASE WHEN count(r1) OVER {rows('19 PRECEDING', 'CURRENT ROW')} >= 10 THEN stddev_pop(r1) OVER {rows('19 PRECEDING', 'CURRENT ROW')} END AS vol FROM b0), {_FIT}, ex AS (SELECT b0.*, {_RES} AS residual FROM b0 LEFT JOIN fit USING (trade_date, ts_code))", last="ex",
)
_LS, _RES = _two("step", "log_total_mv", "turnover_rate", "trade_date", 10)
proved("residual_least_squares", f"{RETURNS_SQL}, src AS (SELECT * FROM ret), {_LS} SELECT r.trade_date, r.ts_code, {r6(_RES)} AS residual FROM ret r LEFT JOIN fit USING (trade_date, ts_code)", "residual")
_RI, _RES = _two("step", "log_total_mv", "turnover_rate", "trade_date, industry_l1_code", 5, 1.0, True)
proved("residual_ridge", f"{RETURNS_SQL}, src AS (SELECT * FROM ret), {_RI} SELECT r.trade_date, r.industry_l1_code, r.ts_code, {r6(_RES)} AS residual FROM ret r LEFT JOIN fit USING (trade_date, ts_code)", "residual")
_FM, _ = _two("fwd", "step", "turnover_rate", "trade_date", 7, 0.0, True)
proved("residual_fama_macbeth", f"{FUTURE_SQL}, src AS (SELECT * FROM fut), {_FM} SELECT DISTINCT trade_date, 'step' AS name, {r6('ba')} AS coefficient FROM fit UNION SELECT DISTINCT trade_date, 'turnover_rate', {r6('b_b')} FROM fit", "coefficient")


def _bucket(q: int) -> str:
    out = "1"
    for k in range(1, q):
        x = f"((n - 1) * CAST({(k * (1.0 / q)) * 100 / 100!r} AS DOUBLE))"
        low, part = f"(floor({x}) + 1)", f"({x} - floor({x}))"
        high = f"least({low} + 1, n)"
        out += f" + CAST(CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part} ELSE {high} - ({high} - {low}) * (1 - {part}) END < r AS INT)"
    return out


proved(
    "stat_quantile_returns",
    f"""{FUTURE_SQL}, k AS (SELECT trade_date, fwd, count(*) OVER (PARTITION BY trade_date) AS n, row_number() OVER (PARTITION BY trade_date ORDER BY step, ts_code) AS r FROM fut WHERE step IS NOT NULL AND fwd IS NOT NULL),
b AS (SELECT trade_date, fwd, CASE WHEN n < 100 THEN {_bucket(5)} ELSE {_bucket(10)} END AS quantile FROM k WHERE n >= CASE WHEN n < 100 THEN 10 ELSE 20 END), d AS (SELECT trade_date, quantile, avg(fwd) AS m FROM b GROUP BY ALL)
SELECT quantile, {r6('avg(m)')} AS mean_return, count(*) AS days FROM d GROUP BY 1""",
    "mean_return",
)
proved(
    "portfolio_capped_weights",
    f"""{PANEL_SQL}, o AS (SELECT trade_date, ts_code, amount_cny, row_number() OVER d - 1 AS k, count(*) OVER (PARTITION BY trade_date) AS n, sum(amount_cny) OVER (PARTITION BY trade_date) - coalesce(sum(amount_cny) OVER (PARTITION BY trade_date ORDER BY amount_cny DESC, ts_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM panel WINDOW d AS (PARTITION BY trade_date ORDER BY amount_cny DESC, ts_code)),
c AS (SELECT *, amount_cny * (1 - 0.05 * k) > (0.05 + 1e-12) * rest AS full_ FROM o), f AS (SELECT *, sum(full_::INT) OVER (PARTITION BY trade_date) AS m, sum(CASE WHEN NOT full_ THEN amount_cny END) OVER (PARTITION BY trade_date) AS s FROM c)
SELECT trade_date, ts_code, {r6('amount_cny')} AS amount_cny, {r6('CASE WHEN 0.05 * n <= 1 THEN 1.0 / n WHEN full_ THEN 0.05 ELSE amount_cny * (1 - 0.05 * m) / s END')} AS capped FROM f""",
    "amount_cny", "capped",
)


# Walks: recursion, or closed forms of it

proved(
    "event_cooldown",
    f"""WITH RECURSIVE {PANEL_SQL.strip().removeprefix('WITH')}, e AS (SELECT ts_code, trade_date, n FROM (SELECT *, row_number() OVER {W} AS n FROM panel) WHERE volume_shares > 60), first AS (SELECT ts_code, min(n) AS n FROM e GROUP BY 1),
kept AS (SELECT ts_code, n FROM first UNION ALL SELECT k.ts_code, (SELECT min(e.n) FROM e WHERE e.ts_code = k.ts_code AND e.n >= k.n + 10) AS n FROM kept k WHERE n IS NOT NULL) SELECT e.ts_code, e.trade_date, CAST(e.n AS INT) AS n FROM e JOIN kept k ON k.ts_code = e.ts_code AND k.n = e.n""",
)
_A = 2 / 13
proved(
    "timing_ewm",
    f"""{PANEL_SQL}, n AS (SELECT *, row_number() OVER {W} - 1 AS k FROM panel) SELECT ts_code, trade_date, CASE WHEN k >= 4 THEN {r6(f"pow({1 - _A!r}, k) * sum(CASE WHEN k = 0 THEN adj_close ELSE {_A!r} * adj_close * pow({1 / (1 - _A)!r}, k) END) OVER {W}")} END AS ewm FROM n""",
    "ewm",
)
_B = 13 / 14
_MEAN = "pow({b!r}, k) * sum(CASE WHEN k = 0 THEN {x} WHEN k > 0 THEN {a!r} * {x} * pow({c!r}, k) END) OVER " + W
proved(
    "timing_rsi",
    f"""{PANEL_SQL}, n AS (SELECT *, row_number() OVER {W} - 2 AS k, adj_close - lag(adj_close) OVER {W} AS d FROM panel), m AS (SELECT ts_code, trade_date, k, {_MEAN.format(b=_B, a=1 - _B, c=1 / _B, x='greatest(d, 0)')} AS g, {_MEAN.format(b=_B, a=1 - _B, c=1 / _B, x='greatest(-d, 0)')} AS l FROM n)
SELECT ts_code, trade_date, CASE WHEN k >= 13 THEN {r6('CASE WHEN g + l > 0 THEN 100 * g / (g + l) ELSE 50 END')} END AS rsi FROM m""",
    "rsi",
)
proved(
    "timing_positions",
    f"""WITH RECURSIVE {PANEL_SQL.strip().removeprefix('WITH')}, d AS (SELECT trade_date, least(greatest((avg(turnover_rate) - 0.03) / (0.06 - 0.03), 0), 1) AS t, row_number() OVER (ORDER BY trade_date) AS k FROM panel GROUP BY 1),
w AS (SELECT k, trade_date, least(greatest(t, -0.1), 0.1) AS held FROM d WHERE k = 1 UNION ALL SELECT d.k, d.trade_date, w.held + least(greatest(d.t - w.held, -0.1), 0.1) FROM w JOIN d ON d.k = w.k + 1) SELECT 'market' AS series, trade_date, {r6('held')} AS position FROM w""",
    "position",
)
proved(
    "rotation_retained",
    f"""{PANEL_SQL}, k AS (SELECT trade_date, ts_code, rank() OVER (PARTITION BY trade_date ORDER BY amount_cny DESC, ts_code) AS rank FROM panel), s AS (SELECT *, sum((rank > 20)::INT) OVER {W} AS drops FROM k)
SELECT trade_date, ts_code, CAST(rank AS INT) AS rank, rank <= 20 AND coalesce(max(CASE WHEN rank <= 10 THEN 1 END) OVER (PARTITION BY ts_code, drops ORDER BY trade_date) = 1, false) AS held FROM s""",
)
proved(
    "rotation_greedy",
    f"""WITH RECURSIVE {PANEL_SQL.strip().removeprefix('WITH')}, c AS (SELECT trade_date, industry_l2_code AS concept_code, sum(amount_cny) AS score, list_distinct(list(ts_code % 5)) AS members FROM panel GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, concept_code) AS r FROM c),
w AS (SELECT trade_date, r, [members] AS kept, true AS took FROM o WHERE r = 1
UNION ALL SELECT w.trade_date, o.r, CASE WHEN ok THEN list_append(w.kept, o.members) ELSE w.kept END, ok FROM w JOIN o ON o.trade_date = w.trade_date AND o.r = w.r + 1 AND o.r <= 30,
 LATERAL (SELECT len(w.kept) < 3 AND len(list_filter(w.kept, lambda x: len(list_intersect(x, o.members)) >= 0.5 * greatest(1, len(list_distinct(list_concat(x, o.members)))))) = 0 AS ok) z)
SELECT o.trade_date, o.concept_code, {r6('o.score')} AS score, CAST(row_number() OVER (PARTITION BY o.trade_date ORDER BY o.r) AS INT) AS rank FROM w JOIN o USING (trade_date, r) WHERE took""",
    "score",
)


# Experiments of a whole factor

_SMOOTH = f"""{PANEL_SQL}, sm AS (SELECT * REPLACE (avg(adj_open) OVER s AS adj_open, avg(adj_close) OVER s AS adj_close) FROM panel WINDOW s AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))"""
_FACTOR = MOMENTUM_SQL.replace(PANEL_SQL, _SMOOTH).replace("AS lagged FROM panel)", "AS lagged FROM sm)")

proved(
    "experiment_quality",
    f"""{_FACTOR}, dy AS (SELECT trade_date, count(z) AS n FROM f GROUP BY 1) SELECT count(*) AS rows, count(DISTINCT ts_code) AS codes, (SELECT count(*) FROM dy) AS days, {r6('(SELECT median(n) FROM dy)')} AS median_section, {r6('count(z) / count(*)')} AS coverage, {r6('count(DISTINCT z) / count(z)')} AS distinct_ratio FROM f""",
    "median_section", "coverage", "distinct_ratio",
)

_LEADS = ", ".join(f"lead(adj_open, {h + 1}) OVER {W} / lead(adj_open, 1) OVER {W} - 1 AS s{h}" for h in (1, 4))
_PEERS = ", ".join(f"s{h} - (coalesce(sum(s{h}) OVER c, 0) - s{h}) / nullif(count(s{h}) OVER c - 1, 0) AS m{h}" for h in (1, 4))
_CELLS = " UNION ALL ".join(f"SELECT trade_date, {h} AS horizon, '{t}' AS target, '{u}' AS universe, z AS x, {c}{h} AS y FROM lb WHERE {u}" for h in (1, 4) for t, c in (("stock_return", "s"), ("stock_minus_peers", "m")) for u in ("is_liquid", "is_tradeable"))
_BY = "trade_date, horizon, target, universe"
_KEY = "horizon, target, universe"
_ERF = "(1 / (1 + 0.3275911::DOUBLE * abs(nw_t) / sqrt(2)))"
_P = f"least({_ERF} * (0.254829592::DOUBLE + {_ERF} * (-0.284496736::DOUBLE + {_ERF} * (1.421413741::DOUBLE + {_ERF} * (-1.453152027::DOUBLE + {_ERF} * 1.061405429::DOUBLE)))) * exp(-nw_t * nw_t / 2), 1)"
_SHOWN = ("mean", "std", "positive_ratio", "icir", "t_value", "nw_t", "oos_mean", "p_value", "fdr_q")

proved(
    "experiment_tests",
    f"""{_FACTOR}, ld AS (SELECT *, {_LEADS} FROM sm), lb AS (SELECT ld.*, z, {_PEERS} FROM ld JOIN f USING (trade_date, ts_code) WINDOW c AS (PARTITION BY trade_date, industry_l1_code)), ce AS ({_CELLS}),
rk AS (SELECT {_BY}, {_avg_rank('x', _BY)} AS a, {_avg_rank('y', _BY)} AS b FROM ce WHERE x IS NOT NULL AND y IS NOT NULL), ic AS (SELECT {_BY}, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 12) END AS ic FROM rk GROUP BY ALL),
la AS (SELECT trade_date, percent_rank() OVER (ORDER BY trade_date) >= 0.8 AS late FROM (SELECT DISTINCT trade_date FROM sm)), dv AS (SELECT *, ic - avg(ic) OVER (PARTITION BY {_KEY}) AS d FROM ic JOIN la USING (trade_date) WHERE ic IS NOT NULL),
lg AS (SELECT *, {', '.join(f'd * lag(d, {k}) OVER (PARTITION BY {_KEY} ORDER BY trade_date) AS p{k}' for k in range(1, 6))} FROM dv),
su AS (SELECT {_KEY}, count(*) AS days, avg(ic) AS mean, stddev_samp(ic) AS std, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio, avg(ic) FILTER (late) AS oos_mean, sum(d * d) AS p0, {', '.join(f'coalesce(sum(p{k}), 0) AS p{k}' for k in range(1, 6))} FROM lg GROUP BY ALL),
nw AS (SELECT *, mean / std * sqrt(252) AS icir, mean / std * sqrt(days) AS t_value, mean / sqrt((p0 + {' + '.join(f'2 * (1 - {k} / 6.0::DOUBLE) * p{k}' for k in range(1, 6))}) / days / days) AS nw_t FROM su), pv AS (SELECT *, {_P} AS p_value FROM nw), q AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value) AS raw FROM pv),
fq AS (SELECT *, least(min(raw) OVER (ORDER BY p_value DESC, raw DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS fdr_q FROM q) SELECT {_KEY}, days, {', '.join(f'{r6(c)} AS {c}' for c in _SHOWN)} FROM fq""",
    *_SHOWN,
)
