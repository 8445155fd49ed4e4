"""The groups of the timing table over the driver's tables, with their SQL: weeks are sessions, orders and parts stand for vendor tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import timing_groups as groups
from panelyard.plans import research_queries
from panelyard.plans.panel_queries import RETURNS_SQL, r6, returns
from panelyard.plans.study_queries import said
from panelyard.sources.market import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query and its SQL under its function's name."""

    def register(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return register


def _text(day):
    return F.date_format(day, "yyyyMMdd")


def _week(c: str):
    return F.to_date(F.date_trunc("week", c))


def _index(r):
    return groups.index_frame(r.groupBy("trade_date").agg(F.avg("adj_close").alias("close")))


def _stocks(r):
    return r.select(_text("trade_date").alias("trade_date"), "ts_code", F.col("step").alias("pct_chg"), F.col("amount_cny").alias("amount"))


_BASE = f"{RETURNS_SQL}, idx AS (SELECT trade_date, avg(adj_close) AS c, sum(amount_cny) AS amount FROM ret GROUP BY 1)"


def _roll(x: str, size: int, least: int, f: str = "avg") -> str:
    frame = f"(ORDER BY trade_date ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} >= {least} THEN {f}({x}) OVER {frame} END"


def _chg(x: str, k: int) -> str:
    return f"{x} / nullif(lag({x}, {k}) OVER (ORDER BY trade_date), 0) - 1"


def _shown(names, also: str = "trade_date") -> str:
    return f"SELECT {also}, " + ", ".join(f"{r6(n)} AS {n}" for n in names)


# Valuation

_VALUE_SQL = """, pe AS (SELECT trade_date, avg(total_mv_cny) / avg(amount_cny) - 30 AS pe_ttm FROM ret GROUP BY 1), bd AS (SELECT trade_date, avg(turnover_rate) * 100 AS y FROM ret GROUP BY 1 HAVING dayofyear(trade_date) % 3 <> 0),
va AS (SELECT trade_date, pe_ttm, CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END AS earnings_yield, coalesce(y / 100, 0.03) AS bond_10y_yield, CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END - coalesce(y / 100, 0.03) AS erp FROM pe LEFT JOIN bd USING (trade_date))"""


def _valuation(r):
    basic = r.groupBy("trade_date").agg((F.avg("total_mv_cny") / F.avg("amount_cny") - 30).alias("pe_ttm")).select(_text("trade_date").alias("trade_date"), F.col("pe_ttm").cast("string").alias("pe_ttm"))
    bond = r.groupBy("trade_date").agg((F.avg("turnover_rate") * 100).alias("y")).filter(F.dayofyear("trade_date") % 3 != 0)
    bond = bond.select("trade_date", F.lit(10.0).alias("curve_term"), F.col("y").alias("yield")).unionByName(bond.select("trade_date", F.lit(5.0).alias("curve_term"), F.lit(99.0).alias("yield")))
    return groups.valuation(basic, bond, 0.03)


_VALUES = ("pe_ttm", "earnings_yield", "bond_10y_yield", "erp")


@query(f"{_BASE}{_VALUE_SQL} {_shown(_VALUES)} FROM va")
def timing_valuation(spark, sf_dir):
    return said(_valuation(returns(spark, sf_dir)), *_VALUES)


# Breadth

_BREADTH = ("index_ret_20d", "index_ret_60d", "index_vol_20d", "index_drawdown_60d", "index_above_ma20", "index_above_ma60", "up_ratio", "adv_dec_log", "up_ratio_ma5", "up_ratio_ma20", "breadth_thrust")


def _trend(size: int) -> str:
    mean = _roll("c", size, max(5, size // 2))
    return f"CASE WHEN ({mean}) IS NOT NULL THEN CASE WHEN c > ({mean}) THEN 1.0 ELSE 0.0 END END"


@query(f"""{_BASE}, lr AS (SELECT *, ln(c) - ln(lag(c) OVER (ORDER BY trade_date)) AS l FROM idx), ix AS (SELECT trade_date, {_chg('c', 20)} AS index_ret_20d, {_chg('c', 60)} AS index_ret_60d, {_roll('l', 20, 10, 'stddev_samp')} AS index_vol_20d, c / ({_roll('c', 60, 20, 'max')}) - 1 AS index_drawdown_60d, {_trend(20)} AS index_above_ma20, {_trend(60)} AS index_above_ma60 FROM lr),
ud AS (SELECT trade_date, count(*) FILTER (step > 0) AS u, count(*) FILTER (step < 0) AS d FROM ret GROUP BY 1), ur AS (SELECT trade_date, u / nullif(u + d, 0) AS up_ratio, ln((u + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) AS adv_dec_log FROM ud), um AS (SELECT *, {_roll('up_ratio', 5, 3)} AS up_ratio_ma5, {_roll('up_ratio', 20, 10)} AS up_ratio_ma20 FROM ur),
br AS (SELECT *, up_ratio_ma5 - up_ratio_ma20 AS breadth_thrust FROM ix LEFT JOIN um USING (trade_date)) {_shown(_BREADTH)} FROM br""")
def timing_breadth(spark, sf_dir):
    r = returns(spark, sf_dir)
    return said(groups.breadth(_index(r), _stocks(r)), *_BREADTH)


# Funding

_FUNDING = ("rzmre_ratio", "rzye_chg_5d", "rzye_chg_20d", "rzye_chg_60d", "rzmre_boll_pos_20", "rzmre_boll_pct_20", "rzmre_boll_pos_60", "rzmre_boll_pct_60")


def _margin(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(_text(_week("o_orderdate")).alias("trade_date"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("rzmre"), F.col("o_totalprice").alias("rzye"))


_BANDS = ", ".join(f"(q - ({_roll('q', k, max(5, k // 2))})) / nullif(({_roll('q', k, max(5, k // 2), 'stddev_samp')}), 0) AS rzmre_boll_pos_{k}, (q - (({_roll('q', k, max(5, k // 2))}) - 2 * ({_roll('q', k, max(5, k // 2), 'stddev_samp')}))) / nullif(4 * ({_roll('q', k, max(5, k // 2), 'stddev_samp')}), 0) AS rzmre_boll_pct_{k}" for k in (20, 60))


@query(f"""{_BASE}, mg AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS trade_date, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS b, sum(o_totalprice) AS e FROM orders GROUP BY 1), mq AS (SELECT mg.*, b / nullif(amount, 0) AS q FROM mg LEFT JOIN idx USING (trade_date)),
fu AS (SELECT trade_date, q AS rzmre_ratio, {', '.join(f"{_chg('e', k)} AS rzye_chg_{k}d" for k in (5, 20, 60))}, {_BANDS} FROM mq) {_shown(_FUNDING)} FROM fu""")
def timing_funding(spark, sf_dir):
    return said(groups.funding(_margin(spark, sf_dir), _stocks(returns(spark, sf_dir))), *_FUNDING)


# Options

_OPTIONS = ("put_call_log", "iv_atm", "iv_realized_spread")


def _options(spark, sf_dir):
    p, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    code = lambda c: F.concat(F.lit("O"), F.col(c).cast("string"))
    month = F.col("p_partkey") % 90
    basic = p.select(code("p_partkey").alias("ts_code"), F.col("p_retailprice").alias("exercise_price"), _text(F.add_months(F.lit("1992-01-20").cast("date"), month.cast("int"))).alias("maturity_date"), F.when(F.col("p_partkey") % 2 == 0, "P").otherwise("C").alias("call_put"))
    daily = line.groupBy(_week("l_shipdate").alias("d"), "l_partkey").agg(F.sum("l_extendedprice").alias("amount"), F.max("l_quantity").alias("q"))
    return basic, daily.select(_text("d").alias("trade_date"), code("l_partkey").alias("ts_code"), (F.col("q") * 2).alias("close"), "amount")


_OPTION_SQL = f"""{_BASE}, ba AS (SELECT p_partkey AS k, p_retailprice AS strike, CAST(DATE '1992-01-20' + to_months(CAST(p_partkey % 90 AS INT)) AS DATE) AS mat, p_partkey % 2 = 0 AS put FROM part),
od AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date, l_partkey AS k, sum(l_extendedprice) AS amount, max(l_quantity) * 2 AS px FROM lineitem GROUP BY ALL), oq AS (SELECT od.*, strike, mat, put FROM od LEFT JOIN ba USING (k)),
pc AS (SELECT trade_date, ln((coalesce(sum(amount) FILTER (put), 0) + 1) / (coalesce(sum(amount) FILTER (NOT put), 0) + 1)) AS put_call_log FROM oq GROUP BY 1)"""


def _phi(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x}) / sqrt(2)))"
    poly = f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))))"
    erf = f"(1 - {poly} * exp(-({x}) * ({x}) / 2))"
    return f"(CASE WHEN ({x}) >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END)"


def _worth(v: str) -> str:
    one = f"((ln(s / strike) + (0.02::DOUBLE + {v} * {v} / 2) * years) / ({v} * sqrt(years)))"
    call = f"(s * {_phi(one)} - strike * exp(-0.02::DOUBLE * years) * {_phi(f'({one} - {v} * sqrt(years))')})"
    return f"({call} - CASE WHEN put THEN s - strike * exp(-0.02::DOUBLE * years) ELSE 0 END)"


@query(f"""{_OPTION_SQL}, sp AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date, avg(p_retailprice) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), nm AS (SELECT oq.*, c AS s, date_diff('day', trade_date, mat) AS days, date_diff('day', trade_date, mat) / 365.0::DOUBLE AS years FROM oq JOIN sp USING (trade_date) WHERE px > 0 AND amount >= 0 AND abs(ln(strike / c)) <= 0.05 AND date_diff('day', trade_date, mat) > 7),
iv AS (SELECT *, list_reduce(list_prepend([1e-4::DOUBLE, 5.0::DOUBLE], list_transform(range(40), lambda k: [0.0::DOUBLE, 0.0::DOUBLE])), lambda a, b: CASE WHEN {_worth('((a[1] + a[2]) / 2)')} > px THEN [a[1], (a[1] + a[2]) / 2] ELSE [(a[1] + a[2]) / 2, a[2]] END) AS e FROM nm WHERE {_worth('1e-4::DOUBLE')} <= px AND px <= {_worth('5.0::DOUBLE')}),
ok AS (SELECT *, (e[1] + e[2]) / 2 AS v FROM iv WHERE (e[1] + e[2]) / 2 BETWEEN 0.01 AND 1.5) SELECT trade_date, round(avg(v), 3) AS iv_atm FROM (SELECT *, min(days) OVER (PARTITION BY trade_date) AS near FROM ok) WHERE days = near GROUP BY 1""")
def timing_option_surface(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    spot = groups.index_frame(sold.groupBy(_week("l_shipdate").alias("trade_date")).agg(F.avg("p_retailprice").alias("close")))
    return groups.at_the_money(*_options(spark, sf_dir), spot).select("trade_date", F.round("iv_atm", 3).alias("iv_atm"))


@query(f"""{_OPTION_SQL}, iv AS (SELECT trade_date, avg(turnover_rate) * 4 AS iv_atm FROM ret WHERE is_liquid GROUP BY 1), lr AS (SELECT *, ln(c) - ln(lag(c) OVER (ORDER BY trade_date)) AS l FROM idx), rv AS (SELECT trade_date, ({_roll('l', 20, 10, 'stddev_samp')}) * sqrt(252) AS real FROM lr),
op AS (SELECT trade_date, put_call_log, iv_atm, iv_atm - real AS iv_realized_spread FROM pc FULL JOIN iv USING (trade_date) LEFT JOIN rv USING (trade_date)) {_shown(_OPTIONS)} FROM op""")
def timing_options(spark, sf_dir):
    r = returns(spark, sf_dir)
    iv = r.filter("is_liquid").groupBy("trade_date").agg((F.avg("turnover_rate") * 4).alias("iv"))
    return said(groups.option_sentiment(*_options(spark, sf_dir), _index(r), iv), *_OPTIONS)


# Futures: orders of a week, shipped in later months, stand for contracts

_FUTURES = ("fut_ls_log", "fut_near_basis_ann", "fut_next_basis_ann")


def _futures(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("m", F.date_trunc("month", F.date_add("l_shipdate", 31)))
    code = F.concat(F.when(F.col("l_suppkey") % 5 == 0, "IC").otherwise("IF"), F.date_format("m", "yyMM"))
    daily = both.groupBy(_text(_week("o_orderdate")).alias("trade_date"), code.alias("ts_code")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("settle"))
    basic = both.select(code.alias("ts_code"), code.alias("symbol"), _text(F.date_add("m", 19)).alias("delist_date")).distinct()
    side = lambda f: F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)
    return both.select(_text(_week("o_orderdate")).alias("trade_date"), code.alias("symbol"), side("R").alias("long_hld"), side("A").alias("short_hld")), daily, basic


@query(f"""{_BASE}, bo AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS trade_date, CAST(date_trunc('month', CAST(l_shipdate AS DATE) + 31) AS DATE) AS m, l_suppkey % 5 <> 0 AS mine, l_returnflag, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ho AS (SELECT trade_date, ln((sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) + 1.0) / (sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) + 1.0)) AS fut_ls_log FROM bo WHERE mine GROUP BY 1),
dq AS (SELECT trade_date, m, date_diff('day', trade_date, m + 19) AS days, avg(l_extendedprice / l_quantity) AS p FROM bo WHERE mine GROUP BY 1, 2), bs AS (SELECT trade_date, (p - c) / c * 365 / days AS b, row_number() OVER (PARTITION BY trade_date ORDER BY days) AS k FROM dq JOIN idx USING (trade_date) WHERE days > 5),
nn AS (SELECT trade_date, max(b) FILTER (k = 1) AS fut_near_basis_ann, max(b) FILTER (k = 2) AS fut_next_basis_ann FROM bs WHERE k <= 2 GROUP BY 1), ft AS (SELECT * FROM ho FULL JOIN nn USING (trade_date)) {_shown(_FUTURES)} FROM ft""")
def timing_futures(spark, sf_dir):
    return said(groups.futures_sentiment(_index(returns(spark, sf_dir)), "IF", *_futures(spark, sf_dir)), *_FUTURES)


# Money flow and macro

_FLOW = ("main_net_ratio", "main_net_ratio_ma5", "main_net_ratio_ma20", "main_net_ratio_sum_5d", "main_net_ratio_sum_20d")


@query(f"""{_BASE}, fl AS (SELECT trade_date, coalesce(sum(amount_cny * step), 0) / any_value(amount) AS q FROM ret JOIN idx USING (trade_date) GROUP BY 1),
fm AS (SELECT trade_date, q AS main_net_ratio, {_roll('q', 5, 3)} AS main_net_ratio_ma5, {_roll('q', 20, 10)} AS main_net_ratio_ma20, {_roll('q', 5, 3, 'sum')} AS main_net_ratio_sum_5d, {_roll('q', 20, 10, 'sum')} AS main_net_ratio_sum_20d FROM fl) {_shown(_FLOW)} FROM fm""")
def timing_money_flow(spark, sf_dir):
    r = returns(spark, sf_dir)
    return said(groups.money_flow(r.select("trade_date", (F.col("amount_cny") * F.col("step")).alias("net_mf_amount")), _stocks(r)), *_FLOW)


_MACRO = ("cpi_yoy", "cpi_yoy_chg_1m", "cpi_yoy_chg_3m", "pmi", "pmi_chg_1m", "pmi_chg_3m", "pmi_above_50", "epu_log", "epu_log_chg_1m", "macro_growth_score", "macro_inflation_score", "macro_uncertainty_score")
_L = "OVER (ORDER BY trade_date)"
_MACRO_SQL = f""", mo AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, avg(o_totalprice) AS a, count(*) AS n, max(o_totalprice) AS x FROM orders GROUP BY 1),
cp AS (SELECT CAST(m + INTERVAL 40 DAY AS DATE) AS trade_date, a / 50000 AS v FROM mo), pm AS (SELECT CAST(m + INTERVAL 32 DAY AS DATE) AS trade_date, n % 17 + 42.0::DOUBLE AS v FROM mo), ep AS (SELECT CAST(m + INTERVAL 60 DAY AS DATE) AS trade_date, ln(x) AS v FROM mo),
c1 AS (SELECT trade_date, v AS cpi_yoy, v - lag(v, 1) {_L} AS cpi_yoy_chg_1m, v - lag(v, 3) {_L} AS cpi_yoy_chg_3m FROM cp), p1 AS (SELECT trade_date, v AS pmi, v - lag(v, 1) {_L} AS pmi_chg_1m, v - lag(v, 3) {_L} AS pmi_chg_3m FROM pm), e1 AS (SELECT trade_date, v AS epu_log, v - lag(v, 1) {_L} AS epu_log_chg_1m FROM ep),
mj AS (SELECT * FROM c1 FULL JOIN p1 USING (trade_date) FULL JOIN e1 USING (trade_date)), mf AS (SELECT trade_date, {', '.join(f'last_value({c} IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}' for c in ('cpi_yoy', 'cpi_yoy_chg_1m', 'cpi_yoy_chg_3m', 'pmi', 'pmi_chg_1m', 'pmi_chg_3m', 'epu_log', 'epu_log_chg_1m'))} FROM mj),
ma AS (SELECT *, CASE WHEN pmi > 50 THEN 1.0 WHEN pmi IS NOT NULL THEN 0.0 END AS pmi_above_50, pmi + pmi_chg_3m AS macro_growth_score, cpi_yoy + cpi_yoy_chg_3m AS macro_inflation_score, epu_log AS macro_uncertainty_score FROM mf)"""


def _macro(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.avg("o_totalprice").alias("a"), F.count("*").alias("n"), F.max("o_totalprice").alias("x"))
    known = lambda k: F.date_add("m", k)
    return groups.macro(
        o.select(_text(known(40)).alias("ann_date"), (F.col("a") / 50000).alias("nt_yoy")), o.select(known(32).alias("available_date"), (F.col("n") % 17 + 42.0).cast("string").alias("pmi010000")), o.select(known(60).alias("date"), F.col("x").alias("epu")),
    )


@query(f"{_BASE}{_MACRO_SQL} {_shown(_MACRO)} FROM ma")
def timing_macro(spark, sf_dir):
    return said(_macro(spark, sf_dir).select("trade_date", *_MACRO), *_MACRO)


# The table

_TABLE = ("index_close", "erp", "erp_chg_5d", "pmi", "pmi_chg_3m", "label_5d_excess_return")


def _share(x: str, size: int) -> str:
    frame = f"(ORDER BY trade_date ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {frame} >= 20 THEN greatest(least(len(list_filter(list({x}) OVER {frame}, lambda z: z <= {x})) / count({x}) OVER {frame}, 0.99), 0.01) END"


@query(f"""{_BASE}{_VALUE_SQL}{_MACRO_SQL}, vd AS (SELECT trade_date, erp, erp - lag(erp, 5) {_L} AS erp_chg_5d, {_share('erp', 60)} AS pct FROM va), vl AS (SELECT trade_date, lag(erp) {_L} AS erp, lag(erp_chg_5d) {_L} AS erp_chg_5d, lag(pct) {_L} AS pct FROM idx LEFT JOIN vd USING (trade_date)),
mz AS (SELECT idx.trade_date, pmi, pmi_chg_3m FROM idx ASOF LEFT JOIN ma ON idx.trade_date >= ma.trade_date), ml AS (SELECT trade_date, lag(pmi, 2) {_L} AS pmi, lag(pmi_chg_3m, 2) {_L} AS pmi_chg_3m FROM mz), lb AS (SELECT trade_date, c AS index_close, lead(c, 5) {_L} / c - 1 AS label_5d_excess_return FROM idx),
tt AS (SELECT * FROM lb JOIN vl USING (trade_date) JOIN ml USING (trade_date)) {_shown((*_TABLE, 'pct'))}, CASE WHEN pct > 0.9 THEN 1.0::DOUBLE WHEN pct IS NOT NULL THEN 0.0 END AS erp_high_90 FROM tt""")
def timing_table(spark, sf_dir):
    r = returns(spark, sf_dir)
    made = groups.timing_table(_index(r), {"valuation": _valuation(r), "macro": _macro(spark, sf_dir)}, {"macro": 2}, (5,), z=30, pct=60, changes=(5,))
    return said(made.withColumnRenamed("erp_pct_60", "pct").select("trade_date", *_TABLE, "pct", "erp_high_90"), *_TABLE, "pct")


_IMPLIED = research_queries.QUERIES["timing_implied_volatility"]


@query(f"""WITH o AS (SELECT o_orderkey, 80.0::DOUBLE + o_orderkey % 40 AS strike, 0.1::DOUBLE + (o_orderkey % 9) / 10.0::DOUBLE AS years, o_orderkey % 2 = 1 AS put, 100.0::DOUBLE AS s FROM orders), q AS (SELECT *, greatest(CASE WHEN put THEN strike - 100 ELSE 100 - strike END, 0) + 6.0 AS px FROM o),
iv AS (SELECT *, list_reduce(list_prepend([1e-4::DOUBLE, 5.0::DOUBLE], list_transform(range(40), lambda k: [0.0::DOUBLE, 0.0::DOUBLE])), lambda a, b: CASE WHEN {_worth('((a[1] + a[2]) / 2)')} > px THEN [a[1], (a[1] + a[2]) / 2] ELSE [(a[1] + a[2]) / 2, a[2]] END) AS e, {_worth('1e-4::DOUBLE')} <= px AND px <= {_worth('5.0::DOUBLE')} AS ok FROM q)
SELECT o_orderkey, CASE WHEN ok THEN round((e[1] + e[2]) / 2, 3) END AS sigma FROM iv""")
def timing_implied_volatility(spark, sf_dir):
    return _IMPLIED(spark, sf_dir).withColumn("sigma", F.round("sigma", 3))  # a bisection ends within 1e-8
