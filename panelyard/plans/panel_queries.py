"""Joins, aggregates, windows, ranks, residuals and statistics as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.functions.frames import shown
from panelyard.operators import combine, events, joins, portfolio, residual, rotation, stats
from panelyard.sources.market import PANEL_SQL, table, weekly_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
W = "(PARTITION BY ts_code ORDER BY trade_date)"


def close():
    return F.col("adj_close")


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL if there is any."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def rows(a: str, b: str) -> str:
    return f"(PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {a} AND {b})"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + 1e-9, 6)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_panel(spark, sf_dir).withColumn("step", frames.safe_ratio(close(), F.lag(close(), 1).over(frames.history())) - 1)


RETURNS_SQL = f"{PANEL_SQL}, ret AS (SELECT *, adj_close / lag(adj_close, 1) OVER {W} - 1 AS step FROM panel)"
FUTURE_SQL = f"{RETURNS_SQL}, fut AS (SELECT *, lead(adj_open, 3) OVER {W} / lead(adj_open, 1) OVER {W} - 1 AS fwd FROM ret)"


def future(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).withColumn("fwd", stats.forward_open_return(2))


# Joins


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_checked(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return joins.checked_join(table(spark, sf_dir, "orders"), c, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey AS key, 'left_only' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right_only' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def join_unmatched(spark, sf_dir):
    return joins.unmatched(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS large FROM customer")
def join_semi_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("large", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("large", F.lit(False)))


def _clicks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]  # two names
    left = e.filter(F.col("event_type") == kinds[0]).select("event_id", "user_id", "ts")
    right = e.filter(F.col("event_type") == kinds[1]).groupBy("user_id", F.col("ts").alias("seen")).agg(F.max("event_id").alias("seen_id")).withColumn("expiry", F.expr("seen + interval 12 hours"))
    return left, right


CLICKS_SQL = """WITH kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
l AS (SELECT event_id, user_id, ts FROM events JOIN kinds USING (event_type) WHERE k = 1),
r AS (SELECT user_id, ts AS seen, max(event_id) AS seen_id, ts + INTERVAL 12 HOUR AS expiry FROM events JOIN kinds USING (event_type) WHERE k = 2 GROUP BY user_id, ts)"""


@query(f"{CLICKS_SQL} SELECT event_id, seen_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.seen")
def join_asof(spark, sf_dir):
    left, right = _clicks(spark, sf_dir)
    return joins.asof(left, right, ["user_id"], "ts", "seen", ["seen_id"]).select("event_id", "seen_id")


@query(f"{CLICKS_SQL} SELECT event_id, seen_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.seen")
def join_asof_strict(spark, sf_dir):
    left, right = _clicks(spark, sf_dir)
    return joins.asof(left, right, ["user_id"], "ts", "seen", ["seen_id"], exact=False).select("event_id", "seen_id")


@query(f"{CLICKS_SQL} SELECT event_id, CASE WHEN date_diff('day', CAST(seen AS DATE), CAST(ts AS DATE)) <= 1 THEN seen_id END AS seen_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.seen")
def join_asof_tolerance(spark, sf_dir):
    left, right = _clicks(spark, sf_dir)
    return joins.asof(left, right, ["user_id"], "ts", "seen", ["seen_id"], tolerance_days=1).select("event_id", "seen_id")


@query(f"{CLICKS_SQL} SELECT event_id, CASE WHEN ts < expiry THEN seen_id END AS seen_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.seen")
def join_asof_expiry(spark, sf_dir):
    left, right = _clicks(spark, sf_dir)
    return joins.asof(left, right, ["user_id"], "ts", "seen", ["seen_id"], expires="expiry").select("event_id", "seen_id")


MEMBERS_SQL = """members AS (SELECT s_suppkey AS ts_code, m.k AS slice, CAST(DATE '1995-01-01' + CAST(s_suppkey % 7 * 30 + m.k * 400 AS INTEGER) AS DATE) AS in_date,
 CASE WHEN m.k < 4 THEN CAST(DATE '1995-01-01' + CAST(s_suppkey % 7 * 30 + m.k * 400 + 300 + s_suppkey % 3 * 120 AS INTEGER) AS DATE) END AS out_date FROM supplier, (VALUES (0), (1), (2), (3), (4)) m(k))"""


def _members(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ts_code"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("slice"))
    start = F.col("ts_code") % 7 * 30 + F.col("slice") * 400
    day = lambda n: F.date_add(F.lit("1995-01-01").cast("date"), n.cast("int"))
    return m.withColumn("in_date", day(start)).withColumn("out_date", F.when(F.col("slice") < 4, day(start + 300 + F.col("ts_code") % 3 * 120)))


@query(f"{PANEL_SQL}, {MEMBERS_SQL} SELECT p.trade_date, p.ts_code, (SELECT arg_max(slice, in_date) FROM members m WHERE m.ts_code = p.ts_code AND p.trade_date >= in_date AND (out_date IS NULL OR p.trade_date < out_date)) AS slice FROM panel p")
def join_interval(spark, sf_dir):
    return joins.interval_join(weekly_panel(spark, sf_dir), _members(spark, sf_dir), ["ts_code"], "trade_date", "in_date", "out_date", ["slice"]).select("trade_date", "ts_code", "slice")


@query(f"WITH {MEMBERS_SQL} SELECT ts_code, slice FROM (SELECT *, lag(coalesce(out_date, DATE '9999-12-31')) OVER (PARTITION BY ts_code ORDER BY in_date) AS e FROM members) WHERE in_date < e")
def join_overlap_check(spark, sf_dir):
    return joins.overlaps(_members(spark, sf_dir), ["ts_code"], "in_date", "out_date").select("ts_code", "slice")


@query(f"{PANEL_SQL}, cal AS (SELECT trade_date, lag(trade_date, 2) OVER (ORDER BY trade_date) AS known FROM (SELECT DISTINCT trade_date FROM panel)), {MEMBERS_SQL}, l AS (SELECT trade_date, ts_code, known FROM panel JOIN cal USING (trade_date)) SELECT trade_date, l.ts_code, slice FROM l ASOF LEFT JOIN members m ON l.ts_code = m.ts_code AND l.known >= m.in_date")
def join_asof_lagged(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).select("trade_date", "ts_code")
    return joins.asof_lagged(p, _members(spark, sf_dir), p, ["ts_code"], "trade_date", "in_date", ["slice"], sessions=2).select("trade_date", "ts_code", "slice")


@query(f"{PANEL_SQL}, o AS (SELECT *, row_number() OVER {W} AS n FROM panel), e AS (SELECT ts_code, n, trade_date FROM o WHERE volume_shares > 100) SELECT e.ts_code, e.trade_date AS event_date, CAST(o.n - e.n AS INTEGER) AS \"offset\", {r6('o.adj_close')} AS adj_close FROM e JOIN o ON e.ts_code = o.ts_code AND o.n BETWEEN e.n + 1 AND e.n + 3")
def join_event_path(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).withColumn("n", F.row_number().over(frames.history()))
    e = p.filter("volume_shares > 100").select("ts_code", "n", F.col("trade_date").alias("event_date"))
    return joins.event_paths(e, p, "ts_code", "n", 3, ["adj_close"]).select("ts_code", "event_date", "offset", shown(close()).alias("adj_close"))


# Aggregates


@query(f"{RETURNS_SQL} SELECT trade_date, industry_l1_code, count(*) AS n, count(DISTINCT industry_l2_code) AS groups, {r6('median(adj_close)')} AS median_close, {r6('avg(step)')} AS mean_step FROM ret GROUP BY ALL")
def agg_industry(spark, sf_dir):
    return returns(spark, sf_dir).groupBy("trade_date", "industry_l1_code").agg(F.count("*").alias("n"), F.count_distinct("industry_l2_code").alias("groups"), shown(F.median("adj_close")).alias("median_close"), shown(F.avg("step")).alias("mean_step"))


@query(f"{RETURNS_SQL}, w AS (SELECT *, lag(total_mv_cny) OVER {W} AS weight FROM ret) SELECT trade_date, industry_l1_code, {r6('sum(weight * step) / nullif(sum(weight), 0)')} AS weighted_return, count(step) AS members FROM w GROUP BY ALL")
def agg_weighted_return(spark, sf_dir):
    p = returns(spark, sf_dir).withColumn("weight", F.lag("total_mv_cny").over(frames.history()))
    return rotation.weighted_return(p, ["trade_date", "industry_l1_code"], "step", "weight").withColumn("weighted_return", shown(F.col("weighted_return")))


@query(f"{RETURNS_SQL} SELECT trade_date, ts_code, {r6('(coalesce(sum(step) OVER g, 0) - step) / nullif(count(step) OVER g - 1, 0)')} AS peers FROM ret WINDOW g AS (PARTITION BY trade_date, industry_l1_code)")
def agg_leave_one_out(spark, sf_dir):
    p = returns(spark, sf_dir)
    return p.select("trade_date", "ts_code", shown(frames.leave_one_out(F.col("step"), Window.partitionBy("trade_date", "industry_l1_code"))).alias("peers"))


@query(f"{PANEL_SQL}, f AS (SELECT *, amount_cny - 50000 AS flow FROM panel) SELECT trade_date, {r6('sum(flow * flow) / nullif(sum(abs(flow)) * sum(abs(flow)), 0)')} AS hhi, {r6('max(abs(flow)) / nullif(sum(abs(flow)), 0)')} AS top_share, {r6('abs(sum(flow)) / nullif(sum(abs(flow)), 0)')} AS coherence FROM f GROUP BY trade_date")
def agg_concentration(spark, sf_dir):
    from panelyard.operators import radar

    p = weekly_panel(spark, sf_dir).withColumn("flow", F.col("amount_cny") - 50000)
    return radar.concentration(p, "flow", ["trade_date"]).select("trade_date", *(shown(F.col(c)).alias(c) for c in ("hhi", "top_share", "coherence")))


@query(f"{RETURNS_SQL} SELECT trade_date, {r6('avg(CASE WHEN step > 0 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END)')} AS of_known, {r6('avg(CASE WHEN step > 0 THEN 1.0 ELSE 0.0 END)')} AS of_all FROM ret GROUP BY trade_date")
def agg_breadth(spark, sf_dir):
    p = returns(spark, sf_dir)
    a, b = rotation.breadth(p, ["trade_date"], "step"), rotation.breadth(p, ["trade_date"], "step", null_counts=True).withColumnRenamed("breadth", "all")
    return a.join(b, "trade_date").select("trade_date", shown(F.col("breadth")).alias("of_known"), shown(F.col("all")).alias("of_all"))


@query(f"{PANEL_SQL} SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, industry_l1_code, CAST(sum(CAST(amount_cny AS DECIMAL(18,2))) AS DOUBLE) AS amount, {r6('avg(adj_close)')} AS mean_close FROM panel GROUP BY ALL")
def agg_resample(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    return p.groupBy(F.to_date(F.date_trunc("month", "trade_date")).alias("month"), "industry_l1_code").agg(F.sum(F.col("amount_cny").cast("decimal(18,2)")).cast("double").alias("amount"), shown(F.avg("adj_close")).alias("mean_close"))


@query(f"{RETURNS_SQL} SELECT ts_code, CAST(year(trade_date) AS INTEGER) AS year, {r6('product(1 + step / 10) - 1')} AS compound FROM ret WHERE step IS NOT NULL GROUP BY ALL")
def agg_compound(spark, sf_dir):
    p = returns(spark, sf_dir).filter("step is not null")
    return p.groupBy("ts_code", F.year("trade_date").alias("year")).agg(shown(F.product(1 + F.col("step") / 10) - 1).alias("compound"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def agg_keep_last(spark, sf_dir):
    return joins.keep_last(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"{PANEL_SQL} SELECT CAST(year(trade_date) AS INTEGER) AS year, {', '.join(f'''{r6(f'avg(adj_close) FILTER (industry_l1_code = {chr(39)}{k}{chr(39)})')} AS i{k}''' for k in range(5))} FROM panel GROUP BY 1")
def agg_pivot(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).groupBy(F.year("trade_date").alias("year")).pivot("industry_l1_code", [str(k) for k in range(5)]).agg(F.avg("adj_close"))
    return p.select("year", *(shown(F.col(str(k))).alias(f"i{k}") for k in range(5)))


@query(f"{PANEL_SQL} SELECT trade_date, ts_code, k AS field, {r6('v')} AS value FROM (SELECT trade_date, ts_code, unnest(['adj_high', 'adj_low']) AS k, unnest([adj_high, adj_low]) AS v FROM panel)")
def agg_unpivot(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).unpivot(["trade_date", "ts_code"], ["adj_high", "adj_low"], "field", "value")
    return p.withColumn("value", shown(F.col("value")))


@query(f"{PANEL_SQL} SELECT coalesce(CAST(y AS INTEGER), 0) AS year, coalesce(industry_l1_code, 'all') AS industry, count(*) AS n, CAST(sum(CAST(amount_cny AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM (SELECT *, year(trade_date) AS y FROM panel) GROUP BY GROUPING SETS ((y, industry_l1_code), (y), ())")
def agg_grids(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).select(F.year("trade_date").alias("year"), F.col("industry_l1_code").alias("industry"), "amount_cny")
    g = p.groupingSets([["year", "industry"], ["year"], []], "year", "industry").agg(F.count("*").alias("n"), F.sum(F.col("amount_cny").cast("decimal(18,2)")).cast("double").alias("amount"))
    return g.fillna({"year": 0, "industry": "all"})


# Windows


def windowed(name: str, column, sql: str, source=None, source_sql: str | None = None):
    """A query of one column over returns (or another frame) of each row."""

    def fn(spark, sf_dir):
        return (source or returns)(spark, sf_dir).select("trade_date", "ts_code", shown(column()).alias("x"))

    fn.__name__ = name
    query(f"{source_sql or RETURNS_SQL + ' '} SELECT trade_date, ts_code, {r6(sql)} AS x FROM {'ret' if source_sql is None else 'src'}")(fn)


S = lambda: F.col("step")
windowed("win_shifted_std", lambda: frames.rolling(S(), 8, "std", 5, shift=2, ddof=1), f"CASE WHEN count(step) OVER {rows('9 PRECEDING', '2 PRECEDING')} >= 5 THEN stddev_samp(step) OVER {rows('9 PRECEDING', '2 PRECEDING')} END")
windowed("win_median", lambda: frames.rolling(S(), 12, "median", 6, shift=1), f"CASE WHEN count(step) OVER {rows('12 PRECEDING', '1 PRECEDING')} >= 6 THEN median(step) OVER {rows('12 PRECEDING', '1 PRECEDING')} END")
windowed("win_prior_quantile", lambda: frames.rolling_quantile(S(), 20, 0.8, 10), f"CASE WHEN count(step) OVER {rows('20 PRECEDING', '1 PRECEDING')} >= 10 THEN quantile_cont(step, 0.8) OVER {rows('20 PRECEDING', '1 PRECEDING')} END")
PRIOR = f"(SELECT *, list_filter(list(step) OVER {rows('40 PRECEDING', '1 PRECEDING')}, lambda z: z IS NOT NULL) AS a, list_filter(list(step) OVER {rows('39 PRECEDING', 'CURRENT ROW')}, lambda z: z IS NOT NULL) AS b FROM ret)"
windowed("win_prior_percentile", lambda: frames.prior_percentile(S(), 40, 15), "CASE WHEN step IS NOT NULL AND len(a) >= 15 THEN (len(list_filter(a, lambda z: z < step)) + 0.5 * len(list_filter(a, lambda z: z = step))) / len(a) END", returns, f"{RETURNS_SQL}, src AS {PRIOR}")
windowed("win_trailing_rank", lambda: frames.trailing_rank(S(), 40, 15), "CASE WHEN step IS NOT NULL AND len(b) >= 15 THEN (len(list_filter(b, lambda z: z < step)) + (len(list_filter(b, lambda z: z = step)) + 1) / 2.0) / len(b) END", returns, f"{RETURNS_SQL}, src AS {PRIOR}")
windowed("win_corr", lambda: frames.rolling_corr(S(), F.col("turnover_rate"), 15, 10), f"CASE WHEN count(step) OVER {rows('14 PRECEDING', 'CURRENT ROW')} >= 10 THEN corr(step, CASE WHEN step IS NOT NULL THEN turnover_rate END) OVER {rows('14 PRECEDING', 'CURRENT ROW')} END")
windowed("win_forward_max", lambda: frames.forward(F.col("adj_high"), 5, "max"), f"CASE WHEN count(adj_high) OVER {rows('1 FOLLOWING', '5 FOLLOWING')} >= 5 THEN max(adj_high) OVER {rows('1 FOLLOWING', '5 FOLLOWING')} END")
windowed("win_forward_mean", lambda: frames.forward(S(), 4, "mean"), f"CASE WHEN count(step) OVER {rows('1 FOLLOWING', '4 FOLLOWING')} >= 4 THEN avg(step) OVER {rows('1 FOLLOWING', '4 FOLLOWING')} END")
windowed("win_compound", lambda: frames.compound(S() / 10, 6), f"CASE WHEN count(step) OVER {rows('5 PRECEDING', 'CURRENT ROW')} >= 6 THEN exp(sum(ln(1 + greatest(step / 10, -0.999999))) OVER {rows('5 PRECEDING', 'CURRENT ROW')}) - 1 END")
windowed("win_drawdown", lambda: close() / F.max(close()).over(frames.history().rowsBetween(Window.unboundedPreceding, 0)) - 1, f"adj_close / max(adj_close) OVER {rows('UNBOUNDED PRECEDING', 'CURRENT ROW')} - 1")
windowed("win_forward_fill", lambda: F.last(F.when(F.col("volume_shares") > 40, close()), ignorenulls=True).over(frames.history().rowsBetween(Window.unboundedPreceding, 0)), f"last_value(CASE WHEN volume_shares > 40 THEN adj_close END IGNORE NULLS) OVER {rows('UNBOUNDED PRECEDING', 'CURRENT ROW')}")
windowed("win_cumulative", lambda: F.sum("volume_shares").over(frames.history().rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(frames.history()), f"sum(volume_shares) OVER {rows('UNBOUNDED PRECEDING', 'CURRENT ROW')} / row_number() OVER {W}")
windowed(
    "win_average_true_range", lambda: frames.rolling(F.col("tr"), 10), f"CASE WHEN count(tr) OVER {rows('9 PRECEDING', 'CURRENT ROW')} >= 10 THEN avg(tr) OVER {rows('9 PRECEDING', 'CURRENT ROW')} END",
    lambda s, d: weekly_panel(s, d).withColumn("tr", frames.true_range(F.col("adj_high"), F.col("adj_low"), F.lag(close(), 1).over(frames.history()), strict=True)),
    f"{PANEL_SQL}, pc AS (SELECT *, lag(adj_close) OVER {W} AS p FROM panel), src AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(adj_high - adj_low, abs(adj_high - p), abs(adj_low - p)) END AS tr FROM pc)",
)
windowed(
    "win_run_length", lambda: frames.run_length(F.col("up"), F.col("island"), Window.partitionBy("ts_code", "island").orderBy("trade_date")), "CASE WHEN up THEN sum(CAST(up AS INTEGER)) OVER (PARTITION BY ts_code, island ORDER BY trade_date) ELSE 0 END",
    lambda s, d: returns(s, d).withColumn("up", F.coalesce(S() > 0, F.lit(False))).withColumn("island", F.sum((~F.col("up")).cast("int")).over(frames.history())),
    f"{RETURNS_SQL}, u AS (SELECT *, coalesce(step > 0, false) AS up FROM ret), src AS (SELECT *, sum(CAST(NOT up AS INTEGER)) OVER {W} AS island FROM u)",
)
windowed("win_first_in_window", lambda: events.first_in_window(F.col("volume_shares") > 60, 5).cast("int"), f"CAST(volume_shares > 60 AND coalesce(max(CAST(volume_shares > 60 AS INTEGER)) OVER {rows('5 PRECEDING', '1 PRECEDING')}, 0) = 0 AS INTEGER)")


# Ranks, top-k, sets


@query(f"{RETURNS_SQL} SELECT trade_date, ts_code, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY step DESC NULLS LAST, ts_code) AS INTEGER) AS rank FROM ret WHERE step IS NOT NULL QUALIFY rank <= 5")
def top_by_date(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col("step").desc_nulls_last(), "ts_code"))
    return returns(spark, sf_dir).filter("step is not null").withColumn("rank", r).filter("rank <= 5").select("trade_date", "ts_code", "rank")


@query(f"{RETURNS_SQL}, f AS (SELECT * FROM ret WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date, industry_l2_code ORDER BY step DESC, ts_code) = 1) SELECT trade_date, ts_code, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY step DESC, ts_code) AS INTEGER) AS rank FROM f QUALIFY rank <= 4")
def top_by_cluster(spark, sf_dir):
    return rotation.top_by_cluster(returns(spark, sf_dir), ["trade_date"], "step", "industry_l2_code", 4).select("trade_date", "ts_code", "rank")


@query(f"{RETURNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY adj_close DESC, ts_code) <= 10 AS a, row_number() OVER (PARTITION BY trade_date ORDER BY volume_shares DESC, ts_code) <= 10 AS b FROM ret) SELECT trade_date, {r6('sum(CAST(a AND b AS INTEGER)) / nullif(sum(CAST(a OR b AS INTEGER)), 0)')} AS jaccard FROM k GROUP BY trade_date")
def set_top_overlap(spark, sf_dir):
    return combine.top_overlap(weekly_panel(spark, sf_dir), "adj_close", "volume_shares", 10).withColumn("jaccard", shown(F.col("jaccard")))


@query(f"{PANEL_SQL}, a AS (SELECT DISTINCT ts_code FROM panel WHERE volume_shares > 100), b AS (SELECT DISTINCT ts_code FROM panel WHERE adj_close > 1900) SELECT ts_code, CASE WHEN a.ts_code IS NOT NULL AND b.ts_code IS NOT NULL THEN 'common' WHEN b.ts_code IS NULL THEN 'dropped' ELSE 'added' END AS part FROM a FULL JOIN b USING (ts_code)")
def set_attribution(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    a, b = p.filter("volume_shares > 100").select("ts_code").distinct(), p.filter("adj_close > 1900").select("ts_code").distinct()
    return a.intersect(b).withColumn("part", F.lit("common")).unionByName(a.exceptAll(b).withColumn("part", F.lit("dropped"))).unionByName(b.exceptAll(a).withColumn("part", F.lit("added")))


# Residuals


@query(f"{RETURNS_SQL}, v AS (SELECT trade_date, ts_code, step AS y, CASE WHEN step IS NOT NULL THEN log_total_mv END AS x FROM ret) SELECT trade_date, ts_code, CASE WHEN y IS NOT NULL AND count(x) OVER d >= 10 THEN {r6('(y - avg(y) OVER d) - coalesce(covar_pop(x, y) OVER d / nullif(var_pop(x) OVER d, 0), 0) * (x - avg(x) OVER d)')} END AS residual FROM v WINDOW d AS (PARTITION BY trade_date)")
def residual_one_control(spark, sf_dir):
    return residual.one_control(returns(spark, sf_dir), "step", "log_total_mv", ["trade_date"], 10, "residual").select("trade_date", "ts_code", shown(F.col("residual")).alias("residual"))


@query(f"""{RETURNS_SQL}, a AS (SELECT *, step - avg(step) OVER c AS y, CASE WHEN step IS NOT NULL THEN log_total_mv END - avg(CASE WHEN step IS NOT NULL THEN log_total_mv END) OVER c AS x FROM ret WINDOW c AS (PARTITION BY trade_date, industry_l1_code)),
g AS (SELECT trade_date, count(DISTINCT industry_l1_code) AS k FROM ret GROUP BY 1)
SELECT trade_date, ts_code, CASE WHEN count(y) OVER d > k + 1 THEN {r6('y - coalesce(sum(x * y) OVER d / nullif(sum(x * x) OVER d, 0), 0) * x')} END AS residual FROM a JOIN g USING (trade_date) WINDOW d AS (PARTITION BY trade_date)""")
def residual_industry_size(spark, sf_dir):
    return residual.industry_and_size(returns(spark, sf_dir), "step", "log_total_mv", "industry_l1_code", "residual").select("trade_date", "ts_code", shown(F.col("residual")).alias("residual"))


@query()
def residual_least_squares(spark, sf_dir):
    return residual.least_squares(returns(spark, sf_dir), "step", ["log_total_mv", "turnover_rate"], ["trade_date"], 10, "residual")


@query()
def residual_ridge(spark, sf_dir):
    return residual.least_squares(returns(spark, sf_dir), "step", ["log_total_mv", "turnover_rate"], ["trade_date", "industry_l1_code"], 5, "residual", ridge=1.0, standardize=True)


@query()
def residual_rolling(spark, sf_dir):
    return residual.rolling_residual(returns(spark, sf_dir), "step", ["turnover_rate", "log_total_mv"], 30, "residual", least=20)


@query()
def residual_fama_macbeth(spark, sf_dir):
    return residual.fama_macbeth(future(spark, sf_dir), "fwd", ["step", "turnover_rate"])


# Statistics


@query(f"{FUTURE_SQL}, g AS (SELECT *, sum(fwd) OVER w AS s, count(fwd) OVER w AS n FROM fut WINDOW w AS (PARTITION BY trade_date, industry_l1_code)) SELECT trade_date, ts_code, {r6('fwd')} AS stock_return, {r6('fwd - (s - fwd) / nullif(n - 1, 0)')} AS stock_minus_peers FROM g")
def stat_forward_targets(spark, sf_dir):
    return stats.forward_targets(weekly_panel(spark, sf_dir), 2).select("trade_date", "ts_code", shown(F.col("stock_return")).alias("stock_return"), shown(F.col("stock_minus_peers")).alias("stock_minus_peers"))


def _avg_rank(x: str, d: str = "trade_date") -> str:
    return f"rank() OVER (PARTITION BY {d} ORDER BY {x}) + (count(*) OVER (PARTITION BY {d}, {x}) - 1) / 2.0"


IC_SQL = f"{FUTURE_SQL}, pr AS (SELECT trade_date, {_avg_rank('step')} AS a, {_avg_rank('fwd')} AS b FROM fut WHERE step IS NOT NULL AND fwd IS NOT NULL), ic AS (SELECT trade_date, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM pr GROUP BY 1)"


def _ic(spark, sf_dir, **params):
    return stats.daily_ic(future(spark, sf_dir), "step", "fwd", **params)


@query(f"{IC_SQL} SELECT trade_date, n, {r6('ic')} AS ic FROM ic")
def stat_rank_ic(spark, sf_dir):
    return _ic(spark, sf_dir).withColumn("ic", shown(F.col("ic")))


@query(f"{FUTURE_SQL} SELECT trade_date, count(*) AS n, {r6('CASE WHEN count(*) >= 20 THEN corr(step, fwd) END')} AS ic FROM fut WHERE step IS NOT NULL AND fwd IS NOT NULL GROUP BY 1")
def stat_pearson_ic(spark, sf_dir):
    return _ic(spark, sf_dir, method="pearson", least=20).withColumn("ic", shown(F.col("ic")))


@query(f"{IC_SQL} SELECT count(ic) AS days, {r6('avg(ic)')} AS mean, {r6('stddev_samp(ic)')} AS std, {r6('avg(CASE WHEN ic > 1e-12 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)')} AS positive_ratio, {r6('avg(ic) / stddev_samp(ic) * sqrt(252)')} AS icir, {r6('avg(ic) / stddev_samp(ic) * sqrt(count(ic))')} AS t_value FROM ic")
def stat_ic_summary(spark, sf_dir):
    s = stats.ic_summary(_ic(spark, sf_dir))
    return s.select("days", *(shown(F.col(c)).alias(c) for c in ("mean", "std", "positive_ratio", "icir", "t_value")))


@query(f"""{IC_SQL}, c AS (SELECT trade_date, ic - avg(ic) OVER () AS d, avg(ic) OVER () AS m FROM ic WHERE ic IS NOT NULL),
p AS (SELECT m, d * d AS p0, {', '.join(f'd * lag(d, {k}) OVER (ORDER BY trade_date) AS p{k}' for k in range(1, 5))} FROM c)
SELECT count(*) AS n, {r6('max(m)')} AS mean, {r6('max(m) / sqrt((sum(p0) + ' + ' + '.join(f'2 * (1 - {k} / 5.0) * coalesce(sum(p{k}), 0)' for k in range(1, 5)) + ') / count(*) / count(*))')} AS nw_t FROM p""")
def stat_newey_west(spark, sf_dir):
    ic = _ic(spark, sf_dir).withColumn("series", F.lit("all"))
    return stats.newey_west_sums(ic, ["series"], 4).select("n", shown(F.col("mean")).alias("mean"), shown(F.col("nw_t")).alias("nw_t"))


@query(f"""{PANEL_SQL}, t AS (SELECT ts_code, CASE WHEN count(*) > 250 THEN exp(-abs(avg(adj_close) - 1500) / 100) END AS p_value FROM panel GROUP BY 1),
q AS (SELECT *, p_value * count(p_value) OVER () / row_number() OVER (ORDER BY p_value NULLS LAST) AS raw FROM t)
SELECT ts_code, {r6('CASE WHEN p_value IS NOT NULL THEN least(min(raw) OVER (ORDER BY p_value DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) END')} AS fdr_q FROM q""")
def stat_fdr(spark, sf_dir):
    t = weekly_panel(spark, sf_dir).groupBy("ts_code").agg(F.when(F.count("*") > 250, F.exp(-F.abs(F.avg("adj_close") - 1500) / 100)).alias("p_value"))
    return stats.fdr(t).select("ts_code", shown(F.col("fdr_q")).alias("fdr_q"))


@query()
def stat_quantile_returns(spark, sf_dir):
    return stats.quantile_returns(future(spark, sf_dir), "step", "fwd", 10)


@query(f"""{FUTURE_SQL}, cnd AS (SELECT *, ({_avg_rank('volume_shares')}) / count(*) OVER (PARTITION BY trade_date) AS pr, count(*) OVER (PARTITION BY trade_date) AS m FROM fut),
bk AS (SELECT *, CASE WHEN m >= 5 THEN least(greatest(ceil(pr * 5), 1), 5) END AS bucket FROM cnd),
vv AS (SELECT trade_date, CAST(bucket AS BIGINT) AS bucket, {_avg_rank('step', 'trade_date, bucket')} AS a, {_avg_rank('fwd', 'trade_date, bucket')} AS b FROM bk WHERE step IS NOT NULL AND fwd IS NOT NULL AND bucket IS NOT NULL)
SELECT trade_date, bucket, count(*) AS n, {r6('CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END')} AS ic FROM vv GROUP BY ALL""")
def stat_conditional_ic(spark, sf_dir):
    p = future(spark, sf_dir)
    bucket = stats.condition_bucket(frames.pct_rank(F.col("volume_shares")), F.count("volume_shares").over(frames.section()), 5)
    b = p.withColumn("bucket", bucket.cast("long")).filter("bucket is not null")
    return stats.daily_ic(b, "step", "fwd", ["bucket"]).withColumn("ic", shown(F.col("ic")))


@query(f"""{IC_SQL}, x AS (SELECT year(trade_date) AS year, ic, row_number() OVER (PARTITION BY year(trade_date) ORDER BY trade_date) - 1 AS spot FROM ic WHERE ic IS NOT NULL), n AS (SELECT year, count(*) AS n, avg(ic) AS mean, least(4, count(*)) AS size FROM x GROUP BY 1),
d AS (SELECT n.*, r.draw, unnest(range(CAST(ceil(n / size) AS BIGINT))) AS k FROM n, range(200) r(draw) WHERE n >= 2), s AS (SELECT *, ('0x' || substr(md5('20240101:' || draw || ':' || k), 1, 8))::BIGINT % (n - size + 1) AS start, least(size, n - k * size) AS len FROM d),
m AS (SELECT s.year, draw, avg(ic) AS m FROM s JOIN x ON x.year = s.year AND x.spot >= start AND x.spot < start + len GROUP BY ALL)
SELECT n.year, {r6('any_value(mean)')} AS mean, {r6('quantile_cont(m, 0.025)')} AS low, {r6('quantile_cont(m, 0.975)')} AS high FROM n LEFT JOIN m USING (year) GROUP BY 1""")
def stat_block_bootstrap(spark, sf_dir):
    ic = _ic(spark, sf_dir).withColumn("year", F.year("trade_date"))
    out = stats.block_bootstrap(ic, ["year"], "ic", "trade_date", block=4, draws=200)
    return out.withColumns({c: shown(F.col(c)) for c in ("mean", "low", "high")})


@query(f"{PANEL_SQL} SELECT count(*) AS rows, count(DISTINCT ts_code) AS codes, {r6('avg(CASE WHEN is_liquid THEN 1.0 ELSE 0.0 END)')} AS liquid, {r6('(SELECT median(n) FROM (SELECT count(*) AS n FROM panel GROUP BY trade_date))')} AS median_section FROM panel")
def stat_quality(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    a = p.agg(F.count("*").alias("rows"), F.count_distinct("ts_code").alias("codes"), shown(F.avg(F.col("is_liquid").cast("double"))).alias("liquid"))
    return a.crossJoin(p.groupBy("trade_date").count().agg(shown(F.median("count")).alias("median_section")))  # one row each


# Combination


COMBINED_SQL = f"""{RETURNS_SQL}, q AS (SELECT trade_date, quantile_cont(step, 0.05) AS l1, quantile_cont(step, 0.95) AS h1, quantile_cont(volume_shares, 0.05) AS l2, quantile_cont(volume_shares, 0.95) AS h2 FROM ret GROUP BY 1),
n0 AS (SELECT *, CASE WHEN step IS NOT NULL THEN least(greatest(step, l1), h1) END AS c1, least(greatest(volume_shares, l2), h2) AS c2 FROM ret JOIN q USING (trade_date)),
n1 AS (SELECT *, CASE WHEN count(c1) OVER d >= 10 THEN (c1 - avg(c1) OVER d) / nullif(stddev_pop(c1) OVER d, 0) END AS a, CASE WHEN count(c2) OVER d >= 10 THEN (c2 - avg(c2) OVER d) / nullif(stddev_pop(c2) OVER d, 0) END AS b FROM n0 WINDOW d AS (PARTITION BY trade_date))"""
PARTS = [combine.Component("a", 2.0, "negative"), combine.Component("b", 1.0)]


def _combined(spark, sf_dir):
    p = combine.normalize(returns(spark, sf_dir), "step", "a", winsor=(0.05, 0.95))
    return combine.normalize(p, "volume_shares", "b", winsor=(0.05, 0.95))


@query(f"{COMBINED_SQL} SELECT trade_date, ts_code, {r6('(-2 * a + b) / 3')} AS factor_value FROM n1")
def combine_weighted(spark, sf_dir):
    return combine.combine(_combined(spark, sf_dir), PARTS).select("trade_date", "ts_code", shown(F.col("factor_value")).alias("factor_value"))


@query(f"{COMBINED_SQL}, s AS (SELECT *, (coalesce(-a, 0) * (a IS NOT NULL)::INT + coalesce(b, 0) * (b IS NOT NULL)::INT) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0) AS v FROM n1 WHERE true) SELECT trade_date, ts_code, {r6('CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT >= 1 AND NOT coalesce(b > 1.5, false) THEN CASE WHEN coalesce(a < -1, false) THEN v - 0.5 ELSE v END END')} AS factor_value FROM s")
def combine_filtered(spark, sf_dir):
    p = combine.combine(_combined(spark, sf_dir), PARTS, missing="require_minimum_components", minimum=1, equal=True)
    p = combine.apply_filters(p, [combine.Filter("b", "gt", 1.5), combine.Filter("a", "lt", -1.0, "penalize", 0.5)])
    return p.select("trade_date", "ts_code", shown(F.col("factor_value")).alias("factor_value"))


@query(f"{COMBINED_SQL} SELECT trade_date, ts_code, {r6('b')} AS without_a, {r6('-a')} AS without_b FROM n1")
def combine_leave_one_out(spark, sf_dir):
    p = combine.leave_one_out(_combined(spark, sf_dir), PARTS)
    return p.select("trade_date", "ts_code", shown(F.col("without_a")).alias("without_a"), shown(F.col("without_b")).alias("without_b"))


# Portfolio


@query(f"{PANEL_SQL}, r AS (SELECT *, lead(adj_open, 2) OVER {W} / lead(adj_open, 1) OVER {W} - 1 AS f FROM panel), m AS (SELECT trade_date, avg(CASE WHEN is_liquid THEN f END) AS m FROM r GROUP BY 1) SELECT trade_date, {r6('coalesce(lag(m, 2) OVER (ORDER BY trade_date), 0)')} AS benchmark_return FROM m")
def portfolio_benchmark(spark, sf_dir):
    return portfolio.universe_benchmark(weekly_panel(spark, sf_dir)).withColumn("benchmark_return", shown(F.col("benchmark_return")))


def _grid(spark, sf_dir, what):
    calm = lambda c: frames.rolling(F.col(c), 26, "mean", 1)  # noqa: E731  weekly prices of the driver's tables are noise; money made of noise grows without bound
    p = weekly_panel(spark, sf_dir).withColumns({"adj_open": calm("adj_open"), "adj_close": calm("adj_close")})
    p = p.withColumn("raw_open", F.col("adj_open")).withColumn("is_suspended", F.lit(False))
    scores = p.select("trade_date", "ts_code", F.pmod(F.xxhash64("trade_date", "ts_code"), F.lit(1000)).cast("double").alias("factor_value"))
    grid = [(f"top{n}_hold{h}_cost{c}", n, h, float(c)) for n in (5, 10) for h in (2, 4) for c in (0, 20)]
    return portfolio.ledgers(p, scores, spark.createDataFrame(grid, "scenario string, top_n int, holding_days int, cost_bps double"), rules=portfolio.Rules(lot_size=1), what=what)


@query()
def portfolio_ledgers(spark, sf_dir):
    return _grid(spark, sf_dir, "days")


@query()
def portfolio_trades(spark, sf_dir):
    return _grid(spark, sf_dir, "trades")


@query()
def portfolio_metrics(spark, sf_dir):
    return portfolio.metrics(_grid(spark, sf_dir, "days"))


@query()
def portfolio_capped_weights(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).select("trade_date", "ts_code", "amount_cny")
    return portfolio.capped_weights(p, ["trade_date"], "amount_cny", 0.05)
