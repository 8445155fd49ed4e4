"""Point-in-time fundamentals: statements replayed in the order of their announcements.

What was known at an event is a window over the announcements before it, so the
replay is joins and windows: each event sees, per period, the latest version
announced by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames

FIELDS = ("revenue_ttm", "net_assets", "roe_ttm", "revenue_growth_yoy", "roe_change_yoy", "debt_to_assets", "net_profit_ttm")


def statements(raw: DataFrame, values: list[str]) -> DataFrame:
    """ts_code, event_date, end_date, values: consolidated reports only, announced on f_ann_date or ann_date; the last update of a day wins."""
    day = lambda c: F.try_to_date(F.col(c).cast("string"), "yyyyMMdd") if c in raw.columns else F.lit(None).cast("date")
    have = [F.col(v).cast("double").alias(v) if v in raw.columns else F.lit(None).cast("double").alias(v) for v in values]
    flag = F.coalesce(F.col("update_flag").cast("int"), F.lit(0)) if "update_flag" in raw.columns else F.lit(0)
    rows = raw.filter(F.col("report_type").cast("string") == "1") if "report_type" in raw.columns else raw
    rows = rows.select("ts_code", F.coalesce(day("f_ann_date"), day("ann_date")).alias("event_date"), day("end_date").alias("end_date"), flag.alias("_flag"), *have)
    rows = rows.filter("ts_code is not null and event_date is not null and end_date is not null and event_date >= end_date")
    full = sum((F.col(v).isNotNull().cast("int") for v in values), F.lit(0))
    w = Window.partitionBy("ts_code", "event_date", "end_date").orderBy(F.desc("_flag"), full.desc(), *(F.col(v).desc_nulls_last() for v in values))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_flag")


def _known(events: DataFrame, rows: DataFrame, values: list[str], name: str) -> DataFrame:
    """For each event a map end_date -> values of the latest version announced by then."""
    seen = events.join(rows.withColumnRenamed("event_date", "_said"), "ts_code").filter("_said <= event_date")  # the statements of one security
    latest = seen.groupBy("ts_code", "event_date", "end_date").agg(F.max_by(F.struct(*values), "_said").alias("v"))
    return latest.groupBy("ts_code", "event_date").agg(F.map_from_entries(F.collect_list(F.struct("end_date", "v"))).alias(name))


def fundamentals(income: DataFrame, balance: DataFrame, sessions: DataFrame) -> DataFrame:
    """ts_code, available_date, source_event_date, report_period, FIELDS: a row where what is known changes, on the session after the event."""
    i = statements(income, ["total_revenue", "revenue", "n_income_attr_p"])
    b = statements(balance, ["total_assets", "total_liab", "total_hldr_eqy_exc_min_int", "total_hldr_eqy_inc_min_int"])
    i = i.select("ts_code", "event_date", "end_date", F.coalesce("total_revenue", "revenue").alias("revenue"), F.col("n_income_attr_p").alias("profit"))
    b = b.select("ts_code", "event_date", "end_date", F.coalesce("total_hldr_eqy_exc_min_int", "total_hldr_eqy_inc_min_int").alias("equity"), F.col("total_assets").alias("assets"), F.col("total_liab").alias("debts"))
    events = i.select("ts_code", "event_date").union(b.select("ts_code", "event_date")).distinct()
    both = _known(events, i, ["revenue", "profit"], "inc").join(_known(events, b, ["equity", "assets", "debts"], "bal"), ["ts_code", "event_date"])
    both = both.withColumn("period", F.array_max(F.array_intersect(F.map_keys("inc"), F.map_keys("bal")))).filter("period is not null")
    before = lambda years: F.add_months(F.col("period"), -12 * years)
    at = lambda m, day, field: F.try_element_at(F.col(m), day)[field]

    def ttm(field: str, years: int) -> Column:
        end = before(years) if years else F.col("period")
        year_end = F.make_date(F.year(end) - 1, F.lit(12), F.lit(31))
        now = at("inc", end, field)
        return F.when(F.month(end) == 12, now).otherwise(now + at("inc", year_end, field) - at("inc", F.add_months(end, -12), field))

    def mean_equity(a: Column, c: Column) -> Column:
        return (F.coalesce(a, c) + F.coalesce(c, a)) / 2

    positive = lambda x: F.when(x > 0, x)
    e0, e1, e2 = at("bal", F.col("period"), "equity"), at("bal", before(1), "equity"), at("bal", before(2), "equity")
    roe = F.try_divide(ttm("profit", 0), positive(mean_equity(e0, e1)))
    past_roe = F.try_divide(ttm("profit", 1), positive(mean_equity(e1, e2)))
    out = both.select(
        "ts_code", F.col("event_date").alias("source_event_date"), F.col("period").alias("report_period"), ttm("revenue", 0).alias("revenue_ttm"), e0.alias("net_assets"), roe.alias("roe_ttm"),
        (F.try_divide(ttm("revenue", 0), positive(ttm("revenue", 1))) - 1).alias("revenue_growth_yoy"), (roe - past_roe).alias("roe_change_yoy"),
        F.try_divide(at("bal", F.col("period"), "debts"), positive(at("bal", F.col("period"), "assets"))).alias("debt_to_assets"), ttm("profit", 0).alias("net_profit_ttm"),
    )
    payload = F.struct("report_period", *FIELDS)
    w = Window.partitionBy("ts_code").orderBy("source_event_date")
    changed = out.withColumn("_new", ~payload.eqNullSafe(F.lag(payload).over(w)) | (F.row_number().over(w) == 1)).filter("_new").drop("_new")
    # The next session: sessions and events on one line, the session after carried back.
    line = changed.select("source_event_date").distinct().select(F.col("source_event_date").alias("d"), F.lit(1).alias("event"), F.lit(None).cast("date").alias("session"))
    line = line.union(sessions.select(F.col("trade_date").alias("d")).distinct().select("d", F.lit(0), F.col("d")))
    after = Window.orderBy(F.desc("d"), F.desc("event")).rowsBetween(Window.unboundedPreceding, -1)  # one row a session or announcement day
    following = line.withColumn("available_date", F.last("session", ignorenulls=True).over(after)).filter("event = 1 and available_date is not null").select(F.col("d").alias("source_event_date"), "available_date")
    dated = changed.join(F.broadcast(following), "source_event_date")
    last = F.row_number().over(Window.partitionBy("ts_code", "available_date").orderBy(F.desc("source_event_date")))
    return dated.withColumn("_n", last).filter("_n = 1").select("ts_code", "available_date", "source_event_date", "report_period", *FIELDS)


def book_to_price(panel: DataFrame, known: DataFrame) -> DataFrame:
    """``panel`` with the fundamentals known on each date by an as-of join, and book_to_price."""
    from panelyard.operators.joins import asof

    joined = asof(panel, known, ["ts_code"], "trade_date", "available_date", ["available_date", "net_assets", "roe_ttm", "revenue_ttm"])
    return joined.withColumn("book_to_price", frames.safe_ratio(F.col("net_assets"), F.col("total_mv_cny")))
