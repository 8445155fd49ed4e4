"""The daily panel from raw vendor datasets, its quality rules, and immutable published versions."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import frames
from panelyard.operators.joins import interval_join

# Units of the vendor's numbers, and the panel's columns.
HANDS, THOUSANDS, TEN_THOUSANDS = 100.0, 1000.0, 10_000.0
FLOWS = ("net_mf_amount", "buy_sm_amount", "sell_sm_amount", "buy_lg_amount", "sell_lg_amount", "buy_elg_amount", "sell_elg_amount")
DELISTING = "退市|退市整理"


@dataclass(frozen=True)
class FlagPolicy:
    """How universe flags are made. ``tradeable_in_eligible`` and ``liquid_by`` tell the known policies apart."""

    name: str = "ingested"
    listing_age: int = 60
    window: int = 20
    least_mean_amount: float = 5e7
    least_traded: int = 18
    st_in_eligible: bool = False
    liquid_by: str = "amount"  # or "rank": the day's largest amounts
    liquid_top: int = 1000


SYNCED = FlagPolicy(name="synced", st_in_eligible=True, liquid_by="rank")


def vendor_date(c: str) -> Column:
    """yyyyMMdd text as a date; what is no date is missing."""
    return F.try_to_date(F.col(c).cast("string"), "yyyyMMdd")


def dated(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: vendor_date(c) for c in columns if c in df.columns and dict(df.dtypes)[c] != "date"})


def _columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, missing ones as NULL."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names))


def build_panel(sets: dict[str, DataFrame], policy: FlagPolicy = FlagPolicy(), level: str = "l1") -> DataFrame:
    """One row per session and security that traded or was suspended; datasets that are absent leave their columns NULL."""
    keys = ["trade_date", "ts_code"]
    daily = dated(sets["daily"], "trade_date")
    listed = sets["stock_basic"].select("ts_code").distinct() if "stock_basic" in sets else None
    only = lambda df: df.join(listed, "ts_code", "left_semi") if listed is not None else df
    base = only(daily)
    if "suspend" in sets:
        stopped = only(dated(sets["suspend"], "trade_date").select(*keys).distinct())
        base = base.unionByName(stopped.join(base, keys, "left_anti"), allowMissingColumns=True)
    panel = base
    for name, values in (("adj_factor", ["adj_factor"]), ("daily_basic", ["total_mv", "circ_mv", "turnover_rate"]), ("moneyflow", list(FLOWS)), ("stk_limit", ["up_limit", "down_limit"])):
        right = _columns(dated(sets[name], "trade_date"), *keys, *values) if name in sets else None
        panel = panel.join(right, keys, "left") if right is not None else panel.withColumns({v: F.lit(None).cast("double") for v in values})
    number = lambda c: F.col(c).cast("double")
    positive_log = lambda c: F.ln(F.when(c > 0, c))
    columns = {f"raw_{c}": number(c) for c in ("open", "high", "low", "close")} | {f"adj_{c}": number(c) * number("adj_factor") for c in ("open", "high", "low", "close")}
    columns |= {"volume_shares": number("vol") * HANDS, "amount_cny": number("amount") * THOUSANDS, "pct_change": number("pct_chg"), "total_mv_cny": number("total_mv") * TEN_THOUSANDS, "circ_mv_cny": number("circ_mv") * TEN_THOUSANDS}
    columns |= {"log_total_mv": positive_log(number("total_mv") * TEN_THOUSANDS), "log_circ_mv": positive_log(number("circ_mv") * TEN_THOUSANDS), "limit_up_price": number("up_limit"), "limit_down_price": number("down_limit")}
    columns |= {f"{c}_cny": number(c) * TEN_THOUSANDS for c in FLOWS}
    panel = panel.withColumns(columns).withColumns({"is_suspended": F.col("open").isNull(), "pre_close": number("pre_close"), "adj_factor": number("adj_factor"), "turnover_rate": number("turnover_rate")})
    panel = panel.withColumn("is_limit_up_open", F.coalesce(F.col("raw_open") >= F.col("limit_up_price") - 0.001, F.lit(False)))
    panel = panel.withColumn("is_limit_down_open", F.coalesce(F.col("raw_open") <= F.col("limit_down_price") + 0.001, F.lit(False)))
    panel = _industry(panel, sets.get("industry_membership"), level)
    panel = _status(panel, sets.get("st_status"), sets.get("st_status_coverage"))
    panel = flags(panel.withColumn("listing_trade_days", F.row_number().over(frames.history()).cast("long")), policy)
    return panel.select(
        *keys, "raw_open", "raw_high", "raw_low", "raw_close", "pre_close", "adj_factor", "adj_open", "adj_high", "adj_low", "adj_close", "volume_shares", "amount_cny", "pct_change",
        "total_mv_cny", "circ_mv_cny", "log_total_mv", "log_circ_mv", "turnover_rate", *(f"{c}_cny" for c in FLOWS), f"industry_{level}_code", f"industry_{level}_name", "limit_up_price", "limit_down_price",
        "is_suspended", "is_limit_up_open", "is_limit_down_open", "is_st", "is_delisting_period", "listing_trade_days", "is_factor_eligible", "is_tradeable", "is_liquid", "st_status_known",
    )


def _industry(panel: DataFrame, membership: DataFrame | None, level: str) -> DataFrame:
    code, name = f"industry_{level}_code", f"industry_{level}_name"
    if membership is None:
        return panel.withColumns({code: F.lit(None).cast("string"), name: F.lit(None).cast("string")})
    m = dated(membership, "in_date", "out_date")
    source = lambda kind: f"industry_{kind}" if f"industry_{kind}" in m.columns else f"{level}_{kind}"
    m = m.select("ts_code", "in_date", "out_date", F.col(source("code")).alias(code), F.col(source("name")).alias(name))
    return interval_join(panel, m, ["ts_code"], "trade_date", "in_date", "out_date", [code, name])


def _status(panel: DataFrame, status: DataFrame | None, coverage: DataFrame | None) -> DataFrame:
    """is_st and is_delisting_period from the daily status list; a status is known on checked or listed dates."""
    if status is None:
        panel = panel.withColumns({"is_st": F.lit(False), "is_delisting_period": F.lit(False)})
    else:
        s = dated(status, "trade_date")
        said = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("name", "type") if c in s.columns), F.lit(""))
        s = s.groupBy("trade_date", "ts_code").agg(F.max(said.rlike(DELISTING)).alias("_delisting"))
        panel = panel.join(s, ["trade_date", "ts_code"], "left").withColumns({"is_st": F.col("_delisting").isNotNull(), "is_delisting_period": F.coalesce("_delisting", F.lit(False))})
    if coverage is None:
        return panel.withColumn("st_status_known", F.lit(False))
    checked = dated(coverage, "trade_date").select("trade_date").distinct().withColumn("_checked", F.lit(True))
    return panel.join(checked, "trade_date", "left").withColumn("st_status_known", F.coalesce("_checked", F.lit(False)))


def flags(panel: DataFrame, policy: FlagPolicy) -> DataFrame:
    old = (F.col("listing_trade_days") >= policy.listing_age) & F.col("adj_close").isNotNull() & ~F.col("is_suspended")
    clean = ~F.col("is_st") & ~F.col("is_delisting_period")
    panel = panel.withColumns({"is_factor_eligible": old & clean if policy.st_in_eligible else old, "is_tradeable": old & clean})
    if policy.liquid_by == "rank":
        rank = F.rank().over(frames.section().orderBy(F.col("amount_cny").desc_nulls_last()))
        return panel.withColumn("is_liquid", F.col("is_tradeable") & F.col("amount_cny").isNotNull() & (rank <= policy.liquid_top))
    frame = frames.history().rowsBetween(1 - policy.window, 0)
    traded = F.count("amount_cny").over(frame)
    mean = F.when(traded >= policy.window, F.avg("amount_cny").over(frame))
    return panel.withColumn("is_liquid", F.col("is_tradeable") & F.coalesce(mean >= policy.least_mean_amount, F.lit(False)) & (traded >= policy.least_traded))


def quality_issues(panel: DataFrame, industry: str = "industry_l1_code") -> DataFrame:
    """rule, severity, n for each rule that fails; one pass of sums and one count of repeated keys."""
    ohlc = [F.col(f"raw_{c}") for c in ("open", "high", "low", "close")]
    priced = F.lit(True)
    for c in ohlc:
        priced = priced & c.isNotNull()
    o, h, l, c = ohlc  # noqa: E741
    wrong = priced & ((F.least(*ohlc) <= 0) | (h < F.greatest(o, c, l)) | (l > F.least(o, c, h)))
    n = lambda cond: F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("long")), F.lit(0))
    eligible = F.coalesce("is_factor_eligible", F.lit(True)) if "is_factor_eligible" in panel.columns else F.lit(True)
    sums = panel.agg(
        F.count("*").alias("rows"), n(wrong).alias("ohlc"), n(priced & (F.col("adj_factor").isNull() | (F.col("adj_factor") <= 0))).alias("adj"), n((F.col("volume_shares") < 0) | (F.col("amount_cny") < 0)).alias("negative"),
        n(~F.coalesce("st_status_known", F.lit(False))).alias("unknown"), n(eligible).alias("eligible"), n(eligible & F.col(industry).isNotNull()).alias("with_industry"), F.count("total_mv_cny").alias("total_mv"), F.count("circ_mv_cny").alias("circ_mv"),
    )
    repeated = panel.groupBy("trade_date", "ts_code").count().filter("count > 1").agg(F.count("*").alias("repeated"))
    both = sums.crossJoin(repeated)  # one row each
    rules = [
        ("nonempty_dataset", "BLOCKING", (F.col("rows") == 0).cast("long")), ("unique_primary_key", "BLOCKING", F.col("repeated")), ("valid_ohlc", "BLOCKING", F.col("ohlc")),
        ("positive_adj_factor", "BLOCKING", F.col("adj")), ("nonnegative_volume_and_amount", "BLOCKING", F.col("negative")), ("point_in_time_st_status", "BLOCKING", F.col("unknown")),
        ("industry_history_coverage", "FEATURE_BLOCKING", (F.col("with_industry") < 0.95 * F.col("eligible")).cast("long")),
        ("daily_basic_coverage", "FEATURE_BLOCKING", (F.least("total_mv", "circ_mv") < 0.95 * F.col("rows")).cast("long")),
    ]
    return both.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), x.cast("long").alias("n")) for r, s, x in rules))).alias("i")).select("i.*").filter("n > 0")


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that does not depend on their order."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{int(r['s'] or 0) % (1 << 64):016x}"


def publish(df: DataFrame, root: str, note: str = "") -> str:
    """Writes an immutable version under ``root``, partitioned by year; its name holds the content's hash. Blocked by any BLOCKING issue."""
    spark, own = df.sparkSession, uuid.uuid4().hex
    dated_ = df.withColumn("year", F.year("trade_date"))
    staged = f"{root}/versions/_staged-{own}"  # made and written once; checks and hash read what was written
    dated_.sortWithinPartitions("year", "ts_code", "trade_date").write.partitionBy("year").parquet(staged)
    kept = spark.read.schema(dated_.schema).parquet(staged).select(*df.columns)
    blocking = [r["rule"] for r in quality_issues(kept).filter("severity = 'BLOCKING'").collect()]  # rules, not rows
    here = spark._jvm.org.apache.hadoop.fs.Path(staged)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if blocking:
        fs.delete(here, True)
        raise ValueError(f"not published: {', '.join(blocking)}")
    version = f"{content_hash(kept)}-{own[:8]}"
    span = kept.agg(F.count("*").alias("rows"), F.min("trade_date").alias("start"), F.max("trade_date").alias("end")).first()
    if not fs.rename(here, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{version}")):
        raise OSError(f"{staged} could not be renamed to {version}")
    manifest = {"version": version, "rows": span["rows"], "start": str(span["start"]), "end": str(span["end"]), "note": note}
    # The manifest is the commit: a version without one is never read.
    df.sparkSession.createDataFrame([(version, json.dumps(manifest))], "version string, manifest string").coalesce(1).write.mode("append").parquet(f"{root}/manifests")
    return version


def load(spark: SparkSession, root: str, version: str = "latest", start=None, end=None) -> DataFrame:
    """A published version; dates prune year folders and Parquet row groups."""
    if version == "latest":
        version = spark.read.parquet(f"{root}/manifests").select("version", F.get_json_object("manifest", "$.end").alias("e"), F.get_json_object("manifest", "$.rows").cast("long").alias("r")).orderBy(F.desc("e"), F.desc("r")).first()["version"]
    df = spark.read.parquet(f"{root}/versions/{version}")
    if start is not None:
        df = df.filter((F.col("year") >= F.year(F.lit(start).cast("date"))) & (F.col("trade_date") >= F.lit(start).cast("date")))
    if end is not None:
        df = df.filter((F.col("year") <= F.year(F.lit(end).cast("date"))) & (F.col("trade_date") <= F.lit(end).cast("date")))
    return df.drop("year")


def merge_increment(old: DataFrame, new: DataFrame, policy: FlagPolicy = SYNCED) -> DataFrame:
    """Old and new rows, new ones winning, fuller ones first; ages and flags made anew over the whole history."""
    from panelyard.operators.joins import keep_last

    full = sum((F.col(c).isNotNull().cast("int") for c in old.columns), F.lit(0))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    kept = keep_last(both, ["trade_date", "ts_code"], F.col("_new"), full).drop("_new")
    return flags(kept.withColumn("listing_trade_days", F.row_number().over(frames.history()).cast("long")), policy).select(*old.columns)
