"""Versions, tables by suffix, kept results and observations over the driver's tables: written to the shared folder and read again, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import joins
from panelyard.plans.panel_queries import RETURNS_SQL, r6, returns
from panelyard.plans.study_queries import said
from panelyard.sources import files, panel
from panelyard.sources.market import PANEL_SQL, table, weekly_panel

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query and its SQL under its function's name."""

    def register(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return register


def _publishable(spark, sf_dir):
    """The weekly panel with the columns that a version is checked by."""
    p = weekly_panel(spark, sf_dir)
    raw = {f"raw_{c}": F.col(f"adj_{c}") for c in ("open", "high", "low", "close")}
    return p.withColumns(raw | {"adj_factor": F.lit(1.0), "st_status_known": F.lit(True), "circ_mv_cny": F.col("total_mv_cny") / 2})


@query(f"{PANEL_SQL} SELECT trade_date, ts_code, {r6('adj_close')} AS adj_close, {r6('total_mv_cny / 2')} AS circ_mv_cny, is_liquid FROM panel WHERE trade_date BETWEEN DATE '1996-06-01' AND DATE '1998-03-31'")
def source_panel_version(spark, sf_dir):
    root = files.shared_folder(spark, "versions")
    panel.publish(_publishable(spark, sf_dir), root)
    return said(panel.load(spark, root, start="1996-06-01", end="1998-03-31").select("trade_date", "ts_code", "adj_close", "circ_mv_cny", "is_liquid"), "adj_close", "circ_mv_cny")


@query(f"""{PANEL_SQL}, v AS (SELECT 'old' AS note, count(*) AS rows, min(trade_date) AS s, max(trade_date) AS e FROM panel WHERE trade_date < DATE '1999-01-01' UNION ALL SELECT 'whole', count(*), min(trade_date), max(trade_date) FROM panel)
SELECT note, rows, CAST(s AS VARCHAR) AS first_date, CAST(e AS VARCHAR) AS last_date, rows > 1000 AND s <= DATE '1995-06-01' AS complete FROM v""")
def source_manifests(spark, sf_dir):
    root, p = files.shared_folder(spark, "versions"), _publishable(spark, sf_dir)
    noted = [files.manifest(spark, root, panel.publish(df, root, note)) for note, df in (("old", p.filter("trade_date < '1999-01-01'")), ("whole", p))]
    return spark.createDataFrame([(m["note"], m["rows"], m["start"], m["end"], files.is_complete(m, 1000, "1995-06-01")) for m in noted], "note string, rows long, first_date string, last_date string, complete boolean")  # two versions


_KINDS = ("csv", "tsv", "txt", "json", "orc", "parquet")


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT kind, o_orderpriority, count(*) AS rows, count(DISTINCT o_custkey) AS customers, {r6('sum(CAST(o_totalprice AS DECIMAL(18,2)))')} AS total, min(day) AS first_day FROM o, (SELECT unnest({list(_KINDS)!r}) AS kind) GROUP BY ALL""")
def source_tables(spark, sf_dir):
    """One table in every format, read again by its suffix."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    root, out = files.shared_folder(spark, "tables"), None
    for kind in _KINDS:
        files.write_table(o, f"{root}/orders.{kind}")
        back = files.read_table(spark, f"{root}/orders.{kind}", "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double, day date" if kind in ("csv", "tsv", "txt", "json") else None)
        back = back.select(F.lit(kind).alias("kind"), *o.columns)
        out = back if out is None else out.unionByName(back)
    made = out.groupBy("kind", "o_orderpriority").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.min("day").alias("first_day"))
    return said(made, "total")


@query(f"{RETURNS_SQL} SELECT trade_date, ts_code, {r6('step')} AS step, true AS kept FROM ret WHERE step IS NOT NULL")
def source_kept_result(spark, sf_dir):
    """The second call reads what the first has written."""
    root, calls = files.shared_folder(spark, "kept"), []

    def build():
        calls.append(1)
        return returns(spark, sf_dir).filter("step is not null").select("trade_date", "ts_code", "step")

    identity = {"formula": "ret(close, 1)", "data": sf_dir}
    files.cached(spark, root, identity, build)
    again = files.cached(spark, root, identity, build)
    return said(again.withColumn("kept", F.lit(len(calls) == 1)), "step")


@query(f"{RETURNS_SQL}, e AS (SELECT trade_date, ts_code, step FROM ret WHERE step > 0.5) SELECT trade_date, ts_code, {r6('step')} AS step, (SELECT count(*) FROM e) AS noted FROM e")
def source_observation(spark, sf_dir):
    events = returns(spark, sf_dir).filter("step > 0.5").select("trade_date", "ts_code", "step")
    folder = files.write_observation(spark, files.shared_folder(spark, "observations"), {"kind": "jump"}, events)
    noted = F.split(F.get_json_object("value", "$.events"), "-")[0].cast("long")
    card = spark.read.text(f"{folder}/card.json").select(noted.alias("noted"))
    return said(spark.read.parquet(f"{folder}/events.parquet").crossJoin(F.broadcast(card)), "step")  # one card


@query(f"""{PANEL_SQL}, a AS (SELECT trade_date, ts_code, adj_close, 0 AS root FROM panel WHERE trade_date < DATE '1999-06-01'), b AS (SELECT trade_date, ts_code, adj_close * 2, 1 FROM panel WHERE trade_date >= DATE '1999-01-01' AND is_liquid), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT trade_date, ts_code, {r6('adj_close')} AS adj_close, root FROM u QUALIFY row_number() OVER (PARTITION BY trade_date, ts_code ORDER BY root DESC) = 1""")
def source_roots(spark, sf_dir):
    """Two roots of one dataset: rows of the later root win."""
    p, folder = weekly_panel(spark, sf_dir).select("trade_date", "ts_code", "adj_close", "is_liquid"), files.shared_folder(spark, "roots")
    for root, df in enumerate((p.filter("trade_date < '1999-06-01'"), p.filter("trade_date >= '1999-01-01' and is_liquid").withColumn("adj_close", F.col("adj_close") * 2))):
        df.select("trade_date", "ts_code", "adj_close").write.parquet(f"{folder}/raw/v{root}/vendor/bars.parquet")
    parts = [files.raw_dataset(spark, folder, f"v{root}", "vendor", "bars").withColumn("root", F.lit(root)) for root in range(2)]
    none = files.raw_dataset(spark, folder, "v9", "vendor", "bars")
    return said(joins.keep_last(parts[0].unionByName(parts[1]) if none is None else none, ["trade_date", "ts_code"], F.col("root")), "adj_close")
