"""Panels from the driver's tables: a weekly bar of each supplier stands for a security's daily bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (trade_date, ts_code): prices are amounts over quantities of a supplier's week."""
    cents = lambda c: F.col(c).cast("decimal(18,2)")  # noqa: E731  sums of decimals are the same in any order
    price = F.col("l_extendedprice") / F.col("l_quantity")
    bars = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"), F.col("l_suppkey").alias("ts_code"))
        .agg(F.max(price).alias("adj_high"), F.min(price).alias("adj_low"), F.sum(cents("l_extendedprice")).cast("double").alias("amount_cny"), F.sum(cents("l_quantity")).cast("double").alias("volume_shares"))
    )
    firms = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    firms = firms.select(F.col("s_suppkey").alias("ts_code"), F.col("n_regionkey").cast("string").alias("industry_l1_code"), F.col("n_nationkey").cast("string").alias("industry_l2_code"), ((F.abs("s_acctbal") + 1) * 1000).alias("total_mv_cny"))
    panel = bars.join(firms, "ts_code")
    return panel.select(
        "trade_date", "ts_code", ((F.col("adj_high") + F.col("adj_low")) / 2).alias("adj_open"), "adj_high", "adj_low",
        (F.col("amount_cny") / F.col("volume_shares")).alias("adj_close"), "volume_shares", "amount_cny", "total_mv_cny",
        F.ln("total_mv_cny").alias("log_total_mv"), (F.col("volume_shares") / 1000).alias("turnover_rate"), "industry_l1_code", "industry_l2_code",
        (F.col("amount_cny") >= 50000).alias("is_liquid"), (F.col("volume_shares") >= 20).alias("is_tradeable"), (F.col("volume_shares") >= 10).alias("is_factor_eligible"),
    )


#: The same panel in DuckDB SQL, as common table expressions that end in ``panel``.
PANEL_SQL = """
WITH line AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date, l_suppkey AS ts_code, l_extendedprice / l_quantity AS px,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l_quantity AS DECIMAL(18,2)) AS qty FROM lineitem),
bar AS (SELECT trade_date, ts_code, max(px) AS adj_high, min(px) AS adj_low, CAST(sum(ext) AS DOUBLE) AS amount_cny, CAST(sum(qty) AS DOUBLE) AS volume_shares FROM line GROUP BY ALL),
firm AS (SELECT s_suppkey AS ts_code, CAST(n_regionkey AS VARCHAR) AS industry_l1_code, CAST(n_nationkey AS VARCHAR) AS industry_l2_code, (abs(s_acctbal) + 1) * 1000 AS total_mv_cny
         FROM supplier JOIN nation ON s_nationkey = n_nationkey),
panel AS (SELECT trade_date, ts_code, (adj_high + adj_low) / 2 AS adj_open, adj_high, adj_low, amount_cny / volume_shares AS adj_close, volume_shares, amount_cny, total_mv_cny,
                 ln(total_mv_cny) AS log_total_mv, volume_shares / 1000 AS turnover_rate, industry_l1_code, industry_l2_code,
                 amount_cny >= 50000 AS is_liquid, volume_shares >= 20 AS is_tradeable, volume_shares >= 10 AS is_factor_eligible
          FROM bar JOIN firm USING (ts_code))"""
