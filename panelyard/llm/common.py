"""What the training-data operators share: the cluster's shared folder, written tables, input columns."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="panelyard-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _own_folder()).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/panelyard/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``text`` with null read as empty; no other column of ``docs`` comes along."""
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for inner columns beside those of ``df``: ``names``, lengthened where ``df`` has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_row_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id (null last) of each group ``root`` of ``found``.

    ``found`` has doc_id, h (xxhash64 of the text, null as empty), rows and root for
    each distinct id and text; rows that share both count as one.
    """
    own, one, h, rows, row = fresh(docs, "own", "one", "h", "rows", "row")
    firsts = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "rows")).alias("w"))
    firsts = firsts.select(F.col("w.doc_id").alias(one), F.col("w.h").alias(h), F.col("w.rows").alias(rows))
    kept = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).join(firsts, F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(own) == F.col(h)))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = kept.filter(F.col(rows) > 1).groupBy(one, h).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*")
    return kept.filter(F.col(rows) == 1).select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(repeated)
