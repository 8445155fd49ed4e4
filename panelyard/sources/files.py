"""Tables by the suffix of their path, and results kept under the hash of what made them."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Mapping
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {"parquet": ("parquet", {}), "csv": ("csv", {"sep": ","}), "txt": ("csv", {"sep": ","}), "tsv": ("csv", {"sep": "\t"}), "json": ("json", {}), "orc": ("orc", {})}


class DamagedEntry(RuntimeError):
    pass


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="panelyard-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``; one of our own only where Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or _own_folder()).rstrip('/')}/panelyard/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as read back from a new shared folder, for what reads it several times and must not make it anew."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its suffix; delimited text has a header, and its types come from ``schema`` or one pass over the data."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in READERS:
        raise ValueError(f"{path}: not one of {', '.join(sorted(READERS))}")
    kind, options = READERS[suffix]
    reader = spark.read.format(kind).options(**options)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str) -> None:
    """A table in the format of its suffix, as a folder of parts; nothing that exists is overwritten."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"{path}: not one of {', '.join(sorted(READERS))}")
    kind, options = READERS[suffix]
    df.write.format(kind).options(**options, **({"header": True} if kind == "csv" else {})).mode("errorifexists").save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def raw_dataset(spark: SparkSession, root: str, version: str, source: str, name: str) -> DataFrame | None:
    """A vendor table of a version as it came (``<root>/raw/<version>/<source>/<name>.parquet``), or none if it was never fetched."""
    path = f"{root.rstrip('/')}/raw/{version}/{source}/{name}.parquet"
    return spark.read.parquet(path) if _exists(spark, path) else None


def manifest(spark: SparkSession, root: str, version: str) -> dict | None:
    """What was noted when a version was published, or none."""
    path = f"{root.rstrip('/')}/manifests"
    if not _exists(spark, path):
        return None
    found = spark.read.parquet(path).filter(F.col("version") == version).select("manifest").first()
    return json.loads(found["manifest"]) if found else None


def is_complete(noted: Mapping[str, object], rows: int = 1_000_000, since: str = "2017-01-01") -> bool:
    """Whether a version holds the whole history: it says so, or is as long and as old as a whole one."""
    if noted.get("version_kind") is not None:
        return noted["version_kind"] == "complete"
    return int(noted.get("rows") or 0) > rows and str(noted.get("start") or "9999") <= since


def write_observation(spark: SparkSession, root: str, card: Mapping[str, object], events: DataFrame) -> str:
    """Writes an observation once: its events, and a card that names their hash and number. The folder's name is the card's hash.

    The card is written last, so a folder without one is no observation; one that has been written is never written again.
    """
    from panelyard.sources.panel import content_hash

    said = dict(card) | {"events": content_hash(events)}
    folder = f"{root.rstrip('/')}/observations/{cache_key(said)}"
    if _exists(spark, f"{folder}/card.json/_SUCCESS"):
        raise FileExistsError(folder)
    events.write.mode("overwrite").parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(json.dumps(said, sort_keys=True, default=str),)], "card string").coalesce(1).write.mode("overwrite").text(f"{folder}/card.json")
    return folder


def cache_key(identity: Mapping[str, object]) -> str:
    """Hash of everything that a result depends on: its declaration, version of the data, dates, universe, engine."""
    return hashlib.sha256(json.dumps(dict(identity), sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, identity: Mapping[str, object], build: Callable[[], DataFrame], keys: tuple[str, ...] = ("trade_date", "ts_code")) -> DataFrame:
    """The result of ``build``, read from ``root`` if it was written for the same identity, else made, checked and written.

    An entry counts once its write has committed (``_SUCCESS``); a half-written one is an error, as is one that repeats a key.
    """
    path = f"{root.rstrip('/')}/{cache_key(identity)}.parquet"
    if _exists(spark, path):
        if not _exists(spark, f"{path}/_SUCCESS"):
            raise DamagedEntry(f"{path} was not finished; remove it and run again")
        return spark.read.parquet(path)
    made = build()
    if missing := set(keys) - set(made.columns):
        raise ValueError(f"the result lacks {', '.join(sorted(missing))}")
    made.write.parquet(path)
    kept = spark.read.parquet(path)
    if kept.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        raise ValueError(f"the result repeats {', '.join(keys)}")
    return kept
