"""Importance resampling towards a target distribution, by hashed word runs and Gumbel top-k.

Features are the runs of one to ``RUNS`` consecutive words, hashed to ``BUCKETS``
buckets.  The first pass counts them: each task sums ``np.bincount`` vectors over its
Arrow batches and gives one vector, ``treeReduce`` merges the vectors.  A bucket's gain
is the log ratio of its smoothed shares in the target and in the corpus.  The second
pass gathers the broadcast gains (``BUCKETS`` numbers, whatever the input) of a batch's
features and sums them by document with a weighted ``np.bincount``.

A document's score is the floored mean of its gains and Gumbel noise from its id, so
the highest scores are a sample without replacement.  Ranks come from a range sort of
ids and scores alone: each task numbers its range, and the ranges' sizes (one number a
task) are added up.

Cases: null text is the empty text, without features and with weight 0; a null id is
the empty id and stands last among ties; rows that repeat an id share its noise and
are drawn each, in the order of n_features and weight; without target every bucket is
as rare as in an empty one; a very long text is hashed in chunks; other columns are
not read (``drawn`` returns them); an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import fresh, written

BUCKETS, RUNS, SCALE = 10_000, 2, 1000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CHUNK = 1 << 16


def features(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and buckets of the features of each chunk of a text in UTF-8."""
    words: list[bytes] = []

    def hashed(known: int) -> np.ndarray:
        """Buckets of the runs that end after the first ``known`` words."""
        crcs, found = [zlib.crc32(w) for w in words], []
        for n in range(1, RUNS + 1):
            if n > 1:
                crcs = [zlib.crc32(b" " + w, c) for w, c in zip(words[n - 1 :], crcs)]
            found += crcs[max(0, known - n + 1) :]
        return np.array(found, np.int64) % BUCKETS

    known = 0
    for m in _WORD.finditer((text or b"").translate(_LOWER)):
        words.append(m[0])
        if len(words) - known >= _CHUNK:
            yield len(words) - known, hashed(known)
            words = words[len(words) - RUNS + 1 :]
            known = len(words)
    if len(words) > known:
        yield len(words) - known, hashed(known)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, ids in features(text.as_py()):
                    total += np.bincount(ids, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["vector"])

    vectors = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(tally, "vector binary").rdd.map(lambda row: np.frombuffer(row.vector, np.int64))
    none = docs.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1)
    return vectors.union(none).treeReduce(np.add, depth=3)


def gains_of(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Gain of each bucket, in thousandths, floored."""
    t, s = target.astype(np.float64), corpus.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, names: tuple[str, str, str] = ("n_words", "n_features", "weight"), text: str = "text") -> DataFrame:
    """``docs`` with the number of words and features and the floored mean gain of each text as long columns ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains.astype(np.float64))
    at = docs.columns.index(text)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n = batch.num_rows
            words, sizes, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            rows, buckets, waiting = [], [], 0

            def flush() -> None:
                nonlocal sums, waiting
                if rows:
                    owner = np.repeat(np.array(rows), [len(b) for b in buckets])
                    sums += np.bincount(owner, weights=gain[np.concatenate(buckets)], minlength=n)
                    rows.clear()
                    buckets.clear()
                    waiting = 0

            for i, body in enumerate(batch.column(at).cast(pa.binary())):
                for count, ids in features(body.as_py()):
                    words[i] += count
                    sizes[i] += len(ids)
                    rows.append(i)
                    buckets.append(ids)
                    waiting += len(ids)
                    if waiting > 16 * _CHUNK:
                        flush()
            flush()
            weight = np.where(sizes > 0, sums.astype(np.int64) // np.maximum(sizes, 1), 0)  # whole numbers: sums are exact
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words), pa.array(sizes), pa.array(weight)], [*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(gather, kinds + "".join(f", `{n}` long" for n in names))


def noise(doc_id: Column, seed: int = 7) -> Column:
    """Gumbel noise of an id, in thousandths, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-float(SCALE) * F.ln(-F.ln((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, by: list[Column], least: str, percent: int) -> DataFrame:
    """Rows of which ``least`` holds, and their ``rank`` in the order ``by`` (null beyond ``percent`` of them)."""
    some = written(rows.filter(least).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "resample-sorted")
    part = F.shiftright("at", 33)  # the task that numbered the row
    before, total = [], 0
    for p, n in some.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a task
        before.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))
    rank = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before") + 1
    return some.withColumn("part", part).join(offsets, "part").select(*rows.columns, F.when(rank <= percent * total // 100, rank).alias("rank"))


def _ranks(scored: DataFrame, percent: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Eligible rows with their rank, and the others."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    thin = scored.select("doc_id", "n_words", "n_features", "weight", "score", "row")
    return ranked(thin, by, f"n_words >= {least_words}", percent), thin.filter(f"n_words < {least_words}").withColumn("rank", F.lit(None).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of ``docs``; rank is null for what is not drawn.

    Of the documents of ``least_words`` words or more, ``percent`` in a hundred are drawn.
    """
    gains = gains_of(bucket_counts(target), bucket_counts(docs))
    scored = weighed(docs.select("doc_id", "text"), gains).drop("text")
    scored = written(scored.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()}), "resample-scores")
    drawn_from, others = _ranks(scored, percent, least_words)
    return drawn_from.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns."""
    row, n_words, n_features, weight = fresh(docs, "row", "n_words", "n_features", "weight")
    gains = gains_of(bucket_counts(target), bucket_counts(docs))
    whole = written(weighed(docs, gains, (n_words, n_features, weight)).withColumn(row, F.monotonically_increasing_id()), "resample-rows")
    scored = whole.select("doc_id", F.col(n_words).alias("n_words"), F.col(n_features).alias("n_features"), F.col(weight).alias("weight"), F.col(row).alias("row"))
    chosen, _ = _ranks(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), percent, least_words)
    return whole.join(chosen.filter("rank is not null").select(F.col("row").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
