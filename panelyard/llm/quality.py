"""Quality classifier: supervised subword embeddings, averaged per document, softmax output, numpy SGD.

Words, adjacent word pairs and character 3- to 5-grams (with word boundaries)
are hashed into ``2**bits`` learned vectors.  A document is the mean of its
vectors; a softmax over two classes reads it.  Training runs on the driver over
a bounded sample (``max_rows`` labelled documents, smallest hashes of doc_id first):
Spark turns their whole texts, of any length, into bags of at most ``2**bits`` buckets
and counts, and only the bags come to the driver.  Scoring is one pass over whole
texts, where the model is folded into one number per hash bucket.

Cases: null text is the empty text and gets the score of the bias alone; labels
that repeat are averaged, null ones and those of absent documents ignored;
without both classes in the sample every score is the sample's share of class 1
(0.5 for no labels); repeated rows get equal scores; a very long text takes memory
in proportion to itself; other columns are not read (``keep_good`` returns them);
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import fresh, texts

#: Odd multipliers of the polynomial hashes.
_P, _Q, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # one number per hash bucket: the vector's share of the logit of class 1
    bias: float
    bits: int


def grams(text: str, bits: int) -> np.ndarray:
    """Hash buckets of all words, word pairs and character n-grams of the whole text, repeats included."""
    raw = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    space = (raw == 32) | ((raw >= 9) & (raw <= 13)) | (raw == 0xA0)
    keep = ~space | np.r_[True, ~space[:-1]]
    space = space[keep]
    c = np.where(space, np.uint64(32), raw[keep].astype(np.uint64))
    if len(c) < 3:
        return np.zeros(0, np.int64)
    found, blanks = [], np.cumsum(space)
    h = c
    for n in range(2, 6):
        if len(c) < n:
            break
        h = h[:-1] * _P + c[n - 1 :]
        if n >= 3:
            inside = blanks[n - 2 : len(c) - 1] == blanks[: len(c) - n + 1]
            found.append((h[inside] + np.uint64(n)) * _MIX)
    ends = np.flatnonzero(space)
    starts, sizes = ends[:-1] + 1, np.diff(ends) - 1
    power = np.cumprod(np.full(sizes.max(), _P, np.uint64))
    at = np.arange(len(c) - 2) - np.repeat(ends[:-1], sizes + 1)[: len(c) - 2]
    inner = np.where(space[1:-1], np.uint64(0), c[1:-1] * power[np.minimum(at, sizes.max() - 1)])
    word = np.add.reduceat(inner, starts - 1) * _Q
    pair = np.where(word[1:] == word[:-1], _Q, word[:-1] * _P + word[1:])  # a word said twice is one sign, whatever the word
    found += [word * _MIX, (pair + np.uint64(1)) * _MIX]
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and how often each stands in it."""
    ids, n = np.unique(grams(text, bits), return_counts=True)
    return ids.astype(np.int32), n.astype(np.int32)


def packed(ids: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """A bag as few bytes: steps from bucket to bucket, and counts, compressed."""
    return zlib.compress(np.diff(ids, prepend=np.int32(0)).tobytes(), 1), zlib.compress(n.tobytes(), 1)


def unpacked(ids: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(zlib.decompress(n), np.int32)
    return np.cumsum(np.frombuffer(zlib.decompress(ids), np.int32), dtype=np.int32), n.astype(np.min_scalar_type(n.max(initial=0)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = 17, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Numpy SGD over ``bag``s, one document a step; the step is normalised by the document's squared weights."""
    labels = np.asarray(labels, int)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(2**bits, np.float32), float(np.log(share / (1 - share))), bits)
    rng = np.random.default_rng(seed)
    vector = rng.normal(0, 0.1, (2**bits, dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, n = bags[i]
            w = (n / max(n.sum(), 1)).astype(np.float32)
            lr = rate * (1 - steps / total)
            steps += 1
            hidden = w @ vector[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(ids):
                vector[ids] -= lr * (w / (w @ w))[:, None] * (out @ p)[None, :]
            out -= 0.1 * lr * np.outer(hidden, p)
            bias -= 0.02 * lr * p
    return Model(vector @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]), bits)


def score_of(model: Model, text: str) -> float:
    ids = grams(text, model.bits)
    z = model.bias + (float(model.weight[ids].mean(dtype=np.float64)) if len(ids) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> DataFrame:
    """quality, text of the ``max_rows`` labelled documents outside the held-out fold of the smallest hashes of doc_id.

    Texts count whole; of rows that share an id the text of the smallest hash counts.
    """
    marked = (
        labels.filter("doc_id is not null and quality is not null")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    )
    ids = docs.select("doc_id").join(marked, "doc_id").distinct().select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts(docs, "doc_id").join(F.broadcast(ids), "doc_id")  # at most max_rows rows
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "quality", "text")).alias("r")).select("r.quality", "r.text", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("quality", "text")


def held_out(doc_id):
    """The fifth of the ids from which no label is learnt; a null id is in it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, bits: int = 17, **params) -> Model:
    @F.pandas_udf("ids binary, counts binary")
    def bags(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([packed(*bag(t, bits)) for t in text], columns=["ids", "counts"])

    rows = labelled_sample(docs, labels, max_rows).select("quality", bags("text").alias("b")).select("quality", "b.*").toArrow()  # at most max_rows bags of 2**bits
    return fit([unpacked(i.as_py(), n.as_py()) for i, n in zip(rows["ids"], rows["counts"])], np.array(rows["quality"].to_pylist(), int), bits, **params)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as ``column`` (the model is ``2**bits`` floats: a fixed size)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for text in batches:
            yield pd.Series([score_of(own, t) for t in text], dtype="float64")

    return docs.withColumn(column, scored(F.coalesce(F.col("text"), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **params))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    (own,) = fresh(docs, "own_score")
    scored = score(docs, train(docs, labels, **params), own)
    return scored.filter(F.col(own) >= threshold).drop(own)
