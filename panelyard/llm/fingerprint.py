"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

A document is a bag of words.  For each of ``K`` samples and each word, two
gamma(2, 1) variables r and c and a uniform beta come from hashes of the word and
the sample's number; with weight w, t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta) - r.  The sample is the smallest a.  It is a function of
the word and t alone, so two documents agree in a sample exactly if they drew the
same word and t, which has the probability sum(min) / sum(max) of their weights:
the generalised Jaccard similarity.

``neighbours`` puts each document next to its successor by doc_id with one
shuffle of the texts: documents are dealt to ranges of ids, each range also gets
the first document of the next, and the successor is the next row in the range.
Ranges hold equal bytes (4 MB, or a 65,536th of all where that is more), whatever the
ids: their cuts come from a sort of the keys alone, and an id or a row that repeats
is cut like others, by the text's hash and the row's number.

With 32 samples a likeness has a standard error of up to 0.09 (0.5 / sqrt(32)).

Cases: null text is the empty text; without words the fingerprint is all zeros
(alike to another such); ids that repeat are ordered by their text's hash, null
ids come first; ids may be of any type that has an order; a single document is its own successor; other columns are not
read; a very long text is a range of its own, its words one array; an empty table
gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.llm.common import texts, written

K = 32
MOST_RANGES = 65536
_UNIT = 1 << 21


def terms(text: Column) -> Column:
    """The text's words, sorted."""
    return F.sort_array(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))


def weighted(words: str) -> Column:
    """(term, weight) of each distinct word of the column ``words``, which is sorted: its runs."""
    return F.transform("starts", lambda p, i: F.struct(F.xxhash64(F.get(words, p)).alias("term"), (F.coalesce(F.get("starts", i + 1), F.size(words)) - p).alias("weight")))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of one word in sample ``k``."""
    uniform = lambda bits, shift: (F.shiftrightunsigned(bits, shift).bitwiseAND(_UNIT - 1) + 0.5) / float(_UNIT)
    one, two = F.xxhash64(term, F.lit(k)), F.xxhash64(term, F.lit(k + 65536))
    r = -F.ln(uniform(one, 0) * uniform(one, 21))
    log_c = F.ln(-F.ln(uniform(one, 42) * uniform(two, 0)))
    beta = uniform(two, 21)
    return log_c - r * (F.floor(log_weight / r + beta) - beta) - r


def signatures(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fp`` (K times 4 hex digits) of each row; ``keys`` tell the rows apart."""
    words = rows.select(*keys, terms(F.col(text)).alias("words"))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    runs = words.withColumn("starts", F.when(F.size("words") > 0, starts).otherwise(F.array().cast("array<int>")))
    each = runs.select(*keys, F.explode_outer(weighted("words")).alias("x")).select(*keys, F.col("x.term").alias("term"), F.ln(F.col("x.weight").cast("double")).alias("lw"))
    drawn = each.groupBy(*keys).agg(*(F.min(sample(F.col("term"), F.col("lw"), k)).alias(f"a{k}") for k in range(K)))
    digits = [F.when(F.col(f"a{k}").isNull(), "0000").otherwise(F.substring(F.sha1(F.col(f"a{k}").cast("string").cast("binary")), 1, 4)) for k in range(K)]
    return drawn.select(*keys, F.lower(F.concat(*digits)).alias("fp"))


def likeness(one: str, other: str) -> Column:
    """Share of equal samples of two fingerprints."""
    at = lambda fp, k: F.substring(fp, 4 * k + 1, 4)
    return sum(((at(one, k) == at(other, k)).cast("int") for k in range(K)), F.lit(0)) / float(K)


def _cuts(rows: DataFrame, range_bytes: int) -> list:
    """First keys (doc_id, h, tie) of ranges of about ``range_bytes`` each, in order; at most about ``MOST_RANGES``.

    Only keys and sizes are sorted: Spark deals them to ranges of its own, and each of these is cut by its running size.
    """
    key = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("tie").asc()]
    light = rows.select("doc_id", "h", "tie", (F.octet_length("text") + 64).cast("long").alias("size")).repartitionByRange(*key).sortWithinPartitions(*key)
    light = written(light.withColumn("at", F.monotonically_increasing_id()), "neighbour-keys")
    total = light.agg(F.sum("size")).first()[0] or 0
    part = F.shiftright("at", 33)  # the partition in which the row was numbered
    before = F.coalesce(F.sum("size").over(Window.partitionBy(part).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = light.select("doc_id", "h", "tie", "at", part.alias("part"), F.floor(before / max(range_bytes, -(-total // MOST_RANGES))).alias("number"))
    firsts = ranges.groupBy("part", "number").agg(F.min(F.struct("at", "doc_id", "h", "tie")).alias("first"))
    return firsts.select("first.*").orderBy("at").drop("at").collect()  # MOST_RANGES, and one for each partition


def _range_of(cuts: list, id_kind: str) -> Column:
    """Number of the range of a row (doc_id, h, tie): the last cut that is not above it, by binary search in literals."""
    literal = lambda values, kind: F.from_json(F.lit(json.dumps([None if v is None else str(v) for v in values])), "array<string>").cast(f"array<{kind}>")
    ids, hs, ties = literal([c["doc_id"] for c in cuts], id_kind), literal([c["h"] for c in cuts], "long"), literal([c["tie"] for c in cuts], "long")
    no_id, own = sum(c["doc_id"] is None for c in cuts), F.col("doc_id")

    def reached(k: Column) -> Column:
        later = (F.col("h") > F.get(hs, k)) | (F.col("h") == F.get(hs, k)) & (F.col("tie") >= F.get(ties, k))
        above = own.isNotNull() & ((own > F.get(ids, k)) | (own == F.get(ids, k)) & later)
        return F.coalesce(F.when(k < no_id, own.isNotNull() | later).otherwise(above), F.lit(False))

    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length(), -1, -1)))
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((at + step <= len(cuts)) & reached(at + step - 1), step).otherwise(0))
    return F.greatest(below - 1, F.lit(0))


def neighbours(docs: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """range, rn, extra, doc_id, text, next_text: rows with ``extra`` are first documents of the next range, there to be a successor."""
    spark = docs.sparkSession
    base = texts(docs, "doc_id").withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    cuts = _cuts(base, range_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = spark.createDataFrame([(k - 1 if k else len(cuts) - 1, c["doc_id"], c["h"]) for k, c in enumerate(cuts)], f"to int, head_id {kind}, head_h long")
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    wanted = F.broadcast(heads.select("head_id", "head_h").distinct())  # no more rows than cuts
    firsts = base.join(wanted, same).groupBy("doc_id", "h").agg(F.first("text").alias("text"))  # equal texts
    taken = firsts.join(F.broadcast(heads), same).select("doc_id", "text", "h", F.col("to").alias("range"), F.lit(True).alias("extra"))
    both = base.select("doc_id", "text", "h", _range_of(cuts, kind).alias("range"), F.lit(False).alias("extra")).unionByName(taken)
    w = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "h")
    return both.select("range", F.row_number().over(w).alias("rn"), "extra", "doc_id", "text", F.coalesce(F.lead("text").over(w), F.lit("")).alias("next_text"))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = neighbours(docs).withColumn("edited", edited)
    rows = rows.select("range", "rn", "extra", "doc_id", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("x"))
    keys = ["range", "rn", "extra", "doc_id", "n_chars", "sha"]
    signed = signatures(rows.select(*keys, F.col("x.which").alias("which"), F.col("x.body").alias("body")), [*keys, "which"], "body")
    pair = signed.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fingerprint"))
    follows = pair.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("rn"))).filter("not extra")
    return follows.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
