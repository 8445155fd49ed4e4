"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``max_bits`` = 4 bits agree in at
least 8 - 4 = 4 of their 8 bytes.  The index has two levels.  Spark posts each
*distinct* fingerprint under 20 (byte positions, byte values) keys of three
positions, chosen so that any 4 agreeing positions contain one (a Turan system);
within such a list every fingerprint is posted again under each other position and
its byte.  A pair's shared positional bytes are tallied from these postings: three
of the key and one for each inner list that holds both.  Only pairs that an inner
list brings together are ever formed; those that reach the guaranteed minimum are
verified by their differing bits.  No pair leaves a task: a task returns stars of
the links it found.  Lists longer than ``block`` are dealt out as pairs of bounded
blocks, so no task holds a whole hot list; exact copies meet before the index, as
one fingerprint, and come back to their rows in bounded parts.

Cases: null text is the empty text; no words give fingerprint 0, which links
like any other; repeated rows and ids each come back; a component of null ids
only has a null component_id; other columns are not read (``keep_one`` returns
them); a text of any length takes memory in proportion to itself; ``components``
raises if a chain of links is so long that 60 rounds (2^30 links and more) don't
settle it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import one_row_each, texts, written

BYTES = 8
#: Rows of a fingerprint that stay together: HOT_ROWS, or a HOT-th of all where that is more.
HOT, HOT_ROWS = 10_000, 512


def fingerprint_of(text: str | None, words_per_shingle: int = 4) -> int:
    """SimHash of one text: majority bits of the XXH64 (seed 42) of its word shingles, as a signed 64-bit int."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(words_per_shingle))) if len(words) >= words_per_shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), 42) for run in runs), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, *also: Column) -> DataFrame:
    """doc_id, fp (signed long) and ``also`` for each row of ``docs``."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words_per_shingle) for t in text], dtype="int64")

    return texts(docs, "doc_id").select("doc_id", fp("text").alias("fp"), *also)


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions such that any 4 positions contain one of them."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(triple):
        g = sorted(group[p] for p in triple)
        return g[0] == g[2] or (g in ([0, 0, 1], [1, 1, 2], [0, 2, 2]))

    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


def tallied(fps: np.ndarray, cell: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of one cell that share a byte beside the ``known`` ones of their list's key, and how many bytes they share.

    Each fingerprint is posted again inside its cell under every other position and
    its byte there; a pair's count is that of the key and one for each posting list
    in which both stand.  known: of each row a bitmap of its key's positions.
    """
    n, found = np.int64(len(fps)), []
    values = fps.view(np.uint8).reshape(-1, BYTES)  # little endian: position p is bits 8 p and on
    for p in range(BYTES):
        rows = np.flatnonzero(known >> p & 1 == 0)
        list_of = cell[rows] * np.int64(256) + values[rows, p]
        order = np.argsort(list_of, kind="stable")
        rows, list_of = rows[order], list_of[order]
        for step in range(1, len(rows)):
            same = np.flatnonzero(list_of[step:] == list_of[:-step])
            if not len(same):
                break  # a list's rows are neighbours: none is this long
            a, b = rows[same], rows[same + step]
            found.append(np.minimum(a, b) * n + np.maximum(a, b))
    pairs, count = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
    i, j = pairs // n, pairs % n
    return i, j, count + np.bitwise_count(known[i])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row linked to each of ``n`` rows, directly or through others."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, max_bits: int = 4, block: int = 1024) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` whose components are those of all links; a task's edges are stars.

    Raises for ``max_bits`` above 4: the keys meet every pair with four equal bytes, and such pairs may have fewer.
    """
    if max_bits > BYTES - 4:
        raise ValueError(f"the index guarantees pairs of {BYTES - 4} differing bits at most")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    triples = position_triples()
    keys = [F.lit(k << 24).cast("long") + byte(a) * 65536 + byte(b) * 256 + byte(c) for k, (a, b, c) in enumerate(triples)]
    posted = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = (
        posted.join(lists, "key")
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )
    positions = np.array([sum(1 << p for p in t) for t in triples], np.int64)

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            cell = rows[["key", "lo", "hi"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
            kept = rows.iloc[starts[-1] :]  # the last cell may go on in the next batch
            yield from cells(rows, starts)
        if kept is not None:
            yield from cells(kept, np.array([0, len(kept)]))

    def cells(rows: pd.DataFrame, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
        fps, key, sizes = rows["fp"].to_numpy(np.int64), rows["key"].to_numpy(np.int64), np.diff(bounds)
        part = np.cumsum(sizes.astype(np.float64) ** 2) // (2 * block) ** 2  # cells of bounded pairs at once
        for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
            if not len(own):
                continue
            rows_of = slice(bounds[own[0]], bounds[own[-1] + 1])
            some = np.ascontiguousarray(fps[rows_of])
            i, j, count = tallied(some, np.repeat(own, sizes[own]), positions[key[rows_of] >> 24])
            near = np.flatnonzero(count >= BYTES - max_bits)  # the guaranteed minimum
            ok = near[np.bitwise_count((some[i[near]] ^ some[j[near]]).view(np.uint64)) <= max_bits]
            label = forest(len(some), i[ok], j[ok])
            joined = np.flatnonzero(label != np.arange(len(some)))
            yield pd.DataFrame({"u": some[label[joined]], "v": some[joined]})

    return dealt.mapInPandas(forests, "u long, v long").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, root (smallest reachable node) of an undirected graph (u, v): alternating large and small stars.

    Each round is a few joins and aggregates on edges only and is written to the
    shared folder; rounds grow with the logarithm of the longest chain.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(limit):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {limit} rounds")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id linked, directly or through others) for each row of ``docs``."""
    fps = written(fingerprints(docs, words_per_shingle, F.monotonically_increasing_id().alias("row")), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-distinct")
    roots = components(links(distinct, max_bits))
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    # Components of two fingerprints and more have a name of their own; written, so that the join sees their size.
    names = written(grouped.groupBy("root").agg(F.min("least").alias("name"), F.count("*").alias("n")).filter("n > 1").select("root", "name"), "simhash-names")
    named = grouped.join(names, "root", "left").select("fp", "rows", F.coalesce("name", "least").alias("component_id"))
    # Fingerprints of many rows are dealt out in parts; fewer than HOT have more than a HOT-th of the rows, so they can be broadcast.
    most = max(HOT_ROWS, -(-(distinct.agg(F.sum("rows")).first()[0] or 0) // HOT))
    parts = F.ceil(F.col("rows") / most).cast("int")
    hot = distinct.filter(F.col("rows") > most).select("fp", parts.alias("parts"))
    salted = fps.join(F.broadcast(hot), "fp", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int"))
    spread = named.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(spread, ["fp", "part"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words_per_shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id.

    Rows that repeat an id and its text count as one; a row with a null doc_id
    stays only if no row of its component has an id.
    """
    fps = written(fingerprints(docs.select("doc_id", "text"), words_per_shingle, F.xxhash64("text").alias("h")), "simhash")
    roots = components(links(fps.select("fp").distinct(), max_bits))
    ids = fps.groupBy("doc_id", "h", "fp").agg(F.count("*").alias("rows"))
    return one_row_each(docs, ids.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "h", F.coalesce("root", "fp").alias("root"), "rows"))
