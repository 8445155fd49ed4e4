"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

A bin holds at most ``capacity`` characters, at most one document of a source and
at most one of a duplicate cluster.  Open bins stand in the order of their
residual room; each carries a bitmap of its sources and one of its clusters.  A
piece, longest first, goes to the tightest compatible bin: the search starts at
the first bin with room enough and goes on to its successors, without a limit,
until one has neither the piece's source bit nor its cluster bit.  A document
longer than ``capacity`` is cut into pieces of ``capacity`` characters and a rest.

The pieces are dealt by hash into groups of about ``group_pieces`` pieces, one
group a time is packed in a task; the number of groups grows with the input, so
a hot source or cluster is spread over all of them and no task holds more.

Cases: null and empty texts are pieces of length 0; a null source conflicts with
nothing; without ``cluster`` the cluster is the text itself, white space and case
aside, so near copies may share a bin; pieces of one length stand by doc_id, then
piece; repeated rows are packed each; other columns are not read; a very long text
is so many pieces, dealt like any others; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = 512


def _bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Word and mask of each code (-1: none) in a bitmap, and the bitmap's number of words."""
    words = max(1, int(codes.max(initial=-1)) // 64 + 1)
    mask = np.where(codes >= 0, np.uint64(1) << (np.maximum(codes, 0) % 64).astype(np.uint64), np.uint64(0))
    return np.maximum(codes, 0) // 64, mask, words


def pack(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each piece; sources and clusters are codes from 0, -1 for none."""
    n = len(lengths)
    s_word, s_mask, s_words = _bits(sources)
    c_word, c_mask, c_words = _bits(clusters)
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room = np.zeros(n, np.int64)  # of the open bins, ascending
    name = np.zeros(n, np.int64)
    s_map = np.zeros((n, s_words), np.uint64)  # by bin
    c_map = np.zeros((n, c_words), np.uint64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        at = int(np.searchsorted(room[:opened], lengths[i]))
        chosen = -1
        while at < opened and chosen < 0:
            own = name[at : min(at + _STEP, opened)]
            free = ((s_map[own, s_word[i]] & s_mask[i]) | (c_map[own, c_word[i]] & c_mask[i])) == 0
            k = int(free.argmax())
            if free[k]:
                chosen = at + k
            at += _STEP
        if chosen < 0:
            own, left = opened, capacity
            opened += 1
            hole = opened - 1
        else:
            own, left, hole = int(name[chosen]), int(room[chosen]), chosen
        bin_of[i], offset[i] = own, capacity - left
        s_map[own, s_word[i]] |= s_mask[i]
        c_map[own, c_word[i]] |= c_mask[i]
        left -= int(lengths[i])
        # The bin moves down to its new place in the order of room.
        to = int(np.searchsorted(room[:hole], left))
        room[to + 1 : hole + 1] = room[to:hole].copy()
        name[to + 1 : hole + 1] = name[to:hole].copy()
        room[to], name[to] = left, own
    return bin_of, offset


def pieces(docs: DataFrame, capacity: int, cluster: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, n_chars, source, cluster, ``also`` of each piece of each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))) if cluster is None else F.xxhash64(F.col(cluster))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.length(text).alias("size"), same.alias("cluster"), *also)
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int")))))
    return cut.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).alias("n_chars"), "source", "cluster", *also)


def best_fit(docs: DataFrame, capacity: int = 16384, group_pieces: int = 4096, cluster: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """bin_id, slot, bin_offset and doc_id, piece, start, n_chars, source, ``also`` of each piece of each row of ``docs``."""
    cut = pieces(docs, capacity, cluster, also)
    groups = max(1, -(-(cut.select("piece").count()) // group_pieces))
    # The row's number spreads rows that repeat; it is the same whenever a task is run again.
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "n_chars", F.monotonically_increasing_id()), F.lit(groups)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_chars", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sources = pd.factorize(group["source"])[0]
        bin_of, offset = pack(group["n_chars"].to_numpy(np.int64), sources, pd.factorize(group["cluster"])[0], capacity)
        first = int(group["pack_group"].iloc[0]) << 24
        return pd.DataFrame({"bin_id": bin_of + first, "slot": group.groupby(bin_of).cumcount(), "bin_offset": offset, "doc_id": group["doc_id"], "piece": group["piece"], "start": group["start"], "n_chars": group["n_chars"], "source": group["source"]} | {c: group[c] for c in also})

    return dealt.groupBy("pack_group").applyInPandas(packed, f"bin_id long, slot int, bin_offset int, doc_id {kind}, piece int, start int, n_chars int, source string" + kinds)


def best_fit_with_text(docs: DataFrame, capacity: int = 16384, **params) -> DataFrame:
    """The columns of ``best_fit`` and text, the characters of each piece.

    Groups are packed by ids and lengths alone; texts come back by id, hash and
    piece, so that null and shared ids meet their own text.
    """
    rows = docs.select("doc_id", "text", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("of_text"))
    bins = best_fit(rows, capacity, also=("of_text",), **params)
    own = rows.select(F.col("doc_id").alias("own_id"), F.col("of_text").alias("own_text"), F.coalesce("text", F.lit("")).alias("whole")).dropDuplicates(["own_id", "own_text"])
    last = F.greatest(F.lit(0), F.floor((F.length("whole") - 1) / capacity).cast("int"))
    cut = own.withColumn("own_piece", F.explode(F.sequence(F.lit(0), last))).select("own_id", "own_text", "own_piece", F.substring("whole", F.col("own_piece") * capacity + 1, F.lit(capacity)).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("of_text") == F.col("own_text")) & (F.col("piece") == F.col("own_piece"))
    return bins.join(cut, same).drop("of_text", "own_id", "own_text", "own_piece")
