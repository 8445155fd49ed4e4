"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of a 60-bit key of their
text's MD5.  The smallest feasible shard capacity is found by binary search; a
capacity is checked greedily.  The check reads segments of the key range (their
bytes, and whether they hold one group), not groups: taking segments as
divisible bounds the capacity from below, taking them as atomic from above, and
while the bounds differ the segments where cuts may fall are split further by a
Spark aggregate.  The driver holds at most ``2**first_bits`` segments and
``refine_at_once * 2**6`` more a round, whatever the number of rows.  The shards
are then cut under that capacity as evenly as it allows, so a group larger than
an equal share does not leave other shards empty or small.

Slots come from counts of fixed units of rows, so no shard is numbered in one task.

Cutting greedily at the capacity itself would keep every shard within it, but where
one group is larger than an equal share it leaves the last shards empty (a group of a
third of all bytes: 3 full shards of 40), so the law ``bytes`` asks for the even cuts.

Cases: null text has no bytes and is grouped with the empty text; repeated rows
and null ids get slots of their own, in the order of their first reading; texts whose
keys tie are one group only if they are equal but for a chance of 2^-60 a pair; a very
long text is one group, of which only its size and hashes are kept; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.llm.common import texts, written

KEY_BITS, SPLIT_BITS = 60, 6


class Segments:
    """Stretches of the key range in order: first key, bytes, whether it is one group, and how far its keys are cut."""

    def __init__(self, first, size, atomic, shift):
        order = np.argsort(first, kind="stable")
        self.first, self.size, self.atomic, self.shift = (np.asarray(x)[order] for x in (first, size, atomic, shift))
        self.ends = np.r_[0, np.cumsum(self.size)]

    def greedy(self, capacity: int, shards: int, divisible: bool, bounded: bool = True) -> list[int]:
        """Positions in bytes after each shard; segments that hold several groups are divisible, or atomic."""
        at, out, total = 0, [], int(self.ends[-1])
        for _ in range(shards):
            to = at + capacity
            if to >= total:
                to = total
            else:
                k = int(np.searchsorted(self.ends, to, "right")) - 1
                if not divisible or self.atomic[k]:
                    to = max(int(self.ends[k]), at if bounded else 0)
            at = to
            out.append(at)
        return out

    def least(self, shards: int, divisible: bool) -> int:
        """The smallest capacity at which the greedy check passes: binary search."""
        total = int(self.ends[-1])
        low, high = -(-total // shards), total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.greedy(middle, shards, divisible)[-1] == total else (middle + 1, high)
        return low

    def open_at(self, low: int, high: int, shards: int) -> np.ndarray:
        """Segments of several groups where a greedy cut may fall at a capacity from low to high."""
        near = np.zeros(len(self.size), bool)
        for a, b in zip(self.greedy(low, shards, False), self.greedy(high, shards, True)):
            near[max(0, np.searchsorted(self.ends, a, "left") - 1) : np.searchsorted(self.ends, b, "right")] = True
        return np.flatnonzero(near & ~self.atomic.astype(bool))

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """First keys of shards 1 and on: as even as the capacity allows.

        A segment larger than an equal share is a shard of its own; each stretch
        between such segments is cut evenly into the whole number of shards that
        comes nearest to the share.
        """
        total, latest, n = int(self.ends[-1]), [0] * (shards + 1), len(self.size)
        latest[shards] = total
        for k in range(shards - 1, -1, -1):  # where shard k may start at the earliest so that the rest still fits
            latest[k] = int(self.ends[np.searchsorted(self.ends, latest[k + 1] - capacity, "left")])
        share, large = total / shards, np.zeros(n, bool)
        while (more := self.size > share).sum() > large.sum() and more.sum() < shards:
            large, share = more, (total - self.size[more].sum()) / (shards - more.sum())
        ahead, keys, at = np.append(np.flatnonzero(large), n), [], 0  # at: a segment
        for k in range(shards - 1):
            begin, left = int(self.ends[at]), shards - k
            low = max(int(np.searchsorted(self.ends, latest[k + 1], "left")), min(at + 1, n))
            high = max(low, int(np.searchsorted(self.ends, begin + capacity, "right")) - 1)
            if at < n and large[at]:
                near = at + 1
            else:
                stretch = int(ahead[np.searchsorted(ahead, at)])
                others = (total - begin - int(self.size[at:][large[at:]].sum())) / max(1, left - int(large[at:].sum()))
                length = int(self.ends[stretch]) - begin
                goal = begin + length / max(1, round(length / others) if others else 1)
                near = int(np.searchsorted(self.ends, goal))
                if near > at + 1 and abs(self.ends[near - 1] - goal) <= abs(self.ends[min(near, n)] - goal):
                    near -= 1
            at = int(np.clip(near, low, high))
            keys.append(int(self.first[at]) if at < n else 1 << KEY_BITS)
        return keys


def _segments(rows: DataFrame, shift: int, within: list[int] | None = None, outer: int = 0) -> list:
    if within is not None:
        rows = rows.filter(F.shiftright("key", outer).isin(within))
    found = rows.groupBy(F.shiftright("key", shift).alias("segment")).agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("size").alias("size"))
    return [(r["first"], r["size"], r["first"] == r["last"], shift) for r in found.collect()]  # bounded: see the module


def minimax_cuts(rows: DataFrame, shards: int, first_bits: int = 14, refine_at_once: int = 256) -> tuple[int, list[int]]:
    """Smallest capacity, and first keys of shards 1 and on, for ``rows`` (key, size)."""
    found = Segments(*zip(*(_segments(rows, KEY_BITS - first_bits) or [(0, 0, True, 0)])))
    while True:
        low, high = found.least(shards, True), found.least(shards, False)
        todo = found.open_at(low, high, shards) if low < high else np.zeros(0, int)
        if not len(todo):
            return high, found.cuts(high, shards)
        todo = todo[np.argsort(-found.size[todo], kind="stable")][:refine_at_once]
        shift = int(found.shift[todo[0]])
        todo = todo[found.shift[todo] == shift]
        finer = _segments(rows, max(0, shift - SPLIT_BITS), [int(k) >> shift for k in found.first[todo]], shift)
        rest = np.setdiff1d(np.arange(len(found.size)), todo)
        found = Segments(*(np.concatenate([old[rest], new]) for old, new in zip((found.first, found.size, found.atomic, found.shift), map(np.array, zip(*finer)))))


def shard(docs: DataFrame, shards: int = 40, units: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    body = F.col("text").cast("binary")
    key = F.conv(F.substring(F.md5(body), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = texts(docs, "doc_id").select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "shard-rows")
    _, cuts = minimax_cuts(rows, shards)
    number = reduce(add, ((F.col("key") >= cut).cast("int") for cut in cuts), F.lit(0))
    placed = rows.withColumn("shard", number).withColumn("unit", F.pmod(F.xxhash64("row"), F.lit(units)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("shard", "unit").agg(F.count("*").alias("n")).select("shard", "unit", F.coalesce(before, F.lit(0)).alias("offset"))
    slotted = placed.join(F.broadcast(offsets), ["shard", "unit"])  # at most shards * units rows
    slot = F.col("offset") + F.row_number().over(Window.partitionBy("shard", "unit").orderBy("row")) - 1
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
