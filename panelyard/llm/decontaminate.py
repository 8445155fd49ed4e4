"""Benchmark decontamination by the q-gram lemma.

Texts are compared by their lower-cased letters and digits.  If a region of a
document is within ``e`` edits of an item of ``m`` such characters, both share at
least ``m - q + 1 - q * e`` q-grams, and these lie on at most ``e + 1`` neighbouring
diagonals.  So shared q-grams are counted in bands of ``2 (e + 1)`` diagonals that
overlap by half; a band that meets the bound is a region, and a banded alignment
verifies it.  ``e`` is ``max_edit_rate`` of the item, less where the bound would
fall below one; an item of fewer than ``q`` characters has to be the whole document.

The items are cut into blocks of at most ``block_chars`` characters; one pass over
the documents holds one block, so what a task holds is bounded however large the
benchmark is.

Cases: null text is the empty text; items without letters and digits match
nothing; repeated items and rows each come back; other columns are not read
(``drop_leaking`` returns them); empty tables give no rows.  A text is one array
of its characters; the tally of a very long or repetitive one is bounded by a
chunk of hits, a transform of its length and the half-bands of its items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelyard.llm.common import fresh, texts

_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BITS = 22
#: Hits tallied at once, and hits of one q-gram that are counted by a convolution.
CHUNK, HEAVY = 1 << 20, 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point of the first plane its lower case, or 0 if it is no letter or digit."""
    return np.array([ord(low) if chr(c).isalnum() and len(low := chr(c).lower()) == 1 else c if chr(c).isalnum() else 0 for c in range(65536)], np.uint32)


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and digits of the text as code points, and where each stands in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = _letters()[np.minimum(raw, 65535)]
    low = np.where(raw > 65535, raw, low)
    at = np.flatnonzero(low)
    return low[at], at


def qgram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    c = chars.astype(np.uint64)
    h = np.zeros(len(c) - q + 1, np.uint64)
    for i in range(q):
        h = h * _P + c[i : len(c) - q + 1 + i]
    return h * _MIX


def budget(m: int, q: int, rate: float) -> int:
    """Edits allowed for an item of ``m`` characters: the bound of the lemma must stay at one or more."""
    return max(0, min(int(rate * m), (m - q) // q))


def best_alignment(item: np.ndarray, region: np.ndarray, max_edits: int) -> tuple[int, int] | None:
    """Fewest edits of ``item`` against any stretch of ``region`` and where that stretch ends, in a band around the corner.

    The band is as wide as the region is longer than the item, and ``max_edits`` to either side.
    """
    if len(region) < len(item) - max_edits:
        return None
    m, width = len(item), max(1, len(region) - len(item) + 1 + 2 * max_edits)
    padded = np.concatenate([np.full(max_edits, 0, np.uint32), region, np.full(width + max_edits, 0, np.uint32)])
    step = np.arange(width)
    cost = np.zeros(width, np.int64)
    for i in range(m):
        diagonal = cost + (padded[i : i + width] != item[i])
        up = np.r_[cost[1:], m + 1] + 1
        cost = np.minimum(diagonal, up)
        cost = np.minimum.accumulate(cost - step) + step
    at = int(cost.argmin())
    return (int(cost[at]), min(max(m + at - max_edits, 0), len(region))) if cost[at] <= max_edits else None


@dataclass(frozen=True)
class Index:
    """The q-grams of a block of items: sorted hashes, and for each its items and places."""

    ids: list
    chars: list
    edits: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    tiny: dict
    longest: int


def build(items: list[tuple], q: int, rate: float) -> Index:
    own = [(i, normalised(t or "")[0]) for i, t in items]
    tiny: dict = {}
    for i, c in own:
        if 0 < len(c) < q:
            tiny.setdefault(c.tobytes(), []).append(i)
    own = [(i, c) for i, c in own if len(c) >= q]
    hashes = [qgram_hashes(c, q) for _, c in own]
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(own)), [len(h) for h in hashes])
    place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    distinct, first = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[(distinct >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    edits = np.array([budget(len(c), q, rate) for _, c in own], np.int64)
    needed = np.array([len(c) - q + 1 for _, c in own], np.int64) - q * edits
    return Index([i for i, _ in own], [c for _, c in own], edits, np.maximum(needed, 1), distinct, np.r_[first, len(flat)].astype(np.int64), item[order], place[order].astype(np.int64), seen, tiny, max((len(c) for _, c in own), default=0))


def band_counts(places: np.ndarray, slot: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """(item, band, shared q-grams) of each band of two half-bands of diagonals that meets its item's bound.

    Hits are tallied in chunks of at most about ``CHUNK``.  Where one q-gram stands
    at many places of both texts, its hits are counted by a convolution instead of
    one by one, so repetitive texts take no more than a few transforms an item.
    """
    n = index.first[slot + 1] - index.first[slot]
    size = int(places[-1]) + 1
    order = np.argsort(slot, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(slot[order]) > 0])
    heavy = np.zeros(len(places), bool)
    groups = []
    for a, b in zip(starts, np.r_[starts[1:], len(order)]):
        k = slot[order[a]]
        if (b - a) * int(index.first[k + 1] - index.first[k]) > HEAVY:
            heavy[order[a:b]] = True
            groups.append((order[a:b], int(k)))
    tallies: dict[int, np.ndarray] = {}  # by item: hits of each half-band, from diagonal -longest on

    def halves(item: int) -> np.ndarray:
        if item not in tallies:
            tallies[item] = np.zeros((size + index.longest) // int(index.edits[item] + 1) + 2, np.int64)
        return tallies[item]

    spectra: dict[int, list] = {}
    for rows, k in groups:
        posting = slice(int(index.first[k]), int(index.first[k + 1]))
        for item in np.unique(index.item[posting]):
            own = index.place[posting][index.item[posting] == item]
            spectra.setdefault(int(item), []).append((places[rows], own))
    for item, pairs in spectra.items():
        longest = len(index.chars[item])
        width = 1 << int(size + longest).bit_length()
        total = np.zeros(width // 2 + 1, np.complex128)
        for doc, own in pairs:
            there, here = np.zeros(width, np.float64), np.zeros(width, np.float64)
            there[doc] = 1
            here[longest - own] = 1
            total += np.fft.rfft(there) * np.fft.rfft(here)
        hits = np.rint(np.fft.irfft(total, width)).astype(np.int64)[: size + longest]  # at diagonal + longest
        band = (np.arange(len(hits)) - longest + index.longest) // int(index.edits[item] + 1)
        halves(item)[: band[-1] + 1] += np.bincount(band, hits, band[-1] + 1).astype(np.int64)
    light = np.flatnonzero(~heavy)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.split(light, np.flatnonzero(np.diff(np.cumsum(n[light]) // CHUNK)) + 1):
        if not len(part):
            continue
        posting = np.repeat(index.first[slot[part]] - np.r_[0, np.cumsum(n[part])[:-1]], n[part]) + np.arange(n[part].sum())
        item = index.item[posting]
        band = (np.repeat(places[part], n[part]) - index.place[posting] + index.longest) // (index.edits[item] + 1)
        own, seen = np.unique(item * np.int64(1 << 40) + band, return_counts=True)
        keys, inverse = np.unique(np.r_[keys, own], return_inverse=True)
        counts = np.bincount(inverse, np.r_[counts, seen], len(keys)).astype(np.int64)
    more: list[np.ndarray] = []
    for item, tally in tallies.items():
        low, high = np.searchsorted(keys, [item << 40, item + 1 << 40])
        tally[keys[low:high] & ((1 << 40) - 1)] += counts[low:high]
        keys, counts = np.delete(keys, slice(low, high)), np.delete(counts, slice(low, high))
        at = np.flatnonzero(tally)
        more.append(np.array([(item << 40) + at, tally[at]]))
    keys, counts = np.concatenate([np.array([keys, counts]), *more], axis=1)
    both, inverse = np.unique(np.r_[keys, keys - 1], return_inverse=True)  # a band starts at each half-band and takes the next
    shared = np.bincount(inverse, np.r_[counts, counts], len(both)).astype(np.int64)
    item = (both + 1) >> 40  # the band before an item's first
    enough = shared >= index.needed[item]
    for k, i, c in zip(both[enough].tolist(), item[enough].tolist(), shared[enough].tolist()):
        yield i, k - (i << 40), c


def regions(text: str, index: Index, q: int) -> list[tuple]:
    """(item id, start, end, edits, shared q-grams) of each region of the text, in code points; those of an item don't overlap.

    Exact copies come first, then the regions of the bands that share most, each the best of its band and the two beside it.
    """
    chars, at = normalised(text)
    if 0 < len(chars) < q:
        return [(i, int(at[0]), int(at[-1]) + 1, 0, 0) for i in index.tiny.get(chars.tobytes(), [])]
    h = qgram_hashes(chars, q)
    places = np.flatnonzero(index.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(places) or not len(index.hashes):
        return []
    slot = np.minimum(np.searchsorted(index.hashes, h[places]), len(index.hashes) - 1)
    hit = index.hashes[slot] == h[places]
    places, slot = places[hit], slot[hit]
    if not len(places):
        return []
    by_item: dict[int, dict[int, int]] = {}
    for i, band, shared in band_counts(places, slot, index):
        by_item.setdefault(i, {})[band] = shared
    whole, out = chars.astype("<u4").tobytes() if by_item else b"", []
    for i, bands in by_item.items():
        own = index.chars[i]
        exact = list(copies(whole, own.astype("<u4").tobytes()))
        taken = [(begin, begin + len(own)) for begin in exact]
        out += [(i, *span, 0, len(own) - q + 1) for span in taken]
        align = cache(lambda start, end, own=own, e=int(index.edits[i]): region_in(own, chars, start, end, e))
        for band in sorted(bands, key=lambda b: (-bands[b], b)):
            while near := [(*r, bands[b]) for b in (band, band - 1, band + 1) if b in bands for gap in free(taken, *stretch(index, i, b, len(chars))) if (r := align(*gap))]:
                edits, begin, stop, shared = min(near)
                insort(taken, (begin, stop))
                out.append((i, begin, stop, edits, shared))
    return [(index.ids[i], int(at[begin]), int(at[stop - 1]) + 1, edits, shared) for i, begin, stop, edits, shared in sorted(out, key=lambda r: r[1:4] + r[:1])]


def stretch(index: Index, item: int, band: int, n: int) -> tuple[int, int]:
    """The part of a text of ``n`` characters that a band of an item's diagonals covers."""
    step = int(index.edits[item]) + 1
    low = band * step - index.longest
    return max(0, low), min(n, low + 2 * step + len(index.chars[item]))


def region_in(own: np.ndarray, chars: np.ndarray, start: int, end: int, e: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best alignment of an item in a stretch, if it is within the budget."""
    if end - start < len(own) - e or (aligned := best_alignment(own, chars[start:end], e)) is None:
        return None
    edits, stop = aligned
    back = best_alignment(own[::-1], chars[start : start + stop][::-1][: len(own) + e], e)
    begin = max(0, stop - (back[1] if back else len(own)))
    return (edits, start + begin, start + stop) if stop > begin else None


def copies(whole: bytes, own: bytes) -> Iterator[int]:
    """Where exact copies stand, in characters of four bytes; leftmost, without overlap."""
    at = whole.find(own)
    while at >= 0:
        if at % 4:
            at = whole.find(own, at + 1)
        else:
            yield at // 4
            at = whole.find(own, at + len(own))


def free(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a stretch that no taken one covers; taken is in order and without overlap."""
    k = max(0, bisect_left(taken, (start, start)) - 1)
    out = []
    while k < len(taken) and taken[k][0] < end:
        if taken[k][1] > start:
            if taken[k][0] > start:
                out.append((start, taken[k][0]))
            start = taken[k][1]
        k += 1
    return [*out, (start, end)] if start < end else out


def blocks(benchmark: DataFrame, block_chars: int) -> list[int]:
    """Numbers of the blocks that the benchmark is cut into."""
    total = benchmark.agg(F.sum(F.length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    return list(range(max(1, -(-2 * total // block_chars))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, max_edit_rate: float = 0.1, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, start, end, edits, shared: each region of a document that holds a benchmark item, in code points."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    numbers = blocks(items, block_chars)
    source = texts(docs, "doc_id")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start long, end long, edits int, shared long"
    arrow = to_arrow_type(items.schema["item_id"].dataType)

    def one(number: int) -> DataFrame:
        # A block of the items by hash: at most about block_chars characters, whatever the size of the benchmark.
        own = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(len(numbers))) == number).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = build(shared.value, q, max_edit_rate)
            for batch in batches:
                ids = batch.column(0)
                rows = [(k, *r) for k, text in enumerate(batch.column(1).to_pylist()) for r in regions(text, index, q)]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], arrow), *(pa.array(c, t) for c, t in zip(cols[2:], (pa.int64(), pa.int64(), pa.int32(), pa.int64())))],
                    names=["doc_id", "item_id", "start", "end", "edits", "shared"],
                )

        return source.mapInArrow(scan, schema)

    return reduce(DataFrame.unionByName, [one(k) for k in numbers])


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that hold no region of a benchmark item, with their columns.

    Rows are told apart by doc_id; rows with a null id are kept, as they can't be named.
    """
    (own,) = fresh(docs, "leaking")
    leaking = find_leaks(docs, benchmark, **params).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaking, F.col("doc_id") == F.col(own), "left_anti")
