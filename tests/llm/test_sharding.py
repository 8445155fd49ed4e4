import random
import zlib
from collections import defaultdict

from panelyard.llm import sharding


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        low, high = (low, c) if n <= shards else (c + 1, high)
    return low


def check(docs, rows, shards):
    got = sharding.shard(docs, shards).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    slots, total = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return got, total


def test_capacity_is_minimax_and_groups_hold(spark, docs, corpus):
    rows = [(i, t) for i, t, *_ in corpus]
    got, total = check(docs, rows, 6)
    groups = defaultdict(set)
    text = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())): t or "" for i, t in rows}
    for r in got:
        groups[text[(r["doc_id"], r["size"], r["text_crc32"])]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    import hashlib

    order = defaultdict(int)
    for _, t in rows:
        order[int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)] += len((t or "").encode()) + 16
    assert max(total.values()) == least_capacity([order[k] for k in sorted(order)], 6)


def test_refinement_finds_the_same_capacity(spark):
    rng = random.Random(6)
    keys = sorted(rng.sample(range(1 << 60), 400))
    sizes = [rng.randint(1, 500) for _ in keys]
    sizes[200] = 20000
    rows = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
    for shards in (1, 3, 17):
        capacity, cuts = sharding.minimax_cuts(rows, shards, first_bits=2, refine_at_once=3)
        assert capacity == least_capacity(sizes, shards)
        total = defaultdict(int)
        for k, s in zip(keys, sizes):
            total[sum(k >= c for c in cuts)] += s
        assert max(total.values()) <= capacity and len(cuts) == shards - 1


def test_a_giant_group_leaves_the_others_even(spark):
    rows = [(i, f"text {i} " * 5) for i in range(400)] + [(1000 + i, "giant " * 50) for i in range(60)]
    _, total = check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 8)
    rest = sorted(total.values())[:-1]
    assert len(total) == 8 and max(rest) < 1.5 * min(rest)


def test_few_rows_and_none(spark, no_docs):
    rows = [(1, "a"), (2, None), (3, ""), (None, "b"), (1, "a")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 40)
    assert sharding.shard(no_docs).count() == 0
