import pytest
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from panelyard.llm import simhash


def plain(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps, ids, bits=4):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            up[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(top(i), []).append(ids[i])
    return {i: min((x for x in groups[top(i)] if x is not None), default=None) for i in range(len(fps))}


def test_triples_meet_every_four_positions():
    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_components_match_brute_force(docs, corpus):
    rows = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    fps = [plain(t) for _, t, *_ in corpus]
    want = closure(fps, [r[0] for r in corpus])
    assert sorted(rows, key=repr) == sorted(((corpus[i][0], fps[i], want[i]) for i in range(len(corpus))), key=repr)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c d') h").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_chains_and_hot_lists_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(300)}
    chain = [int(rng.integers(0, 2**62))]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(62, 4, replace=False)))
    far = [int(x) for x in rng.integers(0, 2**62, 300)]
    fps = sorted(near | set(chain) | set(far))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=16)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = closure(fps, signed)
    assert {x: found.get(x, x) for x in signed} == {x: want[i] for i, x in enumerate(signed)}


def test_keep_one_keeps_columns_and_one_row_a_group(docs, corpus):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    fps = [plain(t) for _, t, *_ in corpus]
    want = {v for v in closure(fps, [r[0] for r in corpus]).values()}
    assert sorted(ids) == sorted(want)


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).filter(F.lit(True)).count() == 0


def test_tallies_are_the_shared_bytes_of_pairs_that_share_one_more():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 4, (60, 8)).astype(np.uint8)
    fps[rng.random((60, 8)) < 0.3] += 100
    values = np.ascontiguousarray(fps).view(np.int64).reshape(-1)
    cell, known = np.repeat([0, 1, 2], 20), np.repeat([0b111, 0b1011, 0b11100000], 20)
    for c in range(3):  # a list's rows share the bytes of its key
        for p in range(8):
            if int(known[20 * c]) >> p & 1:
                fps[20 * c : 20 * c + 20, p] = 7
    values = np.ascontiguousarray(fps).view(np.int64).reshape(-1)
    i, j, count = simhash.tallied(values, cell, known)
    want = {(a, b): int((fps[a] == fps[b]).sum()) for a, b in combinations(range(60), 2) if cell[a] == cell[b] and (fps[a] == fps[b]).sum() > 3}
    assert dict(zip(zip(i.tolist(), j.tolist()), count.tolist())) == want


def test_forest_labels_are_the_smallest_reachable_rows():
    rng = np.random.default_rng(7)
    for n in (1, 2, 40):
        i, j = rng.integers(0, n, (2, n // 2))
        label = simhash.forest(n, i, j)
        own = list(range(n))
        for _ in range(n):
            for a, b in zip(i, j):
                own[a] = own[b] = min(own[a], own[b])
        assert label.tolist() == own


def test_hot_fingerprints_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    rows = [(k, "the same few words again and again") for k in range(50)] + [(100 + k, f"text number {k} of its own kind") for k in range(10)] + [(5, "the same few words again and again")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [plain(t) for _, t in rows]
    want = closure(fps, [i for i, _ in rows])
    assert sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == sorted((rows[k][0], fps[k], want[k]) for k in range(len(rows)))


def test_no_more_bits_than_the_index_guarantees(spark):
    fps = spark.createDataFrame([(1,), (2,)], "fp long")
    with pytest.raises(ValueError):
        simhash.links(fps, 5)
