from collections import Counter, defaultdict

import numpy as np

from panelyard.llm import packing


def test_every_piece_goes_to_a_tightest_compatible_bin():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        lengths = rng.integers(0, 50, n)
        sources, clusters = rng.integers(-1, 6, n), rng.integers(-1, 70, n)
        bin_of, offset = packing.pack(lengths, sources, clusters, 60)
        room, members = {}, defaultdict(list)
        for i in np.argsort(-lengths, kind="stable").tolist():
            free = {b: r for b, r in room.items() if r >= lengths[i] and not any((sources[i] >= 0 and sources[j] == sources[i]) or (clusters[i] >= 0 and clusters[j] == clusters[i]) for j in members[b])}
            b = int(bin_of[i])
            if free:
                assert b in free and free[b] == min(free.values())
            else:
                assert b not in room
            assert offset[i] == 60 - room.get(b, 60)
            room[b] = room.get(b, 60) - lengths[i]
            members[b].append(i)


def test_all_characters_once_and_no_conflict(docs, corpus):
    rows = packing.best_fit(docs, capacity=500, group_pieces=16).collect()
    assert Counter(r["doc_id"] for r in rows for _ in range(r["n_chars"])) == Counter(i for i, t, *_ in corpus for _ in range(len(t or "")))
    assert len(rows) == sum(max(1, -(-len(t or "") // 500)) for _, t, *_ in corpus)
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for own in bins.values():
        assert sum(r["n_chars"] for r in own) <= 500
        known = [r["source"] for r in own if r["source"] is not None]
        assert len(known) == len(set(known))
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        at = 0
        for r in sorted(own, key=lambda r: r["slot"]):
            assert r["bin_offset"] >= 0
        for r in sorted(own, key=lambda r: (r["bin_offset"], r["n_chars"])):
            assert r["bin_offset"] == at
            at += r["n_chars"]
    text = {i: t or "" for i, t, *_ in corpus}
    for own in bins.values():
        whole = [text[r["doc_id"]].lower().split() for r in own if r["doc_id"] is not None and len(text[r["doc_id"]]) <= 500 and text[r["doc_id"]].split()]
        assert len({tuple(w) for w in whole}) == len(whole)


def test_cluster_column_and_empty(spark, no_docs):
    docs = spark.createDataFrame([(i, f"text {i}", None, 1) for i in range(9)], "doc_id long, text string, source string, c int")
    rows = packing.best_fit(docs, cluster="c").collect()
    assert len({r["bin_id"] for r in rows}) == 9
    assert packing.best_fit(no_docs).count() == 0


def test_groups_are_of_pieces_not_of_documents(spark):
    docs = spark.createDataFrame([(i, "x" * 10_000 if i < 5 else "short", f"s{i % 50}") for i in range(60)] + [(999, "twice", "t")] * 40, "doc_id long, text string, source string").repartition(4)
    rows = packing.best_fit(docs, capacity=100, group_pieces=64).collect()
    assert len(rows) == 5 * 100 + 55 + 40 and sum(r["n_chars"] for r in rows) == 5 * 10_000 + 55 * 5 + 40 * 5
    groups = Counter(r["bin_id"] >> 24 for r in rows)
    assert len(groups) >= 8 and max(groups.values()) < 3 * 64
    assert max(Counter(r["bin_id"] >> 24 for r in rows if r["doc_id"] == 999).values()) < 25
