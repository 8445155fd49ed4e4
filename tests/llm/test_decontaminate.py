import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from panelyard.llm import decontaminate as d


def letters(t):
    return [c.lower() for c in t or "" if c.isalnum()]


def distance(item, text):
    """Fewest edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def planted(seed=2):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.randint(6, 14)).capitalize() + ".") for i in range(6)] + [(6, None), (7, "ab"), (8, "...")]
    docs = []
    for i in range(40):
        t = words(rng, rng.randint(0, 30))
        if i % 3 == 0:
            leak = list(items[i % 6][1])
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = rng.choice([[], ["z"], [leak[at], "q"]])
            t += "\n" + "".join(leak).upper() + "!! " + words(rng, rng.randint(0, 5))
        docs.append((i, t))
    return items, docs + [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, items[1][1] + " " + items[1][1]), (104, "A b"), (None, items[2][1])]


def test_leaks_are_those_of_full_alignment(spark):
    items, docs = planted()
    got = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=200).collect()
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    for doc_id, text in docs:
        for item_id, item in items:
            own, other = letters(item), letters(text)
            want = None
            if len(own) >= 8:
                e = distance(own, other)
                want = e if e <= d.budget(len(own), 8, 0.1) else None
            elif own and own == other:
                want = 0
            assert found.get((doc_id, item_id)) == want, (doc_id, item_id)
    assert sum(r["doc_id"] == 103 and r["item_id"] == 1 for r in got) == 2
    assert sum(r["doc_id"] == 102 for r in got) == 2
    text = dict(docs[:-2])
    for r in got:
        if r["doc_id"] in text and r["edits"] == 0 and r["item_id"] < 6:
            assert letters(text[r["doc_id"]][r["start"] : r["end"]]) == letters(dict(items)[r["item_id"]])


def test_lemma_bound_never_loses_a_region():
    rng = random.Random(8)
    for _ in range(200):
        m = rng.randint(8, 80)
        item = [rng.choice("abcd") for _ in range(m)]
        e = d.budget(m, 8, 0.1)
        assert m - 8 + 1 - 8 * e >= 1
        text = item[:]
        for _ in range(e):
            text[rng.randrange(len(text))] = "z"
        index = d.build([(1, "".join(item))], 8, 0.1)
        assert d.regions("xx" + "".join(text) + "yy", index, 8)


def test_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randint(97, 99) for _ in range(rng.randint(1, 12))]
        region = [rng.randint(97, 99) for _ in range(rng.randint(0, 16))]
        e = rng.randint(0, 3)
        got = d.best_alignment(np.array(item, np.uint32), np.array(region, np.uint32), e)
        want = distance(item, region)
        assert (got[0] if got else None) == (want if want <= e else None)


def test_drop_keeps_clean_rows_and_columns(spark):
    items, docs = planted()
    frame = spark.createDataFrame([(i, t, "en", 3) for i, t in docs], "doc_id long, text string, lang string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.drop_leaking(frame, bench)
    assert kept.columns == frame.columns
    leaking = {r["doc_id"] for r in d.find_leaks(frame, bench).collect()} - {None}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in leaking), key=repr)


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    assert d.find_leaks(docs, bench).count() == 0
    assert d.find_leaks(docs.limit(0), spark.createDataFrame([(1, "some text here")], "item_id long, text string")).count() == 0


def plain_counts(places, slot, index):
    seen = Counter()
    for p, s in zip(places, slot):
        for k in range(index.first[s], index.first[s + 1]):
            i = int(index.item[k])
            band = (p - index.place[k] + index.longest) // (index.edits[i] + 1)
            seen[i, int(band)] += 1
            seen[i, int(band) - 1] += 1
    return {k: n for k, n in seen.items() if n >= index.needed[k[0]]}


@pytest.mark.parametrize("limit", [1 << 16, 5])
def test_tallies_in_chunks_and_by_convolution_are_the_plain_ones(monkeypatch, limit):
    rng = random.Random(3)
    monkeypatch.setattr(d, "CHUNK", 50)
    monkeypatch.setattr(d, "HEAVY", limit)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(8, 60))) for _ in range(4)] + ["ab" * 20, "a" * 30]
        index = d.build(list(enumerate(texts)), 4, 0.1)
        chars = np.array([ord(rng.choice("ab")) for _ in range(rng.randint(30, 200))] + [97] * 40, np.uint32)
        h = d.qgram_hashes(chars, 4)
        slot = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
        places = np.flatnonzero(index.hashes[slot] == h)
        assert {(i, b): n for i, b, n in d.band_counts(places, slot[places], index)} == plain_counts(places, slot[places], index)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ab" * 500_000, "the same line again and again. " * 30_000], ids=["letter", "pair", "line"])
def test_long_repetitive_texts(text):
    index = d.build([(1, "a" * 2000), (2, "ab" * 700), (3, "the same line again and again. " * 20), (4, "qu" * 300)], 8, 0.1)
    tracemalloc.start()
    began = time.process_time()
    found = d.regions(text, index, 8)
    assert time.process_time() - began < 30 and tracemalloc.get_traced_memory()[1] < 600_000_000
    tracemalloc.stop()
    assert len({r[0] for r in found}) == 1 and all(r[3] == 0 for r in found)
    chars = len(letters(text))
    own = len(letters({1: "a" * 2000, 2: "ab" * 700, 3: "the same line again and again. " * 20}[found[0][0]]))
    assert len(found) == chars // own
