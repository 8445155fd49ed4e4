"""Near words, forms and roots against all pairs; the automata against plain sets."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelyard.llm import variants
from panelyard.llm.variants import Automaton


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out, form = {}, {}
    for w, k in words.items():
        about = [v for v in words if near(w, v)]
        best = min(about, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * k else None
        out[w] = [k, len(about)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += [form[w], words.get(form[w]), root]
    return {w: tuple(x) for w, x in out.items()}


def spellings(rng, base, n):
    out = []
    for _ in range(n):
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k, c = rng.randrange(len(w) + 1), rng.choice("aeéñtz")
            w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
        out.append(w if rng.random() < 0.8 else w.upper())
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = ["".join(rng.choice("aeinrstl") for _ in range(rng.randint(6, 11))) for _ in range(25)] + ["aaaaaaa", "abababab", "straßen", "überall"]
    rows = [(i, " ".join(w + rng.choice([" ", ", ", "9 ", "-"]) for w in spellings(rng, base, 60))) for i in range(60)]
    chain = " ".join(["grundwort"] * 300 + ["grundworte"] * 30 + ["grundwortes"] * 3)
    return rows + [(100, chain), (101, chain), (102, None), (103, ""), (None, "grundwort Grundwort"), (104, "x" * 4000 + " " + "x" * 4000), rows[3]]


@pytest.mark.parametrize("block", [20_000, 40, 7])
def test_against_all_pairs(spark, texts, block):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.group(df, block_words=block).collect()}
    want = plain(texts)
    assert got == want
    assert max(x[1] for x in want.values()) > 3 and want["grundwortes"][2:] == ("grundworte", want["grundworte"][0], "grundwort")


def test_automaton_numbers_and_size():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) + "ungen" for _ in range(800)})
    a = Automaton(words)
    for k, w in enumerate(words):
        state, number = a.walk(w)
        assert number == k and a.final[state]
    # Minimal: no two states that words reach have the same arcs.
    reached, todo = {0}, [0]
    while todo:
        for to, _ in a.arcs[todo.pop()].values():
            if to not in reached:
                reached.add(to)
                todo.append(to)
    assert len({(a.final[s], *((c, to) for c, (to, _) in a.arcs[s].items())) for s in reached}) == len(reached)
    assert not Automaton([]).near("abc", 1)


def test_one_error_either_side():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(2, 9))) for _ in range(300)})
    turned = sorted(w[::-1] for w in words)
    ahead, back = Automaton(words), Automaton(turned)
    for w in words:
        found = {words[k] for k in ahead.near(w, len(w) // 2)} | {turned[k][::-1] for k in back.near(w[::-1], len(w) - len(w) // 2)}
        assert found == {v for v in words if near(w, v)}


def test_odd_tables(spark, docs, no_docs, corpus):
    assert variants.group(no_docs).count() == 0
    clash = docs.withColumns({"word": F.lit("x"), "run": F.lit(1), "n": F.lit(2)})
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.group(clash).collect()}
    assert got == plain([(r[0], r[1]) for r in corpus])


def test_many_words_of_one_half(spark):
    """A prefix that all words share spans several blocks: none of them holds it whole, and all of them are asked."""
    rng = random.Random(2)
    words = {"prefix" + "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(400)}
    counted = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in variants.near_words(counted, 30).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}
