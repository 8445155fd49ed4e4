import random
import zlib

import numpy as np

from panelyard.llm import quality

GOOD = ["an", "er", "th", "on", "in"]


def make(rng, good):
    w = ["".join(rng.choice(GOOD) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
    return " ".join(w) if good else " ".join(x + rng.choice(["$$$", "###"]) for x in w)


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, make(rng, i % 4 > 0), int(i % 4 > 0)) for i in range(n)]


def test_grams_are_those_of_a_plain_loop():
    def plain(text):
        w = text.split()
        n = len(w) + max(0, len(w) - 1)
        for x in w:
            n += sum(max(0, len(x) + 2 - k + 1) for k in (3, 4, 5))
        return n

    for t in ("", "a", " a  b ", "abc de f", "one  two\tthree\none", "x" * 300):
        assert len(quality.grams(t, 17)) == plain(t), t
    assert (quality.grams("a  b", 17) == quality.grams(" a b\n", 17)).all()


def test_held_out_accuracy_and_defined_cases(spark):
    data = rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(1000, None), (1001, ""), (None, "an er")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(5, None), (None, 1), (7, 1 if data[7][2] else 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 303
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i, _, _ in data if got[i]["held_out"]] == held
    assert np.mean([got[i]["predicted"] == data[i][2] for i in held]) > 0.95
    assert got[1000]["score"] == got[1001]["score"] and 0 <= got[1000]["score"] <= 1


def test_one_class_none_and_empty(spark):
    docs = spark.createDataFrame([(1, "an"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.classify(docs, one).collect())
    assert quality.classify(docs.limit(0), one).count() == 0


def test_keep_good_keeps_columns(spark):
    data = rows(200)
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in data], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = {i for i, _, q in data if q}
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids ^ good) <= 4


def test_sample_is_bounded_and_no_text_keeps_others_out(spark):
    data = rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(-i, 1) for i in range(1, 500)], "doc_id long, quality int")
    assert quality.labelled_sample(docs, labels, max_rows=10).count() == 10  # labels of absent documents take no place
    whole = quality.labelled_sample(docs, labels).collect()
    huge = docs.unionByName(spark.createDataFrame([(i, "an " * 400_000) for i in range(1000, 1004)], docs.schema))
    more = labels.unionByName(spark.createDataFrame([(i, 0) for i in range(1000, 1004)], labels.schema))
    learnt = quality.labelled_sample(huge, more).collect()  # long texts are learnt from, and keep no other out
    long = {r["text"] for r in learnt} - {r["text"] for r in whole}
    assert set(whole) < set(learnt) and long == {"an " * 400_000}
    ids, counts = quality.bag("an " * 400_000, 17)
    assert len(ids) < 20 and counts.sum() == len(quality.grams("an " * 400_000, 17))
    for text in ("an " * 400_000, data[0][1], "", "a b"):
        whole_bag = quality.bag(text, 17)
        assert all((a == b).all() for a, b in zip(quality.unpacked(*quality.packed(*whole_bag)), whole_bag))
    model = quality.train(huge, more)
    assert quality.score_of(model, "an " * 400_000) < 0.3 < quality.score_of(model, next(t for _, t, q in data if q))


def test_scores_and_training_are_those_of_plain_loops():
    """One model trained gram by gram in plain Python; the scores agree."""
    data = rows(40)
    texts_, labels = [t for _, t, _ in data], np.array([q for *_, q in data])
    bits, dim, epochs, rate = 12, 3, 2, 0.5
    model = quality.fit([quality.bag(t, bits) for t in texts_], labels, bits=bits, dim=dim, epochs=epochs, rate=rate, seed=3)
    rng = np.random.default_rng(3)
    vector, out = rng.normal(0, 0.1, (2**bits, dim)).astype(np.float32).astype(float), rng.normal(0, 0.5, (dim, 2)).astype(np.float32).astype(float)
    bias, steps = [float(np.log(1 - labels.mean())), float(np.log(labels.mean()))], 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts_)):
            ids = quality.grams(texts_[i], bits).tolist()
            lr, steps = rate * (1 - steps / (epochs * len(texts_))), steps + 1
            share = {g: ids.count(g) / len(ids) for g in set(ids)}
            hidden = [sum(w * vector[g][d] for g, w in share.items()) for d in range(dim)]
            z = [sum(hidden[d] * out[d][c] for d in range(dim)) + bias[c] for c in range(2)]
            p = [np.exp(x) / sum(np.exp(y) for y in z) for x in z]
            p[labels[i]] -= 1
            square, back = sum(w * w for w in share.values()), [out[d][0] * p[0] + out[d][1] * p[1] for d in range(dim)]
            for g, w in share.items():
                for d in range(dim):
                    vector[g][d] -= lr * w / square * back[d]
            for c in range(2):
                for d in range(dim):
                    out[d][c] -= 0.1 * lr * hidden[d] * p[c]
                bias[c] -= 0.02 * lr * p[c]
    for t in [*texts_, "", "unseen words"]:
        ids = quality.grams(t, bits).tolist()
        hidden = [sum(vector[g][d] for g in ids) / max(1, len(ids)) for d in range(dim)]
        z = [sum(hidden[d] * out[d][c] for d in range(dim)) + bias[c] for c in range(2)]
        assert abs(quality.score_of(model, t) - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-3
