import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, n int, shard string"
PAGES = "page_id long, url string, html string, digest string, host string"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "in", "re", "st", "ou", "le", "mi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with null, empty, long, copied and repeated ones, and columns whose names clash with inner ones."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(3, 120)) for _ in range(40)]
    long = words(rng, 4000)
    own = base + [None, "", "   ", long, base[0], base[0], base[1] + " more", base[2].upper(), "x", "ÄÖ ß \U0001f600 " + base[3]]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), f"k{i}", -i, i, "s") for i, t in enumerate(own)]
    rows.append(rows[7])  # a repeated row
    rows.append((None, base[8], None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
