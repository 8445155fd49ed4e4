import math
from collections import Counter

from pyspark.sql import functions as F

from panelyard.llm import urls

URLS = [
    (1, "https://www.A.org/x/y?q=1#f"), (2, "http://example.org/es/1"), (3, "http://sub.example.org/en/15"), (4, "http://example.org/en/25"), (5, "http://x.com/fr/9"), (6, "http://y.com/de/1?a=1&b=2"),
    (7, "http://z.net/en/1"), (8, None), (9, "no scheme/at/all"), (10, "x://HOST.Org?q"), (11, "http://evilexample.org/es/1"), (12, ""), (13, "http://a/b://c.org/d"), (14, "http://org/"), (7, "http://z.net/en/1"), (None, "http://q.com/en/#z"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = path = ""
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: next((k for k, c in enumerate(rest) if c in "?#"), len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for r, v in urls.RULES:
        h, s, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return best


def frame(spark, rows=URLS):
    return spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, label int")


def test_rules_and_parts(spark):
    got = urls.judge(frame(spark)).collect()
    assert len(got) == len(URLS)
    want = dict(URLS)
    for r in got:
        host, path = parts(want[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        best = rule(host, path)
        assert r["rule"] == (best[0] if best else None)
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")


def test_features(spark):
    u = "http://a-b.c.org/x/12?k=v&z=1#f"
    df = spark.createDataFrame([(u,)], "url string").select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    r = urls.features(df).first()
    n = Counter(u)
    assert r["n_url"] == len(u) and r["depth"] == 2 and r["labels"] == 2 and r["hyphens"] == 1 and r["params"] == 2 and r["fragment"] == 1 and r["suffix"] == "org"
    assert abs(r["digits"] - 3 / len(u)) < 1e-12
    assert abs(r["entropy"] + sum(c / len(u) * math.log2(c / len(u)) for c in n.values())) < 1e-9


def test_trees_learn_held_out_urls(spark):
    make = lambda i, bad: f"http://h{i % 7}.shop/{'p' * (i % 5)}" + (f"?id={i * 7919}&s={i * 104729}&t={i * 31}" if bad else f"/about/{'word' * (i % 3)}")
    rows = [(i, make(i, i % 2 == 0), float(i % 2 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, label double").select("*", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    f = urls.features(df)
    f = urls.with_suffixes(f, urls.suffix_statistics(f), F.col("label"))
    model = urls.train(f.filter("page_id % 5 <> 0"))
    from pyspark.ml.feature import VectorAssembler

    held = model.transform(VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(f.filter("page_id % 5 = 0")))
    assert held.filter("prediction = label").count() >= 76


def test_one_class_and_none(spark):
    only = [(1, "http://a.org/1"), (2, "http://b.net/1")]
    assert {r["verdict"] for r in urls.judge(frame(spark, only)).collect()} == {"allow"}
    assert urls.judge(frame(spark).limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(frame(spark, [(1, "http://b.net/1")])).collect()} == {"allow"}


def test_a_repeated_url_is_one_url(spark):
    base = [(i, f"http://h{i % 9}.org/{'a' * (i % 17)}/{i}") for i in range(120)] + [(1000 + i, f"http://h{i % 9}.com/de/{i}?q={i * 7919}") for i in range(60)] + [(2000 + i, f"http://h{i}.com/de-x/{i}?q={i * 104729}") for i in range(20)]
    again = base + [(5000 + i, base[3][1]) for i in range(3000)]
    one, two = ({r["page_id"]: (r["verdict"], r["block_score"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), max_rows=100).collect() if r["page_id"] < 5000} for rows in (base, again))
    assert one == two and {one[2000 + i][0] for i in range(20)} == {"block"}


def test_suffix_share_leaves_the_row_out(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 0.0), ("c", "y", 1.0)], "url string, suffix string, label double")
    got = {r["url"]: (round(math.expm1(r["suffix_n"]), 6), r["suffix_block"]) for r in urls.with_suffixes(rows, urls.suffix_statistics(rows), F.col("label")).collect()}
    assert got == {"a": (1.0, 5 / 11), "b": (1.0, 6 / 11), "c": (0.0, 0.5)}
