"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for what no rule decides.

Features are lengths, path depth, digit ratio, character entropy, parameter
counts and statistics of the host's suffix: how many other labelled URLs have it
and what share of them is blocked, smoothed.  The trees learn from labelled URLs
(``label`` 1 block, 0 allow); ``judge`` labels with the rules the URLs they
decide, so what it learns is which URLs look like those that the rules block: it
can't tell more than the rules' authors did.  Training takes a bounded sample of
different URLs (``max_rows``, at most half from each class, smallest hashes first);
suffix counts and judging cover all rows.

Cases: a null URL or one without ``://`` has empty host and path and is judged by
the trees like any other; repeated rows are judged alike and counted as one URL;
URLs of equal hashes stand in their own order; without labelled URLs of both
classes the verdict is that of the only class, or allow; other columns are not
read; a long URL takes time in proportion to its length and its different
characters; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import written

# The rules, as (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digits", "hyphens", "entropy", "params", "n_query", "fragment", "suffix_n", "suffix_block")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null: its host or a subdomain of it, and a path that starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        out = F.when(((host == own) | host.endswith("." + own)) & path.startswith(slash + rest), F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character; 0 for the empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path and others) with the lexical FEATURES and ``suffix``, without suffix statistics."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return urls.withColumns(
        {
            "n_url": F.length(url).cast("double"), "n_host": F.length("host").cast("double"), "n_path": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/"), "labels": count(F.col("host"), "."), "digits": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0),
            "hyphens": count(F.col("host"), "-"), "entropy": entropy(url), "params": count(query, "="), "n_query": F.length(query).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"), "suffix": F.substring_index("host", ".", -1),
        }
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """suffix, n, blocked over all different labelled URLs."""
    return labelled.groupBy("suffix").agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("blocked"))


def with_suffixes(rows: DataFrame, statistics: DataFrame, own: Column) -> DataFrame:
    """``rows`` with suffix_n and suffix_block, without the row's ``own`` label (null for none); the share is smoothed towards a half by ten."""
    others = F.greatest(F.coalesce("n", F.lit(0.0)) - own.isNotNull().cast("double"), F.lit(0.0))
    blocked = F.greatest(F.coalesce("blocked", F.lit(0.0)) - F.coalesce(own, F.lit(0.0)), F.lit(0.0))
    return rows.join(statistics, "suffix", "left").withColumn("suffix_n", F.log1p(others)).withColumn("suffix_block", (blocked + 5.0) / (others + 10.0)).drop("n", "blocked")


def train(labelled: DataFrame, max_rows: int = 20000, trees: int = 20, depth: int = 4, seed: int = 7):
    """The model on different labelled URLs (FEATURES, label, url), or the only class there is.

    The sample takes at most half of ``max_rows`` from each class, smallest hashes of the URL first.
    """
    rows = labelled.select(*FEATURES, F.col("label").cast("double").alias("label"), F.xxhash64("url").alias("h"), "url")
    classes = [rows.filter(F.col("label") == c).orderBy("h", "url").limit(max_rows // 2) for c in (0.0, 1.0)]
    sample = written(classes[0].unionByName(classes[1]).drop("h", "url"), "url-sample")
    found = [r[0] for r in sample.select("label").distinct().collect()]  # 0 and 1 at most
    if len(found) < 2:
        return found[0] if found else 0.0
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2).fit(assembled)


def labelled_by(rows: DataFrame, label: Column) -> DataFrame:
    """The different URLs of ``rows`` (url, host, path) that have a ``label``, with it and their features."""
    return features(rows.withColumn("label", label.cast("double")).filter("label is not null").select("url", "host", "path", "label").distinct())


def judge(pages: DataFrame, rules=RULES, **params) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for each row of ``pages``."""
    verdicts = F.lit(None).cast("string")
    for rule, verdict in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdicts)
    block = (F.col("by_rule") == "block").cast("double")
    labelled = written(labelled_by(rows, block), "url-labelled")
    statistics = written(suffix_statistics(labelled), "url-suffixes")
    model = train(with_suffixes(labelled, statistics, F.col("label")), **params)
    known = with_suffixes(features(rows), statistics, block)
    if isinstance(model, float):
        judged = known.withColumn("block_score", F.lit(model))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known))
        judged = scored.withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("by_rule", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
