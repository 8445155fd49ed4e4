"""Learning on a panel: folds without look-ahead, weights, models of ``pyspark.ml``, regimes, and tables that judge a score."""

from __future__ import annotations

from itertools import permutations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames
from panelyard.sources import files


def sessions(panel: DataFrame) -> DataFrame:
    """trade_date, session: the calendar's ordinals, from 0."""
    w = Window.orderBy("trade_date")  # one row a session
    return panel.select("trade_date").distinct().withColumn("session", F.row_number().over(w) - 1)


def folds(panel: DataFrame, first: int, step: int, horizon: int, embargo: int = 0, length: int | None = None) -> DataFrame:
    """fold, trade_date, part: walk-forward folds over sessions.

    Fold k tests ``step`` sessions from session first + k * step; it trains on sessions
    whose labels, ``horizon`` + 1 sessions long, are known ``embargo`` sessions before
    that, and at most ``length`` of them.
    """
    cal = sessions(panel)
    n = cal.agg(F.max("session") + 1).first()[0] or 0
    starts = list(range(first, n, step))
    grid = panel.sparkSession.createDataFrame([(k, s) for k, s in enumerate(starts)] or [(0, n)], "fold int, start int")
    last = F.col("start") - embargo - horizon - 1
    part = F.when((F.col("session") >= F.col("start")) & (F.col("session") < F.col("start") + step), "test").when((F.col("session") < last) & (F.col("session") >= last - (length or 1 << 30)), "train")
    return cal.join(F.broadcast(grid)).select("fold", "trade_date", part.alias("part")).filter("part is not null")  # folds are a stated grid


def weights(rows: DataFrame, half_life: int = 126, time: str = "trade_date") -> DataFrame:
    """``rows`` with weight: each date counts the same, and half as much for every ``half_life`` sessions of age."""
    w = Window.orderBy(time)  # one row a session
    dated_ = rows.groupBy(time).agg(F.count("*").alias("_n")).withColumn("_s", F.row_number().over(w))
    aged = dated_.select(time, "_n", (F.max("_s").over(Window.partitionBy()) - F.col("_s")).alias("_age"))
    return rows.join(F.broadcast(aged), time).withColumn("weight", F.pow(F.lit(0.5), F.col("_age") / half_life) / F.col("_n")).drop("_age", "_n")


def walk_forward(rows: DataFrame, features: list[str], label: str, plan: DataFrame, kind: str = "ridge", **params) -> DataFrame:
    """fold, trade_date, ts_code, label, prediction of the test part of each fold; each fold is fitted on its own training part.

    Every fold reads ``rows`` and ``plan`` more than once: give them as ``files.written``.
    """
    models = {
        "ridge": lambda: LinearRegression(labelCol=label, weightCol="weight", regParam=params.get("reg", 0.1)),
        "elastic": lambda: LinearRegression(labelCol=label, weightCol="weight", regParam=params.get("reg", 0.01), elasticNetParam=0.5),
        "trees": lambda: GBTRegressor(labelCol=label, weightCol="weight", maxIter=params.get("trees", 10), maxDepth=3, seed=7),
        "logistic": lambda: LogisticRegression(labelCol=label, weightCol="weight", regParam=params.get("reg", 0.01)),
    }
    data = rows.dropna(subset=[*features, label])
    weighted, assembler = weights(data), VectorAssembler(inputCols=features, outputCol="features")
    out = None
    for k in [r["fold"] for r in plan.select("fold").distinct().orderBy("fold").collect()]:  # the folds of the plan
        own = plan.filter(F.col("fold") == k)
        train, test = (assembler.transform(d.join(F.broadcast(own.filter(F.col("part") == p).select("trade_date")), "trade_date")) for p, d in (("train", weighted), ("test", data)))
        scored = models[kind]().fit(train).transform(test)
        value = vector_to_array("probability")[1] if kind == "logistic" else F.col("prediction")
        part = scored.select(F.lit(k).alias("fold"), "trade_date", "ts_code", label, value.alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


def mixture_regimes(daily: DataFrame, features: list[str], k: int = 3, seed: int = 7, name: str = "regime") -> DataFrame:
    """``daily`` with regime and its probability by a Gaussian mixture; regimes are numbered by the mean of the first feature."""
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(daily.dropna(subset=features))
    model = GaussianMixture(k=k, seed=seed, featuresCol="_features", predictionCol="_cluster", probabilityCol="_p").fit(data)
    order = sorted(range(k), key=lambda i: float(model.gaussians[i].mean[0]))
    names = F.element_at(F.array(*(F.lit(order.index(i)) for i in range(k))), F.col("_cluster") + 1)
    return model.transform(data).select(*daily.columns, names.alias(name), F.array_max(vector_to_array("_p")).alias(f"{name}_probability"))


def calibration(scored: DataFrame, label: str, score: str = "prediction", buckets: int = 10) -> DataFrame:
    """bucket, n, mean_score, mean_label: by the score's rank over all rows, in partial counts by value first."""
    share = F.percent_rank().over(Window.partitionBy("trade_date").orderBy(score))
    b = scored.withColumn("bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int") + 1)
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("mean_label"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labellings, from their contingency counts."""
    cell = pairs.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    sums = lambda g: cell.groupBy(g).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias(f"s_{g}"))
    s = cell.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n")).crossJoin(sums(a)).crossJoin(sums(b))  # one row each
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / two(F.col("n"))
    return s.select(frames.safe_ratio(F.col("s") - expected, (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2 - expected).alias("ari"))


def align_states(fits: DataFrame, axes: list[str], means: str, order: str, k: int, out: str = "aligned") -> DataFrame:
    """``fits`` with ``out``: which state of each refit takes each of the ``k`` places, from refit to refit the same.

    means: an array of ``k`` arrays, a state's mean of each feature.  The first refit's
    states stand in the order of their first mean; a later one's take the places of the
    states before that they are nearest to, by the least sum of squared distances over all
    permutations.  A cost does not depend on how both sides are numbered, so each refit is
    matched to the raw states before it alone, and the matches are then composed: refits
    of a series are one row a period, few enough for one array.
    """
    if k > 6:
        raise ValueError("six states at most: all their permutations are compared")
    w = Window.partitionBy(*axes).orderBy(order)
    places = F.array(*(F.array(*(F.lit(i) for i in p)) for p in permutations(range(k))))
    first = F.transform(F.array_sort(F.transform(F.col(means), lambda m, i: F.struct(F.get(m, F.lit(0)).alias("m"), i.alias("i")))), lambda x: x["i"])

    def distance(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

    def cost(p: Column) -> Column:
        apart = F.transform(F.col("_before"), lambda m, i: distance(m, F.get(F.col(means), F.get(p, i))))
        return F.struct(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x).alias("cost"), p.alias("p"))

    d = fits.withColumn("_before", F.lag(means).over(w))
    d = d.withColumn("_step", F.when(F.col("_before").isNull(), first).otherwise(F.array_min(F.transform(places, cost))["p"]))
    steps = F.collect_list("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_steps", steps)
    start = F.get("_steps", F.lit(0))
    composed = F.aggregate(F.slice("_steps", F.lit(2), F.size("_steps")), start, lambda at, step: F.transform(at, lambda i: F.get(step, i)))
    return d.withColumn(out, composed).drop("_before", "_step", "_steps")


def mixture_walk_forward(daily: DataFrame, features: list[str], k: int = 3, history: int = 252, every: int = 21, iterations: int = 20, time: str = "trade_date") -> DataFrame:
    """time, refit, state, probabilities: a Gaussian mixture's states of each session, by a fit on the ``history`` sessions before its period.

    Every ``every`` sessions the mixture (own variances of each feature) is fitted anew;
    all refits go through expectation and maximisation together, one aggregate a step:
    a step's rows are sessions and the refits whose history holds them.  States keep
    their places from refit to refit (``align_states``).  What a step gives is one row a
    refit, which goes back to the rows by value; refits are periods of a calendar.
    """
    spark, size = daily.sparkSession, len(features)
    w = Window.orderBy(time)  # one row a session
    rows = daily.dropna(subset=features).select(time, F.array(*(F.col(f).cast("double") for f in features)).alias("_x")).withColumn("_s", F.row_number().over(w) - 1)
    path = files.shared_folder(spark, "sessions")  # every step reads them again: without this it makes them anew from the panel
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    refits = -(-max(rows.count() - history, 0) // every)  # refit r is fitted on the sessions from r * every to before r * every + history
    if not refits:
        return rows.select(time, F.lit(0).alias("refit"), F.lit(0).alias("state"), F.array(F.lit(0.0)).alias("probabilities")).limit(0)
    low = F.greatest(F.floor((F.col("_s") - history) / every) + 1, F.lit(0)).cast("int")
    high = F.least(F.floor(F.col("_s") / every), F.lit(refits - 1)).cast("int")
    past = rows.filter(low <= high).withColumn("refit", F.explode(F.sequence(low, high)))
    state = Window.partitionBy("refit").orderBy(F.get("_x", F.lit(0)), time)
    past = past.withColumn("_half", F.floor((F.row_number().over(state) - 1) * k / history).cast("int"))

    def sums(weight, i: int):
        x = [F.get("_x", F.lit(f)) for f in range(size)]
        return [F.sum(weight).alias(f"_w{i}"), *(F.sum(weight * v).alias(f"_m{i}_{f}") for f, v in enumerate(x)), *(F.sum(weight * v * v).alias(f"_v{i}_{f}") for f, v in enumerate(x))]

    def params(found: DataFrame, spread: dict | None) -> dict:
        out = {}
        for r in found.collect():  # one row a refit
            w_ = [max(r[f"_w{i}"], 1e-9) for i in range(k)]
            m = [[r[f"_m{i}_{f}"] / w_[i] for f in range(size)] for i in range(k)]
            v = spread[r["refit"]] if spread else [[max(r[f"_v{i}_{f}"] / w_[i] - m[i][f] ** 2, 0.0) + 1e-6 for f in range(size)] for i in range(k)]
            out[r["refit"]] = ([x / sum(w_) for x in w_], m, v)
        return out

    def frame(p: dict) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(r, *x) for r, x in sorted(p.items())], "refit int, _p array<double>, _mean array<array<double>>, _var array<array<double>>"))  # one row a refit

    def posterior(d: DataFrame) -> DataFrame:
        def log_like(i: int) -> Column:
            x = [(F.get("_x", F.lit(f)), F.get(F.get("_mean", F.lit(i)), F.lit(f)), F.get(F.get("_var", F.lit(i)), F.lit(f))) for f in range(size)]
            return F.ln(F.get("_p", F.lit(i))) + sum((-0.5 * (F.ln(v) + (a - m) * (a - m) / v) for a, m, v in x), F.lit(0.0))

        d = d.withColumn("_l", F.array(*(log_like(i) for i in range(k))))
        d = d.withColumn("_e", F.transform("_l", lambda v: F.exp(v - F.array_max("_l"))))
        return d.withColumn("_r", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)))

    start = past.groupBy("refit").agg(*(c for i in range(k) for c in sums((F.col("_half") == i).cast("double"), i)), *(F.var_pop(F.get("_x", F.lit(f))).alias(f"_a{f}") for f in range(size)))
    spread = {r["refit"]: [[r[f"_a{f}"] + 1e-6 for f in range(size)]] * k for r in start.select("refit", *(f"_a{f}" for f in range(size))).collect()}
    model = params(start, spread)
    for _ in range(iterations):
        seen = posterior(past.join(frame(model), "refit"))
        model = params(seen.groupBy("refit").agg(*(c for i in range(k) for c in sums(F.get("_r", F.lit(i)), i))), None)
    aligned = align_states(frame(model), [], "_mean", "refit", k)
    period = F.floor((F.col("_s") - history) / every).cast("int")
    now = posterior(rows.filter(F.col("_s") >= history).withColumn("refit", period).join(F.broadcast(aligned), "refit"))
    probabilities = F.transform("aligned", lambda i: F.get("_r", i))
    now = now.withColumn("probabilities", probabilities)
    return now.select(time, "refit", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int").alias("state"), "probabilities")
