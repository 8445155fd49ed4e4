"""Rank correlations of many pairs: a group's rows move once, as they are."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelyard.operators import gates, stats


def test_pairs_add_no_windows_and_agree_with_plain_ranks(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"trade_date": np.repeat(["a", "b", "c"], 40), **{c: rng.integers(0, 9, 120).astype(float) for c in "xyz"}})
    for c in "xyz":
        pdf.loc[rng.random(120) < 0.2, c] = None
    pdf.loc[pdf.trade_date == "c", "x"] = 4.0  # no spread
    rows = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "xyz"})
    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    made = stats.rank_correlations(rows, pairs, ["trade_date"])
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()  # a window a side of each pair made rows of a kilobyte
    for r in made.collect():
        own = pdf[pdf.trade_date == r["trade_date"]]
        assert [r[f"values_{c}"] for c in "xyz"] == [own[c].count() for c in "xyz"]
        for i, (a, b) in enumerate(pairs):
            both = own[[a, b]].dropna().rank()
            assert r[f"n{i}"] == len(both)
            want = both[a].corr(both[b]) if both[a].std() > 0 else None
            assert (r[f"r{i}"] is None) == (want is None) and (want is None or abs(r[f"r{i}"] - want) < 1e-12)


def test_a_row_of_many_slices_moves_once(spark):
    pdf = pd.DataFrame({"trade_date": [1] * 8 + [2] * 8, "x": [float(i * 5 % 8) for i in range(16)], "y": [float(i * 3 % 7) for i in range(16)], "up": [i % 3 > 0 for i in range(16)]})
    made = gates.conditional_grid(spark.createDataFrame(pdf), {"x": F.col("x")}, {"all": F.lit(True), "up": F.col("up"), "none": F.col("x") > 99, "unknown": F.lit(None).cast("boolean")}, {1: "y"})
    below = made._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[1]
    assert "Generate" not in below  # a copy of the row for each of its slices went through the shuffle and the sort
    got = {(r["trade_date"], r["condition"]): r for r in made.collect()}
    assert set(got) == {(d, c) for d in (1, 2) for c in ("all", "up")}
    for (d, c), r in got.items():
        own = pdf[(pdf.trade_date == d) & ((c == "all") | pdf.up)][["x", "y"]].rank()
        assert r["n"] == len(own) and abs(r["ic"] - own.x.corr(own.y)) < 1e-11
