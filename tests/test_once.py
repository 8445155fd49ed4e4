"""Steps that sort or make their rows once."""

import uuid

from panels import make_panel
from pyspark.sql import functions as F

from panelyard.functions import frames
from panelyard.operators import diagnostics, execution, models, residual, rotation, value
from panelyard.plans import feature_queries
from panelyard.sources import panel as versions


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_streaks_share_one_order(spark):
    said = [(d, "a", d not in (3, 6), d > 4, True, None, 20) for d in range(1, 9)]
    rows = spark.createDataFrame(said, "trade_date int, ts_code string, price_weak boolean, diffusion_weak boolean, relative_weak boolean, breakdown boolean, rank int")
    made = execution.exit_states(rows)
    assert not any("_island" in line for line in _plan(made).splitlines())
    got = [(r["price_streak"], r["dual_streak"], r["severe_streak"]) for r in made.orderBy("trade_date").collect()]
    assert got == [(1, 0, 0), (2, 0, 0), (0, 0, 0), (1, 0, 0), (2, 1, 1), (0, 0, 0), (1, 1, 1), (2, 2, 2)]


def test_picks_are_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, i, float(i), float(-i) if i != 2 else None) for i in range(6)], "trade_date int, ts_code int, x double, y double")
    made = diagnostics.top_overlap(rows, ["x", "y"], (2, 5))
    assert "WindowGroupLimit" in _plan(made)
    assert {r["top_n"]: r["mean_jaccard"] for r in made.collect()} == {2: 0.0, 5: 4 / 6}


def test_a_version_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    p = spark.createDataFrame(make_panel(days=4, stocks=3)).withColumns({"st_status_known": F.lit(True), "circ_mv_cny": F.col("total_mv_cny")})
    root = f"/tmp/versions-{uuid.uuid4().hex}"
    versions.publish(p.mapInPandas(count, p.schema), root, "n")
    assert made.value == 12
    back = versions.load(spark, root)
    assert sorted(back.columns) == sorted(p.columns) and versions.content_hash(back) == versions.content_hash(p)


def test_refits_do_not_make_the_sessions_again(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    daily = spark.createDataFrame([(i, (i * 37 % 11) / 10, (i * 53 % 7) / 10) for i in range(40)], "trade_date int, a double, b double")
    out = models.mixture_walk_forward(daily.mapInPandas(count, daily.schema), ["a", "b"], 2, 20, 10, iterations=3)
    assert out.count() == 20 and made.value == 40


def test_folds_and_fits_make_their_rows_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    said = [(d, s, (d * 7 + s * 3) % 5 / 10, (d * 3 + s * 5) % 7 / 10, s / 10 + d % 3, float(s)) for d in range(170) for s in range(6)]
    panel = spark.createDataFrame(said, "trade_date int, ts_code int, step double, fwd double, turnover_rate double, log_total_mv double")
    monkeypatch.setattr(feature_queries, "future", lambda *_: panel.mapInPandas(count, panel.schema))
    assert feature_queries.model_walk_forward(spark, "").count() == 17 and made.value == len(said)


def test_weights_leave_the_rows_where_they_are(spark):
    rows = spark.createDataFrame([(d, s) for d in range(3) for s in range(d + 1)], "trade_date int, ts_code int")
    made = models.weights(rows, 1)
    assert not any("Window [count(1)" in line for line in _plan(made).splitlines())
    assert {(r["trade_date"], r["weight"]) for r in made.collect()} == {(0, 0.25), (1, 0.25), (2, 1 / 3)}


def test_value_features_share_windows_and_fits(spark):
    assert residual.least_squares(spark.createDataFrame([(1, i, i * 1.5 + i % 2, float(i)) for i in range(9)], "trade_date int, ts_code int, y double, x double"), "y", ["x"], ["trade_date"], 5, "r", slopes=True).filter("slopes is not null").count() == 1
    wide = frames.winsorize_mad(spark.createDataFrame([(1, float(i), float(i * i)) for i in range(9)], "trade_date int, a double, b double"), ["a", "b"], 1.0)
    assert sum("Window [" in line for line in _plan(wide).splitlines()) == 2  # each column had two of its own
    assert sorted((r["a"], r["b"]) for r in wide.collect())[::8] == [(2.0, 1.0), (6.0, 31.0)]
    panel = spark.createDataFrame([(d, s, (d * 7 + s * 3) % 5 / 10, (d * 3 + s * 5) % 7 / 10) for d in range(30) for s in range(2)], "trade_date int, ts_code int, x double, y double")
    rows, corrs = value._moment_corrs(panel, "x", "y", 8, 3)
    made = rows.select("trade_date", "ts_code", "x", "y", *(c.alias(f"c{k}") for k, c in enumerate(corrs)))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("avg(") <= 8  # five for each lag before
    pdf = made.toPandas().sort_values(["ts_code", "trade_date"])
    for _, own in pdf.groupby("ts_code"):
        for k in range(4):
            want = own["x"].rolling(8).corr(own["y"].shift(k))
            assert (own[f"c{k}"].isna() == want.isna()).all() and (own[f"c{k}"] - want).abs().max() < 1e-9


def test_memberships_are_sorted_once_and_repeats_go(spark):
    m = spark.createDataFrame([(1, "c", 7), (1, "c", 7), (3, "c", 7), (3, "c", 7), (2, "c", 8), (2, "c", 8)], "trade_date int, concept_code string, ts_code int")
    found = rotation.membership_leaks(m, spark.createDataFrame([(d,) for d in range(1, 5)], "trade_date int"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [" in line and "ts_code" in line for line in plan.splitlines())  # their distinct rows were hashed first
    assert sorted(tuple(r) for r in found.collect()) == [(2, "c", 7, "leaked"), (2, "c", 8, "lost"), (4, "c", 7, "leaked")]


def test_value_features_send_wide_rows_to_their_cell_once(spark):
    """Means of peers come from sums by session and industry; the chain's own exchange alone moves rows by cell."""
    panel = make_panel(6, 8).assign(log_total_mv=1.0, log_circ_mv=1.0, turnover_rate=1.0, **{c: 1.0 for c in value.FUNDAMENTALS})
    plan = _plan(value.value_features(spark.createDataFrame(panel), value.Parameters(least=4)))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("trade_date" in line.split("],")[-2] and "industry_l1_code" in line.split("],")[-2] for line in windows)
