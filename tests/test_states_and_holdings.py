"""Placebos, state alignment, mixtures and holdings against plain loops."""

import random
from collections import Counter
from datetime import date, timedelta
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import holdings, models, rotation


def day(k):
    return date(2024, 1, 1) + timedelta(days=k)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(day(d), f"{s:02d}", rng.choice(["up", "down", None]), None if rng.random() < 0.2 else rng.randint(0, 5) / 2) for d in range(9) for s in range(20)]
    return rows, spark.createDataFrame(rows, "trade_date date, ts_code string, state string, v double").repartition(3)


def test_placebo_keeps_cells(spark, scored):
    rows, df = scored
    got = rotation.shuffle_placebo(df, "v", ("trade_date", "state")).collect()
    assert len(got) == len(rows) and {(r.trade_date, r.ts_code, r.state, r.v) for r in got} == set(rows)
    cells = lambda k: Counter((r.trade_date, r.state, r[k]) for r in got if r.state is not None)
    assert cells("v") == cells("placebo")
    assert all((r.placebo is None) == (r.v is None or r.state is None) for r in got)
    assert sum(r.placebo != r.v for r in got if r.v is not None and r.state) > 20
    again = rotation.shuffle_placebo(df.repartition(7), "v", ("trade_date", "state")).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    other = rotation.shuffle_placebo(df, "v", ("trade_date", "state"), salt="x").collect()
    assert {tuple(r) for r in other} != {tuple(r) for r in got}


def test_labels_move_with_their_gaps(spark, scored):
    rows, df = scored
    got = rotation.shuffle_placebo(df, "v", missing="move").collect()
    assert Counter((r.trade_date, r.v) for r in got) == Counter((r.trade_date, r.placebo) for r in got)
    assert any((r.v is None) != (r.placebo is None) for r in got)
    assert rotation.shuffle_placebo(df.limit(0), "v").count() == 0


def aligned(raw):
    order = sorted(range(len(raw[0])), key=lambda i: raw[0][i][0])
    out = [order]
    for before, now in zip(raw, raw[1:]):
        ref = [before[i] for i in out[-1]]
        out.append(list(min(permutations(range(len(now))), key=lambda p: sum((a - b) ** 2 for m, i in zip(ref, p) for a, b in zip(m, now[i])))))
    return out


@pytest.mark.parametrize("k", [2, 3, 4])
def test_alignment_against_loops(spark, k):
    rng = random.Random(k)
    series = {s: [[[rng.gauss(i, 0.8), rng.gauss(-i, 0.8)] for i in rng.sample(range(k), k)] for _ in range(12)] for s in "ab"}
    df = spark.createDataFrame([(s, t, m) for s, ms in series.items() for t, m in enumerate(ms)], "s string, t int, means array<array<double>>")
    got = {(r.s, r.t): r.aligned for r in models.align_states(df, ["s"], "means", "t", k).collect()}
    for s, raw in series.items():
        assert [got[s, t] for t in range(12)] == aligned(raw)


def test_planted_swaps_are_undone(spark):
    rng = random.Random(1)
    swaps = [rng.sample(range(3), 3) for _ in range(15)]
    means = [[[float(10 * j + t * 0.1), float(-j)] for j in swap] for t, swap in enumerate(swaps)]
    df = spark.createDataFrame(list(enumerate(means)), "t int, means array<array<double>>")
    got = {r.t: r.aligned for r in models.align_states(df, [], "means", "t", 3).collect()}
    assert all([swap[i] for i in got[t]] == [0, 1, 2] for t, swap in enumerate(swaps))
    with pytest.raises(ValueError):
        models.align_states(df, [], "means", "t", 7)


def plain_mixture(x, k, history, every, iterations):
    """Refits, their posteriors and states, by numpy."""
    fits = []
    for begin in range(0, max(len(x) - history, 0), every):
        p = x[begin : begin + history]
        half = np.floor(np.argsort(np.lexsort((np.arange(history), p[:, 0]))) * k / history).astype(int)
        r = np.eye(k)[half]
        w, m, v = None, None, np.tile(p.var(axis=0) + 1e-6, (k, 1))
        for it in range(iterations + 1):
            n = np.maximum(r.sum(axis=0), 1e-9)
            w, m = n / n.sum(), r.T @ p / n[:, None]
            if it:
                v = np.maximum(r.T @ (p * p) / n[:, None] - m**2, 0) + 1e-6
            if it == iterations:
                break
            r = post(p, w, m, v)
        fits.append((w, m, v))
    order = aligned([f[1].tolist() for f in fits])
    out = []
    for s in range(history, len(x)):
        f = (s - history) // every
        out.append((f, post(x[s : s + 1], *fits[f])[0][order[f]]))
    return out


def post(x, w, m, v):
    like = np.log(w) - 0.5 * (np.log(v)[None] + (x[:, None] - m[None]) ** 2 / v[None]).sum(axis=2)
    e = np.exp(like - like.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_mixture_against_loops(spark):
    rng = np.random.default_rng(2)
    state = (np.arange(90) // 9) % 2
    x = np.column_stack([rng.normal(state * 4, 1), rng.normal(-state, 1)])
    df = spark.createDataFrame([(day(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "trade_date date, a double, b double").repartition(3)
    got = models.mixture_walk_forward(df, ["a", "b"], 2, 40, 11, 6).orderBy("trade_date").collect()
    want = plain_mixture(x, 2, 40, 11, 6)
    assert len(got) == len(want) == 50
    for r, (f, p) in zip(got, want):
        assert r.refit == f and np.allclose(r.probabilities, p, atol=1e-8) and r.state == int(np.argmax(p))
    assert np.mean([r.state == state[40 + i] for i, r in enumerate(got)]) > 0.8  # places stay through refits
    cut = models.mixture_walk_forward(df.filter(F.col("trade_date") < day(60)), ["a", "b"], 2, 40, 11, 6).collect()
    assert {r.trade_date: r.state for r in cut}.items() <= {r.trade_date: r.state for r in got}.items()  # no look-ahead
    assert models.mixture_walk_forward(df.limit(10), ["a", "b"], 2, 40, 11, 6).count() == 0


@pytest.fixture(scope="module")
def book(spark):
    rng = random.Random(9)
    calendar = [day(d * 2) for d in range(30)]
    signals = sorted({(rng.choice(calendar), rng.choice("abcdef")) for _ in range(60)})
    return calendar, signals, spark.createDataFrame([(d,) for d in calendar], "trade_date date"), spark.createDataFrame(signals, "trade_date date, ts_code string")


def test_holdings_against_loops(spark, book):
    calendar, signals, cal, sig = book
    at = {d: i for i, d in enumerate(calendar)}
    held = [(calendar[at[d] + k], c, d) for d, c in signals for k in range(2, 6) if at[d] + k < 30]
    lots = holdings.lots(sig, cal, 2, 4)
    assert sorted((r.trade_date, r.ts_code, r.signal_date) for r in lots.collect()) == sorted(held)
    pos = lots.withColumns({"value": F.ascii("ts_code").cast("double") - 90, "g": F.when(F.col("ts_code") < "d", "x").otherwise("y")})
    have = Counter((at[d], c) for d, c, _ in held)
    got = {at[r.trade_date]: r for r in holdings.daily_holdings(pos, cal, "value", "g").collect()}
    weights = []
    for s in range(30):
        own = {c: n * (ord(c) - 90) for (t, c), n in have.items() if t == s}
        weights.append({c: v / sum(own.values()) for c, v in own.items()})
        before, r = (weights[s - 1] if s else {}), got[s]
        assert (r.holding_count, r.unique_holding_count) == (sum(n for (t, _), n in have.items() if t == s), len(own)) and r.group_count == len({c < "d" for c in own})
        assert (r.entries, r.exits) == (len(own.keys() - before.keys()), len(before.keys() - own.keys()))
        assert abs(r.turnover - sum(abs(weights[s].get(c, 0) - before.get(c, 0)) for c in own.keys() | before.keys()) / 2) < 1e-12
        assert (r.largest_weight or 0) == pytest.approx(max(weights[s].values(), default=0))
    runs = []
    for c in "abcdef":
        days = sorted(t for t, x in have if x == c)
        for t in days:
            if t - 1 not in days:
                end = t
                while end + 1 in days:
                    end += 1
                runs.append((c, calendar[t], calendar[end], end - t + 1, end == 29))
    assert sorted(tuple(r) for r in holdings.spells(pos, cal).collect()) == sorted(runs)
    dup = {(r.trade_date, r.ts_code): r.duplicate for r in holdings.duplicate_signals(sig, cal, 2, 4).collect()}
    assert dup == {(d, c): any(x == c and at[e] < at[d] and at[e] + 5 >= at[d] + 2 for e, x in signals) for d, c in signals}
    one = holdings.holding_statistics(pos, cal, sig, "value", "g", 2, 4).first()
    closed = [n for *_, n, open_ in runs if not open_]
    assert one.average_holding_sessions == pytest.approx(np.mean(closed)) and one.ended_spells == len(closed) and one.duplicate_signal_rate == pytest.approx(np.mean(list(dup.values())))
    assert one.average_position_weight == pytest.approx(np.mean([v for w in weights for v in w.values()]))
    empty = holdings.daily_holdings(pos.limit(0), cal, "value", "g").collect()
    assert len(empty) == 30 and all(r.holding_count == 0 and r.largest_weight is None for r in empty)
