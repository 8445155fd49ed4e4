"""Rotation of industries and concepts: bridges from groups to members, returns, churn, greedy selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions import frames


def weighted_return(members: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, weighted_return: by yesterday's weight; rows without a return still weigh."""
    return members.groupBy(*by).agg(frames.safe_ratio(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("weighted_return"), F.count(value).alias("members"))


def breadth(members: DataFrame, by: list[str], value: str, null_counts: bool = False) -> DataFrame:
    """by, breadth: share of positive values; missing ones are left out, or count as not positive."""
    up = F.col(value) > 0
    return members.groupBy(*by).agg(F.avg((F.coalesce(up, F.lit(False)) if null_counts else up).cast("double")).alias("breadth"))


def churn(bridge: DataFrame, calendar: DataFrame, lag: int = 5, group: str = "concept_code") -> DataFrame:
    """trade_date, group, members, common, churn: against the membership ``lag`` sessions before; a self-join on the session's number."""
    numbered = calendar.select("trade_date").distinct().withColumn("_s", F.row_number().over(Window.orderBy("trade_date")))  # one row a session
    b = bridge.select("trade_date", group, "ts_code").distinct().join(F.broadcast(numbered), "trade_date")
    before = b.select((F.col("_s") + lag).alias("_s"), group, "ts_code", F.lit(1).alias("_was"))
    joined = b.join(before, ["_s", group, "ts_code"], "left")
    sizes = before.groupBy("_s", group).agg(F.count("*").alias("_n"))
    now = joined.groupBy("trade_date", "_s", group).agg(F.count("*").alias("members"), F.count("_was").alias("common"))
    both = now.join(sizes, ["_s", group])
    return both.select("trade_date", group, "members", "common", (1 - frames.safe_ratio(F.col("common"), F.col("members") + F.col("_n") - F.col("common"))).alias("churn"))


def relative_rotation(returns: DataFrame, group: str, value: str, window: int = 10, momentum: int = 5) -> DataFrame:
    """``returns`` with rs_ratio, rs_momentum and quadrant: relative strength against the date's mean and its change."""
    day = Window.partitionBy("trade_date")
    w = Window.partitionBy(group).orderBy("trade_date")
    out = returns.withColumn("_rel", F.col(value) - F.avg(value).over(day))
    out = out.withColumn("_rs", frames.rolling(F.col("_rel"), window, "sum", w=w)).withColumn("rs_ratio", 100 + 10 * frames.zscore(F.col("_rs")))
    out = out.withColumn("rs_momentum", F.col("rs_ratio") - F.lag("rs_ratio", momentum).over(w))
    quadrant = F.when((F.col("rs_ratio") >= 100) & (F.col("rs_momentum") >= 0), "leading").when(F.col("rs_ratio") >= 100, "weakening").when(F.col("rs_momentum") >= 0, "improving").when(F.col("rs_momentum").isNotNull(), "lagging")
    return out.withColumn("quadrant", quadrant).drop("_rel", "_rs")


def transitions(states: DataFrame, entity: str, state: str) -> DataFrame:
    """``states`` with previous, changed (true on the first row) and days in the current run."""
    w = Window.partitionBy(entity).orderBy("trade_date")
    out = states.withColumn("previous", F.lag(state).over(w)).withColumn("changed", ~F.col(state).eqNullSafe(F.col("previous")) | (F.row_number().over(w) == 1))
    run = F.sum(F.col("changed").cast("int")).over(w)
    return out.withColumn("_run", run).withColumn("days", F.row_number().over(Window.partitionBy(entity, "_run").orderBy("trade_date"))).drop("_run")


def top_by_cluster(scores: DataFrame, by: list[str], score: str, cluster: str, n: int, code: str = "ts_code") -> DataFrame:
    """The best ``n`` of each group with one of a cluster at most: best of each cluster first, then best of those."""
    order = [F.col(score).desc_nulls_last(), F.col(code)]
    first = scores.filter(F.col(score).isNotNull()).withColumn("_c", F.row_number().over(Window.partitionBy(*by, cluster).orderBy(*order))).filter("_c = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n).drop("_c")


def greedy_distinct(scores: DataFrame, by: list[str], score: str, members: str, n: int, most_overlap: float = 0.5, pool: int = 30, code: str = "concept_code") -> DataFrame:
    """The best ``n`` of each group whose Jaccard overlap with every accepted one stays below ``most_overlap``.

    Acceptance depends on what was accepted before, so each group's ``pool`` best
    candidates (the pool is the feature's own) are walked in a grouped function.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), code))
    best = scores.filter(F.col(score).isNotNull()).withColumn("_r", rank).filter(F.col("_r") <= pool).select(*by, code, score, members, "_r")
    kinds = {f.name: f.dataType.simpleString() for f in best.schema.fields}

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, set]] = []
        pdf = pdf.sort_values("_r", ignore_index=True)
        for i, own in enumerate(pdf[members]):
            s = set(own)
            if len(kept) < n and all(len(s & t) < most_overlap * max(1, len(s | t)) for _, t in kept):
                kept.append((i, s))
        return pdf.iloc[[i for i, _ in kept]][[*by, code, score]].assign(rank=range(1, len(kept) + 1))

    return best.groupBy(*by).applyInPandas(walk, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, code, score)) + ", rank int")


def retained(ranks: DataFrame, entity: str, admit: int, keep: int) -> DataFrame:
    """``ranks`` with held: admitted at rank ``admit`` or better, kept while at ``keep`` or better.

    Since the last row on which it was admitted, the entity never fell below ``keep``:
    two running counts, no loop.
    """
    w = Window.partitionBy(entity).orderBy("trade_date")
    out = ranks.withColumn("_drop", F.sum((F.col("rank") > keep).cast("int")).over(w))
    entered = F.max(F.when(F.col("rank") <= admit, F.lit(1))).over(Window.partitionBy(entity, "_drop").orderBy("trade_date"))
    return out.withColumn("held", (F.col("rank") <= keep) & F.coalesce(entered == 1, F.lit(False))).drop("_drop")


def placebo_ring(scores: DataFrame, score: str, code: str = "ts_code") -> DataFrame:
    """``scores`` with placebo: each code gets the next code's score of the date, the last the first's."""
    codes = scores.select(code).distinct()
    w = Window.orderBy(code)  # one row a code
    ring = codes.select(F.col(code), F.coalesce(F.lead(code).over(w), F.min(code).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    other = scores.select("trade_date", F.col(code).alias("_next"), F.col(score).alias("placebo"))
    return scores.join(ring, code).join(other, ["trade_date", "_next"], "left").drop("_next")


def shuffle_placebo(rows: DataFrame, value: str, by: tuple[str, ...] = ("trade_date",), code: str = "ts_code", salt: str = "placebo", missing: str = "stay") -> DataFrame:
    """``rows`` with placebo: the values of each cell ``by`` (a date, or a date and state) dealt anew, the same on every run.

    The permutation joins two ranks: the row of the i-th hash of salt, cell and code gets
    the value of the i-th code.  Missing values ``stay`` where they are, or ``move`` with
    the others (labels); rows of a cell that has no name get none.
    """
    known = F.col(value).isNotNull() if missing == "stay" else F.lit(True)
    named = F.lit(True)
    for c in by:
        named = named & F.col(c).isNotNull()
    cell = Window.partitionBy(*by, "_dealt")
    h = F.md5(F.concat_ws(":", F.lit(salt), *(F.col(c).cast("string") for c in (*by, code))).cast("binary"))
    d = rows.withColumn("_dealt", named & known)
    d = d.withColumns({"_to": F.row_number().over(cell.orderBy(h, code)), "_from": F.row_number().over(cell.orderBy(code))})
    given = d.filter("_dealt").select(*by, F.lit(True).alias("_dealt"), F.col("_from").alias("_to"), F.col(value).alias("placebo"))
    return d.join(given, [*by, "_dealt", "_to"], "left").select(*rows.columns, "placebo")


def membership_leaks(members: DataFrame, calendar: DataFrame, group: str = "concept_code", code: str = "ts_code") -> DataFrame:
    """trade_date, group, code, kind of what a backfill of the latest membership changes: members ``leaked`` to dates on which they were none, and ``lost`` ones.

    Only dates on which a pair's membership differs are made: the gaps between its
    sessions, each exploded by itself.
    """
    days = calendar.select("trade_date").distinct().withColumn("_s", F.row_number().over(Window.orderBy("trade_date")))  # one row a session
    latest, end = members.agg(F.max("trade_date")).scalar(), days.agg(F.max("_s")).scalar()
    pair = Window.partitionBy(group, code).orderBy("_s")
    whole = pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one shuffle and one sort for all
    m = members.select("trade_date", group, code).join(F.broadcast(days), "trade_date").withColumn("_latest", latest)
    m = m.withColumns({"_stays": F.max("trade_date").over(whole) == F.col("_latest"), "_before": F.coalesce(F.lag("_s").over(pair), F.lit(0))})
    m = m.filter(F.col("_before") < F.col("_s"))  # a pair's second row of a session goes
    lost = m.filter(~F.col("_stays")).select("trade_date", group, code, F.lit("lost").alias("kind"))
    last = F.col("trade_date") == F.col("_latest")
    spans = F.array(F.struct((F.col("_before") + 1).alias("a"), (F.col("_s") - 1).alias("b")), F.struct((F.col("_s") + 1).alias("a"), F.when(last, F.col("_end")).otherwise(0).alias("b")))
    gaps = m.filter("_stays").withColumn("_end", end).select(group, code, F.explode(spans).alias("g")).filter("g.a <= g.b").select(group, code, F.explode(F.sequence("g.a", "g.b")).alias("_s"))
    leaked = gaps.join(F.broadcast(days), "_s").select("trade_date", group, code, F.lit("leaked").alias("kind"))
    return leaked.unionByName(lost)


def lookahead_effect(members: DataFrame, leaks: DataFrame, values: DataFrame, value: str, group: str = "concept_code", code: str = "ts_code") -> DataFrame:
    """trade_date, group, members_then, members_backfilled, leaked, lost, and the mean ``value`` of the members then and of the backfilled ones."""
    kinds = leaks.filter("kind = 'lost'").select("trade_date", group, code, F.lit(True).alias("_lost"))
    own = members.select("trade_date", group, code).distinct().join(kinds, ["trade_date", group, code], "left").select("trade_date", group, code, F.lit(True).alias("_then"), F.col("_lost").isNull().alias("_now"))
    new = leaks.filter("kind = 'leaked'").select("trade_date", group, code, F.lit(False).alias("_then"), F.lit(True).alias("_now"))
    rows = own.unionByName(new).join(values.select("trade_date", code, F.col(value).alias("_v")), ["trade_date", code], "left")
    count = lambda test: F.sum(test.cast("long"))
    then, now = F.col("_then"), F.col("_now")
    return rows.groupBy("trade_date", group).agg(
        count(then).alias("members_then"), count(now).alias("members_backfilled"), count(now & ~then).alias("leaked"), count(then & ~now).alias("lost"),
        F.avg(F.when(then, F.col("_v"))).alias("mean_then"), F.avg(F.when(now, F.col("_v"))).alias("mean_backfilled"),
    )


def salted_sums(rows: DataFrame, by: list[str], sums: dict[str, Column], distinct: dict[str, str], salt: str, salts: int = 16) -> DataFrame:
    """by, sums and counts of distinct values, added up in ``salts`` parts of each group first.

    A part holds the rows whose ``salt`` column hashes to it, so a popular group's rows go
    to as many tasks; counts of distinct values of ``salt`` itself add up, as a value has
    one part.
    """
    if set(distinct.values()) - {salt}:
        raise ValueError("only distinct values of the salt column add up over its parts")
    parts = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts))).groupBy(*by, "_salt").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.count_distinct(c).alias(n) for n, c in distinct.items()))
    return parts.groupBy(*by).agg(*(F.sum(n).alias(n) for n in (*sums, *distinct)))


def bridge(members: DataFrame, stocks: DataFrame, salts: int = 16, least: int = 8, most: int = 500, group: str = "concept_code", code: str = "ts_code") -> DataFrame:
    """trade_date, group and what its members say of it on that date: counts, coverage, capital, amount, breadth of both kinds, its return and whether it is usable.

    stocks: trade_date, code, mv, amount, up (the state that breadth counts; missing is
    no), step (the day's return) and mv_before.  A date's return is that of the members
    of the session before, by yesterday's capital.
    """
    key = ["trade_date", code]
    known = stocks.select(code).distinct()
    held = members.join(known, code, "left_semi")
    up = F.coalesce(F.col("up"), F.lit(False)).cast("double")
    now = salted_sums(
        held.join(stocks.select(*key, "mv", "amount", "up"), key), ["trade_date", group],
        {"concept_mv": F.col("mv"), "_up_mv": F.col("mv") * up, "_up": up, "_rows": F.lit(1), "concept_amount": F.col("amount")}, {"matched_member_count": code}, code, salts,
    )
    source = salted_sums(members, ["trade_date", group], {"source_member_count": F.lit(1)}, {}, code, salts)
    days = stocks.select("trade_date").distinct().withColumn("_next", F.lead("trade_date").over(Window.orderBy("trade_date")))  # one row a session
    later = held.join(F.broadcast(days), "trade_date").select(F.col("_next").alias("trade_date"), group, code).filter("trade_date is not null")
    moved = salted_sums(later.join(stocks.select(*key, "step", "mv_before"), key), ["trade_date", group], {"_weight": F.col("mv_before"), "_moved": F.col("mv_before") * F.col("step")}, {}, code, salts)
    out = source.join(now, ["trade_date", group], "left").join(moved, ["trade_date", group], "left")
    matched = F.coalesce("matched_member_count", F.lit(0))
    return out.select(
        "trade_date", group, "source_member_count", matched.alias("matched_member_count"), frames.safe_ratio(matched, F.col("source_member_count")).alias("member_match_coverage"), "concept_mv", "concept_amount",
        frames.safe_ratio(F.col("_up"), F.col("_rows")).alias("breadth_equal"), frames.safe_ratio(F.col("_up_mv"), F.col("concept_mv")).alias("breadth_capital"), frames.safe_ratio(F.col("_moved"), F.col("_weight")).alias("concept_return"), matched.between(least, most).alias("usable"),
    )
