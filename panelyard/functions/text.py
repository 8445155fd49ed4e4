"""Columns of names: themes by keyword, benchmarks without their wording."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of a benchmark that says nothing about which index it is.
WORDING = ("收益率", "价格指数", "全收益指数", "指数", "100%", "×", "*", "（", "）", "(", ")", "人民币", "CNY")


def theme(name: Column, rules: Iterable[tuple[str, Iterable[str]]], other: str = "other_theme") -> Column:
    """The first theme of ``rules`` (theme, keywords) of which the name holds a keyword."""
    out = F.lit(None).cast("string")
    for label, keywords in reversed(list(rules)):
        held = F.lit(False)
        for k in keywords:
            held = held | F.contains(name, F.lit(k))
        out = F.when(F.coalesce(held, F.lit(False)), F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def benchmark_key(name: Column) -> Column:
    """A benchmark's name in capitals, without its WORDING and anything but digits, Latin and Chinese letters."""
    out = F.upper(F.coalesce(name, F.lit("")))
    for token in WORDING:
        out = F.replace(out, F.lit(token), F.lit(""))
    return F.regexp_replace(out, r"[^0-9A-Z一-鿿]", "")
