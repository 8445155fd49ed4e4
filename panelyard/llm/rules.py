"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule bounds a measure, or a measure as a share of another.  ``measured`` takes the
measures of a text from its words and lines in one expression: inner values (the
words, the lines, the hashes of the word windows) are bound once and handed on, so no
text is split twice.  Windows are compared by hash only to find who may be equal;
windows of equal hashes are compared as words.

Cases: null text is the empty text: no words, no lines, ``base_failed``; a share of
nothing is null and breaks no rule; ids take no part, so null ones and repeated rows
are judged like others; a text of any length takes memory in proportion to itself;
other columns are not read (``keep`` returns them); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import fresh

SPACE, WINDOW, LETTER = r"[\x20\x09-\x0D]+", 8, r"[A-Za-zÀ-ɏ]"
#: Frequent words of the languages of the corpus.
STOP_WORDS = tuple(dict.fromkeys((
    "the of and to a in is that for it was on with be as by this are at from "  # English
    "der die und den von zu das sich mit auf des für ist nicht im dem ein eine als "  # German
    "de la que el en y los se del las por un no con su una es para al lo "  # Spanish
    "le et les du une pour est qui dans par pas au sur avec"  # French
).split()))


@dataclass(frozen=True)
class Rule:
    """``measure`` (over ``per``, if named) lies from ``low`` to ``high``, or the text fails."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


#: What every text is held to first.
BASE = (Rule("few_words", "n_words", low=20), Rule("repeated_words", "n_repeat_words", "n_words", high=0.30))
#: The table of thresholds.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=3, high=10),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("letters", "n_letter_words", "n_words", low=0.7),
    Rule("stop_words", "n_stop_words", "n_words", low=0.05),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.4),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_letter_words", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(array, test))


def repeated(words: Column, size: int = WINDOW) -> Column:
    """How many of the words stand in a window of ``size`` words that the text holds twice or more."""
    starts = F.when(F.size(words) > size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.struct(F.xxhash64(*(F.get(words, i + (k - 1)) for k in range(size))).alias("h"), i.alias("at")))

    def covered(windows: Column) -> Column:
        window = lambda at: F.slice(words, at, F.lit(size))
        equal = lambda x, other: F.coalesce((x["h"] == other["h"]) & (window(x["at"]) == window(other["at"])), F.lit(False))
        twice = F.filter(windows, lambda x, k: equal(x, F.get(windows, k + 1)) | equal(x, F.get(windows, k - 1)))
        own = lambda at: F.transform(at, lambda i, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - i, F.lit(size))))  # noqa: E731  the words up to the next such window
        return let(F.sort_array(F.transform(twice, lambda x: x["at"])), lambda at: F.aggregate(own(at), F.lit(0), lambda a, b: a + b))

    some = lambda w: F.size(F.array_distinct(F.transform(w, lambda x: x["h"]))) < F.size(w)
    return let(hashes, lambda w: F.when(some(w), let(F.sort_array(w), covered)).otherwise(0))


def measured(text: Column) -> Column:
    """A struct of ``MEASURES``, all long, of one text."""

    def of(words: Column, lines: Column) -> Column:
        plain = lambda w: F.regexp_replace(F.lower(w), "[.,;:]+$", "")
        found = {
            "n_words": F.size(words),
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
            "n_letter_words": count_of(words, lambda w: w.rlike(LETTER)),
            "n_stop_words": count_of(words, lambda w: plain(w).isin(*STOP_WORDS)),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_bullet_lines": count_of(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")),
            "n_ellipsis_lines": count_of(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")),
            "n_repeat_words": repeated(words),
        }
        return F.struct(*(found[m].cast("long").alias(m) for m in MEASURES))

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words, lambda w: let(lines, lambda n: of(w, n)))


def broken(rule: Rule, of: Callable[[str], Column]) -> Column:
    """Whether a text with the measures ``of`` breaks the rule; never null."""
    value = of(rule.measure).cast("double") if rule.per is None else F.try_divide(of(rule.measure).cast("double"), of(rule.per).cast("double"))
    tests = [value < float(rule.low)] if rule.low is not None else []
    tests += [value > float(rule.high)] if rule.high is not None else []
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def judged(docs: DataFrame, also: dict[str, Column], rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """``also``, ``MEASURES``, base_failed, failed (names of the broken rules) and kept for each row of ``docs``."""

    def verdict(m: Column) -> Column:
        bad = lambda some: F.array_compact(F.array(*(F.when(broken(r, lambda name: m[name]), r.name) for r in some)).cast("array<string>"))
        names = bad((*base, *rules))
        return F.struct(*(m[x].alias(x) for x in MEASURES), (F.size(bad(base)) > 0).alias("base_failed"), names.alias("failed"), (F.size(names) == 0).alias("kept"))

    found = let(let(F.coalesce(F.col("text"), F.lit("")), measured), verdict)
    (own,) = fresh(docs, "judged")
    return docs.select(*(c.alias(k) for k, c in also.items()), found.alias(own)).select(*also, f"{own}.*")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, ``MEASURES``, base_failed, failed, kept for each row of ``docs``."""
    return judged(docs, {"doc_id": F.col("doc_id")}, rules)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, with their columns."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return judged(docs, {"row": whole}, rules).filter("kept").select("row.*")
