"""Spelling variants: words that differ by one code point, found by forward and backward automata.

The corpus' words are counted by Spark.  They are dealt to blocks twice, by ranges of
the word and by ranges of the word read backward.  A task turns a block into a minimal
acyclic automaton whose arcs carry offsets: their sum along a word's path is the word's
number in the block (a perfect hash), under which its count stands.  Two words at
distance one share the first or the second half of either, so a word is looked up
forward (first half exact, then one error) and backward (second half exact, then one
error), in the blocks whose range meets its exact half; what both directions find
counts once.  No pair is formed but those at distance one.

A block holds about ``BLOCK`` words, and the words looked up in it stream past: a task's
memory does not grow with the vocabulary, however many words share a half.

Cases: null text is the empty text; a null doc_id is the empty id; repeated rows count
each; ties go to the smaller word in code-point order; a very long run of letters is a
word like others, with an automaton of its length; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import written

BLOCK, LEAST_CHARS, LEAST_TIMES, DELETED, OVER = 20_000, 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ABOVE = "Ā"  # above every letter of a word


class Automaton:
    """Minimal acyclic automaton of sorted different words; the offsets on a word's path add up to its number."""

    def __init__(self, words: list[str]):
        nexts: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        done: list[int] = []
        path, before = [0], ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                state, letter = path.pop(), before[len(path) - 1]
                key = (self.final[state], *nexts[state].items())
                if key in known:
                    nexts[path[-1]][letter] = known[key]
                else:
                    known[key] = state
                    done.append(state)

        for word in words:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            close(same)
            for letter in word[same:]:
                nexts[path[-1]][letter] = len(nexts)
                path.append(len(nexts))
                nexts.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            before = word
        close(0)
        below = [0] * len(nexts)  # words that end at a state or after it
        self.arcs: list[dict[str, tuple[int, int]]] = [{} for _ in nexts]
        for state in [*done, 0]:  # children come first
            total = int(self.final[state])
            for letter, to in nexts[state].items():
                self.arcs[state][letter] = (to, total)
                total += below[to]
            below[state] = total

    def walk(self, word: str, start: int = 0, stop: int | None = None, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        """State and number after ``word[start:stop]``, or None where no word goes on so."""
        for i in range(start, len(word) if stop is None else stop):
            step = self.arcs[state].get(word[i])
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that share the first ``exact`` letters and differ by one inserted, deleted or replaced letter after them."""
        found: set[int] = set()

        def ends(start: int, state: int, number: int) -> None:
            end = self.walk(word, start, None, state, number)
            if end and self.final[end[0]]:
                found.add(end[1])

        at = self.walk(word, 0, exact)
        for i in range(exact, len(word) + 1):
            if at is None:
                break
            state, number = at
            before, own = word[i - 1] if i > exact else None, word[i] if i < len(word) else None
            for letter, (to, offset) in self.arcs[state].items():
                if letter != before:  # the same letter one place earlier gives the same word
                    ends(i, to, number + offset)
                if own is not None and letter != own:
                    ends(i + 1, to, number + offset)
            if own is not None and own != before:
                ends(i + 1, state, number)
            at = self.walk(word, i, min(i + 1, len(word)), state, number)
        return found


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """word and n, its occurrences, of the corpus' words; every ``DELETED``-th run of letters (by hash) loses one."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"), F.length("run").alias("size"))
    cut = F.pmod("h", "size").cast("int")
    word = F.when(F.col("h") % DELETED == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.col("size")))).otherwise(F.col("run"))
    words = runs.filter((F.col("size") > least_chars) | (F.col("h") % DELETED != 0)).select(word.alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_times)


def _found(words: DataFrame, backward: bool, blocks: int) -> DataFrame:
    """word, near, near_n: words that share the exact half in one direction and differ by one letter in the other."""
    key = F.reverse("word") if backward else F.col("word")
    keyed = words.select(key.alias("key"), "n")
    ranges = written(keyed.repartitionByRange(blocks, "key").select("key", "n", F.spark_partition_id().alias("block")), "variant-blocks")
    firsts = ranges.groupBy("block").agg(F.min("key").alias("first")).orderBy("block").collect()  # one row for each BLOCK words
    names, cuts = [r["block"] for r in firsts], [r["first"] for r in firsts]
    half = lambda size: size - size // 2 if backward else size // 2  # noqa: E731  the letters that are exact in this direction

    @F.pandas_udf("array<int>")
    def met(keys: pd.Series) -> pd.Series:
        """The blocks whose range meets the words that begin with the exact half."""
        out = []
        for k in keys:
            exact = k[: half(len(k))]
            low = max(0, bisect_right(cuts, exact) - 1)
            out.append(names[low : max(low + 1, bisect_left(cuts, exact + _ABOVE))])
        return pd.Series(out)

    asked = ranges.select(F.explode(met("key")).alias("block"), F.lit(1).alias("asks"), "key", F.lit(0).cast("long").alias("n"))
    rows = ranges.select("block", F.lit(0).alias("asks"), "key", "n").unionByName(asked)
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", "asks", "key")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, built, keys, counts = None, None, [], []
        for batch in batches:
            found = []
            for b, asks, key, n in zip(batch["block"], batch["asks"], batch["key"], batch["n"]):
                if b != block:
                    block, built, keys, counts = b, None, [], []
                if not asks:
                    keys.append(key)
                    counts.append(n)
                    continue
                built = built or Automaton(keys)
                found += [(key, keys[k], counts[k]) for k in built.near(key, half(len(key)))]
            turned = [(a[::-1], b[::-1], n) for a, b, n in found] if backward else found
            yield pd.DataFrame(turned, columns=["word", "near", "near_n"])

    return rows.mapInPandas(search, "word string, near string, near_n long")


def near_words(words: DataFrame, block_words: int = BLOCK) -> DataFrame:
    """word, near, near_n: all pairs of different words of ``words`` (word, n) at distance one, from either side."""
    blocks = max(1, -(-words.count() // block_words))
    both = _found(words, False, blocks).unionByName(_found(words, True, blocks))
    return both.repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last of the forms that follow from word, of ``forms`` (word, form); a form occurs more often than its word.

    Each round doubles the steps that are taken; it is written, and rounds grow with the logarithm of the longest chain.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        new = written(now.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not new.filter("moved").head(1):
            return new.select("word", "root")
        now = new.select("word", "root")


def group(docs: DataFrame, over: int = OVER, block_words: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of ``docs``.

    form: the commonest near word, if it occurs ``over`` times as often or more; root: the last form of a chain of them.
    """
    words = written(vocabulary(docs), "variant-words")
    best = near_words(words, block_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").withColumn("form", F.when(-F.col("best.less") >= over * F.col("n"), F.col("best.near")))
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), -F.col("best.less")).alias("form_n")), "variant-forms")
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
