"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio. DataFrame functions only.

Two first-order Markov models over character classes are trained by counting
transitions: one on labelled random strings (hex, base64 and base32 spellings of
hashes), one on ordinary identifiers (fixed words and those of a bounded sample of documents,
alone and joined as snake, kebab and camel case, and in capitals).  A candidate, a maximal run of
``[A-Za-z0-9+/_=-]`` of ``min_length`` or more characters, is a secret if its mean
log-likelihood ratio per transition is above ``threshold``.  The table of ratios
has a fixed size (classes squared) and is a literal of the plan.

The base patterns are found leftmost and non-overlapping for each kind: the text
is split at the matches, and the lengths of pieces and matches give the spans.

Cases: null text is the empty text, which has no spans; rows are judged one by
one, so repeated rows and null ids change nothing, and other columns are not read
(``redact`` returns them); texts of any length take time in proportion to it
(sums over matches go by blocks); an empty corpus leaves the identifier model at
its smoothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import fresh, texts

# The base patterns and the least lengths that count.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more: a shorter run can't hold a longer one
HEX = r"[0-9a-f]{16,}"  # maximal runs, so the same as [0-9a-f]+ of 16 or more
KINDS = ("assign", "access", "hex", "markov")

# Ordinary words, labelled samples that are there whatever the corpus.
ORDINARY = (
    "about account action active address after amount array before between body buffer cache called change check class client close code color column common config content context control count create current "
    "data date default delete description device display document during element enable error event every example false field file filter first format from function group handler header height image index "
    "input instance item language large length level library list local location message method model module name network next number object option order other output package page parameter parent password "
    "path people pattern period place point position previous process product project property query question random range read record reference region remote report request resource response result return "
    "right round sample schema screen search second section secret select server service session setting should simple single size source start state status string style submit system table target template "
    "text their there these think through time title token total track transfer type under update upload user value variable vector version view volume water where which while width window without word world write years"
)

CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
K = len(CLASSES)
#: Added to every count of a transition.
SMOOTHING = 0.1


def let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, total, combine) -> Column:
    """Of each place of an array, ``total`` of all values before it; by blocks of 128, so that no sum starts at the beginning."""
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(v) - 1, F.lit(0)), 7)), lambda b: total(F.slice(v, b * 128 + 1, F.lit(128))))
    ahead = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
    own = lambda v, i: total(F.slice(v, F.shiftright(i, 7) * 128 + 1, i.bitwiseAND(127)))
    return let(values, lambda v: let(blocks(v), lambda sums: let(ahead(sums), lambda a: F.transform(v, lambda _, i: combine(F.get(a, F.shiftright(i, 7)), own(v, i))))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _max(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(-1))


def spans_of(text: Column, pattern: str, kind: int, keep=None, unit=F.length) -> Column:
    """Structs (start, kind, end, found) of the matches of ``pattern``, in code points or another ``unit``; ``keep`` filters the matched strings."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    span = lambda at, x: F.struct((at + unit(x["gap"])).alias("start"), F.lit(kind).alias("kind"), (at + unit(x["gap"]) + unit(x["hit"])).alias("end"), x["hit"].alias("found"))
    zipped = let(found, lambda hits: F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")))
    walked = let(zipped, lambda z: let(running(F.transform(z, lambda x: unit(x["gap"]) + unit(x["hit"])), _sum, lambda a, b: a + b), lambda before: F.transform(z, lambda x, i: span(F.get(before, i), x))))
    if keep is not None:
        walked = F.filter(walked, lambda s: keep(s["found"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _transitions(strings: DataFrame) -> DataFrame:
    """a, b, n: counts of neighbouring characters of the column ``s``."""
    letters = F.filter(F.split("s", ""), lambda c: c != "")
    pairs = strings.select(F.explode(let(letters, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y)))).alias("p"))
    return pairs.groupBy("p").agg(F.count("*").alias("n")).select(F.instr(F.lit(CLASSES), F.substring("p", 1, 1)).alias("a"), F.instr(F.lit(CLASSES), F.substring("p", 2, 1)).alias("b"), F.col("p").alias("p"), "n").filter("a > 0 and b > 0")


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """Labelled samples of class random: spellings of hashes of 0 to n - 1."""
    h = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(h)), "=+$", "")
    return spark.range(n).select(F.explode(F.array(h, base64, F.translate(base64, "+/", "-_"), F.upper(F.translate(base64, "+/-_", "2345")))).alias("s"))


def identifiers(docs: DataFrame, sample_docs: int) -> DataFrame:
    """Labelled samples of class ordinary: the words of the ``sample_docs`` documents of the smallest hashes, and compounds of neighbours."""
    sample = texts(docs, "doc_id").filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    plain = F.translate("text", "áàâäãéèêëíìîïóòôöõúùûüçñß", "aaaaaeeeeiiiiooooouuuucns")
    words = sample.select(F.filter(F.split(plain, "[^A-Za-z0-9]+"), lambda w: w.rlike("^[A-Za-z]{2,}$")).alias("ws"))
    next_to = let(F.col("ws"), lambda ws: F.zip_with(ws, F.slice(ws, F.lit(2), F.size(ws)), lambda w, v: F.struct(w.alias("w"), F.coalesce(v, F.lit("")).alias("v"))))
    known = docs.sparkSession.range(1).select(F.split(F.lit(ORDINARY), " ").alias("ws"))
    two = words.unionAll(known).select(F.explode(next_to).alias("x")).select("x.w", "x.v")
    return two.select(F.explode(F.array(F.col("w"), F.lower("w"), F.concat_ws("_", "w", "v"), F.concat_ws("_", F.upper("w"), F.upper("v")), F.concat_ws("-", F.lower("w"), F.lower("v")), F.concat("w", F.initcap("v")))).alias("s")).filter("length(s) >= 2")


def train(docs: DataFrame, sample_docs: int = 200, n_random: int = 1000) -> list[float]:
    """Log-likelihood ratios random : ordinary of all transitions, row by row; K * K numbers, smoothed."""

    def log_probabilities(strings: DataFrame) -> list[list[float]]:
        counts = [[SMOOTHING] * K for _ in range(K)]
        for r in _transitions(strings).collect():  # at most K * K rows
            counts[r["a"] - 1][r["b"] - 1] += r["n"]
        return [[math.log(c / sum(row)) for c in row] for row in counts]

    random, ordinary = log_probabilities(random_strings(docs.sparkSession, n_random)), log_probabilities(identifiers(docs, sample_docs))
    return [round(r - o, 6) for rs, os in zip(random, ordinary) for r, o in zip(rs, os)]


def mean_ratio(s: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of the string ``s`` of CLASSES: one walk along it."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded into one literal
    step = lambda a, c: F.struct(c.alias("last"), (a["total"] + F.when(a["last"] > 0, F.element_at(table, (a["last"] - 1) * K + c)).otherwise(0.0)).alias("total"))
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(CLASSES), c))
    return F.aggregate(codes, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("total")), step, lambda a: a["total"]) / (F.length(s) - 1)


def with_spans(docs: DataFrame, ratios: list[float], min_length: int = 20, threshold: float = 0.6, column: str = "spans", unit=F.length) -> DataFrame:
    """``docs`` with ``column``: all spans (start, kind, end, found) of the text by start, then kind."""
    body = F.coalesce(F.col("text"), F.lit(""))
    candidate = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{min_length},}}"
    base = [
        spans_of(body, ASSIGN, 0, lambda s: F.length(F.regexp_extract(s, ASSIGN, 2)) >= ASSIGN_LEAST, unit),
        spans_of(body, ACCESS, 1, None, unit),
        spans_of(body, HEX, 2, None, unit),
    ]
    markov = spans_of(body, candidate, 3, lambda s: mean_ratio(s, ratios) > threshold, unit)
    return docs.withColumn(column, F.sort_array(F.concat(*base, markov)))


def scan(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``."""
    ratios = train(docs)
    found = with_spans(texts(docs, "doc_id"), ratios, **params)
    kinds = F.array(*map(F.lit, KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def stretches(spans: Column) -> Column:
    """Structs (start, end) of the union of ``spans``, which are in the order of their starts; spans that touch are one."""

    def merged(s: Column, before: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["start"] > F.get(before, i))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return let(opens, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p)["start"].alias("start"), F.coalesce(F.get(before, F.get(at, j + 1)), last).alias("end"))))

    ends = lambda s: running(F.transform(s, lambda x: x["end"]), _max, F.greatest)
    return let(spans, lambda s: F.when(F.size(s) > 0, let(ends(s), lambda before: merged(s, before))).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


def redact(docs: DataFrame, mark: str = "[SECRET]", **params) -> DataFrame:
    """``docs`` with each stretch of secrets in ``text`` replaced by ``mark``, and ``n_chars``, if there, counted anew.

    Positions are bytes here: a piece is cut from the text without a walk to it.
    """
    spans, clean = fresh(docs, "spans", "clean")
    found = with_spans(docs, train(docs), column=spans, unit=F.octet_length, **params).withColumn(spans, stretches(F.col(spans)))
    after = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    piece = lambda body, i: F.substring(body, after(i) + 1, F.coalesce(F.get(spans, i)["start"], F.octet_length(body)) - after(i)).cast("string")
    hit = F.size(spans) > 0
    pieces = let(F.col("text").cast("binary"), lambda body: F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: piece(body, i)))
    out = found.withColumn(clean, F.when(hit, F.array_join(pieces, mark)).otherwise(F.col("text")))
    columns = {"text": F.col(clean).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(hit, F.length(clean).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*(columns.get(c, F.col(f"`{c}`")) for c in docs.columns))
