"""HTML extraction by wrapper induction.

A page becomes a tree in which siblings of one label (tag and class or id names;
for unnamed containers also whether they hold links, prose or bare text) are one
node.  The trees of a host are aligned with the host's commonest tree by simple
tree matching.  Every text of every node is counted over the host's different pages,
which are told apart by their longest block.  A text that stands at a node of nearly
every page makes that node constant there: it is template.  So are nodes that rotate
few texts over many pages (adverts) or hold mostly links (menus).  Other nodes whose
texts vary are slots.  The slots decide where the main text is:

* if article or main elements hold most of the slots' prose, it is there;
* otherwise it is in the lowest node that holds all slots of prose.

A page's main text is the blocks under the node that aligns with that place, in page
order, without the template.  Names of elements (nav, footer, aside, form and the like,
and containers whose class or id says that they are one) decide where counting can't:
of what varies as prose does (reader comments, sidebars), and on hosts of fewer than
``LEAST_PAGES`` different pages, from which nothing is template by count.  Inside the
main place a constant heading among slots stays, and other constant text among them
is template from ``INNER_PAGES`` different pages on.  Copies of a page are one.

All pages take part: trees and texts are counted by host, node and text with
partial sums before any shuffle, so a host with a third of the pages is spread
over all tasks.  In the last join wrappers are broadcast while they are small, and
beyond that Spark splits hot hosts (adaptive skew join).

Cases: null html is the empty page, whose text is empty; a null url or one
without a host belongs to the host ""; repeated rows each come back; other columns
are not read; of trees that are equally common the longest, then the last in
order, is the model; parsing, folding and matching take near-linear time in the
page, however long, deep or unbalanced it is; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import written
from panelyard.llm.urls import host_of

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr td th caption figcaption".split())
RAW = set("script style noscript template textarea iframe svg object title".split())
NEVER = set("head nav footer aside form button select menu dialog".split())
MAIN = {"article", "main"}
CLOSES_ITSELF = set("li dt dd tr td th option p".split())
# Names of containers that hold no main text, whole; as a part of a name only those of the first line.
PARTS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu nav navbar navigation newsletter popup promo sidebar sponsor sponsored subscribe widget".split())
NAMES = PARTS | set("alert complementary contentinfo dialog login masthead modal notice notices overlay recommended related replies reply search share sharing side-bar social toolbar".split())
ADVERTS = set("ad ads advert adverts advertisement sponsored".split())

NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SPECIAL = re.compile(r"[>\"']")
DIGITS = re.compile(r"\d+")
SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
LEAST_PAGES, INNER_PAGES, CONSTANT, ROTATING = 8, 20, 0.9, 0.25


def tokens(html: str) -> Iterator[tuple[int, int, str, bool]]:
    """Start, end, tag name ('' for what is skipped) and whether it closes, of each piece of markup; in linear time.

    A tag ends at the first ``>`` outside quotes, or if its quotes don't close at the first ``>``.
    """
    memo: dict[int, int] = {}
    at, special, size = 0, -1, len(html)

    def from_quote(quote: int) -> int:
        chain = []
        while quote not in memo:
            chain.append(quote)
            close = html.find(html[quote], quote + 1)
            m = SPECIAL.search(html, close + 1) if close >= 0 else None
            if m is None or m[0] == ">":
                memo[quote] = m.start() if m else -1
            else:
                quote = m.start()
        for k in chain:
            memo[k] = memo[quote]
        return memo[quote]

    while (start := html.find("<", at)) >= 0:
        at, kind = start + 1, html[start + 1 : start + 2]
        if kind in ("!", "?"):
            comment = html.startswith("--", at + 1)
            end = html.find("-->" if comment else ">", at)
            end = size if end < 0 and comment else end + (3 if comment else 1)
            if end > at:
                yield start, end, "", False
                at = end
            continue
        closing = kind == "/"
        name = NAME.match(html, at + closing)
        if not name:
            continue
        if special < name.end():
            m = SPECIAL.search(html, name.end())
            if m is None:
                return  # no tag ends any more
            special = m.start()
        end = special if html[special] == ">" else from_quote(special)
        end = html.find(">", at) if end < 0 else end
        if end < 0:
            continue
        at, tag = end + 1, name[0].lower()
        if tag in RAW and not closing:
            if html[end - 1] != "/":
                close = _closing(tag).search(html, at)
                at = close.end() if close else size
            yield start, at, "", False
        else:
            yield start, at, tag, closing


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def excluded(tag: str, names: list[str], in_main: bool) -> bool:
    """Whether an element is never main text, by its tag and the names of its class, id and role; inside articles only by whole names."""
    lower = [n.lower() for n in names]
    if tag in INLINE:
        return any(n in ADVERTS for n in lower)
    if tag in NEVER or tag == "header" and not in_main:
        return True
    if tag in (TEXTUAL if in_main else TEXTUAL - {"li", "td"}) or tag in MAIN or tag in ("body", "html"):
        return False
    if in_main:
        return any(n in NAMES for n in lower)
    parts = {p.lower() for n in names for p in SPLIT.split(n)}
    return any(n in NAMES for n in lower) or bool(parts & PARTS) or "header" in parts


class Page:
    """Nodes in page order (tag, label, parent, never: in an element that is no main text), and blocks (node, text, characters in links)."""

    def __init__(self, html: str):
        self.tag, self.label, self.parent, self.never = [""], [""], [-1], [False]
        self.blocks: list[tuple[int, str, int]] = []
        stack, open_tags, parts, links, in_link, at = [0], Counter(), [], 0, False, 0
        muted, mute_tag, mute_level = 0, "", 0  # an inline advert is left out, and splits no block

        def flush() -> None:
            nonlocal links
            if parts:
                text = "".join(parts)
                parts.clear()
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((stack[-1], text, min(links, len(text))))
                links = 0

        def add(text: str) -> None:
            nonlocal links
            parts.append(text)
            links += len(text.strip()) if in_link else 0

        for start, end, tag, closing in tokens(html):
            if muted and len(stack) < mute_level:
                muted = 0  # its block ended before it
            if start > at and not muted:
                add(html[at:start])
            at = end
            if not tag:
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag == "a":
                in_link = not closing
            if muted and tag == mute_tag:
                muted += -1 if closing else 1
                continue
            if closing:
                if open_tags[tag]:
                    flush()
                    while True:
                        gone = self.tag[stack.pop()]
                        open_tags[gone] -= 1
                        if gone == tag:
                            break
                elif tag not in INLINE:
                    flush()
                continue
            token = html[start:end]
            names = sorted({w for found in NAMED.findall(token) for w in "".join(found).split()}) if "=" in token else []
            bad = excluded(tag, names, bool(open_tags["article"] or open_tags["main"]))
            if tag in INLINE and bad and not muted:
                muted, mute_tag, mute_level = 1, tag, len(stack)
            if tag in INLINE or tag in VOID and tag != "hr":
                continue
            flush()
            if tag in VOID:
                continue
            while len(stack) > 1 and (self.tag[stack[-1]] == "p" or self.tag[stack[-1]] == tag and tag in CLOSES_ITSELF):
                open_tags[self.tag[stack.pop()]] -= 1
            up = stack[-1]
            stack.append(len(self.tag))
            open_tags[tag] += 1
            self.tag.append(tag)
            named = "" if tag in TEXTUAL else "".join("." + DIGITS.sub("", w) for w in names)
            self.label.append(("!" if bad else "") + tag + named)
            self.parent.append(up)
            self.never.append(self.never[up] or bad)
        if not muted or len(stack) < mute_level:
            add(html[at:])
        flush()

    def folded(self) -> tuple[tuple[list[int], list[str]], list[int]]:
        """The folded tree as parents and labels of its nodes, and the folded node of each node."""
        n = len(self.tag)
        chars, links, prose = [0] * n, [0] * n, [t in TEXTUAL and t not in ("li", "td") for t in self.tag]
        for k, text, linked in self.blocks:
            chars[k] += len(text)
            links[k] += linked
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            chars[up] += chars[k]
            links[up] += links[k]
            prose[up] = prose[up] or prose[k] and chars[k] > 0
        ids: dict[tuple[int, str], int] = {}
        parents, labels, number = [-1], [""], [0] * n
        for k in range(1, n):
            label = self.label[k]
            if label == self.tag[k] and label not in TEXTUAL and label not in MAIN:
                label += "/" + ("l" if 2 * links[k] > chars[k] else "p" if prose[k] else "t")
            key = (number[self.parent[k]], label)
            if key not in ids:
                ids[key] = len(labels)
                parents.append(key[0])
                labels.append(label)
            number[k] = ids[key]
        return (parents, labels), number


def heaviest(places: list[int], weights: list[int]) -> tuple[int, list[int]]:
    """Weight and indices of the heaviest subsequence of strictly increasing places (all different)."""
    ends, best, at, back = [], [], [], []  # a staircase: a later end is heavier
    for i, (place, weight) in enumerate(zip(places, weights)):
        k = bisect_left(ends, place)
        total = weight + (best[k - 1] if k else 0)
        back.append(at[k - 1] if k else -1)
        stop = bisect_left(best, total + 1, k)
        ends[k:stop], best[k:stop], at[k:stop] = [place], [total], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return (best[-1] if best else 0), out[::-1]


def match(a: tuple[list[int], list[str]], b: tuple[list[int], list[str]]) -> tuple[int, list[int]]:
    """Simple tree matching of folded trees: most nodes matched parent by parent and in order, and of each node of a its node of b (-1: none).

    Labels of siblings differ, so a child has one possible partner, and the best
    matching of two lists of children is the heaviest subsequence in order.
    """
    (pa_, la), (pb, lb) = a, b
    kid = {(pb[j], lb[j]): j for j in range(1, len(lb))}
    to, kids = [0] + [-1] * (len(la) - 1), [[] for _ in la]
    for i in range(1, len(la)):
        if to[pa_[i]] >= 0:
            to[i] = kid.get((to[pa_[i]], la[i]), -1)
            if to[i] >= 0:
                kids[pa_[i]].append(i)
    weight, kept = [1] * len(la), [False] * len(la)
    for i in range(len(la) - 1, -1, -1):
        if kids[i]:
            total, chosen = heaviest([to[k] for k in kids[i]], [weight[k] for k in kids[i]])
            weight[i] += total
            for c in chosen:
                kept[kids[i][c]] = True
    for i in range(1, len(la)):
        if not kept[i] or to[pa_[i]] < 0:
            to[i] = -1
    return weight[0], to


@lru_cache(maxsize=64)
def _tree(shape: str) -> tuple[list[int], list[str]]:
    return tuple(json.loads(shape))


@lru_cache(maxsize=256)
def aligned(shape: str, model: str) -> list[int]:
    """Of each node of a page's tree the node of the model's tree, or -1."""
    return match(_tree(shape), _tree(model))[1]


def summary(html: str) -> tuple[int, str, list[int], list[int], list[int], list[int]]:
    """Hash of the longest block, the folded tree as text, and node, hash, characters and linked characters of each different text of a node."""
    page = Page(html)
    tree, number = page.folded()
    seen = {(number[k], zlib.crc32(text.encode("utf-8", "surrogatepass"))): (len(text), linked) for k, text, linked in page.blocks}
    longest = max((text for k, text, _ in page.blocks if not page.never[k]), key=len, default="")
    body = xxhash.xxh64_intdigest(longest.encode("utf-8", "surrogatepass")) - 2**63
    return body, json.dumps(tree, separators=(",", ":")), [k for k, _ in seen], [c for _, c in seen], [c for c, _ in seen.values()], [x for _, x in seen.values()]


HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


def place_of(shape: str, slots: list[tuple[int, int, int, int, int, int]], constant: list[tuple[int, int, int, int, int]]) -> tuple[int, list[int], list[int], list[tuple[int, int]]]:
    """The node of a host's tree that holds its main text; nodes in it and nodes anywhere that are template as a whole; constant texts that are template.

    slots: node, pages, different texts, texts, characters, linked characters;
    constant: node, hash, texts, characters, linked characters of the texts of nearly every page.
    """
    parents, labels = _tree(shape)
    tags = [re.match(r"!?([^./]*)", label)[1] for label in labels]
    named = [False] * len(labels)
    for k in range(1, len(labels)):
        named[k] = named[parents[k]] or labels[k].startswith("!")
    held, rotating, linked, pages_of = [0] * len(labels), [], [], {}
    taken = Counter(), Counter()
    for node, _, _, chars, links in constant:
        taken[0][node] += chars
        taken[1][node] += links
    for node, pages, different, texts, chars, links in slots:
        pages_of[node] = pages
        chars, links = chars - taken[0][node], links - taken[1][node]
        if 2 * links > chars:
            linked.append(node)
        elif pages >= LEAST_PAGES and different <= ROTATING * texts:
            rotating.append(node)
        elif not named[node]:
            held[node] = chars
    total, whole = sum(held), list(held)
    for k in range(len(labels) - 1, 0, -1):
        whole[parents[k]] += whole[k]
    in_main = [False] * len(labels)
    mains = []
    for k in range(1, len(labels)):
        in_main[k] = in_main[parents[k]]
        if tags[k] in MAIN and not in_main[k] and whole[k]:
            in_main[k] = True
            mains.append(k)
    template = sorted(linked + rotating)
    if mains and 2 * sum(whole[k] for k in mains) >= total:
        place, inner = lowest(parents, mains), []
    else:
        place, inner = lowest(parents, [k for k in range(len(labels)) if held[k]]), template
    inside = [k == place for k in range(len(labels))]
    beside = set()  # parents of slots
    for k in range(1, len(labels)):
        inside[k] = inside[k] or inside[parents[k]]
        if held[k]:
            beside.add(parents[k])
    stays = lambda k: inside[k] and parents[k] in beside and tags[k] in TEXTUAL and (tags[k] in HEADINGS or pages_of.get(k, 0) < INNER_PAGES)
    return place, inner, template, [(k, crc) for k, crc, *_ in constant if not stays(k)]


def lowest(parents: list[int], nodes: list[int]) -> int:
    """The lowest common ancestor of nodes (0 of none)."""
    if not nodes:
        return 0
    at = nodes[0]
    for k in nodes[1:]:
        while at != k:  # a parent's number is smaller than its child's
            at, k = (parents[at], k) if at > k else (at, parents[k])
    return at


def sorted_blocks(html: str, model: str | None = None, place: int = 0, inner: frozenset = frozenset(), template: frozenset = frozenset(), constant: frozenset = frozenset()) -> tuple[list[str], int, int, int]:
    """The page's main blocks, and how many others are template, are told by a name, or stand elsewhere."""
    page = Page(html)
    tree, number = page.folded()
    parents, labels = tree
    to = aligned(json.dumps(tree, separators=(",", ":")), model) if model is not None else [0] + [-1] * (len(labels) - 1)
    inside = [to[0] == place] + [False] * (len(labels) - 1)
    for k in range(1, len(labels)):
        inside[k] = inside[parents[k]] or to[k] == place
    if not any(inside) or model is None:  # no wrapper, or one that this page does not fit
        inside = [False] * len(labels)
        for k in range(1, len(labels)):
            inside[k] = inside[parents[k]] or re.match(r"[^./]*", labels[k])[0] in MAIN
        inside = inside if any(inside) else [True] * len(labels)
    out, by_count, by_name, elsewhere = [], 0, 0, 0
    for k, text, _ in page.blocks:
        own, at = number[k], to[number[k]]
        fixed = at >= 0 and (at, zlib.crc32(text.encode("utf-8", "surrogatepass"))) in constant
        if fixed or at in (inner if inside[own] else template):
            by_count += 1
        elif page.never[k]:
            by_name += 1
        elif not inside[own]:
            elsewhere += 1
        else:
            out.append(text)
    return out, by_count, by_name, elsewhere


def main_text(html: str, model: str | None = None, place: int = 0, inner: frozenset = frozenset(), template: frozenset = frozenset(), constant: frozenset = frozenset()) -> str:
    """Blocks of the page under the node that aligns with ``place`` of the host's tree ``model``, without the template."""
    return "\n\n".join(sorted_blocks(html, model, place, inner, template, constant)[0])


def induce(pages: DataFrame) -> DataFrame:
    """host, model, place, inner, template, constant: the wrapper of each host of ``pages`` (host, html)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(summary, batch.column(1).to_pylist()))) or [()] * 6
            kinds = (pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["host", "body", "shape", "node", "crc", "chars", "links"])

    trees = pages.select("host", "html").mapInArrow(summarise, "host string, body long, shape string, node array<long>, crc array<long>, chars array<long>, links array<long>")
    trees = trees.groupBy("host", "body").agg(F.min(F.struct("shape", "node", "crc", "chars", "links")).alias("t")).select("host", "t.*")
    trees = written(trees, "page-trees")
    models = trees.groupBy("host", "shape").agg(F.count("*").alias("n")).groupBy("host").agg(F.max_by("shape", F.struct("n", F.length("shape"), "shape")).alias("model"))
    models = written(models, "page-models")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for host, shape, nodes, crcs, chars, links, model in zip(*(c.to_pylist() for c in batch.columns)):
                to, there = aligned(shape, model), set()
                for a, crc, n, linked in zip(nodes, crcs, chars, links):
                    if to[a] >= 0:
                        seen[(host, to[a], crc, n, linked)] += 1
                        there.add(to[a])
                for b in there:
                    seen[(host, b, -1, 0, 0)] += 1  # a page that has text at the node
            cols = list(zip(*seen)) or [()] * 5
            kinds = (pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, seen.values()], kinds)], ["host", "node", "crc", "chars", "links", "n"])

    counted = trees.join(models, "host").select("host", "shape", "node", "crc", "chars", "links", "model").mapInArrow(align, "host string, node long, crc long, chars long, links long, n long")
    texts = counted.groupBy("host", "node", "crc").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("chars")).alias("chars"), F.sum(F.col("n") * F.col("links")).alias("links"))
    texts = written(texts, "page-texts")
    text = F.col("crc") >= 0
    nodes = texts.groupBy("host", "node").agg(F.sum(F.when(~text, F.col("n"))).alias("pages"), F.sum(text.cast("long")).alias("different"), F.sum(F.when(text, F.col("n"))).alias("texts"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    often = texts.filter(text & (F.col("n") >= int(CONSTANT * LEAST_PAGES))).join(nodes.filter(F.col("pages") >= LEAST_PAGES).select("host", "node", "pages"), ["host", "node"]).filter(F.col("n") >= CONSTANT * F.col("pages"))
    # A node's texts of nearly every page are no more than a page has; its nodes are those of one tree.
    constant = often.groupBy("host").agg(F.collect_list(F.struct("node", "crc", "n", "chars", "links")).alias("constant"))
    slots = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "different", "texts", "chars", "links")).alias("slots"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                place, inner, template, fixed = place_of(r["model"], [tuple(x.values()) for x in r["slots"] or []], [tuple(x.values()) for x in r["constant"] or []])
                rows.append((r["host"], r["model"], place, inner, template, [f"{k} {crc}" for k, crc in fixed]))
            kinds = (pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], ["host", "model", "place", "inner", "template", "constant"])

    wrappers = models.join(slots, "host", "left").join(constant, "host", "left").select("host", "model", "slots", "constant")
    return written(wrappers.mapInArrow(placed, "host string, model string, place long, inner array<long>, template array<long>, constant array<string>"), "page-wrappers")


@lru_cache(maxsize=64)
def _pairs(constant: tuple[str, ...]) -> frozenset:
    return frozenset(tuple(map(int, x.split(" "))) for x in constant)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``; n_template, n_named, n_elsewhere: blocks left out by counts, by a name, and for standing outside the main place."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    wrappers = induce(rows).withColumnRenamed("host", "of_host")

    @F.pandas_udf("text string, n_template int, n_named int, n_elsewhere int")
    def body(html: pd.Series, model: pd.Series, place: pd.Series, inner: pd.Series, template: pd.Series, constant: pd.Series) -> pd.DataFrame:
        found = [sorted_blocks(h, m, int(p), frozenset(i), frozenset(t), _pairs(tuple(c))) for h, m, p, i, t, c in zip(html, model, place, inner, template, constant)]
        return pd.DataFrame([("\n\n".join(blocks), *n) for blocks, *n in found], columns=["text", "n_template", "n_named", "n_elsewhere"])

    joined = rows.join(wrappers, F.col("host") == F.col("of_host"))
    made = joined.select("page_id", "url", body("html", "model", "place", "inner", "template", "constant").alias("b"))
    return made.select("page_id", "url", "b.text", F.length("b.text").cast("long").alias("n_chars"), "b.n_template", "b.n_named", "b.n_elsewhere")
