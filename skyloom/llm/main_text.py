"""Main texts of web pages: the contiguous region of greatest score, words counting for it and tags against it.

A page becomes a sequence of text runs and tags.  A word scores by how likely its enclosing elements are to be part of an
article, a tag takes away by how unlikely they are; a linear scan finds the region of greatest sum, and what elements of
menus, notices, adverts, comments and the like hold within it is left out.  Weights come from labelled pages: those of
exactly one <article>, whose elements (a name with the words of its class, id and role) are counted inside and outside
of it.  Counts are smoothed by a prior for each element, low for the names and words of ``BOILERPLATE``.  Elements that
enclose the article, and those within another outside element, say nothing.

Markup is read as browsers do: comments, raw text of scripts and styles, quoted attributes, unclosed paragraphs and items.
A null page is an empty one and has an empty text, as has a page of tags alone; pages are taken whole, however long, in
time that grows with their length; repeated rows and null ids stay row by row; no rows give no rows; without labelled
pages the priors decide.  Of other columns only those to be kept are looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: At most about so many pages are drawn, by a hash of their html, to learn weights from.
LABELLED = 20_000
#: Weight of the prior in pages, and the priors.
STRENGTH, LIKELY, UNLIKELY = 8.0, 0.95, 0.05
#: Cost in words of a tag within text, of another tag, of one in unlikely elements, and of leaving a lone article.
PHRASE_TAG, TAG, OUTSIDE, LEAVE = 1e-6, 0.01, 0.5, 200.0

# Names and words by which authors mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs byline-share comment comments complementary consent contentinfo cookie cookies "
    "dialog disqus disclaimer footer form header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Of these, what heads an article when it stands in one.
HEADING = frozenset(["header", "banner", "masthead"])
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("template select option optgroup button svg canvas object audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WRAPPERS = frozenset(["html", "head", "body"])
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var picture ruby rt rp output math".split())
#: Cells and breaks part words; these part neither words nor blocks.
SPACES = frozenset(["br", "td", "th"])
PHRASING = INLINE | DROPPED | (VOID - {"br", "hr"})
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

ATTRIBUTE = r"""[^\s=>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+"""
MARK = re.compile("<(?=[a-zA-Z/!?])")
TAG_PATTERN = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE}|=)*+)>")
NAMED = re.compile(r"""(?:^|[\s/"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile("[a-z]+")
COMMENT_END = re.compile("--!?>")
LONE = {name: re.compile(rf"<{name}[\s/>]", re.IGNORECASE) for name in ("article", "main")}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", run), ("open", name, attributes) and ("close", name, ""), in order; raw and dropped text is left out."""
    at = 0
    while at < len(page):
        mark = MARK.search(page, at)
        if mark is None:
            yield "text", "", page[at:]
            return
        tag = mark.start()
        if tag > at:
            yield "text", "", page[at:tag]
        m = TAG_PATTERN.match(page, tag)
        if m:
            name = m[2].lower()
            at = m.end()
            if m[1]:
                yield "close", name, ""
            elif name in RAW:
                end = RAW_END[name].search(page, at)
                at = len(page) if end is None else (page.find(">", end.end()) + 1 or len(page))
            else:
                yield "open", name, m[3]
        elif page.startswith("<!--", tag):
            end = COMMENT_END.search(page, tag + 2)
            at = end.end() if end else len(page)
        elif page[tag + 1].isalpha():
            return  # the page ends within a tag
        else:
            at = page.find(">", tag) + 1 or len(page)


def features(name: str, attributes: str) -> list[str]:
    words = [w for m in NAMED.finditer(attributes) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())] if attributes else []
    return [f"{name}.{w}" for w in dict.fromkeys(words)] or [name]


def listed(feature: str, heads: bool) -> bool:
    """Whether a feature is of boilerplate by its name or word; headings only count outside of articles."""
    return any(x in BOILERPLATE and not (heads and x in HEADING) for x in feature.split("."))


class Elements:
    """The open elements of a page, closed as browsers do."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, object]] = []
        self.open: Counter = Counter()

    def pop(self) -> tuple[str, object]:
        name, value = self.stack.pop()
        self.open[name] -= 1
        return name, value

    def push(self, name: str, value: object) -> None:
        self.stack.append((name, value))
        self.open[name] += 1

    def make_room(self, name: str) -> None:
        """Closes the paragraph, item or cell that an element of this name ends."""
        if name in CLOSES:
            ended, within = CLOSES[name]
            ended = ended.split()
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ended:
                    while len(self.stack) > i:
                        self.pop()
                    break
                if self.stack[i][0] in within or self.stack[i][0] not in INLINE | {"p"}:
                    break
        if name not in PHRASING and self.open["p"]:
            i = len(self.stack) - 1
            while i >= 0 and self.stack[i][0] in INLINE:
                i -= 1
            if i >= 0 and self.stack[i][0] == "p":
                while len(self.stack) > i:
                    self.pop()

    def close(self, name: str) -> bool:
        """Closes the nearest element of the name, if one is open; inline ones not across others."""
        if not self.open[name]:
            return False
        if name in INLINE:
            i = len(self.stack) - 1
            while self.stack[i][0] in INLINE and self.stack[i][0] != name:
                i -= 1
            if self.stack[i][0] != name:
                return False
        while self.pop()[0] != name:
            pass
        return True


def lone_mark(page: str) -> str | None:
    """article, or else main, if the page has exactly one."""
    for name, pattern in LONE.items():
        found = pattern.finditer(page)
        if next(found, None) is not None:
            return name if next(found, None) is None else None
    return None


def label_counts(page: str) -> Counter | None:
    """(feature, inside) of the elements of a page of one article, or None."""
    if lone_mark(page) != "article":
        return None
    elements, seen = Elements(), []  # seen: [features, parent, inside, encloses the article]
    for kind, name, more in tokens(page):
        if kind == "close":
            elements.close(name)
        elif kind == "open" and name not in VOID:
            elements.make_room(name)
            parent = elements.stack[-1][1] if elements.stack else -1
            inside = parent >= 0 and (seen[parent][2] or seen[parent][3] == "article")
            seen.append([features(name, more), parent, inside, "article" if name == "article" else ""])
            if name == "article":
                for _, i in elements.stack:
                    seen[i][3] = "encloses"
            elements.push(name, len(seen) - 1)
    counts: Counter = Counter()
    for names, parent, inside, role in seen:
        if not role and (inside or parent < 0 or seen[parent][3] == "encloses"):
            counts.update((f, inside) for f in names if not (inside and listed(f, True)))
    return counts


Weights = Mapping[str, tuple[float, float]]  # feature: how often inside, and outside


def likelihood(names: list[str], weights: Weights, heads: bool) -> float:
    """How likely an element is to be part of an article: by its least likely feature."""
    out = 1.0
    for f in names:
        inside, outside = weights.get(f, (0, 0))
        if heads:
            outside = 0 if f.split(".")[-1] in HEADING else outside
        prior = UNLIKELY if listed(f, heads) else LIKELY
        out = min(out, (STRENGTH * prior + inside) / (STRENGTH + inside + outside))
    return out


def tag_score(name: str, here: float, _: float, in_article: bool) -> float:
    if name in PHRASING:
        return -PHRASE_TAG
    return -TAG if in_article or here >= 0.5 else -TAG - OUTSIDE * (1 - here)


def scored(page: str, weights: Weights) -> list[tuple[float, bool, str]]:
    """(score, whether it may be part of the text, text run, or else a line break or space for a tag)."""
    lone, elements, out = lone_mark(page), Elements(), []
    here = (LIKELY, LIKELY, False)  # likelihood, the same without forms (one may enclose the whole page), within an article
    for kind, name, more in tokens(page):
        if kind == "text":
            gain = max(0.0, 2 * here[0] - 1)
            out.append((gain * len(html.unescape(more).split()) if gain else 0.0, gain > 0, more))
            continue
        mark = " " if name in SPACES else "" if name in PHRASING else "\n"
        if kind == "open" and name not in VOID and name not in WRAPPERS:
            elements.make_room(name)
            here = elements.stack[-1][1] if elements.stack else (LIKELY, LIKELY, False)
            if name == lone:
                here = (LIKELY, LIKELY, True)
            else:
                code = elements.open["pre"] or elements.open["code"]  # its spans have classes of their own
                own = 0.0 if name in DROPPED else 1.0 if code else likelihood(features(name, more), weights, here[2])
                if name in ("article", "main"):
                    here = (min(here[1], own), min(here[1], own), True)
                else:
                    here = (min(here[0], own), here[1] if name == "form" else min(here[1], own), here[2])
            elements.push(name, here)
            out.append((-LEAVE if name == lone else tag_score(name, *here), False, mark))
        elif kind == "close":
            inner = here
            closed = elements.close(name)
            here = elements.stack[-1][1] if elements.stack else (LIKELY, LIKELY, False)
            out.append((-LEAVE if name == lone and closed else tag_score(name, *inner), False, mark))
        else:
            out.append((tag_score(name, LIKELY, LIKELY, False), False, mark))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first of the ranges of greatest positive sum; (0, 0) if there is none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks parted by empty lines, white space within one by single spaces."""
    if not page:
        return ""
    parts = scored(page, weights)
    first, last = best_region([s for s, _, _ in parts])
    blocks: list[list[str]] = [[]]
    for score, is_text, run in parts[first:last]:
        if is_text:
            blocks[-1].append(html.unescape(run))
        elif run == "\n" and score < 0 and blocks[-1]:
            blocks.append([])
        elif run == " " and score < 0:
            blocks[-1].append(" ")
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def learn_weights(pages: DataFrame, column: str = "html", labelled: int = LABELLED) -> dict[str, tuple[float, float]]:
    """Counts of the elements of labelled pages; at most about ``labelled`` pages are drawn, so the table is bounded too.
    What was seen less than three times is left to the prior."""
    rows = pages.count()
    drawn = pages.select(F.col(column).cast("string").alias("html"))
    if rows > labelled:
        drawn = drawn.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(1_000_000 * labelled / rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0):
                total.update(label_counts(page.as_py() or "") or {})
            names = [f for f, _ in total]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["feature", "inside", "n"])

    counts = drawn.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside")
    )
    return {r["feature"]: (float(r["inside"]), float(r["outside"])) for r in counts.where("inside + outside >= 3").collect()}


def main_texts(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html", weights: Weights | None = None) -> DataFrame:
    """The kept columns, text, and n_chars, its code points."""
    weights = learn_weights(pages, column) if weights is None else weights
    rows = pages.select(*keep, F.col(column).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), weights) for page in batch.column(len(keep))]
            cols = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, StructType([rows.schema[c] for c in keep]).add("text", "string").add("n_chars", "long"))
