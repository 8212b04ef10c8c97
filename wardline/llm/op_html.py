"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score by the log-odds of their surroundings (the innermost structural
element) on labelled pages, tags score at or below zero by the log-odds of the tag. One linear scan finds the contiguous run
with the largest sum: the content region. Within it, words of surroundings that score below zero (an advert or a form in the
article) are left out. Labelled pages are those whose markup names one ``article``: its inside is content.

Sample: ``MAX_PAGES`` labelled pages by the smallest hash of the id, whole; the driver gets counts per kind of surroundings and tag.
Elements whose class or id names boilerplate score below zero whatever the labels say, so kinds of pages without a label are
handled by what their markup says. What wraps the content (the page, a form around it, the elements around its longest article or
main) says nothing by its name or tag, unless it is hidden. Extraction is one pass without a shuffle; a page's memory is a small multiple of its size.

The text: character references decoded, white space within a block one space, blocks joined by one space in page order.

Nulls and edge cases: a null or empty page gives an empty text and 0 characters; broken markup is read as far as it goes (an
unfinished tag is dropped, an unfinished reference stays as it is); repeated rows each get their row; extra columns are
ignored; without labelled pages the built-in scores hold.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.registry import query, table
from wardline.llm.sampling import smallest_hashes

MAX_PAGES = 2000
#: Comments, elements whose content is not markup, and tags. An unfinished one runs to the end of the page.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|math|iframe|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
STRUCTURE = frozenset("article aside body button details dialog div dl figcaption figure footer form head header html label main menu nav ol section table title ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold menus, headers, notices, forms and the like.
BOILERPLATE_TAGS = frozenset("aside button dialog footer form head header label menu nav title".split())
#: Words in class, id or role that say the same.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement adverts aside author-bio banner breadcrumb breadcrumbs byline-links comment comments consent cookie cookies "
    "disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup "
    "promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags toc toolbar widget alert".split()
)
#: Parts of a name that tells what an element has or has not, not what it is (``has-sidebar``, ``no-ads``).
STATE_NAMES = frozenset("has no non not with without".split())
#: Elements whose names are about the whole page.
UNNAMED = ("html", "body", "form")
#: Elements of a page that no form of its own holds.
PAGE_PARTS = ("h1", "header", "nav", "footer", "article", "main")
#: Scores of words before any label is seen, and of a tag.
CONTENT, NEUTRAL, BOILERPLATE = 2.0, 1.0, -1.0
TAG = -0.3
#: Bounds of learned scores: boilerplate between two parts of the content must not cut one of them off.
MOST, LEAST_WORD, LEAST_TAG = 3.0, -1.0, -1.5
#: Score of a tag, or of a left-out word, within content.
LEFT_OUT = -0.01
CONTENT_TAGS = ("article", "main")


def _says_boilerplate(name: str) -> bool:
    """Whether a name of a class, id or role, or its first or last part, is one of boilerplate."""
    if name in BOILERPLATE_NAMES:
        return True
    parts = re.split(r"[-_:]+", name)
    return not STATE_NAMES.intersection(parts) and (parts[0] in BOILERPLATE_NAMES or parts[-1] in BOILERPLATE_NAMES)


def kind_of(tag: str, attributes: str) -> str | None:
    """The kind of surroundings an element makes, None if it makes none of its own."""
    named = False
    for m in _ATTRIBUTE.finditer(attributes or ""):
        attribute, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if (attribute == "hidden" and value != "false") or (attribute == "aria-hidden" and value.strip() == "true") or (attribute == "style" and _NO_DISPLAY.search(value)):
            return "!hidden"
        if attribute in ("class", "id", "role") and tag not in UNNAMED:
            named = named or any(_says_boilerplate(name) for name in value.split())
    if named or tag in BOILERPLATE_TAGS:
        return "!" + tag
    return tag if tag in STRUCTURE else None


def inside_of(outer: str, kind: str) -> str:
    """The surroundings that an element of ``kind`` makes within ``outer``.

    Boilerplate stays boilerplate whatever is in it; within content it is marked ``~`` (to be left out, but no reason to end
    the region), and neutral structure within content is content.
    """
    if outer[0] in "!~":
        return outer
    if outer in CONTENT_TAGS:
        return "~" + kind[1:] if kind[0] == "!" else outer
    return kind


def _parts(m: re.Match) -> tuple[str, str, str]:
    """Name, closing mark and attributes of a tag; no name if it is something else."""
    return ((m[3] or m[6] or "").lower(), *((m[2], m[4]) if m[3] else (m[5], m[7])))


def wrappers(markup: list[re.Match], kinds: list[str | None], size: int) -> set[int]:
    """Places in ``markup`` of the elements that wrap a page's content, so that neither their names nor their tags tell about it.

    These are the elements around the longest article or main that is not marked itself, and forms that hold parts of the
    page or most of it.
    """
    found: set[int] = set()
    stack: list[tuple[str, int, int, bool]] = []  # name, place, start of the inside, in something hidden
    outer: dict[int, int] = {}
    forms: list[int] = []  # open ones that hold no part of the page yet
    longest, best = 0, None

    def close(depth: int, end: int) -> None:
        nonlocal longest, best
        while len(stack) > depth:
            tag, i, start, hidden = stack.pop()
            if tag in CONTENT_TAGS and kinds[i] == tag and not hidden and end - start > longest:
                longest, best = end - start, i
            elif tag == "form":
                if forms and forms[-1] == i:
                    forms.pop()
                if 2 * (end - start) > size:
                    found.add(i)

    for i, m in enumerate(markup):
        tag, closing, _ = _parts(m)
        if not tag:
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth, m.start())
                    break
        elif tag not in VOID:
            if tag in PAGE_PARTS:
                found.update(forms)
                forms.clear()
            if tag not in INLINE and stack and stack[-1][0] == "p":
                close(len(stack) - 1, m.start())
            if kinds[i] is not None:
                if tag == "body":
                    close(0, m.start())
                if stack:
                    outer[i] = stack[-1][1]
                stack.append((tag, i, m.end(), kinds[i] == "!hidden" or bool(stack and stack[-1][3])))
                if tag == "form":
                    forms.append(i)
    close(0, size)
    while best in outer:
        best = outer[best]
        found.add(best)
    return found


def read(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Items of a page in order: ("text", "", text, surroundings) and ("tag", name, "block" or "inline", surroundings)."""
    stack: list[tuple[str, str]] = [("html", "html")]
    at = 0
    markup = list(_MARKUP.finditer(page))
    kinds = [kind_of(tag, attributes) if tag and not closing and tag not in VOID else None for tag, closing, attributes in map(_parts, markup)]
    for i in wrappers(markup, kinds, len(page)):
        if kinds[i][0] == "!" and kinds[i] != "!hidden":
            kinds[i] = "div"
    for m, kind in zip(markup, kinds):
        if m.start() > at:
            yield "text", "", page[at : m.start()], stack[-1][1]
        at = m.end()
        tag, closing, _ = _parts(m)
        if not tag:
            if m[1]:
                yield "tag", m[1].lower(), "block", stack[-1][1]
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
        elif tag not in VOID:
            if tag not in INLINE and stack[-1][0] == "p":
                stack.pop()
            if kind is not None:
                if tag == "body":  # ends the head
                    stack = stack[:1]
                stack.append((tag, inside_of(stack[-1][1], kind)))
        yield "tag", ("/" if closing else "") + tag, "inline" if tag in INLINE else "block", stack[-1][1]
    if at < len(page):
        yield "text", "", page[at:], stack[-1][1]


@dataclass
class Weights:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, kind: str) -> float:
        if kind[0] == "~":
            return LEFT_OUT
        if kind in self.words:
            return self.words[kind]
        return BOILERPLATE if kind[0] == "!" else CONTENT if kind in CONTENT_TAGS else NEUTRAL

    def tag(self, name: str, kind: str) -> float:
        return LEFT_OUT if kind[0] == "~" or kind in CONTENT_TAGS else self.tags.get(name, TAG)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest positive sum, the longest such one; (0, 0) if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and total > 0 and i + 1 - start > bounds[1] - bounds[0]):
            best, bounds = total, (start, i + 1)
    return bounds


def extract(page: str | None, weights: Weights) -> str:
    """The main text of one page."""
    if not page:
        return ""
    items = list(read(page))
    scores = [weights.word(k) * len(c.split()) if a == "text" else weights.tag(b, k) for a, b, c, k in items]
    low, high = best_run(scores)
    parts: list[str] = []
    for a, _, c, k in items[low:high]:
        if a == "text":
            if weights.word(k) >= 0:
                parts.append(c)
        elif c == "block":
            parts.append("\n")
    return _SPACE.sub(" ", entities.unescape("".join(parts))).strip(" ")


def label_counts(page: str) -> Counter | None:
    """Counts of (what, name, inside) of a page that names one article; None for other pages."""
    if not page or len(re.findall(r"<article[\s>]", page, re.I)) != 1:
        return None
    counts: Counter = Counter()
    inside = False
    for a, b, c, k in read(page):
        if (a, b) == ("tag", "article"):
            inside = True
        elif (a, b) == ("tag", "/article"):
            inside = False
            counts["tag", b, False] += 1
        elif a == "tag":
            counts["tag", b, inside] += 1
        else:
            counts["word", k, inside] += len(c.split())
    return counts


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> Weights:
    """Weights from a bounded sample of labelled pages. Runs a job over it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(label_counts(page) or {})
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
            names=["what", "name", "inside", "n"],
        )

    named = pages.where(F.col("html").rlike("(?i)<article[\\s>]")).select("page_id", "html")
    ids = smallest_hashes(named.select("page_id"), max_pages, "page_id")
    sample = named.join(F.broadcast(ids.withColumnRenamed("page_id", "sample_id").distinct()), F.col("page_id") == F.col("sample_id")).select("html")
    counts = sample.mapInArrow(count, "what string, name string, inside boolean, n long").groupBy("what", "name", "inside").agg(F.sum("n").alias("n"))
    got = {(r["what"], r["name"], r["inside"]): r["n"] for r in counts.collect()}  # kinds of elements: bounded by the sample
    return weigh(got)


def weigh(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Log-odds with one pseudo-count of either side, words of boilerplate never above zero and tags never above -0.05."""
    out = Weights()
    for what, store in (("word", out.words), ("tag", out.tags)):
        total = {side: sum(n for (w, _, i), n in counts.items() if w == what and i is side) + 1 for side in (True, False)}
        for name in {n for w, n, _ in counts if w == what}:
            inside, outside = counts.get((what, name, True), 0), counts.get((what, name, False), 0)
            if inside + outside < 5:
                continue
            odds = math.log((inside + 1) / total[True]) - math.log((outside + 1) / total[False])
            if what == "word":
                odds = max(LEAST_WORD, min(MOST, odds))
                store[name] = min(odds, -0.5) if name[0] == "!" else odds
            else:
                store[name] = -0.05 if name.lstrip("/") in INLINE else max(LEAST_TAG, min(TAG, odds))
    return out


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    read_ = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return read_.mapInArrow(work, "page_id long, url string, text string, n_chars long")


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fit(pages))
