"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is one sequence of text runs and tags. Words score above zero, tags below
zero, and one linear scan finds the contiguous region of highest sum: the content.
Its blocks are completed at both ends, so that no paragraph is cut.

The weights come from labelled pages, those that mark their article themselves
(``<article>``, else ``<main>``). Spark counts, over all of them, how often each
kind of tag and the words of each kind of block lie in the article and outside, in
three zones: inside a marked article, beside one, and without regard to the mark
(the zone of pages that mark nothing). A word weighs its chance to lie inside, a tag
less than zero by its logarithmic odds to lie outside. Kinds are a fixed list of
element names, so the table of weights doesn't grow with the corpus; ``PRIOR`` is the
belief that counts correct, and the weights where no page is labelled.

Furniture inside the region (menus, page headers, footers, sidebars, notices,
adverts, forms, reader comments, hidden elements) is recognised by element, role or
class name; it scores nothing and gives no text. A doubtful element that holds the
page's article or its first heading isn't furniture, whatever its name.

Defined results: a null, empty or word-less page has an empty text; markup cut off at
the end of a page is markup; on equal sums the region that ends first is taken; repeated rows
and null ids give a row each; an empty table gives no rows; other columns are kept
unless they are named like an output.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import column, ship, without

OUTPUT = ("text", "n_chars")

# Element and role names of the HTML standard, and the words by which pages name their furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
select summary table tbody td tfoot th thead tr ul""".split())
INLINE = frozenset("a abbr b br code em font i img label small span strong sub sup u".split())
FURNITURE = frozenset("""head nav footer aside menu search dialog button select datalist noscript template svg canvas object audio video
map""".split())
ROLES = frozenset("""navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar
tablist""".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
HINTS = frozenset("""ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner
nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar footer copyright colophon sidebar widget
related recommended share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr notice
disclaimer alert popup modal overlay""".split())
PRIOR = {name: 0.9 for name in """p h1 h2 h3 h4 h5 h6 blockquote pre b strong i em u br code font small sub sup abbr figcaption figure
table thead tbody tr td th""".split()} | {name: 0.5 for name in "li ul ol dl dt dd a span img hr".split()} | {
    name: 0.3 for name in "div section center body address details summary".split()} | {
    name: 0.2 for name in "aside article main".split()}

#: Elements that a new element of a kind closes by itself.
CLOSED_BY = {"li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"),
             "th": ("p", "td", "th"), "option": ("option",)}
#: Weight of the prior in labelled tags or words, least and largest loss of a tag, least weight of a word.
STRENGTH, LEAST_LOSS, LARGEST_LOSS, LEAST_WORD = 20.0, 0.05, 6.0, 0.05
OTHER_PRIOR = 0.1

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ABOUT = re.compile(r"(?:no|not|has|have|with|without|is)(?:[-_]|(?=[A-Z]))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: A text run or a tag: kind (0 text, 1 open, 2 close), name or text, attributes.
Item = tuple[int, str, str]


def items(page: str) -> list[Item]:
    """Text runs and tags in page order; comments and the contents of raw elements are left out."""
    out: list[Item] = []
    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            out.append((0, page[at:], ""))
            break
        if m.start() > at:
            out.append((0, page[at:m.start()], ""))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        closes = bool(m.group(1))
        out.append((2 if closes else 1, name, m.group(3)))
        if name in RAW and not closes:
            end = _CLOSE[name].search(page, at)
            at = end.start() if end else n
    return out


def _class_words(value: str) -> set[str]:
    return {w.lower() for name in value.split() if not _ABOUT.match(name) for w in _NAMES.findall(name)}


def furniture(name: str, raw: str, in_article: bool) -> int:
    """0: content; 1: perhaps furniture, unless it holds the article; 2: furniture."""
    if name in FURNITURE:
        return 2
    if name in ("html", "body", "main"):
        return 0
    doubt = 1 if name == "form" or (name == "header" and not in_article) else 0
    if "=" not in raw and "hidden" not in raw:
        return doubt
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)}
    named = _class_words(f"{found.get('class', '')} {found.get('id', '')}")
    if named & COMMENTS or "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return 2
    if name == "article":
        return 0
    return 1 if doubt or named & HINTS or found.get("role", "").lower() in ROLES else 0


class Page:
    """The items of a page with, per item, whether furniture holds it, its block and its zone."""

    def __init__(self, page: str):
        self.items = items(page)
        n = len(self.items)
        spans: list[list[int]] = []  # start, end, certainty of what may be furniture
        stack: list[tuple[str, int]] = []  # open block elements: name, index in spans or -1
        opened: Counter[str] = Counter()
        marks: dict[str, list[list[int]]] = {"article": [], "main": []}
        first_heading = n

        def pop(at: int) -> str:
            name, span = stack.pop()
            opened[name] -= 1
            if span >= 0:
                spans[span][1] = at
            if name in marks:
                next(m for m in reversed(marks[name]) if m[1] == n)[1] = at
            return name

        self.block = [""] * n
        for i, (kind, name, raw) in enumerate(self.items):
            if kind == 1:
                if name in BLOCK:
                    while opened["head"] or (stack and stack[-1][0] in CLOSED_BY.get(name, ("p",))):
                        pop(i)  # elements that end where this one begins
                if (name in BLOCK or name in FURNITURE) and name not in VOID:
                    sure = furniture(name, raw, opened["article"] + opened["main"] > 0)
                    if sure:
                        spans.append([i, n, sure])
                    stack.append((name, len(spans) - 1 if sure else -1))
                    opened[name] += 1
                    if name in marks:
                        marks[name].append([i, n])
                if name == "h1" and first_heading == n:
                    first_heading = i
            elif kind == 2 and opened[name] > 0:
                while pop(i) != name:
                    pass
            self.block[i] = stack[-1][0] if stack else ""
        self.removed = self._cover(n, [s for s in spans if s[2] == 2])
        # a doubtful element that holds the article or, unless a page header, the first heading is none
        shown = [m for name in ("main", "article") for m in marks[name] if not self.removed[m[0]]]
        held = [m[0] for m in shown if m in marks["main"]] + [m[0] for m in shown if m in marks["article"]][:1]
        for start, end, sure in spans:
            if sure == 1:
                heading = self.items[start][1] != "header" and start < first_heading < end and not self.removed[first_heading]
                if not heading and not any(start < at < end for at in held):
                    for i in range(start, end + (end < n)):
                        self.removed[i] = True
        shown = [m for m in shown if not self.removed[m[0]]]
        articles = [m for m in shown if m in marks["article"]]
        self.marked = articles or shown
        inside = self._cover(n, [[a, b, 0] for a, b in self.marked], edges=False)
        self.inside = inside
        self.words = [0 if k else len(x.split()) for k, x, _ in self.items]

    @staticmethod
    def _cover(n: int, spans: list[list[int]], edges: bool = True) -> list[bool]:
        """Whether each item lies in one of the spans, their own tags included or not."""
        step = [0] * (n + 1)
        for start, end, _ in spans:
            step[start if edges else start + 1] += 1
            step[min(n, end + 1) if edges else max(end, start + 1)] -= 1
        out, depth = [], 0
        for s in step[:n]:
            depth += s
            out.append(depth > 0)
        return out

    def feature(self, i: int, zone: str) -> tuple[str, str, str] | None:
        """What the item's weight depends on; None for those that weigh nothing."""
        kind, name, _ = self.items[i]
        if kind == 0:
            return None if self.removed[i] or not self.words[i] else (zone, "words", known(self.block[i]))
        if self.removed[i] and (i > 0 and self.removed[i - 1]) and (i + 1 < len(self.items) and self.removed[i + 1]):
            return None  # inside furniture; only its own tags count
        return (zone, "tag", known(name))

    def zone(self, i: int) -> str:
        return "plain" if not self.marked else "marked" if self.inside[i] else "beside"


def known(name: str) -> str:
    return name if name in BLOCK or name in INLINE or name in FURNITURE else "other"


def count_features(page: str) -> Counter[tuple[str, str, str, bool]]:
    """What a labelled page teaches: (zone, what, kind, inside) -> words or tags; nothing if it marks no single article."""
    out: Counter[tuple[str, str, str, bool]] = Counter()
    p = Page(page)
    if len(p.marked) != 1:
        return out
    for i in range(len(p.items)):
        for zone in (p.zone(i), "plain"):
            f = p.feature(i, zone)
            if f and not (f[1] == "tag" and f[2] in ("article", "main") and zone == "plain"):
                out[(*f, p.inside[i])] += max(1, p.words[i])
    return out


class Weights:
    """Score of an item from the counts of labelled pages."""

    def __init__(self, counts: dict[tuple[str, str, str], tuple[int, int]]):
        self._counts, self._known = counts, {}

    def __call__(self, feature: tuple[str, str, str]) -> float:
        if feature not in self._known:
            zone, what, name = feature
            within, out = self._counts.get(feature, (0, 0))
            prior = {"marked": 0.99, "beside": 0.01}.get(zone) or PRIOR.get(name, OTHER_PRIOR)
            within, out = within + STRENGTH * prior, out + STRENGTH * (1 - prior)
            if what == "words":
                self._known[feature] = max(LEAST_WORD, within / (within + out))
            else:
                self._known[feature] = -min(LARGEST_LOSS, LEAST_LOSS + max(0.0, math.log(out / within)))
        return self._known[feature]


def region(p: Page, weights: Weights) -> tuple[int, int]:
    """First and last item of the maximum-scoring subsequence; (0, -1) if there are no words."""
    best, span, total, start = 0.0, (0, -1), 0.0, 0
    for i in range(len(p.items)):
        f = p.feature(i, p.zone(i))
        if f is None:
            continue
        if total <= 0:
            total, start = 0.0, i
        w = weights(f)
        total += w * p.words[i] if f[1] == "words" else w
        if total > best:
            best, span = total, (start, i)
    return span


def _separates(item: Item) -> bool:
    return item[0] != 0 and item[1] in BLOCK


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the content region, two line breaks between them."""
    if not page:
        return ""
    p = Page(page)
    first, last = region(p, weights)
    if last < first:
        return ""
    while first > 0 and not _separates(p.items[first - 1]) and not p.removed[first - 1]:
        first -= 1
    while last + 1 < len(p.items) and not _separates(p.items[last + 1]) and not p.removed[last + 1]:
        last += 1
    blocks, run = [], []
    for i in range(first, last + 1):
        kind, x, _ = p.items[i]
        if _separates(p.items[i]):
            blocks.append("".join(run))
            run = []
        elif not p.removed[i]:
            run.append(html.unescape(x) if kind == 0 else "\n" if x == "br" else "")
    blocks.append("".join(run))
    return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def learn(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all labelled pages: one row per zone and kind of word or tag comes back."""
    ship(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, str, str, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(count_features(page.as_py() or ""))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
            + [pa.array([total[k] if k[3] is side else 0 for k in keys], pa.int64()) for side in (True, False)],
            names=["zone", "what", "kind", "within", "out"])

    counted = pages.select(column(pages, html_col).cast("string").alias("html")).mapInArrow(
        count, "zone string, what string, kind string, within long, out long")
    rows = counted.groupBy("zone", "what", "kind").agg(F.sum("within").alias("within"), F.sum("out").alias("out")).collect()
    return Weights({(r["zone"], r["what"], r["kind"]): (r["within"], r["out"]) for r in rows})


def extract(pages: DataFrame, html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """The columns of ``pages`` but the page itself, with its main ``text`` and ``n_chars``."""
    weights = weights or learn(pages, html_col)
    kept = [c for c in without(pages, OUTPUT) if c != html_col]
    rows = pages.select(*[column(pages, c).alias(f"c{i}") for i, c in enumerate(kept)], column(pages, html_col).cast("string").alias("html"))
    fields = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1])), "text string", "n_chars long"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"])

    found = rows.mapInArrow(take, fields)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "text", "n_chars")
