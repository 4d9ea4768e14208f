"""HTML extraction: main text by text-to-tag ratios over parser events.

The standard library's parser streams events; every block-level tag starts a new line.
A line's ratio is its characters outside links over its tags; lines of elements that are no text
of an article (SHUT) have none. Ratios are smoothed with a Gaussian over the neighbouring lines
of one element and clustered by a threshold (two means of their logarithms): lines of the upper
cluster are content. Elements then only close its gaps: a line between two of content in one
element is content too, and so is all of an element that has SHARE of its ratios in the upper
cluster (a title, a short last line, a list of links). An element that holds a menu, a footer or
the like is the page and closes nothing. No markup is needed for this: neither article nor main
has a say.

Inserts that say what they are (SHUT_NAMES: a class, id or role of exactly such a name) are left
out of the content's own elements; outside of those their ratios decide, unless a page has FEW lines
or less and inserts make up more than SHORT of what was selected: beside so short an article a
ratio says nothing, and the other lines are clustered again.

Defined results: null or empty html, and pages without text, give an empty text; broken markup
is read as the parser reads it; white space is space, tab, LF, VT, FF and CR; equal html gives
equal text, repeated rows each theirs. One row in, one out; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import slices, table

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no text of an article: menus, headers (of the page), footers, sidebars, adverts' and
#: other frames, forms and their controls, scripts and styles.
SHUT = frozenset("head script style noscript template nav menu header footer aside form button select textarea option input dialog iframe object svg audio video canvas".split())
#: Those that stand beside an article rather than in it.
FRAME = frozenset("nav menu header footer aside".split())
#: What inserts of an article are called that aren't its text; whole names only.
SHUT_NAMES = frozenset("menu navigation footer sidebar notice ad ads advert adverts advertisement form comments banner contentinfo complementary".split())
SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Elements that an opening tag ends without their own end tag.
ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
WHITE = " \t\n\v\f\r"
#: Lines of smoothing, the share of an element's ratios that closes it, and that of inserts in what is kept of a page of few lines that makes it doubtful.
SIGMA, SHARE, SHORT, FEW = 3.0, 0.25, 0.2, 5


class Lines(HTMLParser):
    """Lines of a page: [text parts, characters in links, tags, element path, shut out, insert's element or 0]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, int, bool, bool, int]] = []  # name, number, shut out, article, insert
        self.lines: list[list] = []
        self.count = self.links = 0
        self._new()

    def _inside(self) -> tuple[bool, int]:
        return (self.elements[-1][2], self.elements[-1][4]) if self.elements else (False, 0)

    def _new(self) -> None:
        path = tuple(e[1] for e in self.elements)
        shut = next(((k, e[0]) for k, e in enumerate(self.elements) if e[2]), None)
        outside = shut[0] if shut and shut[1] in FRAME else -1  # how many elements a part of the page's frame stands in
        if self.lines and not self.lines[-1][0]:
            self.lines[-1][3:] = [path, *self._inside(), outside]
        else:
            self.lines.append([[], 0, 0, path, *self._inside(), outside])

    def _shuts(self, tag: str, known: dict[str, str | None]) -> bool:
        if tag in SHUT and not (tag == "header" and any(e[3] for e in self.elements)):  # an article's own header has its title
            return True
        return "hidden" in known or known.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", known.get("style") or ""))

    def _named(self, tag: str, known: dict[str, str | None]) -> bool:
        names = {n.lower() for key in ("class", "id", "role") for n in (known.get(key) or "").split()}
        return not SHUT_NAMES.isdisjoint(names) and tag not in ("html", "body", "main", "article")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            for k in range(len(self.elements) - 1, -1, -1):
                name = self.elements[k][0]
                if name in ENDS[tag]:
                    self._close(k)
                elif name in BLOCKS:
                    break
        elif tag in BLOCKS and self.elements and self.elements[-1][0] == "p":
            self._close(len(self.elements) - 1)
        if tag not in VOID:
            self.count += 1
            known, (shut, insert) = dict(attrs), self._inside()
            self.elements.append((tag, self.count, shut or self._shuts(tag, known), tag in ("article", "main"), insert or self.count * self._named(tag, known)))
            self.links += tag == "a"
        if tag in BLOCKS or [*self._inside()] != self.lines[-1][4:6]:
            self._new()
        self.lines[-1][2] += 1
        if tag == "br":
            self.lines[-1][0].append(" ")

    def _close(self, k: int) -> None:
        for tag, *_ in self.elements[k:]:
            self.links -= tag == "a"
        block = any(e[0] in BLOCKS for e in self.elements[k:])
        del self.elements[k:]
        if block or [*self._inside()] != self.lines[-1][4:6]:
            self._new()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][2] += 1
        for k in range(len(self.elements) - 1, -1, -1):
            if self.elements[k][0] == tag:
                self._close(k)
                return
            if self.elements[k][0] in BLOCKS and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        line = self.lines[-1]
        if line[0] or data.strip(WHITE):
            line[0].append(data)
            if self.links:
                line[1] += len(data)


def smoothed(values: list[float], groups: list[tuple], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbouring lines of one group; the weights at hand are scaled up."""
    reach = math.ceil(3 * sigma)
    weight = [math.exp(-((d / sigma) ** 2) / 2) for d in range(-reach, reach + 1)]
    out, n = [], len(values)
    for i in range(n):
        part = [j for j in range(max(0, i - reach), min(n, i + reach + 1)) if groups[j] == groups[i]]
        total = sum(weight[j - i + reach] for j in part)
        out.append(sum(values[j] * weight[j - i + reach] for j in part) / total)
    return out


def threshold(values: list[float]) -> float:
    """Where two means split the values; the lower mean starts at the least, the upper at the greatest."""
    low, high = min(values), max(values)
    while True:
        cut = (low + high) / 2
        under, over = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not over:
            return low - 1
        means = sum(under) / len(under), sum(over) / len(over)
        if means == (low, high):
            return cut
        low, high = means


def closed(paths: list[tuple], even: list[float], cut: float, apart: set[int]) -> list[bool]:
    """Which lines are over the cut, or close its gaps: a line between two such of one element,
    and every line of an element of whose ratios more than half is over the cut. Elements of
    apart close nothing."""
    chosen = [math.log1p(v) > cut for v in even]
    own: dict[int, list[int]] = {}
    for k, path in enumerate(paths):
        for number in path:
            own.setdefault(number, []).append(k)
    out = chosen[:]
    for number, held in own.items():
        if number in apart:
            continue
        marked = [i for i, k in enumerate(held) if chosen[k]]
        if sum(even[held[i]] for i in marked) > SHARE * sum(even[k] for k in held):
            marked = [0, len(held) - 1]
        for k in held[marked[0] : marked[-1] + 1] if marked else ():
            out[k] = True
    return out


def content(lines: list[tuple]) -> list[int]:
    """The lines (text, characters in links, tags, path, shut out, insert, elements that a part
    of the page's frame stands in) that are content."""
    # An element that holds a menu, a footer and the like is the page, not its article.
    apart = {n for x in lines if x[4] for n in (0, *x[3])[: x[6] + 1]}
    text = [k for k, x in enumerate(lines) if not x[4]]
    while text:
        paths = [(0, *lines[k][3]) for k in text]  # 0: the page
        ratio = [max(0, len(lines[k][0]) - lines[k][1]) / max(1, lines[k][2]) for k in text]
        even = smoothed(ratio, [p[:-1] for p in paths])
        cut = threshold([math.log1p(v) for v in even])
        kept = [k for k, is_ in zip(text, closed(paths, even, cut, apart), strict=True) if is_]
        mass = dict(zip(text, even, strict=True))
        if len(text) > FEW or sum(mass[k] for k in kept if lines[k][5]) <= SHORT * sum(mass[k] for k in kept):
            # Of the content's own elements, inserts are known by name.
            mine = {n for k in kept if not lines[k][5] for n in (0, *lines[k][3])} - apart
            return [k for k in kept if not lines[k][5] or not any(n in mine for n in (0, *lines[k][3][: lines[k][3].index(lines[k][5])]))]
        # Beside an article so short, an insert's ratio says nothing: the rest is clustered again.
        text = [k for k in text if not lines[k][5]]
        if not text:
            return kept
    return []


def blocks(html: str) -> list[str]:
    """The main text's blocks, in page order."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [(SPACE.sub(" ", "".join(line[0])).strip(" "), *line[1:]) for line in parser.lines]
    lines = [x for x in lines if x[0]]
    return [lines[k][0] for k in content(lines)]


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """keys, text (blocks joined by an empty line) and n_chars (its code points)."""
    kept = pages.select(*keys, F.coalesce(F.col(html), F.lit("")).alias("html"))
    fields = [kept.schema[k] for k in keys]
    schema = kept.select(*keys, F.col("html").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = ["\n\n".join(blocks(h)) for h in batch.column("html").to_pylist()]
            columns = [batch.column(f.name) for f in fields] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_text": op8_html_text}
SQL: dict[str, str] = {}
