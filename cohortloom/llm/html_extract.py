"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.llm.common import arrow_pass, keyed_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
# Elements that never hold article text.
OUTSIDE = frozenset("aside button dialog footer form head header iframe menu nav noscript object option script select style svg "
                    "template textarea title".split())
# Words of class, id and role that mark the same.
MARKS = frozenset("ad ads adbox advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs comment "
                  "commentlist comments complementary consent contentinfo cookie cookies dialog disqus footer gdpr header masthead menu "
                  "modal nav navbar navigation newsletter notice notices notification popup promo promotion related search "
                  "share sharing sidebar signup social sponsor sponsored subscribe toolbar".split())
KEEPING = frozenset("main html body".split())
HOLDERS = frozenset("article main section div td th body html".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Line:
    """One block of a page: its text, the tags met since the block before, characters inside links."""

    text: str
    tags: int
    linked: int
    element: int      # number of the innermost element
    holder: int       # number of the nearest holding element
    article: int      # number of the outermost article or main, -1 without one
    heading: bool


class Events(HTMLParser):
    """Turns parser events into lines; of every element its parent, mark and characters are kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int, int]] = [("html", 0, 0, -1)]  # tag, element, holder, article
        self.parents, self.marks, self.sizes, self.articles = [0], [PLAIN], [0], []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.heading = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, element, holder, article = self.open[-1]
            self.lines.append(Line(text, max(self.tags, 1), min(self.linked, len(text)), element, holder, article, self.heading))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self.flush()
            for closed in CLOSES.get(tag, ()):
                self.close_to(closed, stop=HOLDERS - {closed} | {"ul", "ol", "dl", "table"})
        if tag in VOID:
            return
        _, parent, holder, article = self.open[-1]
        element, kind = len(self.parents), mark_of(tag, attrs)
        if kind == FIRM and tag == "header" and article >= 0:
            kind = HEADLINE
        self.parents.append(parent)
        self.marks.append(kind)
        self.sizes.append(0)
        if tag in HOLDERS:
            holder = element
            if article < 0 and tag in ("article", "main"):
                article = element
                self.articles.append(element)
        if tag == "a":
            self.links += 1
        if tag in HEADINGS:
            self.heading = True
        self.open.append((tag, element, holder, article))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag not in INLINE:
            self.flush()
        if tag not in VOID:
            self.close_to(tag)

    def close_to(self, tag: str, stop=frozenset()) -> None:
        """Close the innermost open ``tag`` with all inside it; a tag that is not open is passed over."""
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == tag:
                for closed, *_ in self.open[at:]:
                    if closed == "a":
                        self.links -= 1
                    if closed in HEADINGS:
                        self.heading = False
                del self.open[at:]
                return
            if name in stop:
                return

    def handle_data(self, data):
        self.parts.append(data)
        if self.links > 0:
            self.linked += len(data.strip())

    def unknown_decl(self, data):
        """A CDATA section or the like is no text."""

    def outside(self) -> list[bool]:
        """Whether each line stands in something that is no article text.

        Loose marks are void on the largest article or main that no firm mark covers, and on all around it; on a page
        without one, on elements that hold over three quarters of its text.  A header in an article keeps headings.
        """
        firm = [False] * len(self.parents)
        for e in range(1, len(firm)):
            firm[e] = firm[self.parents[e]] or self.marks[e] == FIRM
        for line in self.lines:
            if not firm[line.element]:
                self.sizes[line.element] += len(line.text)
        for e in range(len(firm) - 1, 0, -1):
            self.sizes[self.parents[e]] += self.sizes[e]
        void = set()
        lead = max((e for e in self.articles if self.sizes[e]), key=lambda e: (self.sizes[e], -e), default=0)
        if lead:
            while lead:
                void.add(lead)
                lead = self.parents[lead]
        else:
            void = {e for e, n in enumerate(self.sizes) if 4 * n > 3 * self.sizes[0]}
        out, headline = list(firm), [False] * len(firm)
        for e in range(1, len(firm)):
            above = self.parents[e]
            out[e] = firm[e] or out[above] or (self.marks[e] == LOOSE and e not in void)
            headline[e] = headline[above] or self.marks[e] == HEADLINE
        return [out[x.element] or (headline[x.element] and not x.heading) for x in self.lines]


PLAIN, LOOSE, FIRM, HEADLINE = range(4)


def mark_of(tag: str, attrs) -> int:
    """FIRM: a menu, script and so on, by tag, a whole word of class, id or role, or hidden.  LOOSE: a form, or such a word
    as part of a longer one (``has-sidebar``), which may also tell of the page around the article."""
    found = FIRM if tag in OUTSIDE and tag != "form" else LOOSE if tag == "form" else PLAIN
    if tag in KEEPING:
        return found
    for name, value in attrs:
        if name == "hidden":
            return FIRM
        if name in ("class", "id", "role") and value:
            for token in value.split():
                words = [w.lower() in MARKS for w in WORDS.findall(token)]
                if words and all(words):
                    return FIRM
                if any(words):
                    found = max(found, LOOSE)
    return found


def smoothed(values: list[float], sigma: float, radius: int) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and its weights shared out again."""
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - radius), min(len(values), i + radius + 1)
        weights = kernel[low - i + radius:high - i + radius]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Border between the two clusters of a set of numbers (two means on logarithms, from the extremes)."""
    logs = sorted(math.log1p(v) for v in values)
    low, high = logs[0], logs[-1]
    for _ in range(50):
        middle = (low + high) / 2
        left = [v for v in logs if v <= middle]
        right = [v for v in logs if v > middle]
        if not right:
            break
        moved = sum(left) / len(left), sum(right) / len(right)
        if moved == (low, high):
            break
        low, high = moved
    return math.expm1((low + high) / 2) * (1 - 1e-9)


def main_text(html: str, sigma: float = 1.0, radius: int = 2, most_linked: float = 0.5) -> str:
    """The article of one page: decoded, white space of a block made one space, blocks joined by one space.

    Lines whose smoothed text-to-tag ratio lies above the border of two clusters and that stand in no menu, header,
    footer, form and so on are the seeds.  The article or main element around seeds, else the elements that hold
    them directly, are the content regions; all their lines outside such parts belong to the text, short ones
    included, as do headings right before a region.  Inside an article, an element without seeds whose text is mostly
    links is left out.  A page without seeds gives its article, else all its lines.
    """
    page = Events()
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    outside = page.outside()
    inside = [i for i, out in enumerate(outside) if not out]
    if not inside:
        return ""
    ratios = smoothed([0.0 if out else (len(line.text) - line.linked) / line.tags for line, out in zip(lines, outside)], sigma, radius)
    border = threshold(ratios)
    seeds = [i for i in inside if ratios[i] >= border and lines[i].linked <= most_linked * len(lines[i].text)]
    articles = {lines[i].article for i in seeds} - {-1} or {lines[i].article for i in inside} - {-1}
    if articles:
        taken = {i for i in inside if lines[i].article in articles}
        seeded = {lines[i].holder for i in seeds} | articles
        linked: dict[int, int] = {}
        for i in taken:
            linked[lines[i].holder] = linked.get(lines[i].holder, 0) + 2 * lines[i].linked - len(lines[i].text)
        if seeds:
            taken = {i for i in taken if lines[i].holder in seeded or linked[lines[i].holder] <= 0}
    elif seeds:
        holders = {lines[i].holder for i in seeds}
        taken = {i for i in inside if lines[i].holder in holders}
        for i in reversed(inside):
            if lines[i].heading and i + 1 in taken:
                taken.add(i)
    else:
        taken = set(inside)
    return " ".join(lines[i].text for i in sorted(taken))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page; null, empty and text-free pages give an empty text."""
    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(html).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[key, url, "text", "n_chars"])

    return arrow_pass(keyed_text(pages, key, html, url), extract, f"{key} long, {url} string, text string, n_chars long")
