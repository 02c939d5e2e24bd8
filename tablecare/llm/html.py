"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element.  Lines inside page furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments, hidden parts)
have no text.  Lines that are mostly links count as empty outside an article; fewer than
``WIDTH`` of them in a row between lines of one region belong to it, more are a menu.
Each piece of furniture and each edge of an article also stands for ``WIDTH`` empty lines.  The
lengths of the lines are summed over sliding windows of ``WIDTH`` lines, on every page;
where the sum surges from zero a region begins, where it dives to zero it ends.  An
article that the page names is evidence for its regions: they are all kept, and another
region only if a window of it reaches ``SURGE`` and it has more text than the whole
article, which then is a teaser.  On pages without text in a named article a region is
kept for its own density, if a window of it reaches ``SURGE`` (or none of the page does),
or for its place: it has a line in the same container as a kept region, or, where that
container is the page itself, lies between two such.  How long the other regions are
does not matter.  Lines of kept regions are the text.

Character references are decoded after the markup is gone; white space inside a block
becomes one space.  Defined cases: null, empty and textless pages give an empty text;
unclosed elements end with their parent; unclosed comments and scripts end with the
page; equal rows get equal results; empty tables give empty results.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 3
SURGE = 86
LINKED = 0.6

# Elements by their role in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
FURNITURE = {
    "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "svg", "canvas", "object", "audio",
    "video", "map", "head", "datalist", "math",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = BLOCKS - {"p", "li", "dt", "dd", "hr", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
NAMES = re.compile(
    r"(^|[\s_-])(nav|navbar|navigation|menu|menus|breadcrumbs?|pager|pagination|footer|masthead|sidebar|side-?bar|aside|"
    r"ads?|adverts?|advertisement|advertising|adsense|adbox|banner|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|disqus|respond|replies|"
    r"share|sharing|social|related|recommended|recommendations|widget|toolbar|skip-?link|copyright|disclaimer)($|[\s_-])", re.I,
)
HEADERS = {"header", "site-header", "global-header", "topbar", "top-bar"}
# A class that tells the state of a page, not what the element is.
STATE = re.compile(r"(has|no|with|is|not|js)[_-]", re.I)
ARTICLE_NAMES = re.compile(r"(^|\s)(article-?body|article-?content|post-?body|post-?content|entry-?content|story-?body)($|\s)", re.I)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>%s)\b[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    % "|".join(sorted(RAW)), re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}


def is_furniture(tag: str, given: dict[str, str], in_article: bool, by_name: bool = True) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_article):
        return True
    if not given or tag in ("html", "body"):
        return False
    if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
        return True
    if not by_name:
        return False
    names = [n for n in f"{given.get('class', '')} {given.get('id', '')}".split() if not STATE.match(n)]
    if tag in ("article", "main"):
        return any(NAMES.fullmatch(n) for n in names)
    return any(NAMES.search(n) or (n.lower() in HEADERS and not in_article) for n in names)


def is_article(tag: str, given: dict[str, str]) -> bool:
    return (
        tag in ("article", "main") or given.get("role", "").lower() in ("main", "article")
        or given.get("itemprop", "").lower() == "articlebody" or bool(ARTICLE_NAMES.search(given.get("class", "")))
    )


class Line:
    __slots__ = ("parts", "article", "container", "linked", "size")

    def __init__(self, article: bool, container: int):
        self.parts: list[str] = []
        self.article, self.container, self.linked, self.size = article, container, 0, 0

    def text(self) -> str:
        return SPACE.sub(" ", references.unescape("".join(self.parts))).strip()


def lines_of(html: str, by_name: bool = True) -> tuple[list[Line | None], bool]:
    """The lines of a page, None for each line without text, and whether it names an article."""
    lines: list[Line | None] = []
    # Open elements: (tag, furniture, article, the number of the innermost container; 0 is the page).
    stack: list[tuple[str, bool, bool, int]] = []
    opened: Counter[str] = Counter()
    hidden = articles = links = containers = 0
    named = False
    line = Line(False, 0)
    at = 0

    def end_line() -> None:
        nonlocal line
        if line.size:
            lines.append(line)
        line = Line(articles > 0, stack[-1][3] if stack else 0)

    def add(text: str) -> None:
        if not hidden and text:
            line.parts.append(text)
            n = len(text.strip())
            line.size += n
            line.linked += n if links else 0

    def close(count: int) -> None:
        nonlocal hidden, articles, links
        for _ in range(count):
            tag, furniture, article, _ = stack.pop()
            opened[tag] -= 1
            if furniture:
                hidden -= 1
                lines.extend([None] * WIDTH)
            articles -= article
            links -= tag == "a"
            if article and tag in BLOCKS:
                lines.extend([None] * WIDTH)

    for m in MARKUP.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            end_line()
        elif tag == "br":
            add(" ")
        if m["close"]:
            # A stray closing tag looks at no open element.
            for depth in range(len(stack) - 1 if opened[tag] else -1, -1, -1):
                if stack[depth][0] == tag:
                    close(len(stack) - depth)
                    break
        elif tag not in VOID:
            if tag in BLOCKS and stack and stack[-1][0] in ("p", "li") and (stack[-1][0] == tag or stack[-1][0] == "p"):
                close(1)
            given = attributes(m["rest"]) if m["rest"] else {}
            furniture = is_furniture(tag, given, articles > 0, by_name)
            article = not furniture and is_article(tag, given)
            if furniture or article or tag in CONTAINERS or tag == "a":
                if m["rest"].rstrip().endswith("/") and tag not in BLOCKS:
                    continue
                inner = stack[-1][3] if stack else 0
                if tag in CONTAINERS and tag not in ("html", "body"):
                    containers += 1
                    inner = containers
                stack.append((tag, furniture, article, inner))
                opened[tag] += 1
                hidden += furniture
                articles += article
                links += tag == "a"
                named = named or (article and not hidden)
                if furniture or (article and tag in BLOCKS):
                    lines.extend([None] * WIDTH)
        if tag in BLOCKS:
            line.article, line.container = articles > 0, stack[-1][3] if stack else 0
    add(html[at:])
    end_line()
    return lines, named


def main_text(html: str | None) -> str:
    """The text between the surge and dive points of a page's line blocks.

    A page that names no article and of which nothing is left is read again without
    going by class and id names.
    """
    if not html:
        return ""
    lines, named = lines_of(html)
    found = between(lines)
    return found if found or named else between(lines_of(html, False)[0])


def between(lines: list[Line | None]) -> str:
    """The text of the kept regions between surge and dive points."""
    texts, sizes = [], []
    for line in lines:
        texts.append(line.text() if line is not None else "")
        counts = line is not None and (line.article or line.linked < LINKED * line.size)
        sizes.append(len(texts[-1]) if counts else 0)
    sizes += [0] * WIDTH
    sums = [sum(sizes[i : i + WIDTH]) for i in range(len(texts))]
    regions, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            # A region is seen up to WIDTH - 1 lines before its first line.
            regions.append((next(j for j in range(start, i) if sizes[j]), i))
            start = None
    own = [any(lines[i].article for i in range(a, b) if sizes[i]) for a, b in regions]
    dense = [max(sums[a:b]) >= SURGE for a, b in regions]
    if any(own):
        article = sum(sum(sizes[a:b]) for (a, b), x in zip(regions, own) if x)
        kept = [x or (d and sum(sizes[a:b]) > article) for (a, b), x, d in zip(regions, own, dense)]
    else:
        kept = in_place(dense if any(dense) else [True] * len(regions), [
            {lines[i].container for i in range(a, b) if sizes[i]} for a, b in regions
        ])
    return "\n\n".join(t for (a, b), x in zip(regions, kept) if x for t in texts[a:b] if t)


def in_place(kept: list[bool], containers: list[set[int]]) -> list[bool]:
    """Regions that are kept, or share a container with a kept one; the page itself (0) only between two such."""
    shared = set().union(*[c for c, k in zip(containers, kept) if k]) - {0}
    on_page = [i for i, (c, k) in enumerate(zip(containers, kept)) if k and 0 in c]
    first, last = (on_page[0], on_page[-1]) if on_page else (0, -1)
    return [k or bool(c & shared) or (0 in c and first < i < last) for i, (c, k) in enumerate(zip(containers, kept))]


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Columns ``keep`` of ``pages``, then ``text`` and ``n_chars``, its code points."""
    keep = [c for c in keep if c not in ("text", "n_chars")]
    kept = [F.col(f"`{c}`").alias(f"__kept{i}") for i, c in enumerate(keep)]
    taken = pages.select(*kept, F.col(f"`{html}`").cast("string").alias("__html"))
    schema = T.StructType([*taken.schema.fields[: len(keep)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names
            )

    return taken.mapInArrow(run, schema).select(*[F.col(f"__kept{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
