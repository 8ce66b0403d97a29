"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element. Text lengths are summed over a sliding window of lines; the sum surges
where the article begins and dives to zero where it ends, and the text between is kept. Tags, class names and links are
evidence of what a line's text weighs: lines of menus, headers, footers, sidebars, notices, adverts, forms and comments,
and lines that are mostly links, weigh nothing, but an element that holds most of the page's text is none of these, whatever
it is called; and lines outside article elements weigh nothing only where these elements hold a fair share of what weighs.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches, texts_of

#: Lines in a window, and the text length in a window that begins a region outside an article element.
WINDOW, SURGE = 3, 80
#: A line with at least this share of its letters in links is navigation.
LINK_SHARE = 0.6
#: An element with more than this share of the page's text isn't boilerplate; article elements with less of what weighs aren't the article.
MOST, FAIR = 0.5, 0.3

RAW = "script style noscript template svg math iframe object embed canvas audio video map select textarea button head title".split()
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q ruby s samp small span strike strong sub sup time tt u var wbr img picture source input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
ARTICLE = frozenset(("article", "main"))
#: Words in a class, id or role that mark an element as no part of the article.
MARKED = re.compile(
    r"(?:^|(?<!with)(?<!has)(?<!no)[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline-share|comments?|comment-?list|complementary|consent|contentinfo|cookies?|disqus|footer|header|masthead|"
    r"menu\w*|modal|nav\w*|newsletter|notices?|overlay|paywall|popup|promo\w*|recommend\w*|related|reply|respond|search|share|sharing|sidebar\w*|signup|skip|social|sponsor\w*|subscribe|toolbar|widget\w*)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
#: Classes of a headline's element within an article.
HEADLINE = re.compile(r"""["'\s=](?:[\w-]*-)?header(?:["'\s]|$)""", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
MARKUP = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">])*+)>""", re.DOTALL)
CLOSERS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}


@dataclass
class Line:
    text: str
    linked: int
    #: Open elements that look like boilerplate, by number.
    marks: tuple[int, ...]
    article: bool
    dropped: bool = False


def _dropped(tag: str, attributes: str) -> bool:
    if tag in BOILERPLATE:
        return True
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name in ("class", "id", "role") and MARKED.search(value):
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, markup stripped and character references decoded."""
    lines: list[Line] = []
    parts: list[str] = []
    links = [0, 0]
    # Open elements: tag, marks of it and the ones around it, whether they are in an article.
    stack: list[tuple[str, tuple[int, ...], bool]] = [("", (), False)]
    marked = count()
    in_link = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text or lines and lines[-1].text:
            lines.append(Line(text, links[0], stack[-1][1], stack[-1][2]))
        parts.clear()
        links[0] = links[1] = 0

    def take(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                links[0] += len(text.strip())

    at = 0
    while True:
        found = MARKUP.search(page, at)
        if found is None:
            take(page[at:])
            break
        take(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            if found.group().startswith("<![CDATA["):
                take(found.group()[9:-3])
            continue
        if tag in CLOSERS:
            if not closing and not attributes.endswith("/"):
                end = CLOSERS[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag != "head":
                    at = len(page)
            continue
        if tag == "body" and not closing:
            parts.clear()
            stack = stack[:1]
            continue
        if tag == "a":
            in_link = not closing
        if tag in INLINE:
            continue
        flush()
        if tag in VOID or tag == "p" or tag in ("html", "body"):
            in_link = in_link and tag in VOID
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
        else:
            _, marks, article = stack[-1]
            # An article's own header holds its headline; an article element begins anew.
            own = _dropped(tag, attributes) and not (article and (tag == "header" or HEADLINE.search(attributes)))
            around = () if tag in ARTICLE else marks
            stack.append((tag, (*around, next(marked)) if own else around, article or tag in ARTICLE))
    flush()
    # What holds most of the text isn't boilerplate.
    held = Counter()
    for line in lines:
        for mark in line.marks:
            held[mark] += len(line.text)
    most = MOST * sum(len(line.text) for line in lines)
    for line in lines:
        line.dropped = any(held[mark] <= most for mark in line.marks)
        line.article &= not line.dropped
    return lines


def main_text(page: str) -> str:
    """The article's blocks joined by one space; empty if there is no text."""
    lines = lines_of(page)
    inside = sum(len(line.text) for line in lines if line.article)
    if inside and inside >= FAIR * sum(len(line.text) for line in lines if not line.dropped):
        for line in lines:
            line.dropped |= not line.article
    else:
        for line in lines:
            line.article = False
    sizes = []
    for line in lines:
        mostly_links = not line.article and line.linked and line.linked >= LINK_SHARE * len(line.text)
        sizes.append(0 if line.dropped or mostly_links else len(line.text))
    windows = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    kept: list[str] = []
    longest: list[str] = []
    i = 0
    while i < len(lines):
        if not windows[i]:
            i += 1
            continue
        end, surged = i, False
        while end < len(lines) and windows[end]:
            surged |= windows[end] >= SURGE or lines[end].article
            end += 1
        region = [lines[k].text for k in range(i, end) if sizes[k]]
        if surged:
            kept += region
        if sum(map(len, region)) > sum(map(len, longest)):
            longest = region
        i = end
    return " ".join(kept or longest)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, one row for each row in.

    A null or empty html has an empty text, as has a page without text; malformed markup is read as browsers do, roughly:
    unclosed elements end with the page. Null ids and urls pass through; extra columns are ignored; there is no shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page) for page in texts_of(batch, "html")]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    chosen = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return map_batches(chosen, run, f"page_id {kind}, url string, text string, n_chars long")
