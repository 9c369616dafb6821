"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element makes a line. A line weighs as many characters as
it has outside links; what stands in menus, forms, adverts and the like weighs nothing and is a gap,
unless the lines before and after it stand in the same element as it does. Tags that mark the article only change weights: a
line within them weighs ``SURGE_CHARS`` more, and on a page that has them a line outside weighs
``OUTSIDE_CHARS`` less. The weights of a few neighbouring lines are summed. A stretch between two dives to nothing is text when
the sums surge in it; from its first line of weight to its last all is kept, lines of links too, but for
lines outside the article that weigh nothing. Pages without such tags are read by the same rule.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwise.llm.base import arrow_schema, kind_of

WINDOW, SURGE_CHARS, OUTSIDE_CHARS = 3, 80, 160

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
CLOSED = re.compile(r"</([a-z][^\s/>]*)")
SPACE, WORD = re.compile(r"\s+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav footer aside form head button select dialog svg object canvas audio video menu noframes".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre".split())  # hold a line; their parent is where it stands
NEVER = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark what is not the article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu menubar "
    "breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login "
    "search pagination pager widget toolbar copyright disclaimer".split()
)
READERS = frozenset("comment comments reply replies respond disqus discussion".split())
ARTICLE = frozenset("article content post story entry text main body".split())


@dataclass
class Line:
    text: str
    weight: int
    inside: bool  # of an article
    gap: bool  # something was left out before it that parts it from the line before


def dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if tag in NEVER or not attributes.strip("/> \n\t"):
        return False
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if re.search(r"\shidden(?=[\s/>]|$)", attributes):
        return True
    named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    words = {w.lower() for w in WORD.findall(named)} | set(re.split(r"[^a-z]+", named.lower()))
    if words & READERS:
        return True
    return tag not in ("article", "header") and tag not in INLINE - {"span"} and bool(words & AROUND) and not words & ARTICLE


def lines_of(page: str) -> list[Line]:
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    in_link = articles = 0
    gaps: set[int] = set()  # elements in which something was left out since the last line
    homes: list[tuple[str, int]] = [("", 0)]  # open elements and their numbers
    opened: Counter[str] = Counter()
    made, last_home = 0, -1
    lowered = page.lower()
    closed = {m[1]: m.start() for m in CLOSED.finditer(lowered)}  # where an element is closed for the last time

    def end_line() -> None:
        nonlocal parts, linked, last_home
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            home = homes[-1][1]
            out.append(Line(text, max(0, len(text) - linked), articles > 0, bool(gaps) and not gaps == {home} == {last_home}))
            gaps.clear()
            last_home = home
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(SPACE.sub(" ", html.unescape(text)))

    at = 0
    skip, depth = "", 0  # the element being left out, and how often it is open
    for m in MARK.finditer(page):
        if m.start() < at:  # within a raw element
            continue
        if not skip and m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, tag = m[1] == "/", m[2].lower()
        if not closing and tag in RAW:  # its content is not markup
            end = lowered.find(f"</{tag}", at) if closed.get(tag, -1) >= at else -1
            at = len(page) if end < 0 and tag != "title" else max(end, at)
            continue
        if skip:
            if tag == skip:
                depth += -1 if closing else 1
            if depth <= 0 or skip == "p" and not closing and tag not in INLINE and tag != "br" and tag != "p":
                skip = ""
            elif skip == "p" and tag == "p" and not closing:
                skip = ""
            else:
                continue
            if closing:
                continue
        if closing:
            if tag == "a":
                in_link = 0
            elif tag not in INLINE:
                end_line()
                if tag in ("article", "main"):
                    articles = max(0, articles - 1)
                if opened[tag]:
                    while True:
                        inner = homes.pop()[0]
                        opened[inner] -= 1
                        if inner == tag:
                            break
            continue
        self_closing = m[3].rstrip().endswith("/>") or tag in VOID
        if not self_closing and dropped(tag, m[3][:-1] if m[3].endswith(">") else m[3], articles > 0) and (closed.get(tag, -1) >= at or tag == "p"):
            if tag not in INLINE:
                end_line()
            gaps.add(homes[-1][1])
            skip, depth = tag, 1
            continue
        if tag == "br":
            say("\n")
        elif tag == "a":
            in_link = 1
        elif tag not in INLINE:
            end_line()
            if tag in ("article", "main"):
                articles += 1
            if not self_closing and tag not in LEAVES:
                made += 1
                homes.append((tag, made))
                opened[tag] += 1
    if not skip and at < len(page):
        say(page[at:])
    end_line()
    return out


def weights(lines: list[Line]) -> list[int]:
    """What the lines weigh, with the tags' say in it."""
    marked = any(x.inside for x in lines)
    return [x.weight + SURGE_CHARS if x.inside else max(0, x.weight - OUTSIDE_CHARS) if marked else x.weight for x in lines]


def main_text(page: str, window: int = WINDOW) -> str:
    """The article's blocks in page order, joined by one space; empty when there are none."""
    lines = lines_of(page)
    marked = any(x.inside for x in lines)
    weight: list[int] = []
    of: list[int] = []
    for i, (x, w) in enumerate(zip(lines, weights(lines), strict=True)):
        if i and x.gap:  # what was left out is as empty lines
            weight.extend([0] * window)
            of.extend([-1] * window)
        weight.append(w)
        of.append(i)
    sums = np.convolve(np.array(weight + [0] * (window - 1)), np.ones(window, dtype=np.int64), "valid") if weight else np.empty(0)
    surge = SURGE_CHARS if marked or not len(sums) else min(sums.max(), SURGE_CHARS)
    kept = []
    i = 0
    while i < len(sums):
        end = i
        while end < len(sums) and sums[end] > 0:
            end += 1
        if end > i and sums[i:end].max() >= surge:
            heavy = [j for j in range(i, end) if weight[j] > 0]
            kept += [of[j] for j in range(heavy[0], heavy[-1] + 1) if of[j] >= 0 and (weight[j] > 0 or not marked or lines[of[j]].inside)]
        i = end + 1
    return " ".join(lines[k].text for k in kept)


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ``text`` and ``n_chars``, the code points of the text.

    A null or empty page has an empty text. Unclosed tags, comments and quotes end with the page at
    the latest. Repeated rows are read each; an empty table gives none.
    """
    keep = [c for c in df.columns if c != html_col] if keep is None else keep
    if {"text", "n_chars"} & set(keep):
        raise ValueError("columns named text or n_chars are there already; rename them or leave them out of keep")
    names = {f"_k{i}": c for i, c in enumerate(keep)}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.col(f"`{html_col}`").alias("_html"))
    spec, schema = arrow_schema(rows, ", ".join([f"{n} {kind_of(rows, n)}" for n in names] + ["text string", "n_chars long"]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "") for p in batch.column("_html").to_pylist()]
            kept = [batch.column(n).cast(schema.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return rows.mapInArrow(run, spec).withColumnsRenamed(names)
