"""Main text of web pages by two passes of block rules.

First pass: a block (text between block-level tags) is decided by where it stands, its
link density, length and stop-word density. Second pass: blocks too short to decide
take the label of the nearest decided neighbours, first those of the same section.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import pick, texts_of

# Element names of HTML by role
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template noscript svg math iframe object canvas audio video head textarea select button title".split())
RAW = frozenset("script style textarea title".split())
BOILER = frozenset("nav footer aside form dialog menu fieldset".split())
MAIN = frozenset("article main".split())
SECTIONS = frozenset("article main section aside nav footer form div".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name page furniture
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert alerts"
    " sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottom copyright legal comment comments reply replies"
    " respond discussion disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay search widget"
    " widgets pagination pager contentinfo complementary toolbar skip hidden paywall toc tags commentlist usercomments adbox adslot infobar banners"
    " notification notifications warning warnings disclaimer promobox sponsorship".split()
)
# Frequent words of English, German, French and Spanish
STOP = frozenset(
    "the of and to in a is that it for was on are as with his they at be this have from or had by not but what all were we when your can said there use an each"
    " which she do how their if will up other about out many then them these so some her would make like him into time has look two more go see no way could my"
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie"
    " einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei"
    " de la le les et des du un une en est que qui dans pour pas au sur ce il elle se ne par plus avec son sa ses mais on ou nous vous leur aux cette ces être sont"
    " el los las y del se lo con para una su al por como más pero sus este ya entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)
LONG_CHARS = 120
SHORT_WORDS = 6
STOP_LOW = 0.08
LINK_HIGH = 0.5

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(r"[a-z]+")
STATE = re.compile(r"\b(?:has|with|without|no)-[\w-]+")  # "has-sidebar" says what a page holds elsewhere


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    heading: bool
    item: bool
    furniture: bool
    main: bool
    section: int


def _furniture(attributes: str, main: bool = False) -> bool:
    """Do class, id, role or visibility name page furniture? A header inside an article belongs to it."""
    if not attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            found = FURNITURE.intersection(PART.findall(STATE.sub(" ", value)))
            if found - {"header"} or found and not main:
                return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "aria-hidden" and value == "true":
            return True
    return False


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order; skipped elements (scripts, styles, forms' controls, ...) give none."""
    out: list[Block] = []
    # open elements: (name, furniture, main, section)
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    parts: list[str] = []
    open_names: Counter[str] = Counter()
    never: set[str] = set()  # names whose closing tag was looked for in vain: it does not come later either
    links = sections = at = 0
    in_link = False
    leaf = ""

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                _, furniture, main, section = stack[-1]
                out.append(Block(text, min(links, len(text)), leaf in HEADING, leaf in ("li", "dd", "dt"), furniture, main, section))
        parts.clear()
        links = 0

    end = len(html)
    search = TAG.search
    while at < end:
        m = search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            parts.append(text)
            if in_link:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = not closing
            if not closing and name not in VOID and _furniture(attributes, stack[-1][2]) and name not in ("a", "label"):
                # an inline element of page furniture is a block of its own until it closes
                flush()
                _, _, main, section = stack[-1]
                stack.append((name, True, main, section))
                open_names[name] += 1
            elif closing and stack[-1][0] == name:
                flush()
                stack.pop()
                open_names[name] -= 1
            continue
        flush()
        in_link = False
        if name in SKIPPED:
            if not closing and not attributes.rstrip().endswith("/"):
                close = None if name in never else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                if close:
                    at = close.end()
                else:
                    never.add(name)
                    if name in RAW:
                        at = end
            continue
        if name in VOID:
            continue
        if closing:
            leaf = ""
            while open_names[name]:  # what stands open inside closes with it
                last = stack.pop()[0]
                open_names[last] -= 1
                if last == name:
                    break
            continue
        leaf = name
        if name in ("p", "html", "body", "tr", "td", "th", "tbody", "thead") or name in HEADING or name in ("li", "dd", "dt"):
            # elements whose end tags are often left out are not kept open, except as furniture
            if not (name not in ("html", "body") and _furniture(attributes, stack[-1][2])):
                continue
        _, furniture, main, section = stack[-1]
        sectioning = name in SECTIONS or name == "header" and not main
        if sectioning:
            sections += 1
        boiler = name in BOILER or (name == "header" and not main) or name not in MAIN and _furniture(attributes, main)
        stack.append((name, furniture or boiler, main or name in MAIN, sections if sectioning else section))
        open_names[name] += 1
    flush()
    return out


def decided(block: Block) -> bool | None:
    """First pass: True for text, False for page furniture, None for blocks too short to tell."""
    if block.furniture:
        return False
    density = block.links / len(block.text)
    if density > LINK_HIGH and (not block.main or block.item):
        return False
    if block.heading:
        return None
    words = WORD.findall(block.text.lower())
    if len(words) < SHORT_WORDS and len(block.text) < LONG_CHARS:
        return None
    stop = sum(w in STOP for w in words) / max(len(words), 1)
    if stop >= STOP_LOW or block.main:
        return True
    return None  # outside the article, length alone does not make keywords or an advert text


def labelled(blocks: list[Block]) -> list[bool]:
    """Second pass: undecided blocks inherit, nearest neighbour first, a heading from what follows it."""
    first = [decided(b) for b in blocks]
    n = len(blocks)
    before: list[int] = [-1] * n
    after: list[int] = [-1] * n
    for order, nearest in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = -1
        for i in order:
            nearest[i] = last
            if first[i] is not None:
                last = i
    out = []
    for i, label in enumerate(first):
        if label is None:
            b, a = before[i], after[i]
            heading = blocks[i].heading
            near = [j for j in ((a, b) if heading else (b, a)) if j >= 0]
            own = [j for j in near if blocks[j].section == blocks[i].section]
            if not near:
                label = blocks[i].links / len(blocks[i].text) <= LINK_HIGH
            elif heading:
                label = first[(own or near)[0]]
            elif own:
                label = first[min(own, key=lambda j: abs(j - i))]
            else:
                label = blocks[i].main or all(first[j] for j in near)
        out.append(label)
    return out


def main_text(html: str) -> str:
    """The article of a page: good blocks in page order, joined by one space."""
    blocks = blocks_of(html)
    return " ".join(b.text for b, good in zip(blocks, labelled(blocks)) if good)


def extracted(html: Column) -> Column:
    """Main text of a column of pages; empty for null and empty pages."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([main_text(page) for page in texts_of(column)], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(html)


def page_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: page_id, url, text, n_chars (code points).

    Null, empty and text-free pages give an empty text; null ids and urls stay; repeated
    rows repeat; an empty table gives no rows; other columns are not read.
    """
    pages = pick(df, page_id=id_col, url=url_col, html=html_col)
    return pages.select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
