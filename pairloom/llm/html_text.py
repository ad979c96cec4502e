"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block elements. Pass 1 decides each block from its share of stop words,
its length and its share of characters in links: good, bad, or ambiguous where it is short or its words say
too little. Pass 2 gives each ambiguous block the label of the nearest decided block before or after it.

Markup is evidence too. Blocks in menus, page headers and footers, sidebars, notices, adverts, forms and
reader comments, by element, role or class, are bad. Where a page names its article (<article>, else <main>), only that
is looked at, its ends count as good neighbours and only links make a block of it bad; elsewhere the page's ends count as
bad neighbours. Good blocks, references decoded and white space (as Unicode has it) made one space, are joined by an empty line. A line
break is white space; two in a row part blocks.

Defined cases: null html counts as empty and has empty text; a page of any length is read whole, in time in proportion to
its length; unclosed elements, tags cut off by the page's end and unknown references do no harm; repeated rows get equal rows; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame

from pairloom.llm.common import map_texts

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its
    just like more most my no not of on one only or other our out over she so some such than that the their them then there these they this to up was
    we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du ein eine einem einen einer er es für hat ich ihr im in ist ja
    kann man mich mir mit nach nicht noch nur oder schon sein sich sie sind so über um und uns vom von vor war was wenn wie wird wir zu zum zur
    à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou où par
    pas plus pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous
    al algo como con contra cual cuando de del desde donde el ella ellos en entre era es esa ese esta este esto están fue ha hay la las lo los más me mi mucho
    muy nada ni no nos nosotros o os otra otro para pero poco por porque que quien se sea sin sobre son su sus también te tiene todo tu un una uno y ya yo
    """.split()
)
# Elements that part blocks, that hold no text of the page, and that hold none of its article.
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header
    hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul
    """.split()
)
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math object canvas audio video select button".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer masthead menu
    nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies reply share sharing sidebar signup skyscraper social
    sponsor sponsored subscribe subscription teaser toolbar widget
    """.split()
)
VOID = frozenset("hr".split())

#: Share of link characters above which a block is bad; lengths below which it is short, and from which it can be good; share of stop words of running text.
LINKS, SHORT, LONG, STOPS = 0.25, 70, 140, 0.1

GOOD, BAD, UNDECIDED = 1, 0, None

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<!(?!--)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Block:
    """Text of a block, characters of it in links, and the places of the page it is in."""

    article: bool
    main: bool
    boilerplate: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name in ("hidden", "aria-hidden") and value in ("", "true", "hidden", name):
            return True
        if name == "role" and value.strip() in ROLES:
            return True
        if name in ("class", "id") and not HINTS.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """The blocks of a page that have text, in its order."""
    found: list[Block] = []
    # Of each open block element: its name, and whether its blocks are in an article, in the main part, in boilerplate.
    opened: list[tuple[str, bool, bool, bool]] = []
    count: Counter[str] = Counter()
    place = (False, False, False)
    block, linked, breaks = Block(*place), False, 0

    def part() -> None:
        nonlocal block
        if block.pieces:
            found.append(block)
        block = Block(*place)

    def close() -> None:
        nonlocal place
        count[opened.pop()[0]] -= 1
        place = opened[-1][1:] if opened else (False, False, False)

    def write(text: str) -> None:
        nonlocal breaks
        if text:
            text = unescape(text)
            block.pieces.append(text)
            if not text.isspace():
                breaks = 0
                if linked:
                    block.linked += len(" ".join(text.split()))

    at, end = 0, len(html)
    while at < end:
        mark = _MARK.search(html, at)
        if not mark:
            write(html[at:])
            break
        write(html[at : mark.start()])
        at = mark.end()
        if mark[2] is None:
            continue
        closing, tag = bool(mark[1]), mark[2].lower()
        if tag in RAW:
            if not closing and not (mark[3] or "").endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(html, at)
                at = stop.end()
        elif tag == "br":
            breaks += 1
            block.pieces.append(" ")
            if breaks > 1:
                part()
        elif tag == "a":
            linked = not closing
        elif tag in BLOCKS:
            if closing:
                if count[tag]:
                    while opened[-1][0] != tag:
                        close()
                    close()
            else:
                # A paragraph ends where a block begins; items and cells end where the next begins.
                while opened and (opened[-1][0] == "p" or (opened[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th"))):
                    close()
                article, main, boilerplate = place
                place = (article or tag == "article", main or tag == "main", boilerplate or _is_boilerplate(tag, mark[3], article))
                if tag not in VOID:
                    opened.append((tag, *place))
                    count[tag] += 1
                else:
                    place = (article, main, boilerplate)
            breaks = 0
            part()
    part()
    return [b for b in found if b.text()]


def first_pass(block: Block, text: str, inside: bool) -> int | None:
    """A block's label by its own words; inside: it is of the part that the page names as its article."""
    if block.boilerplate or block.linked > LINKS * len(text):
        return BAD
    words = [w.strip("\"'.,;:!?()[]«»“”„’*#%$&…-–—").lower() for w in text.split(" ")]
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if not inside and "©" in text:
        return BAD
    if len(text) < SHORT:
        return BAD if block.linked else UNDECIDED
    if stops >= STOPS:
        return GOOD if len(text) >= LONG else UNDECIDED
    return UNDECIDED if inside else BAD


def second_pass(labels: list[int | None], edge: int) -> list[int]:
    """Ambiguous blocks inherit from the nearest decided one, of two as near from the good one; edge: what lies around the blocks."""
    n = len(labels)
    before, after, out = [(n + 1, edge)] * n, [(n + 1, edge)] * n, []
    for order, near, step in ((range(n), before, -1), (range(n - 1, -1, -1), after, 1)):
        last, label = (-1 if step < 0 else n), edge
        for k in order:
            near[k] = (abs(k - last), label)
            if labels[k] is not UNDECIDED:
                last, label = k, labels[k]
    for k, label in enumerate(labels):
        if label is UNDECIDED:
            (d, x), (e, y) = before[k], after[k]
            label = x if d < e else y if e < d else max(x, y)
        out.append(label)
    return out


def main_text(html: str) -> str:
    """The article of a page, its blocks joined by an empty line."""
    all_blocks = [(b, b.text()) for b in blocks(html)]
    inside = [(b, t) for b, t in all_blocks if b.article and not b.boilerplate] or [(b, t) for b, t in all_blocks if b.main and not b.boilerplate]
    looked_at = inside or all_blocks
    labels = [first_pass(b, t, bool(inside)) for b, t in looked_at]
    return "\n\n".join(t for (_, t), label in zip(looked_at, second_pass(labels, GOOD if inside else BAD)) if label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def work(pages_of_batch: list[str], urls: list[str | None]) -> list[list]:
        texts = [main_text(h) for h in pages_of_batch]
        return [urls, texts, [len(t) for t in texts]]

    named = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    return map_texts(named, work, "page_id long, url string, text string, n_chars long", id_col="page_id", text_col="html", also=("url",))
