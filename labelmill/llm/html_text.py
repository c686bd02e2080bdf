"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block elements. First pass: elements and names that mark page furniture, link density, length and
stop-word density decide what they can; second pass: blocks still open take the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import Carried, whole
from labelmill.llm.quality import COMMON_WORDS

STOP_WORDS = frozenset(COMMON_WORDS)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # their content is no markup
SKIPPED = frozenset("nav footer aside form noscript template svg math select button object head dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                   "h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|masthead|menu|modal|nav\w*|newsletter|notices?|overlay|"
                       r"pagination|popup|promo\w*|related|repl(?:y|ies)|respond|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|tags?|toolbar|widget)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu".split())
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|repl(?:y|ies)|respond)(?:$|[\s_-])", re.I)
# A tag ends before the next "<" outside quotes, so that one that is never closed costs no more than its own length.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^<>]*>""", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

LONG, SHORT = 200, 70
HIGH_STOPS, LOW_STOPS, NO_STOPS = 0.30, 0.15, 0.05  # below the last: a language without a word list, or no sentences
MANY_LINKS, SOME_LINKS = 0.5, 0.2
ZONES = 8  # of nested elements with such names, how many innermost ones are looked at


class Block:
    __slots__ = ("parts", "linked", "where", "heading", "zones")

    def __init__(self, where: str, heading: bool, zones: tuple[int, ...] = ()):
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.where, self.heading = where, heading  # where: out, body, main, article
        self.zones = zones  # elements round it whose names speak against it; below 0 the comments of readers

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _furniture(name: str, attributes: str) -> str | None:
    """``out``: never main text; ``replies`` and ``named``: a class or id speaks against it."""
    if name in SKIPPED:
        return "out"
    if not attributes or name in ("html", "body", "main", "article"):
        return None
    named = None
    for key, value in NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return "out"
        if key in ("class", "id") and FURNITURE.search(value):
            named = "replies" if REPLIES.search(value) or named == "replies" else "named"
    return named


def blocks_of(page: str) -> Iterator[Block]:
    """The page's blocks in order, each with where it stands: ``out`` is inside page furniture. Time grows with the page's length."""
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # element, and what holds again after it: where, inside a link, zones
    opened: Counter[str] = Counter()
    where, in_link, zones, made, at = "body", False, (), 0, 0
    block = Block(where, False)
    n = len(page)
    while at < n:
        tag = TAG.search(page, at)
        text = page[at : tag.start() if tag else n]
        if text:
            chunk = html.unescape(text)
            block.parts.append(chunk)
            if in_link:
                block.linked.append(chunk)
        if not tag:
            break
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        if name == "br":
            block.parts.append(" ")
            continue
        shut = None
        if not tag[1]:
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if name == "li" and stack and stack[-1][0] == "li":
                shut = "li"
            elif name in CLOSES_P and any(e[0] == "p" for e in stack[-4:]):
                shut = "p"
        else:
            shut = name
            if not opened[name]:
                if name in BLOCKS and block.parts:
                    yield block
                    block = Block(where, False, zones)
                continue
        while shut and opened[shut]:
            last, where, in_link, zones = stack.pop()
            opened[last] -= 1
            if last == shut:
                break
        if not tag[1] and name not in EMPTY:
            stack.append((name, where, in_link, zones))
            opened[name] += 1
            if where != "out":
                kind = _furniture(name, tag[3])
                if kind == "out" or name == "header" and where == "body":
                    where = "out"
                elif kind:
                    made += 1
                    zones = (*zones, -made if kind == "replies" else made)[-ZONES:]
                elif name in ("article", "main"):
                    where = "article" if name == "article" or where == "article" else "main"
            in_link = in_link or name == "a"
        if name in BLOCKS:
            if block.parts:
                yield block
            block = Block(where, not tag[1] and re.fullmatch("h[1-6]", name) is not None, zones)
    if block.parts:
        yield block


def _judge_zones(found: list[tuple[Block, str]]) -> None:
    """Blocks in elements whose names speak against them go ``out``, unless such an element holds most of the page's running text.

    That is so if no text stands in an article or main element outside such names, and more than half of the running text, reader comments aside, is in the element.
    """
    running = [(b, len(t)) for b, t in found if b.where != "out" and len(t) >= SHORT and link_share(b, t) <= MANY_LINKS and not any(z < 0 for z in b.zones)]
    spared: set[int] = set()
    if not any(not b.zones and b.where in ("article", "main") and link_share(b, t) <= MANY_LINKS for b, t in found):
        held: Counter[int] = Counter()
        for b, size in running:
            held.update(dict.fromkeys(b.zones, size))
        total = sum(size for _, size in running)
        spared = {z for z, size in held.items() if 2 * size > total}
    for b, _ in found:
        if any(z not in spared for z in b.zones):
            b.where = "out"


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(len(words), 1)


def link_share(block: Block, text: str) -> float:
    return len(" ".join("".join(block.linked).split())) / max(len(text), 1)


def first_label(block: Block, text: str, inside: bool) -> bool | None:
    """True: main text, False: not, None: open. ``inside``: the block stands in the page's article."""
    links, stops = link_share(block, text), stop_share(text)
    prose = len(text) >= LONG and stops >= LOW_STOPS  # may hold links
    if links > MANY_LINKS or not inside and ("\N{COPYRIGHT SIGN}" in text or links > SOME_LINKS and not prose):
        return False
    if len(text) < SHORT:
        return None
    if stops >= HIGH_STOPS or inside and stops >= LOW_STOPS:
        return True if inside or len(text) >= LONG else None
    if stops >= LOW_STOPS or stops < NO_STOPS or inside:
        return None
    return False


def home_of(found: list[tuple[Block, str]]) -> tuple[str, ...]:
    """Where the main text stands: the article, else also the main element, else the whole body.

    The first of them that holds half of the running text is it. Blocks of ``LONG`` characters count, on pages without such ones those of
    ``SHORT``, else all; links count nowhere.
    """
    lengths = [(b.where, len(t)) for b, t in found if b.where != "out" and link_share(b, t) <= MANY_LINKS]
    for least in (LONG, SHORT, 1):
        total = sum(n for _, n in lengths if n >= least)
        for home in (("article",), ("article", "main")):
            if total and 2 * sum(n for w, n in lengths if n >= least and w in home) >= total:
                return home
        if total:
            break
    return ("article", "main", "body")


def main_text(page: str | None) -> str:
    """The main text: blocks joined by line feeds, white space in a block as one space; empty if there is none."""
    found = [(b, t) for b in blocks_of(page or "") if (t := b.text())]
    _judge_zones(found)
    home = home_of(found)
    body = "body" in home
    labels: list[bool | None] = [False if b.where not in home else first_label(b, t, not body) for b, t in found]
    if body and True not in labels:
        # No block of a known language stands out: length and links alone decide for blocks without function words.
        open_ = [i for i, x in enumerate(labels) if x is None and len(found[i][1]) >= SHORT and stop_share(found[i][1]) < NO_STOPS]
        least = LONG if any(len(found[i][1]) >= LONG for i in open_) else SHORT
        for i in open_:
            labels[i] = True if len(found[i][1]) >= least else None
    decided = [x if b.where in home else None for x, (b, _) in zip(labels, found)]
    earlier, later = list(decided), list(decided)  # the nearest decided neighbours, for open blocks
    for i in range(1, len(found)):
        earlier[i] = decided[i] if decided[i] is not None else earlier[i - 1]
        later[-1 - i] = decided[-1 - i] if decided[-1 - i] is not None else later[-i]
    result = []
    for i, label in enumerate(labels):
        if label is None:
            before, after = earlier[i], later[i]
            if body:
                label = bool(before and after) or bool(after and found[i][0].heading) or bool(before and after is None)
            else:  # in an article, an open block is dropped only between blocks that are
                label = not (before is False and after is False)
        if label:
            result.append(found[i][1])
    return "\n".join(result)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("_html")]
        names = [n for n in batch.schema.names if n != "_html"]
        yield pa.record_batch([*[batch.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` but with ``text`` and ``n_chars``; one row for each, no shuffle.

    Null or empty html, or a page without main text: empty text. Columns named ``text`` or ``n_chars`` are replaced. Repeated rows are
    judged each. No rows: no rows. Pages cut off in the middle are read as far as they go.
    """
    rest = Carried(pages, "text", "n_chars", html_col)
    plain = pages.select(*rest.cols, whole(html_col).alias("_html"))
    made = plain.mapInArrow(_extract, ", ".join(x for x in (rest.fields, "text string, n_chars bigint") if x))
    return made.select(*rest.back(), "text", "n_chars")
