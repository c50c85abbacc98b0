"""Main text of web pages by composite text density.

A page becomes a tree of its block elements; inline tags only count. For each block, with characters C, tags T, link
characters LC and link tags LT below it, the composite density is

    C / T * log base ln(C / (C - LC) * LC + LC_body / C_body * C + e) of (C / LC * T / LT)

(zero denominators count as 1), and its density sum is the sum over its child blocks. The block with the largest sum holds the
article. The least density on the path from the body to it is the threshold: other blocks at or above it give their own
block with the largest sum. An article or main element around the best block is taken whole.

Elements that are by name, role or class menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments
leave before the densities are computed. Classes and ids count as whole words; of hyphenated ones the first part counts for
adverts, comments, cookie notices and share links, the last one for headers, footers and menus. Blocks that a class marks, and
forms outside articles, stay if they hold an article or, on pages without one, most of the body's unlinked characters. In
articles, only containers are judged by all of these words, other blocks by those of adverts and comments. A header inside an article
stays, as it holds the title.
The text has one line per block: references decoded, white space turned into one space, trimmed; blank blocks give no line.

NULL, blank and text-free pages give an empty text. In tags, quotes count only where a value begins; a tag, comment or raw element that
is never closed goes on to the end of the page. Broken markup is read like a browser would: paragraphs, list items
and cells end where the next begins, end tags without a start are ignored. Work and memory are linear in the page.
Repeated rows give repeated results; an empty table gives an empty result. Columns other than id, url and html are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# Element names and the words in classes, ids and roles that mark what is no article.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter nobr output picture q rp rt ruby s samp small source "
    "span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav aside footer form script style noscript iframe button select textarea svg math template head title object dialog menu".split())
RAW = "script|style|noscript|iframe|textarea|title|template|svg|math|select"
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
    "ol p pre section table ul li dt dd tr td th".split()
)
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ()}
KEPT = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbygoogle sponsor sponsored promo promotion promoted comment comments disqus respond reply replies "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets "
    "breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations login search skip toolbar".split()
)
SELDOM = frozenset("nav navbar navigation menu menus header footer masthead banner topbar bottombar toc copyright legal disclaimer byline tags meta aside".split())
CONTENT = frozenset("article content main post entry story body text page".split())

# Words that mark adverts and reader comments on any element, first and last parts of hyphenated words, and what "related-" lists.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion comment comments disqus reply replies".split())
HEADS = STRONG | frozenset(
    "cookie cookies consent gdpr newsletter subscribe subscription signup sidebar widget breadcrumb breadcrumbs pagination pager share sharing social popup modal overlay".split()
)
TAILS = frozenset("nav navbar navigation menu header footer masthead breadcrumbs".split())
LISTED = frozenset("posts articles stories links news content items reading topics".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>=]")
VALUE = re.compile(r"\s*")
MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?", re.IGNORECASE)
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW.split("|")}


def tokens(source: str):
    """(text before, end tag, name, attributes) of each tag and, without a name, of the text at the end.

    The contents of raw elements are no text; they come in place of the attributes of their end tag.

    Every character is passed once: quotes count only where a value begins, and what is never closed goes on to the end.
    """
    at = 0  # where the text before the next tag begins
    look = 0
    size = len(source)
    while True:
        begin = source.find("<", look)
        if begin < 0:
            break
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            yield source[at:begin], False, None, ""
            if end < 0:
                return
            at = look = end + 3
            continue
        tag = TAG.match(source, begin)
        if tag is None:
            if source[begin + 1 : begin + 2] not in ("!", "?", "/"):
                look = begin + 1  # text
                continue
            end = source.find(">", begin)
            if end < 0:
                break
            yield source[at:begin], False, None, ""
            at = look = end + 1
            continue
        place = tag.end()
        while True:  # to the end of the tag
            stop = STOP.search(source, place)
            if stop is None or stop[0] == ">":
                break
            place = VALUE.match(source, stop.end()).end()
            if source[place : place + 1] in ('"', "'"):
                end = source.find(source[place], place + 1)
                place = end + 1 if end >= 0 else size if source.find(">", place) < 0 else place + 1
        if stop is None:
            if source.find(">", begin) < 0:
                break  # no tag any more
            yield source[at:begin], False, None, ""
            return
        name, rest = tag[2].lower(), source[tag.end() : stop.start()]
        yield source[at:begin], tag[1] == "/", name, rest
        at = look = stop.end()
        if name in RAW_ENDS and not tag[1] and not rest.endswith("/"):
            close = RAW_ENDS[name].search(source, at)
            end = source.find(">", close.end()) if close else -1
            if end < 0:
                return
            yield "", True, name, source[at : close.start()]
            at = look = end + 1
    yield source[at:], False, None, ""


def _marked(words: set[str], in_article: bool) -> bool:
    """Whether class or id words mark what is no article."""
    if not words.isdisjoint(NEVER) or (not words.isdisjoint(SELDOM) and words.isdisjoint(CONTENT)):
        return True
    for word in words:
        parts = re.split("[-_]+", word)
        if len(parts) > 1 and (parts[0] in HEADS or not in_article and parts[-1] in TAILS or parts[0] in ("related", "recommended") and not LISTED.isdisjoint(parts[1:])):
            return True
    return False


def _unwanted(name: str, rest: str, in_article: bool) -> bool | None:
    """Whether an element leaves at once; None if its class or id says so, which its contents can overrule."""
    if name == "form" and not in_article:
        return None  # some hold the whole page
    if name in DROPPED:
        return True
    if name == "header" and not in_article:
        return True
    if not rest or "=" not in rest and "hidden" not in rest:
        return False
    words: set[str] = set()
    for key, *values in MARKS.findall(rest):
        value, key = "".join(values), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return name not in KEPT
        if key == "style":
            if name not in KEPT and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return True
        elif key == "role":
            if name not in KEPT and value.strip().lower() in ROLES:
                return True
        else:
            words.update(value.lower().split())
    if name in KEPT:
        return name == "article" and not words.isdisjoint(STRONG)  # a reader's comment as an article of its own
    if in_article and name not in ("div", "section", "ul", "ol"):
        return name not in INLINE and not words.isdisjoint(STRONG)
    if _marked(words, in_article):
        return True if name in INLINE else None
    return False


class _Page:
    """Blocks in page order: parent, own and inherited counts, and lines of text."""

    def __init__(self):
        self.name, self.parent, self.children = ["body"], [-1], [[]]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.doubtful: list[int] = []  # blocks whose class or id marks them as no article
        self.parts: list[list] = [[]]  # texts, and the numbers of child blocks between them

    def add(self, name: str, parent: int) -> int:
        k = len(self.name)
        self.name.append(name)
        self.parent.append(parent)
        self.children.append([])
        self.children[parent].append(k)
        for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
            counts.append(0)
        self.parts.append([])
        self.parts[parent].append(k)
        self.tags[parent] += 1
        return k


LISTS = frozenset([*ENDS_LIKE, *(name for names in HOLDS.values() for name in names)])


def parse(source: str) -> _Page:
    page = _Page()
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements and their blocks; inline ones have that of the block around
    blocks, lists = [0], []  # places in the stack of elements that are not inline, and of parts of lists and tables
    opened: dict[str, int] = {}  # how many elements of a name are open
    links = articles = dropped = 0  # open links and articles; depth at which an unwanted element began

    def push(name: str, block: int):
        nonlocal links, articles
        if name not in INLINE:
            blocks.append(len(stack))
        if name in LISTS:
            lists.append(len(stack))
        stack.append((name, block))
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
        articles += name in ("article", "main")

    def close(to: int):
        nonlocal links, articles, dropped
        while len(stack) > to:
            name, _ = stack.pop()
            opened[name] -= 1
            links -= name == "a"
            articles -= name in ("article", "main")
        while blocks[-1] >= to:
            blocks.pop()
        while lists and lists[-1] >= to:
            lists.pop()
        if dropped > len(stack):
            dropped = 0

    def write(text: str):
        if dropped or not text:
            return
        text = html.unescape(text) if "&" in text else text
        block = stack[-1][1]
        page.parts[block].append(text)
        size = len(text) if not text[0].isspace() and not text[-1].isspace() else len(text.strip())
        page.chars[block] += size
        if links:
            page.link_chars[block] += size

    for text, ends, name, rest in tokens(source):
        write(text)
        if name is None or name in ("html", "body"):
            continue
        if ends:
            if opened.get(name):
                least = blocks[-1] if name in INLINE else 0
                for k in range(len(stack) - 1, least, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
            continue
        if name in ENDS_PARAGRAPH and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if name in ENDS_LIKE:
            for k in reversed(lists):
                if stack[k][0] in ENDS_LIKE[name]:
                    close(k)
                    break
                if stack[k][0] in HOLDS[name]:
                    break
        block = stack[-1][1]
        if name in VOID:
            if not dropped:
                page.tags[block] += 1
                if name in ("br", "hr"):
                    page.parts[block].append(" ")
            continue
        unwanted = not dropped and _unwanted(name, rest, articles > 0)
        if unwanted:
            push(name, block)
            dropped = len(stack)
        elif name in INLINE or dropped:
            push(name, block)
            if not dropped:
                page.tags[block] += 1
                page.link_tags[block] += name == "a"
        else:
            push(name, page.add(name, block))
            if unwanted is None:
                page.doubtful.append(stack[-1][1])
        if rest.endswith("/") and name not in INLINE and name not in ENDS_PARAGRAPH:
            close(len(stack) - 1)
    _without_doubtful(page)
    return page


def _without_doubtful(page: _Page) -> None:
    """Takes out doubtful blocks, unless they hold an article or, on pages without one, most of the body's unlinked characters."""
    if not page.doubtful:
        return
    count = len(page.name)
    last, plain = list(range(count)), [c - x for c, x in zip(page.chars, page.link_chars)]
    holds = [name in ("article", "main") for name in page.name]
    for k in range(count - 1, 0, -1):
        up = page.parent[k]
        last[up] = max(last[up], last[k])
        plain[up] += plain[k]
        holds[up] |= holds[k]
    gone, end = set(), -1
    for k in page.doubtful:  # in page order
        if k <= end or holds[k] or not holds[0] and 2 * plain[k] > plain[0]:
            continue
        gone.add(k)
        end = last[k]
        for counts in (page.chars, page.tags, page.link_chars, page.link_tags):
            counts[k : end + 1] = [0] * (end + 1 - k)
        page.parts[k : end + 1] = [[] for _ in range(k, end + 1)]
        page.tags[page.parent[k]] -= 1
    for up in {page.parent[k] for k in gone}:
        page.children[up] = [k for k in page.children[up] if k not in gone]
        page.parts[up] = [x for x in page.parts[up] if not (isinstance(x, int) and x in gone)]


def densities(page: _Page) -> tuple[list[float], list[float]]:
    """Composite density and density sum of each block; counts become those of whole subtrees."""
    for k in range(len(page.name) - 1, 0, -1):
        up = page.parent[k]
        for counts in (page.chars, page.tags, page.link_chars, page.link_tags):
            counts[up] += counts[k]
    body_share = page.link_chars[0] / (page.chars[0] or 1)
    density = []
    for chars, tags, link_chars, link_tags in zip(page.chars, page.tags, page.link_chars, page.link_tags):
        if not chars:
            density.append(0.0)
            continue
        base = math.log(chars / ((chars - link_chars) or 1) * link_chars + body_share * chars + math.e)
        ratio = chars / (link_chars or 1) * ((tags or 1) / (link_tags or 1))
        plain = chars / (tags or 1)
        # A base of 1 (no links on the page) leaves no logarithm to that base; the natural one then stands for all blocks.
        density.append(plain * math.log(max(ratio, 1.0)) / (math.log(base) if base > math.e ** 1e-6 and math.log(base) > 1e-9 else 1.0))
    sums = [sum(density[c] for c in children) for children in page.children]
    return density, sums


def chosen(page: _Page) -> list[int]:
    """Blocks that hold the article, in page order, none inside another."""
    density, sums = densities(page)
    if not page.chars[0]:
        return []
    count = len(page.name)
    last = list(range(count))  # last block of each subtree
    best = list(range(count))  # block with the largest sum in each subtree, the first among equals
    for k in range(count - 1, 0, -1):
        up = page.parent[k]
        last[up] = max(last[up], last[k])
        if sums[best[k]] > sums[best[up]] or sums[best[k]] == sums[best[up]] and best[up] != up:
            best[up] = best[k]
    main = best[0] if sums[best[0]] > 0 else 0
    k, threshold = main, density[main]
    while k > 0:
        k = page.parent[k]
        threshold = min(threshold, density[k])
    k = main
    while k > 0 and page.name[k] not in ("article", "main"):
        k = page.parent[k]
    if k > 0:
        return [k]
    taken, k = [], 0
    marked = {main}
    while k < count:  # blocks at or above the threshold give their best block
        if k in marked:
            k = last[k] + 1
        elif density[k] >= threshold and not k <= main <= last[k]:
            marked.add(best[k] if sums[best[k]] > 0 else k)
            k = last[k] + 1
        else:
            k += 1
    for k in sorted(marked):
        if not taken or k > last[taken[-1]]:
            taken.append(k)
    return taken


def lines(page: _Page, root: int) -> list[str]:
    """The texts of the blocks below *root*, each without surplus white space."""
    out: list[str] = []
    stack = [(root, 0)]
    open_line: list[str] = []

    def end():
        text = " ".join("".join(open_line).split())
        open_line.clear()
        if text:
            out.append(text)

    while stack:
        block, at = stack.pop()
        parts = page.parts[block]
        while at < len(parts) and not isinstance(parts[at], int):
            open_line.append(parts[at])
            at += 1
        end()
        if at < len(parts):
            stack.append((block, at + 1))
            stack.append((parts[at], 0))
    return out


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = parse(source)
    return "\n".join(line for root in chosen(page) for line in lines(page, root))


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Rows (id, url, text), one per page."""
    narrow = pages.select(pages[id].alias("id"), pages[url].alias("url"), pages[source].cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                text = pa.array([main_text(x.as_py()) for x in part.column(2)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], ["id", "url", "text"])

    return narrow.mapInArrow(run, narrow.select("id", "url", F.lit("").alias("text")).schema)


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = extract(table(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_main_text": (op2_main_text, None)}
