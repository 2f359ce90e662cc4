"""Main text of web pages: page parts that are no article go, then each site's template."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.session import materialise

RECURRING = 0.5  # of a host's different pages: a subtree on more of them is template
LEAST_PAGES = 10  # different pages of a host that a template subtree is on, at least
SALTS = 64  # tasks that the pages of one host are dealt out to

# A quotation begins only right after an equals sign, as in browsers.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Elements, and words of class, id or role, that mark what is no article.
OUT = frozenset("head nav footer aside form button select option menu dialog object canvas audio video map input label".split()) | RAW
OUT_NAMES = frozenset("""ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended
comment comments reply replies disqus newsletter subscribe subscription signup login search widget pagination pager footer contentinfo
complementary toolbar skip""".split())
OUT_ABOVE = frozenset("header masthead topbar".split())
# What follows a marking word in names like "ad-slot" or "comment-list": fixed list.
PARTS = frozenset("area bar block body bottom box button card cell container content form frame header holder inner item items left link links list module outer panel position right row section slot space text title top unit wrap wrapper".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr td th caption figcaption".split())
# An opening tag ends the open elements of these names, up to the element that holds them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
HOLDS = frozenset("ul ol dl table article section main div body td th blockquote".split())


def meaning(name: str) -> tuple[str, ...]:
    """What a class, id or role may say: the name, its last word ("site-footer"), and its first one
    where only parts of a page follow ("ad-slot"). An "ad-free" line and a "notice-board" say neither."""
    words = [w for w in NAME.findall(name) if not w.isdigit()]
    first = words[:1] if all(w in PARTS or w in OUT_NAMES for w in words[1:]) else []
    return (name, *words[-1:], *first)


class Node:
    __slots__ = ("children", "names", "seal", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.seal = tag, [], None
        self.names = frozenset(n for _, *values in ATTRIBUTE.findall(attributes) for w in "".join(values).lower().split() for n in meaning(w)) if attributes else frozenset()


def parse(page: str) -> Node:
    """The element tree of a page, however broken: unclosed elements end where they must."""
    root = Node("")
    stack, at = [root], 0
    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not found:
            return root
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        ended = ENDS.get(tag, ()) if tag in INLINE or tag in ENDS else {"p"}
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ended:
                del stack[depth:]
                break
            if stack[depth].tag in HOLDS and stack[depth].tag not in ended:
                break
        node = Node(tag, found[3])
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(page, at)
            at = close.end()
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            stack.append(node)


def _is_out(node: Node, inside: bool) -> bool:
    if node.tag in ("article", "main", "body", "html"):
        return node.tag == "article" and bool(node.names & {"comment", "comments", "reply"})
    return node.tag in OUT or bool(node.names & OUT_NAMES) or not inside and (node.tag == "header" or bool(node.names & OUT_ABOVE))


def article(root: Node) -> tuple[list[Node], bool]:
    """The outermost article elements, else the main element, else the page; whether marked so."""
    for wanted in ("article", "main"):
        found, open_ = [], [root]
        while open_:
            node = open_.pop()
            for child in reversed(node.children):
                if isinstance(child, Node) and not _is_out(child, False):
                    open_.append(child)
            if node.tag == wanted or wanted == "main" and "main" in node.names:
                del open_[len(open_) - sum(isinstance(c, Node) and not _is_out(c, False) for c in node.children) :]
                found.append(node)
        if found:
            return found, True
    return [root], False


def seal(node: Node, marked: bool, out: set[int] | None = None) -> int:
    """A hash of the subtree's elements and words; adds those of removable subtrees to `out`."""
    open_ = [(node, False)]
    while open_:
        node, ready = open_.pop()
        if not ready:
            open_.append((node, True))
            open_ += [(c, False) for c in node.children if not isinstance(c, str) and c.seal is None and not _is_out(c, True)]
            continue
        hasher = xxhash.xxh3_64()
        hasher.update(node.tag)
        for child in node.children:
            if isinstance(child, str):
                hasher.update(" ".join(child.split()))
            elif child.seal is not None:
                hasher.update(b"<%d>" % child.seal)
        node.seal = hasher.intdigest() - (1 << 63)
        if out is not None and node.tag not in INLINE and not (marked and node.tag in PROSE):
            out.add(node.seal)
    return node.seal


def blocks(node: Node, marked: bool, template: frozenset[int], lines: list[str], open_: list[str]) -> None:
    """The text of a subtree, a line for each block, without what goes; `open_` is the line that has begun."""
    if template:
        seal(node, marked)
    stack = [iter(node.children)]
    inside: list[Node] = []  # the elements whose children are being read
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if inside and inside.pop().tag not in INLINE:
                _flush(lines, open_)
        elif isinstance(child, str):
            open_.append(child)
        elif child.tag == "br":
            open_.append(" ")
        elif not _is_out(child, True):
            if child.tag not in INLINE:
                if child.seal in template and not (marked and child.tag in PROSE):
                    continue
                _flush(lines, open_)
            inside.append(child)
            stack.append(iter(child.children))


def _flush(lines: list[str], open_: list[str]) -> None:
    line = " ".join("".join(open_).split())
    open_.clear()
    if line:
        lines.append(line)


def main_text(page: str | None, template=frozenset()) -> str:
    """Blocks of the article in page order, one to a line, without the given subtrees."""
    lines: list[str] = []
    roots, marked = article(parse(page or ""))
    for node in roots:
        open_: list[str] = []
        blocks(node, marked, frozenset(template), lines, open_)
        _flush(lines, open_)
    return "\n".join(lines)


def host(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def templates(pages: DataFrame, recurring: float = RECURRING, least: int = LEAST_PAGES) -> DataFrame:
    """(host, seals): hashes of the subtrees on more than `recurring` of a host's pages.

    Pages with equal articles count once, so copies of a page don't make it a template.
    Counts are aggregated before the shuffle, however many pages a host has; a host's
    list is short, as each entry is on half of its pages. Within a marked article only
    whole containers are template, never a single paragraph, heading, item or cell.
    """
    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seals, page_of = [], [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                roots, marked = article(parse(page or ""))
                found: set[int] = set()
                whole = xxhash.xxh3_64_intdigest(b"".join(b"%d," % seal(node, marked, found) for node in roots)) - (1 << 63)
                found -= {node.seal for node in roots}
                rows += [i] * (len(found) + 1)
                seals += [None, *found]
                page_of += [whole] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(seals, pa.int64()), pa.array(page_of, pa.int64())],
                                             ["host", "seal", "page"])

    found = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(subtrees, "host string, seal long, page long")
    counts = materialise(found.distinct().groupBy("host", "seal").agg(F.count("*").alias("n")), "subtrees")
    totals = counts.filter("seal is null").select("host", F.col("n").alias("pages"))
    often = counts.filter("seal is not null").filter(F.col("n") >= least).join(totals, "host")
    return often.filter(F.col("n") > recurring * F.col("pages")).groupBy("host").agg(F.collect_list("seal").alias("seals"))


def extract(pages: DataFrame, recurring: float = RECURRING, least: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`.

    text is the article without menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, comments and the host's template. NULL and empty pages have an empty
    text; a NULL url belongs to the host without a name; repeated rows give equal rows;
    other columns are ignored; an empty table gives an empty one.
    """
    @F.pandas_udf("string")
    def text(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, seals in columns:
            yield pd.Series([main_text(h, () if s is None else s.tolist()) for h, s in zip(page, seals)], dtype=object)

    # A host's pages go to SALTS places, each with the host's short list.
    found = templates(pages, recurring, least).select(F.col("host").alias("_host"), "seals", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    joined = pages.select("page_id", "url", "html").join(found, (host(F.col("url")) == F.col("_host")) & (salt == F.col("_salt")), "left")
    return joined.select("page_id", "url", text("html", "seals").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
