"""Main text of web pages: a host's suffix array and markup.

A page is read once into blocks. Markup says what a block is for certain: frame (menus, headers, footers, sidebars, forms,
hidden parts, and elements whose class or id names an advert, notice or comments and nothing else), article (inside article
or main, or a role of that name), or open. In an article, a class that names a frame among other things, such as
share-price or search-methods, is a weak hint.

Everything outside articles, and blocks of weak hints, are the page's token stream, and the streams of all of a host's
pages go to its suffix array. A token is covered if it lies in a substring of RUN tokens or more that a page of other
content has too. The array decides what markup leaves open:

* On a page that marks no article, covered tokens are boilerplate; the unique runs of open blocks are the text.
* A page's open text is its text, too, where more of it is unique than there is in its articles, which then are teasers or
  comments.
* A block of a weak hint is boilerplate if at least half of it is covered.

Text in marked articles that carries no hint stays even if other pages have it: that is the author's.

The maximal repeats of a suffix array that have RUN tokens or more cover the same tokens as the repeats of just RUN
tokens. So suffixes are compared to that depth only, and neighbours in the array are found by grouping suffixes by host
and first RUN tokens, with partial aggregates before the shuffle: no host's array is held by one task, and a prefix that
all pages share is one row a task.

Defined results: null and empty html give the empty text; unclosed and stray tags, and unclosed quotes, are allowed; an
unclosed frame element ends with its parent; repeated rows, and copies of a page under other ids or urls, are one page to
the array and come back once each; a null url is a host of its own; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Tokens that a repeated substring must have to be boilerplate.
RUN = 8

# Fixed values of HTML: elements that end a block, that hold no text of the page, and that never close.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody tfoot thead title tr ul".split())
RAW = frozenset("script style textarea title template iframe xmp noembed noframes svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("nav footer aside form menu dialog head button select datalist fieldset".split())
#: Words of class, id and role that name a frame element.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu breadcrumb breadcrumbs toolbar sidebar"
    " footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended"
    " comment comments commentlist respond replies disqus widget complementary contentinfo".split()
)
#: Words that say nothing about what an element is for.
PLAIN = frozenset("main top bottom left right inner outer box bar block list item items area section container wrapper wrap holder unit slot panel group row col column page site global primary secondary content body text links link button buttons icon icons form field new js".split())

_TAG = re.compile(
    r"<(?:"
    r"(/?)([a-zA-Z][^\s/>]*)((?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)?/?)(?:>|\Z)"
    r"|!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CARES = re.compile(r"\b(?:class|id|role|hidden)\b", re.I)
_NAME = re.compile(r"[a-z0-9]+")
ARTICLE, OPEN, FRAMED, WEAK = "a", "o", "f", "w"


def _hints(attributes: str, inside: bool) -> tuple[str, bool]:
    """What class, id and role say of an element, FRAMED, WEAK or nothing; and whether its role is that of an article."""
    found = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true":
        return FRAMED, False
    said = ""
    for token in f"{found.get('class', '')} {found.get('id', '')} {role}".lower().split():
        words = set(_NAME.findall(token))
        hints = words & HINTS - ({"header"} if inside else set())  # in an article, its own header holds its heading
        if hints:
            said = FRAMED if words - hints <= PLAIN else said or WEAK
        if said == FRAMED:
            break
    return said, role in ("main", "article")


def blocks(html: str | None) -> tuple[list[tuple[str, str]], bool]:
    """The page's blocks in order (region, text), and whether the page marks an article."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, str]] = []  # open elements: name, in an article, what it is
    inside, kind, any_marked = False, "", False

    def flush() -> None:
        if said := " ".join(unescape("".join(text)).split()):
            out.append((kind if kind == FRAMED or kind == WEAK and inside else ARTICLE if inside else OPEN, said))
        text.clear()

    at, html = 0, html or ""
    skip_to = 0
    for m in _TAG.finditer(html):
        start, end = m.span()
        if start < skip_to:
            continue
        if start > at:
            text.append(html[at:start])
        at = end
        name = m[2]
        if not name:
            continue
        name = name.lower()
        block = name in BLOCK
        if block and text:
            flush()
        if m[1]:
            if stack and stack[-1][0] == name:
                stack.pop()
            elif any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
            else:
                continue
            if text and not block:  # an inline element that is frame ends its own block
                flush()
            inside, kind = stack[-1][1:] if stack else (False, "")
            continue
        if block:
            while stack and (stack[-1][0] == "p" or stack[-1][0] == name == "li"):  # an open paragraph ends here
                stack.pop()
            inside, kind = stack[-1][1:] if stack else (False, "")
        elif name in ("br", "td", "th"):
            text.append(" ")
        attributes = m[3]
        if name in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, end)
            at = skip_to = close.end() if close else len(html)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        said, marked = _hints(attributes, inside) if attributes and _CARES.search(attributes) else ("", False)
        opens = marked or name in ("article", "main")
        if kind == FRAMED or name in FRAME or (name == "header" and not inside):
            said = FRAMED
        elif name in ("html", "body"):
            said = kind
        said = said or kind
        any_marked |= opens and said != FRAMED
        if block or said != kind:
            if text:
                flush()
            stack.append((name, inside or (opens and said != FRAMED), said))
            inside, kind = stack[-1][1:]
    if at < len(html):
        text.append(html[at:])
    if text:
        flush()
    return out, any_marked


PAGE = T.StructType(
    [
        T.StructField("article", T.StringType()),  # the text of marked articles, less weak hints
        T.StructField("stream", T.ArrayType(T.StringType())),  # the tokens of all other blocks
        T.StructField("asks", T.BooleanType()),  # whether the array decides
        T.StructField("regions", T.ArrayType(T.StringType())),  # of the blocks, where it does
        T.StructField("texts", T.ArrayType(T.StringType())),
    ]
)


def read_page(html: str | None) -> tuple:
    found, marked = blocks(html)
    size = lambda region: sum(t.count(" ") + 1 for r, t in found if r == region)
    stream = [w for r, t in found if r != ARTICLE for w in t.split(" ")]
    asks = any(r == WEAK for r, _ in found) or size(OPEN) > size(ARTICLE)
    article = "" if asks else "\n".join(t for r, t in found if r == ARTICLE)
    return article, stream, asks, [r for r, _ in found] if asks else None, [t for _, t in found] if asks else None


@F.pandas_udf(PAGE)
def _read(htmls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in htmls], columns=PAGE.names)


_read = _read.asNondeterministic()  # so that no filter copies it


def decide(regions: list[str], texts: list[str], starts: list[int], run: int) -> str:
    """The text of a page whose substrings of `run` tokens from these starts of its stream are repeated."""
    covered = {i for s in starts for i in range(s, s + run)}
    at, article, unique, sizes = 0, [], [], {ARTICLE: 0, OPEN: 0}
    for region, text in zip(regions, texts, strict=True):
        words = text.split(" ")
        if region == ARTICLE:
            article.append(text)
            sizes[ARTICLE] += len(words)
            continue
        own = [w for k, w in enumerate(words, at) if k not in covered]
        at += len(words)
        if region == WEAK and 2 * len(own) > len(words):
            article.append(text)
            sizes[ARTICLE] += len(words)
        elif region == OPEN and own:
            unique.append(" ".join(own))
            sizes[OPEN] += len(own)
    return "\n".join(unique if sizes[OPEN] > sizes[ARTICLE] else article)


@F.pandas_udf(T.StringType())
def _decided(regions: pd.Series, texts: pd.Series, starts: pd.Series, run: pd.Series) -> pd.Series:
    return pd.Series([decide(r, t, s if s is not None else [], n) for r, t, s, n in zip(regions, texts, starts, run, strict=True)], dtype=object)


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def suffixes(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(host, page, start, prefix): the suffixes of the pages' streams, each by its first `run` tokens."""
    starts = F.expr(f"sequence(1, size(stream) - {run - 1})")
    rows = pages.where(F.size("stream") >= run).select("host", "page", "stream", F.explode(starts).alias("at"))
    return rows.select("host", "page", (F.col("at") - 1).alias("start"), F.array_join(F.slice("stream", F.col("at"), run), " ").alias("prefix"))


def repeated(all_suffixes: DataFrame) -> DataFrame:
    """(host, prefix) of neighbours in the host's suffix array that come from pages of different content."""
    return all_suffixes.groupBy("host", "prefix").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a < b").select("host", "prefix")


def covered(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(host, page, starts) of the pages that ask: where in their streams repeated substrings of `run` tokens begin."""
    asking = suffixes(pages.where("asks").dropDuplicates(["host", "page"]), run)
    return asking.join(repeated(suffixes(pages, run)), ["host", "prefix"], "left_semi").groupBy("host", "page").agg(F.collect_list("start").alias("starts"))


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    What the one pass over the html finds goes to a scratch table; only pages that ask the array meet it in a join.
    """
    rows = pages.select("page_id", "url", host_of("url").alias("host"), _read("html").alias("p")).select("page_id", "url", "host", "p.*")
    rows = materialize(rows.withColumn("page", F.xxhash64("stream")), "pages", compression="zstd")
    asking = rows.where("asks").join(covered(rows, run), ["host", "page"], "left").withColumn("text", _decided("regions", "texts", "starts", F.lit(run)))
    both = rows.where("NOT asks").select("page_id", "url", F.col("article").alias("text")).unionByName(asking.select("page_id", "url", "text"))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
