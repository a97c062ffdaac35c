"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block.  Lines of page furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments) and lines
that are mostly links weigh nothing; where a page has article elements, links in
them weigh as text.  Weights are summed over sliding windows of lines, on every page.
A surge is where the sum leaves zero, a dive where it returns; the runs between them
are cut at furniture and the bounds of articles, and kept from their first line of
text to their last.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their meaning in HTML.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|canvas|video|audio|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("head nav footer aside form menu dialog button fieldset label input search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of a class or an id that mark furniture; a name is cut at signs, digits and inner capitals.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus replies consent cookie cookies "
    "footer footnav gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain pagination pager paywall popup promo promos promoted promotion "
    "related recommended share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets login topnav subnav".split()
)
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(rest)} if rest else {}


def is_furniture(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return tag == "article" and bool({"comment", "teaser"} & set(map(str.lower, PARTS.findall(attrs.get("class", "")))))
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return bool(MARKS & {w.lower() for k in ("class", "id") for w in PARTS.findall(attrs.get(k, ""))})


def lines(page: str) -> tuple[list[str], list[int], list[int]]:
    """Text, weight and article number (0: outside) of each block; furniture is an empty line."""
    text, weight, where = [], [], []
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    linked, articles, hidden, article, anchors = 0, 0, False, 0, 0

    def end_block() -> None:
        nonlocal linked
        s = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if s:
            text.append(s)
            weight.append(0 if linked * 2 > len(s) else len(s))
            where.append(article)
        linked = 0

    def gap() -> None:
        if text and text[-1]:
            text.append("")
            weight.append(0)
            where.append(0)

    def leave(depth: int) -> None:
        nonlocal hidden, article, anchors
        for t, _, _ in stack[depth:]:
            anchors -= t == "a"
        del stack[depth:]
        hidden, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not hidden:
            parts.append(page[at : m.start()])
            if anchors > 0:
                linked += m.start() - at
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            end_block()
        if m["close"]:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == tag:
                    leave(d)
                    break
        elif tag in VOID or m["rest"].endswith("/") and tag not in BLOCK:
            continue
        else:
            if tag in BLOCK:  # what a new block closes without an end tag
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] == "p" or (tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[d][0] == tag):
                        leave(d)
                        break
                    if stack[d][0] in BLOCK:
                        break
            attrs = attributes(m["rest"])
            if (tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "").lower() == "articlebody") and not hidden and not article:
                articles += 1
                article = articles
            own = hidden or is_furniture(tag, attrs, bool(article))
            if own and not hidden:
                end_block()
                gap()
            hidden = own
            stack.append((tag, own, article))
            anchors += tag == "a"
    if not hidden:
        parts.append(page[at:])
    end_block()
    return text, weight, where


def main_text(page: str | None, window: int = 3) -> str:
    """The blocks between a surge and its dive, joined by empty lines.

    A block of mostly links outside of articles starts or ends no run (a bare menu),
    but stays between two blocks of text.  No run goes for its weight: a short closing
    paragraph is text as well.
    """
    if not page:
        return ""
    text, weight, where = lines(page)
    if not text:
        return ""
    art = np.array(where)
    w = np.where(art > 0, [len(t) for t in text], weight)  # links and short lines belong to an article
    sums = np.convolve(w, np.ones(window), "full")[window // 2 :][: len(text)]
    runs, start = [], None
    for i, s in enumerate([*sums.tolist(), 0]):
        gap_here = i == len(text) or not text[i]
        if start is not None and (s == 0 or gap_here or art[i] != art[start]):
            runs.append((start, i))  # dive, or the bound of an article
            start = None
        if start is None and s > 0 and not gap_here:
            start = i  # surge
    kept = []
    for a, b in runs:
        own = np.nonzero(w[a:b])[0] + a
        if len(own):
            kept += text[own[0] : own[-1] + 1]
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, text (empty if none) and n_chars (its code points) for every row.

    A null or empty page gives an empty text; text without markup is its own
    article; broken markup is read as far as it goes; repeated rows and clashing
    extra columns have no effect.  Rows are independent: no shuffle.
    """
    base = pages.select(*keep, F.col(html_col).alias("__html"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__html"]

    def run(batches):
        for pdf in batches:
            got = [main_text(h) for h in pdf.pop("__html")]
            yield pdf.assign(text=got, n_chars=np.array([len(t) for t in got], dtype=np.int64))

    return base.mapInPandas(run, ", ".join([*fields, "text string", "n_chars long"]))
