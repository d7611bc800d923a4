"""Operator 5: main text of web pages by equivalence-class template deduction.

Pass 1 parses every page into tokens: containers (the chain of structural
elements with their class words) and text runs (chain and text).  A token's
occurrence vector over the pages of its host is never built; two 32-bit sums of
a hash of (page, count) over the pages stand for it, so hot hosts combine
map-side.  Tokens of a host with equal sums and page counts form an equivalence
class; classes of at least `MIN_TOKENS` tokens on at least `MIN_PAGES` pages and
half of the host's pages are valid.  Valid
texts are the host's template; a text's token holds its chain, so a valid text
vouches for the containers around it.

Pass 2 joins the template to the host's pages and extracts the remaining slots
in page order.  Elements that are boilerplate by name, role or `hidden` are
dropped.  An element with a listed class or id word is dropped if it holds no
article or main element (within an article: or has a whole listed class name, as
comments do) and recurs on the host's pages (`MIN_PAGES` and one in
`CONFIRM`); on hosts with fewer pages only whole listed class names count.  A
container that has text, but no slot text (text outside the template), on a page
is template and removed from it, inside an article too.  Where the page has an article or main
element, the rest below it remains, else the rest below the lowest container that
covers all slots.  A page (or article) without any slot text, such as one of many
copies, keeps what is not dropped.  Template text that shares its container with
slot text stays: a repeated sentence of the story cannot be told from a notice.

The template of a host is bounded by the length of its pages (its tokens stand on
at least half of them).

Cases: null or empty html = empty text; a page without `://` in its url belongs
to the empty host; truncated or unclosed markup is closed at the end; repeated
pages are extracted alike; other columns pass through, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import own_prefix, per_worker

MIN_TOKENS = 2
MIN_PAGES = 3
HOT = 1024          # a host with more than one in so many pages is dealt to several tasks
CONFIRM = 20        # a class or id word counts on elements that stand on one in so many pages of the host

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|"[^"]*"|'[^']*'""")

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub "
                   "sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# elements that end an open paragraph, list item or cell of the same list or table
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = frozenset("html body article main section div nav aside header footer form table ul ol dl td th blockquote figure".split())
DROP_ELEMENTS = frozenset("head nav footer aside form button select label fieldset dialog menu object canvas audio video map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets "
    "footer copyright masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup login paywall share sharing social related recommended comment comments respond replies disqus search".split())
HEADER_WORDS = frozenset("header".split())        # dropped outside the article only


class Element:
    """key: the chain; own: the chain ends with this element; hard: dropped by name,
    role or hidden, itself or above; listed, header: class or id words; whole: a
    listed class name; article: starts the main text; holds, within: an article
    stands below, above.  drop, main, slot, gone are settled when the whole page is known."""
    __slots__ = ("name", "key", "parent", "inline", "own", "hard", "listed", "header", "whole", "article", "holds", "within", "drop", "main", "slot", "gone")

    def __init__(self, name, key, parent=None, inline=False):
        self.name, self.key, self.parent, self.inline = name, key, parent, inline
        self.hard = parent is not None and parent.hard
        self.own = self.listed = self.header = self.whole = self.article = self.holds = False
        self.within = parent is not None and (parent.within or parent.name == "article")
        self.drop = self.main = self.slot = self.gone = False


def parse(html: str):
    """Text runs and elements of a page.  Yields ("open", element) for every
    element and ("text", element, block number, raw text, in link)."""
    root = Element("", "")
    stack, block, at = [root], 0, 0

    def close_to(k):
        nonlocal block
        if any(not e.inline for e in stack[k:]):
            block += 1
        del stack[k:]

    for m in TOKEN.finditer(html):
        if m.start() > at:
            yield "text", stack[-1], block, html[at:m.start()], any(e.name == "a" for e in stack)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:                                        # comment, raw text element, declaration
            continue
        if name in VOID:
            if name == "br":
                yield "text", stack[-1], block, " ", False
            elif name not in INLINE:
                block += 1
            continue
        if m[2]:                                            # end tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close_to(k)
                    break
                if stack[k].name in BARRIER and (name == "p" or name in INLINE):
                    break
            continue
        inline = name in INLINE
        if not inline:
            for k in range(len(stack) - 1, 0, -1):          # implied ends
                if stack[k].name == "p" or stack[k].name in ENDS.get(name, ()):
                    close_to(k)
                    if name not in ENDS:
                        break
                elif stack[k].name in BARRIER and stack[k].name not in ("td", "th"):
                    break
            block += 1
        top = stack[-1]
        el = Element(name, top.key, top, inline)
        stack.append(el)
        if not inline:
            describe(el, m[4] or "")
        yield "open", el
    if at < len(html):
        yield "text", stack[-1], block, re.sub(r"<[^<]*\Z", "", html[at:]), any(e.name == "a" for e in stack)


def describe(el: Element, markup: str) -> None:
    """Role of a structural element by its name and attributes."""
    attrs: dict[str, str] = {}
    for name, value in ATTR.findall(markup):
        if name:
            attrs.setdefault(name.lower(), value.strip("\"'").lower())
    names = attrs.get("class", "").split()
    words = set(re.findall(r"[a-z0-9]+", " ".join([*names, attrs.get("id", "")])))
    el.hard = el.hard or el.name in DROP_ELEMENTS or "hidden" in attrs or attrs.get("role") in DROP_ROLES
    el.article = el.name in ("article", "main") or attrs.get("role") in ("main", "article")
    if not el.article and el.name not in ("html", "body"):
        el.listed, el.header = bool(words & DROP_WORDS), bool(words & HEADER_WORDS)
        el.whole = any(n in DROP_WORDS or n in HEADER_WORDS for n in names)
    el.own = el.name in BARRIER or bool(words)
    if el.own:
        el.key += f">{el.name}.{'.'.join(sorted(words))}"
    if el.article and not el.hard:
        up = el.parent
        while up is not None and not up.holds:
            up.holds = True
            up = up.parent


def squeeze(raw: str) -> str:
    return " ".join(entities.unescape(raw).split())


def key_of(kind: str, key: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{key}\0{text}") - (1 << 63)


def page_tokens(html: str) -> dict[int, list]:
    """token -> [count, kind]; kind 0 = text, 1 = container, 2 = container with a listed word."""
    out: dict[int, list] = {}
    for t in parse(html):
        if t[0] == "open":
            if t[1].own:
                out.setdefault(chain(t[1].key)[-1], [0, 2 if t[1].listed or t[1].header else 1])[0] += 1
        elif text := squeeze(t[3]):
            out.setdefault(key_of("t", t[1].key, text), [0, 0])[0] += 1
    return out


def extract(html: str, texts: frozenset, repeated: frozenset | None = None) -> str:
    """Blocks of the remaining slots, joined by blank lines.  texts: the host's template
    texts; repeated: its recurring containers with a listed word (None: too few pages to tell)."""
    elements, runs = [], []
    for t in parse(html):
        (elements if t[0] == "open" else runs).append(t[1:])
    elements = [e for e, in elements]
    for el in elements:                                     # parents first
        up = el.parent
        el.drop = up.drop or el.hard or (el.name == "header" and not up.main)
        if not el.drop and (not el.holds or (el.within and el.whole)) and (el.listed or (el.header and not up.main)):
            el.drop = el.whole if repeated is None else chain(el.key)[-1] in repeated
        el.main = up.main or (el.article and not el.drop)
    runs = [r for r in runs if not r[0].drop]
    inside = [r for r in runs if r[0].main]
    if any(r[2].strip() for r in inside):
        if texts:
            inside, _ = slots(inside, elements, texts)
    else:
        inside, filled = slots(runs, elements, texts)
        inside = below_common(inside, filled)
    blocks: dict[int, list[str]] = {}
    for _, block, raw, _ in inside:
        blocks.setdefault(block, []).append(entities.unescape(raw))
    out = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(b for b in out if b)


def slots(runs: list, elements: list, texts: frozenset) -> tuple[list, list]:
    """(runs outside the containers without slot text, runs of slot text); all runs if none is slot text."""
    filled = []
    for run in runs:
        text = squeeze(run[2])
        if text and key_of("t", run[0].key, text) not in texts:
            filled.append(run)
            up = run[0]
            while up is not None and not up.slot:
                up.slot = True
                up = up.parent
    if not filled:
        return runs, []
    for el in elements:
        up = el.parent
        el.gone = up.gone or (el.own and not el.slot and (up.main or not el.main))
    return [r for r in runs if not r[0].gone], filled


def below_common(runs: list, filled: list) -> list:
    """Without an article: the runs below the lowest container that covers all slot text."""
    common: list | None = None
    for el in {id(r[0]): r[0] for r in filled}.values():
        path = []
        while el is not None:
            if el.name in BARRIER or el.parent is None:
                path.append(el)
            el = el.parent
        path.reverse()
        if common is None:
            common = path
        k = 0
        while k < min(len(common), len(path)) and common[k] is path[k]:
            k += 1
        common = common[:k]
    if not common or common[-1].parent is None:
        return runs
    within = {id(common[-1]): True}

    def covered(el):
        path = []
        while el is not None and id(el) not in within:
            path.append(id(el))
            el = el.parent
        found = el is not None and within[id(el)]
        within.update(dict.fromkeys(path, found))
        return found

    return [r for r in runs if covered(r[0])]


def chain(key: str) -> tuple[int, ...]:
    """Token keys of an element's containers, outermost (the page) first."""
    known = per_worker("page-chains", dict)
    if key not in known:
        if len(known) > 1 << 15:
            known.clear()
        ends = [m.start() for m in re.finditer(">", key)] + [len(key)]
        known[key] = tuple(key_of("c", key[:e]) for e in ends)
    return known[key]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: dict[tuple, list] = {}
        for page, host, html in zip(pdf["page"], pdf["host"], pdf["html"]):
            for token, (count, container) in page_tokens(html).items():
                h = xxhash.xxh64_intdigest(f"{page}:{count}")
                row = rows.setdefault((host, token), [0, 0, 0, container])
                row[0] += 1
                row[1] += h & 0xFFFFFFFF
                row[2] += h >> 32
        yield pd.DataFrame([(h, t, *r) for (h, t), r in rows.items()], columns=["host", "token", "pages", "s1", "s2", "container"])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:]*(?::(?!//)[^:]*)*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, texts, repeated): the template of every host with enough
    pages.  pages: page, host, html."""
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages")).filter(F.col("all_pages") >= MIN_PAGES)
    tokens = (pages.mapInPandas(_count, "host string, token long, pages long, s1 long, s2 long, container int")
              .groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
                                            F.max("container").alias("container")))
    seen = tokens.join(hosts, "host").filter((F.col("pages") >= MIN_PAGES) & (
        (F.col("pages") * 2 >= F.col("all_pages")) | ((F.col("container") == 2) & (F.col("pages") * CONFIRM >= F.col("all_pages")))))
    # a class is a host's tokens with one occurrence vector; its size decides
    classes = seen.groupBy("host", "pages", "all_pages", "s1", "s2").agg(F.collect_list(F.struct("container", "token")).alias("members"))
    valid = (F.size("members") >= MIN_TOKENS) & (F.col("pages") * 2 >= F.col("all_pages"))
    member = classes.select("host", valid.alias("valid"), F.explode("members").alias("m")).select("host", "valid", "m.*")
    lists = member.groupBy("host").agg(
        F.collect_list(F.when(F.col("valid") & (F.col("container") == 0), F.col("token"))).alias("texts"),
        F.collect_list(F.when(F.col("container") == 2, F.col("token"))).alias("repeated"))
    none = F.array().cast("array<bigint>")
    return hosts.join(lists, "host", "left").select("host", *[F.coalesce(c, none).alias(c) for c in ("texts", "repeated")])


def shares(pages: DataFrame) -> DataFrame:
    """(host, copies): hosts that hold more than one in HOT of all pages, fewer than HOT of them at any
    size, and the number of tasks that share their pages."""
    n = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = pages.agg(F.count(F.lit(1)).alias("total"))          # one row
    return (n.join(F.broadcast(total)).filter(F.col("n") * HOT > F.col("total"))
            .select("host", F.ceil(F.col("n") * HOT / F.col("total")).cast("int").alias("copies")))


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` without the html, plus text and n_chars (given columns of these names are replaced).

    The pages meet their host's template on (host, share): a hot host's pages are dealt to as many tasks as its
    part of all pages asks for, and its small template is copied to each of them."""
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    p = own_prefix(pages.columns)
    src = pages.select(*kept, host_of(F.col(url)).alias(f"{p}host"), F.coalesce(F.col(html), F.lit("")).alias(f"{p}html"))
    src = src.withColumn(f"{p}page", F.xxhash64(f"{p}html", *kept))
    named = src.select(F.col(f"{p}page").alias("page"), F.col(f"{p}host").alias("host"), F.col(f"{p}html").alias("html"))
    hot = F.broadcast(shares(named.select("host")))              # fewer than HOT rows
    known = (templates(named).join(hot, "host", "left")
             .select(F.col("host").alias(f"{p}host"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias(f"{p}share"),
                     F.col("texts").alias(f"{p}texts"), F.col("repeated").alias(f"{p}repeated")))
    dealt = (src.join(hot.select(F.col("host").alias(f"{p}host"), F.col("copies").alias(f"{p}copies")), f"{p}host", "left")
             .withColumn(f"{p}share", F.pmod(f"{p}page", F.coalesce(f"{p}copies", F.lit(1))).cast("int")))
    joined = dealt.join(known, [f"{p}host", f"{p}share"], "left").select(*kept, f"{p}html", f"{p}texts", f"{p}repeated")
    schema = StructType([pages.schema[c] for c in kept] + [StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = []
            for h, *known in zip(pdf[f"{p}html"], pdf[f"{p}texts"], pdf[f"{p}repeated"]):
                if known[0] is None:                        # too few pages for a template
                    text.append(extract(h, frozenset()))
                else:
                    text.append(extract(h, *[frozenset(k.tolist()) for k in known]))
            yield pdf[kept].assign(text=text, n_chars=[len(t) for t in text])

    return joined.mapInPandas(run, schema)
