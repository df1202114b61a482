"""Main text of web pages by site style trees (operator 2).

One pass parses every page into text blocks, each with its path in the style
tree (tags with their classes, from the root), drops what the markup itself
names as no content (navigation, headers, footers, asides, forms, scripts,
hidden parts, and elements whose class, id or role says advert, cookie notice,
comments and the like) and keeps to ``article`` and ``main`` where they hold a fair share of
the text (less than MAIN_SHARE are teasers beside a story). The pages of a host are then merged by path:

* content importance of a node: 1 minus the mean over its blocks of
  log(pages with that text) / log(pages of the host), which is the entropy of
  a text that is spread evenly over its pages: 1 for texts of their own, 0 for
  a text that all pages repeat;
* presentation importance of an element: the entropy, to the base of its
  pages, of the sequences of child elements it appears with.

Of a node that is low in both, the blocks are removed whose own text repeats,
that is, stands on more than the square root of the host's pages (hosts with at
least MIN_PAGES different pages; fewer tell nothing); other texts there stay.
There are fewer than blocks / sqrt(pages) such texts.

Pages count once for all their copies and near copies, as a much copied article
is no frame: pages of which at most OWN of the text does not repeat are one
page if they have the same longest repeating text.

Host statistics are partial aggregates by (host, node, text), so a host with a
third of all pages is no group of rows anywhere.

Rows: null html is empty and gives an empty text; a null or odd url is a host
of its own kind (''). Repeated rows give repeated results. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import collections
import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, materialise, slices, with_columns_of

MIN_PAGES = 8
LOW_CONTENT, LOW_MAIN, LOW_STYLE = 0.2, 0.1, 0.5
OWN = 0.2

# a tag that the next "<" or the end cuts off ends there: an attempt never reads past its own tag
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>?""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_END = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)", re.I) for t in
        ("script", "style", "title", "textarea", "iframe", "noscript", "template", "svg", "math", "xmp", "noembed")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
                    "ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NOISE_TAGS = frozenset("head nav footer aside form button select option dialog menu object audio video canvas "
                        "frameset applet fieldset datalist".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                         "toolbar".split())
#: Names of what is no content wherever they begin or end a class name or id ...
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense promo promoted sponsor sponsored".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies".split())
_STRONG = _ADVERTS | _COMMENTS | frozenset(
    "breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead nav navbar navigation newsletter pager "
    "pagination popup sidebar subscribe subscription tagcloud topbar".split())
#: ... and names that may stand for content too: they count alone or beside words of layout.
_WEAK = frozenset(
    "banner byline form header hidden login menu modal notice notices overlay promotion recommended related reply "
    "respond share sharing signup skip social toolbar widget widgets".split())
_LAYOUT = frozenset(
    "area bar block bottom box buttons container icons inner left link links list main outer page panel post posts "
    "right section site slot stories top unit wrap wrapper".split())
_DENIAL = frozenset("no not has with without".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(text)}


def _named(at: dict[str, str], strong: frozenset, weak: frozenset) -> bool:
    """Whether a class name or the id says what is no content; never one that says there is none of it."""
    for token in (at.get("class", "") + " " + at.get("id", "")).split():
        words = [w.lower() for w in _NAME.findall(token)]
        if not words or not _DENIAL.isdisjoint(words):
            continue
        if words[0] in strong or words[-1] in strong:
            return True
        if not weak.isdisjoint(words) and all(w in weak or w in strong or w in _LAYOUT for w in words):
            return True
    return False


def _is_noise(tag: str, at: dict[str, str]) -> str:
    """Why an element is no content: "markup" (its tag, role or style), "name", or "" if it may be."""
    if tag in _NOISE_TAGS or "hidden" in at or at.get("aria-hidden") == "true":
        return "markup"
    if at.get("role", "").lower() in _NOISE_ROLES:
        return "markup"
    style = at.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return "markup"
    if tag in ("html", "body"):
        return ""
    if tag in _INLINE:  # a span or link may be of class "comment" or "header" within a text
        return "markup" if _named(at, _ADVERTS, frozenset()) else ""
    if tag in ("article", "main"):
        last = [_NAME.findall(t)[-1:] for t in at.get("class", "").split()]
        return "markup" if at.get("class", "").startswith("comment") or any(
            w and w[0].lower() in _COMMENTS | {"reply"} for w in last) else ""
    if _named(at, _ADVERTS | _COMMENTS, frozenset()):
        return "markup"
    return "name" if _named(at, _STRONG, _WEAK) else ""


_TELLING = re.compile(r"(?:^|[\s\"'])(?:class|id|role|style|aria-hidden|hidden)\b", re.I)
#: Share of a page's text that article and main must hold for the rest to go.
MAIN_SHARE = 0.25
#: Deeper elements take part with their marks, but have no path of their own.
MAX_LEVELS = 400


class _Element:
    __slots__ = ("tag", "path", "noise", "main", "children", "header", "heading", "named", "inline")

    def __init__(self, tag, path, noise, main, header, heading, named, inline=False):
        self.tag, self.path, self.noise, self.main, self.children = tag, path, noise, main, []
        self.header, self.heading, self.named, self.inline = header, heading, named, inline


def parse(page: str) -> tuple[list[tuple[str, bool, str]], list[tuple[str, str]]]:
    """Blocks (path, inside article or main, text) in page order, and the elements'
    (path, child elements with runs taken together).

    Elements that only their name calls no content count again where a page has nothing
    else: such a name stood on the wrapper of it all.
    """
    stack = [_Element("", "", False, False, False, False, False)]
    open_ = collections.Counter()
    blocks, styles, parts, owner = [], [], [], [stack[0]]

    def flush():
        if parts:
            t = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            top = owner[0]
            if t and (not top.header or top.heading):
                blocks.append((top.path, top.main, t, top.named))

    def close(n):
        while len(stack) > n:
            top = stack.pop()
            open_[top.tag] -= 1
            if top.children:
                styles.append((top.path, ",".join(top.children)))

    def push(e):
        stack.append(e)
        open_[e.tag] += 1

    def text(t):
        if t and not stack[-1].noise:
            if not parts:
                owner[0] = stack[-1]
            parts.append(t)
    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None or page[at - 1] != ">":  # a comment, or a tag that is cut off
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _VOID or tag in _INLINE and not open_[tag]:
                if tag == "br":
                    text(" ")
                continue
            if open_[tag]:
                n = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                if tag not in _INLINE:
                    flush()
                close(n)
            continue
        if tag in _END:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                flush()
            continue
        top = stack[-1]
        if tag in _INLINE:
            # elements that are no content, and what must be told from their ends, are kept track of
            if open_[tag] or m[3] and _TELLING.search(m[3]) and _is_noise(tag, _attributes(m[3])):
                push(_Element(tag, top.path, True, top.main, top.header, top.heading, top.named, True))
            continue
        flush()
        i = len(stack) - 1
        while stack[i].inline:
            i -= 1
        if stack[i].tag == "p":  # a block ends a paragraph and what is open in it
            close(i)
        for sibling, stops in (("li", ("ul", "ol")), ("dt", ("dl",)), ("dd", ("dl",)), ("tr", ("table",)),
                               ("td", ("tr", "table")), ("th", ("tr", "table"))):
            if tag == sibling and open_[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in stops:
                        break
                    if stack[i].tag == tag:
                        close(i)
                        break
        attrs = _attributes(m[3]) if m[3].strip(" /\n\t") else {}
        parent = stack[-1]
        name = f"{tag}.{attrs['class']}" if attrs.get("class") else tag
        deep = len(stack) > MAX_LEVELS
        if not deep and (not parent.children or parent.children[-1] != name):
            parent.children.append(name)
        main = parent.main or tag in ("article", "main") or attrs.get("role") == "main" or attrs.get(
            "itemprop") == "articleBody"
        why = _is_noise(tag, attrs) if not parent.noise else ""
        # an article keeps the headings of its header
        why = "" if tag == "header" and parent.main and why == "name" else why
        noise = parent.noise or why == "markup" or (tag == "header" and not parent.main)
        push(_Element(tag, parent.path if deep else f"{parent.path}/{name}", noise, main, parent.header or tag == "header",
                      parent.heading or tag in _HEADINGS, parent.named or why == "name"))
    flush()
    close(1)
    shown = [b[:3] for b in blocks if not b[3]] or [b[:3] for b in blocks]
    size = sum(len(b[2]) for b in shown)
    if sum(len(b[2]) for b in shown if b[1]) >= MAIN_SHARE * size:
        shown = [b for b in shown if b[1]] or shown
    kept = set()
    for b in shown:  # the paths of the blocks and of all elements around them
        path = b[0]
        while path and path not in kept:
            kept.add(path)
            path = path.rpartition("/")[0]
    return shown, [x for x in styles if x[0] in kept]


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


_BLOCK = pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("main", pa.bool_()), ("text", pa.string())])
_STYLE = pa.struct([("path", pa.int64()), ("seen", pa.int64())])


def _parsed():
    names = ["page_id", "url", "host", "page", "blocks", "styles"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html", 1 << 22):
                urls = part.column("url").to_pylist()
                pages, blocks, styles = [], [], []
                for page in part.column("html").to_pylist():
                    b, s = parse(page or "")
                    pages.append(_h("\n".join(x[2] for x in b)))
                    blocks.append([{"path": _h(p), "parent": _h(p.rpartition("/")[0]), "main": m, "text": t}
                                   for p, m, t in b])
                    styles.append([{"path": _h(p), "seen": _h(c)} for p, c in dict(s).items()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array([host_of(u) for u in urls]),
                     pa.array(pages, pa.int64()), pa.array(blocks, pa.list_(_BLOCK)),
                     pa.array(styles, pa.list_(_STYLE))], names)
    return run


def _page_counts(parsed: DataFrame) -> DataFrame:
    """(host, m): hosts with enough different pages."""
    return parsed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("m")).where(
        f"m >= {MIN_PAGES}")


def _once(parsed: DataFrame) -> DataFrame:
    """(host, page, blocks, styles) with texts as (hash, length), where near copies have the same page."""
    d = parsed.select("row", "host", "page", "styles", F.transform("blocks", lambda b: F.struct(
        b["path"].alias("path"), b["parent"].alias("parent"), b["main"].alias("main"),
        F.xxhash64(b["text"]).alias("seen"), F.length(b["text"]).alias("size"))).alias("blocks"))
    texts = d.select("host", "page", F.explode(F.array_distinct("blocks.seen")).alias("seen")).distinct()
    n = texts.groupBy("host", "seen").agg(F.count("*").alias("n"))
    # hosts that count have MIN_PAGES pages, so a text that stands on two of them or one is not common
    common = n.where("n > 2").join(_page_counts(d), "host").where("n * n > m").groupBy("host").agg(
        F.collect_list("seen").alias("common"))
    common = common.join(d.groupBy("host").agg(F.count("*").alias("rows")), "host")
    x = join_skewed(d, materialise(common, "html-common"), "host", "rows", max(1, d.count()), "row")
    own = F.filter("blocks", lambda b: ~F.array_contains("common", b["seen"]))
    shared = F.filter("blocks", lambda b: F.array_contains("common", b["seen"]))

    def size(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda s, b: s + b["size"])
    longest = F.array_max(F.transform("shared", lambda b: F.struct(b["size"], b["seen"])))["seen"]
    near = F.col("common").isNotNull() & (F.size("shared") > 0) & (
        size(F.col("own")) <= OWN * (size(F.col("own")) + size(F.col("shared"))))
    x = x.withColumn("own", own).withColumn("shared", shared)
    return x.select("host", F.when(near, longest).otherwise(F.col("page")).alias("page"), "blocks", "styles")


def unimportant(parsed: DataFrame) -> DataFrame:
    """(host, gone): hashes of node and text of the blocks of each host that are to go."""
    # near copies are one page: they say nothing about a site's frame
    parsed = materialise(_once(parsed), "html-once")
    hosts = _page_counts(parsed)
    blocks = parsed.select("host", "page", F.explode("blocks").alias("b")).select(
        "host", "page", "b.path", "b.parent", "b.main", "b.seen")
    texts = blocks.distinct().groupBy("host", "path", "parent", "main", "seen").agg(F.count("*").alias("n"))
    # summed to nodes before the join: a host's texts are many, its nodes are few
    nodes = texts.groupBy("host", "path", "parent", "main").agg(
        F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("n").alias("blocks")).join(hosts, "host").select(
        "host", "path", "parent", "main", "m", (1 - F.col("s") / F.col("blocks") / F.log("m")).alias("content"))
    styles = parsed.select("host", "page", F.explode("styles").alias("s")).select(
        "host", "page", F.col("s.path").alias("parent"), F.col("s.seen").alias("seen")).distinct()
    # entropy to the base of the pages: log(N) - sum(n log n) / N, over log(N)
    shapes = styles.groupBy("host", "parent", "seen").agg(F.count("*").alias("n")).groupBy("host", "parent").agg(
        F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("n").alias("pages"))
    style = F.when(F.col("pages") > 1, 1 - F.col("s") / F.col("pages") / F.log("pages")).otherwise(1)
    low = F.col("content") < F.when(F.col("main"), LOW_MAIN).otherwise(LOW_CONTENT)
    nodes = nodes.where(low).join(shapes.select("host", "parent", style.alias("style")), ["host", "parent"],
                                  "left").where(F.coalesce("style", F.lit(0.0)) < LOW_STYLE)
    return texts.where("n > 1").join(nodes.select("host", "path", "main", "m"), ["host", "path", "main"]).where(
        "n * n > m").groupBy("host").agg(F.collect_set(F.xxhash64("path", "seen")).alias("gone"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per row."""
    d = with_columns_of(pages, {"page_id": "long", "url": "string", "html": "string"})
    parsed = materialise(d.mapInArrow(
        _parsed(), "page_id long, url string, host string, page long, "
                   "blocks array<struct<path:bigint,parent:bigint,main:boolean,text:string>>, "
                   "styles array<struct<path:bigint,seen:bigint>>").withColumn(
        "row", F.monotonically_increasing_id()), "html-parsed")
    gone = unimportant(parsed).join(parsed.groupBy("host").agg(F.count("*").alias("pages")), "host")
    x = join_skewed(parsed.select("row", "page_id", "url", "host", "blocks"), materialise(gone, "html-gone"),
                    "host", "pages", max(1, parsed.count()), "row")
    kept = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter(
        "blocks", lambda b: ~F.array_contains("gone", F.xxhash64(b["path"], F.xxhash64(b["text"])))))
    return x.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"))


def op2(pages: DataFrame) -> DataFrame:
    """Contract of op2_html."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
