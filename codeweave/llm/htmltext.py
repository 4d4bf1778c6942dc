"""Main text of web pages by a site style tree (operator 5).

1. Every page is parsed into elements; an element's place is its path of block
   tags with their classes and ids.  For each place a page gives its presentation
   (the sequence of child tags) and its content (a hash of its text).
2. Pages of one host are merged: counts by (host, place, presentation) and (host,
   place, content), summed map-side first, so a host with a third of all pages is
   no hot spot.  With ``m`` pages the importance of a place is ``(1 - GAMMA) *
   entropy(presentations) + GAMMA * entropy(contents)``, entropies to base ``m``;
   a branch is as important as its most important place.
3. Places that say by tag or class what they hold have a fixed importance: 1 for
   ``article``, ``main`` and blocks of such names, 0 for navigation, headers, footers,
   adverts, notices, forms and comments.  Words of noise decide first (``comment-content``
   is a comment, ``<article class="comment">`` too); main names count only as whole names.
   What lies in noise is noise, articles included, unless the noise element is never
   closed.  Others lose the branch if it is below ``LOW`` and the host has at least
   ``MIN_PAGES`` pages.
4. Each page is parsed again without its low branches.  If a page marks its article by
   tag, only text inside counts; a block that is main by name alone must hold at least
   half of what is left.  A page that has no text but inside a form (some sites wrap
   whole pages) gives that.

Only branches that the statistics remove must reach the pages: they are
broadcast while they are few, else joined by host.

Cases: null html gives an empty text; pages without a url form one site; broken
markup (unclosed or stray tags, cut comments) never fails; repeated rows each
get a result; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import materialise
from codeweave.llm.urls import host_and_path

GAMMA = 0.9
LOW = 0.1
MIN_PAGES = 8
BROADCAST_BRANCHES = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
#: Of these only the start tag is skipped where there is no end tag.
SOFT_RAW = frozenset(("noscript", "template", "svg", "math"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr img".split())
#: Elements that end an open paragraph or their own kind.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}
NOISE_TAGS = frozenset("head nav header footer aside form button select option menu dialog figure figcaption".split()) | RAW
MAIN_TAGS = frozenset(("article", "main"))
NOISE_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies copyright "
                        "disqus footer form header login menu menus modal nav navbar navigation newsletter notice notices pager "
                        "pagination popup promo related respond share sharing sidebar signup skip social sponsor sponsored "
                        "subscribe tags toolbar widget widgets".split())
#: Whole names of classes, ids and roles, without their hyphens and underscores.
MAIN_NAMES = frozenset("article content entry main maincontent post story articlebody articlecontent articletext postbody postcontent "
                       "entrycontent storybody pagecontent".split())
#: Names that begin so speak of something else on the page.
_ABOUT = re.compile(r"(?:has|with|no|without)[-_]")
PATH_MAX = 400  # characters of a path; deeper ones go on from a hash
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Open:
    """An open block element."""
    __slots__ = ("tag", "path", "noise", "main", "at", "children", "texts")

    def __init__(self, tag: str, path: str, noise: bool, main: int, at: int) -> None:
        self.tag, self.path, self.noise, self.main, self.at = tag, path, noise, main, at
        self.children: list[str] = []
        self.texts: list[str] = []


def _names(attrs: str) -> tuple[list[str], bool, bool]:
    """Words of the names of an element; whether one is main as a whole; whether one holds a word of noise."""
    low = attrs.lower()
    if "class" not in low and "id" not in low and "role" not in low:
        return [], False, False
    names = [w for m in _NAMES.finditer(low) for w in (m[1] or m[2] or m[3] or "").split()]
    words = sorted({w for n in names for w in _SPLIT.split(n) if w and not w.isdigit()})
    noise = any(w in NOISE_NAMES for n in names if not _ABOUT.match(n) for w in _SPLIT.split(n))
    return words, any(n.replace("-", "").replace("_", "") in MAIN_NAMES for n in names), noise


def _unclosed(page: str) -> set[int]:
    """Where the start tags of elements without an end tag begin."""
    open_: dict[str, list[int]] = {}
    for m in _TAG.finditer(page):
        tag = (m[2] or m[5] or "").lower()
        if tag and (m[1] or m[4]):
            if open_.get(tag):
                open_[tag].pop()
        elif tag:
            open_.setdefault(tag, []).append(m.start())
    return {x for at in open_.values() for x in at}


def parse(page: str, low: frozenset[str] = frozenset(), stats: bool = False, forms: bool = False):
    """Main text of a page without the branches of ``low``; with ``stats`` its places instead:
    ``(path, presentation, content)`` of every block element that isn't noise by name.
    ``forms``: forms count."""
    stack = [_Open("", "", False, 0, 0)]
    blocks: list[tuple[int, str]] = []  # 2 inside an article by tag, 1 inside a block that is main by name, 0 elsewhere
    left_open: set[int] | None = None
    buffer: list[str] = []
    places: list[tuple[str, str, str]] = []
    unclosed: set[str] = set()  # of SOFT_RAW, without an end tag from here on

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1]
                if stats:
                    top.texts.append(text)
                elif not top.noise:
                    blocks.append((top.main, text))

    def close(n: int) -> None:
        while len(stack) > n:
            e = stack.pop()
            if stats and not e.noise:
                places.append((e.path, " ".join(e.children), "\n".join(e.texts)))

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            buffer.append(_html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag in INLINE:
            continue
        flush()
        if m[1] or m[4]:  # an end tag
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in ("li", "dd", "dt"):
                    break
        elif tag in SELF_CLOSING:
            while len(stack) > 1 and stack[-1].tag in SELF_CLOSING[tag]:
                close(len(stack) - 1)
        if tag in RAW:
            if tag in ("svg", "math") and m[0].endswith("/>"):
                continue
            if tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in SOFT_RAW:
                    unclosed.add(tag)
                else:
                    at = len(page)
            continue
        words, main_name, noise_name = _names(m[3] or m[6] or "")
        if tag in MAIN_TAGS and any(e.noise for e in stack):  # an article isn't part of an advert that was never closed
            left_open = _unclosed(page) if left_open is None else left_open
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].noise and stack[i].at in left_open and stack[i].tag not in ("nav", "aside"):
                    close(i)
        top = stack[-1]
        top.children.append(tag)
        path = f"{top.path}/{'.'.join([tag, *words])}"
        if len(path) > PATH_MAX:
            path = f"/~{xxhash.xxh64_hexdigest(path)}"
        noise = top.noise or (tag in NOISE_TAGS and not (forms and tag == "form")) or noise_name or path in low
        if tag in ("html", "body"):
            noise = False
        main = 0 if noise else max(top.main, 2 if tag in MAIN_TAGS else 1 if main_name else 0)
        stack.append(_Open(tag, path, noise, main, m.start()))
    flush()
    if stats:
        close(1)
        return places
    by_tag = [t for kind, t in blocks if kind == 2]
    by_name = [t for kind, t in blocks if kind]
    if by_tag:
        text = " ".join(by_tag)
    elif 2 * sum(map(len, by_name)) >= sum(len(t) for _, t in blocks):
        text = " ".join(by_name)
    else:
        text = " ".join(t for _, t in blocks)
    return text or ("" if forms or "<form" not in page.lower() else parse(page, low, forms=True))


def place_counts(pages: DataFrame) -> DataFrame:
    """``(host, path, kind, value, n)``: pages by presentation ('p') and content ('c') of every place; kind 'h': pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[tuple[str, str, str, int], int] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                count[host, "", "h", 0] = count.get((host, "", "h", 0), 0) + 1
                seen: dict[str, list] = {}
                for path, style, content in parse(page or "", stats=True):
                    seen.setdefault(path, []).append((style, content))
                for path, both in seen.items():  # a page counts once at a place
                    for kind, i in (("p", 0), ("c", 1)):
                        key = (host, path, kind, xxhash.xxh64_intdigest("\0".join(x[i] for x in both)) >> 1)
                        count[key] = count.get(key, 0) + 1
            cols = list(zip(*count)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()),
                                              pa.array(cols[3], pa.int64()), pa.array(list(count.values()), pa.int64())],
                                             names=["host", "path", "kind", "value", "n"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, kind string, value bigint, n bigint") \
        .groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """``(host, path, pages, importance)`` of every branch of every site."""
    size = counts.where("kind = 'h'").select("host", F.col("n").alias("pages"))
    # entropy to base m of counts n_i with sum s: (ln s - sum(n_i ln n_i) / s) / ln m
    by = counts.where("kind <> 'h'").groupBy("host", "path", "kind").agg(
        F.sum("n").alias("s"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nln"))
    h = by.join(size, "host").withColumn("h", F.when(F.col("pages") > 1, (F.log(F.col("s").cast("double")) - F.col("nln") / F.col("s"))
                                                     / F.log(F.col("pages").cast("double"))).otherwise(F.lit(1.0)))
    node = h.groupBy("host", "path", "pages").agg(F.sum(F.when(F.col("kind") == "p", (1 - GAMMA) * F.col("h")).otherwise(GAMMA * F.col("h"))).alias("imp"))
    up = F.expr("transform(sequence(2, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    return node.select("host", "pages", "imp", F.explode(up).alias("path")) \
        .groupBy("host", "path", "pages").agg(F.max("imp").alias("importance"))


def low_branches(counts: DataFrame) -> DataFrame:
    """``(host, path)`` of branches to remove; what is in ``article`` or ``main`` is never among them."""
    named = "|".join(sorted(MAIN_TAGS))
    return importance(counts).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW)) \
        .where(~F.col("path").rlike(rf"/({named})([/.]|$)") & ~F.col("path").rlike(r"/(html|body)$")).select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every row."""
    p = pages.select("page_id", "url", host_and_path(F.col("url"))[0].alias("host"), "html")
    low = materialise(low_branches(materialise(place_counts(p))))
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    few = low.limit(BROADCAST_BRANCHES + 1).collect()
    known = len(few) <= BROADCAST_BRANCHES
    sites: dict[str, set[str]] = {}
    for r in few if known else []:
        sites.setdefault(r["host"], set()).add(r["path"])
    sent = spark.sparkContext.broadcast({h: frozenset(x) for h, x in sites.items()})
    if known:
        p = p.withColumn("low", F.array().cast("array<string>"))
    else:
        p = p.join(low.groupBy("host").agg(F.collect_set("path").alias("low")), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = frozenset()
        for b in batches:
            out = [parse(h or "", sent.value.get(host, none) if known else frozenset(x or ()))
                   for host, h, x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return p.select("page_id", "url", "host", "html", "low").mapInArrow(run, f"page_id {kind}, url string, text string")
