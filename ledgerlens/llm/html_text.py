"""Main text of web pages by nearest-URL page differencing.

A page is cut into blocks of text (lines), without those that tags mark as no
article. Pages are put in the order of their URL paths within each host; every
page's lines are aligned with those of its nearest neighbours by longest common
subsequence, and lines that most of them share are deleted. Pages of equal lines
count as one, so that a page's neighbours are others. Guards keep articles whole:
neighbours where the lines that differ hold little of the text on either side are
copies of the page (or of each other), no templates, and don't count; a passage
that a few neighbours quote isn't a template; and where a page marks its article
itself, lines inside need more neighbours that agree.
"""

from __future__ import annotations

import bisect
import functools
import html as htmllib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, prefix_sums, saved, table

#: Neighbours looked at on either side; share of equal lines, and of their words, up to which a neighbour is
#: surely no copy; share of the words in other lines from which it is none; pages dealt out together.
NEIGHBOURS, COPY, DIFFER, TOGETHER = 6, 0.6, 0.2, 128
#: Share of the neighbours that have a template's line, and of those inside a marked article with least number.
MOST, INSIDE, LEAST = 0.5, 0.75, 3
#: Lines that must be equal where a page has a single neighbour.
ALONE = 3

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)/?>|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)[^<>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are no article text wherever they are.
DROPPED = frozenset("aside audio button canvas dialog fieldset footer form head iframe input menu nav noscript object option script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark what isn't the article.
MARKS = frozenset(
    "ad ads adsense advert advertisement adverts aside banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies disclaimer disqus footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: An open element is closed when one of these begins.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Where the search for such an element ends.
SCOPE = frozenset("article aside body div dl fieldset footer form header main nav ol section table ul".split())


#: Words that turn a class name into a remark about the layout ("has-sidebar").
REMARKS = frozenset("has have is no not with without".split())


def _marked(value: str, zone: int, name: str) -> bool:
    """A class or id whose first or last word is a mark. An article's own header
    holds its title; an article element is dropped as a comment or advert only."""
    for word in re.split(r"\s+", value.lower()):
        parts = [p for p in re.split(r"[^a-z0-9]+", word) if p]
        if not parts or parts[0] in REMARKS:
            continue
        hits = MARKS & {parts[0], parts[-1]}
        if zone == 2:
            hits = hits - {"header", "masthead"}
        if name == "article":
            hits = hits & {"ad", "ads", "advert", "comment", "comments", "reply", "replies", "promo", "sponsored"}
        if hits:
            return True
    return False


def _dropped(name: str, attributes: str, zone: int) -> bool:
    if name in DROPPED or name == "header" and zone < 2:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _marked(value, zone, name):
            return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def lines(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order, without what tags mark as no
    article: zone 2 inside article, 1 inside main, 0 elsewhere."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # name, zone, dropped
    words: list[str] = []
    zone, drop, at = 0, False, 0

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append((zone, text))

    def pop(k: int) -> None:
        nonlocal zone, drop
        del stack[k:]
        zone, drop = (stack[-1][1], stack[-1][2]) if stack else (0, False)

    while True:
        m = TAG.search(page, at)
        if not drop:
            text = page[at : m.start() if m else len(page)]
            if text:
                words.append(htmllib.unescape(text))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name in BLOCK:
                flush()
            if k is not None:
                pop(k)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if name in VOID:
            flush() if name == "hr" else words.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in ("article", "main", "body"):  # they end what was left open around them
            k = next((k for k in range(len(stack)) if stack[k][2]), None)
            if k is not None and not (name == "article" and any(x[0] in ("article", "main") for x in stack)):
                pop(k)
        for k in range(len(stack) - 1, -1, -1):
            if name in CLOSES.get(stack[k][0], ()):
                pop(k)
                break
            if stack[k][0] in SCOPE:
                break
        inside = max(zone, 2 if name == "article" else 1 if name == "main" else 0)
        gone = drop or _dropped(name, m[3] or "", zone)
        stack.append((name, inside, gone))
        zone, drop = inside, gone
    flush()
    return out


def main_lines(page: str | None) -> tuple[int, list[str]]:
    """The zone that holds the article, and its lines."""
    found = lines(page)
    best = max((z for z, _ in found), default=0)
    return best, [t for z, t in found if z == best]


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence."""
    return [i for i, _ in aligned(a, b)]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions in a and b of a longest common subsequence (Hunt and Szymanski)."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect.bisect_left(ends, j)
            link = ((i, j), links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


Page = tuple[list[int], list[int]]


def compared(one: Page, two: Page) -> tuple[list[int], list[int], bool, bool]:
    """(positions of the lines of one that two has too, those of two, whether they
    are no copies, whether surely); pages are (lines, words of each)."""
    if not set(one[0]) & set(two[0]):
        return [], [], True, True
    pairs = aligned(one[0], two[0])
    a, b = [i for i, _ in pairs], [j for _, j in pairs]
    rest = min(1 - sum(w[k] for k in at) / max(1, sum(w)) for (_, w), at in ((one, a), (two, b)))
    sure = len(a) <= COPY * max(len(one[0]), len(two[0])) or rest >= 1 - COPY
    return a, b, sure or rest >= DIFFER, sure


def shared(k: int, near: list[int], pair, marked: bool) -> list[int]:
    """Positions of the lines of page k that are its template's: those that most of
    the pages `near` have too (nearest first; copies of k, or of one another, count
    once or not at all). pair(i, j) is compared() of the pages i and j."""
    others: list[int] = []
    for j in near:
        if pair(k, j)[2] and all(pair(i, j)[2] for i in others):
            others.append(j)
    if len(others) == 1:
        same, _, _, sure = pair(k, others[0])
        return same if sure and len(same) >= ALONE and not marked else []
    votes: dict[int, int] = {}
    for j in others:
        for at in pair(k, j)[0]:
            votes[at] = votes.get(at, 0) + 1
    need = max(LEAST, INSIDE * len(others)) if marked else max(2, MOST * len(others))
    return sorted(at for at, n in votes.items() if n >= need)


@functools.cache
def _url() -> re.Pattern:
    return re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)(?::\d+)?([^#]*)")


def place(url: str | None) -> tuple[str, str]:
    """(host, path), with numbers padded so that near ones are neighbours."""
    m = _url().match(url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", url or "")
    return host, re.sub(r"\d+", lambda d: d[0].zfill(12), path)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    A null or empty html gives an empty text, as does a page of nothing but
    markup. Pages with a null url share one host. Repeated rows get equal rows;
    other columns are ignored; an empty table gives no rows. Nothing is cut off.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("_key", F.xxhash64("page_id", "url", "html"))

    def measure(batches):
        for b in batches:
            hosts, paths, marked, hashes, counts = [], [], [], [], []
            for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                host, path = place(u)
                zone, texts = main_lines(h)
                hosts.append(host)
                paths.append(path)
                marked.append(zone > 0)
                hashes.append([_hash(t) for t in texts])
                counts.append([len(t.split()) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hosts), pa.array(paths), pa.array(marked, pa.bool_()), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["_key", "host", "path", "marked", "lines", "words"])

    measured = rows.select("_key", "url", "html").mapInArrow(measure, "_key long, host string, path string, marked boolean, lines array<long>, words array<int>")
    measured = saved(measured.withColumn("content", F.xxhash64("host", "lines", "marked")), "measured")
    first = F.min(F.struct("path", "_key")).alias("at")
    contents = measured.groupBy("content", "host").agg(first, F.bool_and("marked").alias("marked"), F.first("lines").alias("lines"), F.first("words").alias("words"))
    contents = contents.select("content", "host", F.col("at.path").alias("path"), "marked", "lines", "words", F.lit(1).cast("long").alias("one"))
    placed = prefix_sums(contents, [], ["host", "path", "content"], "one", "place").drop("one", "path")
    home = F.expr(f"place div {TOGETHER}")
    around = F.array_distinct(F.array(home, F.expr(f"greatest(place - {NEIGHBOURS}, 0) div {TOGETHER}"), F.expr(f"(place + {NEIGHBOURS}) div {TOGETHER}")))
    dealt = placed.withColumn("home", home).withColumn("group", F.explode(around))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place").reset_index(drop=True)
        contents, gone = [], []
        pages = list(zip(map(list, pdf["lines"]), map(list, pdf["words"]), strict=True))
        host, home, marked = pdf["host"].tolist(), (pdf["home"] == pdf["group"]).to_numpy(), pdf["marked"].tolist()

        @functools.cache
        def pair(i: int, j: int) -> tuple:
            if i > j:
                a, b, other, sure = pair(j, i)
                return b, a, other, sure
            return compared(pages[i], pages[j])

        for k in np.flatnonzero(home).tolist():
            near = [j for d in range(1, NEIGHBOURS + 1) for j in (k - d, k + d) if 0 <= j < len(pdf) and host[j] == host[k]]
            if at := shared(k, near, pair, marked[k]):
                contents.append(pdf["content"][k])
                gone.append(at)
        return pd.DataFrame({"content": pd.Series(contents, dtype="int64"), "gone": pd.Series(gone, dtype=object)})

    shares = dealt.groupBy("group").applyInPandas(compare, "content long, gone array<int>")
    deleted = saved(measured.select("_key", "content").distinct().join(shares, "content").groupBy("_key").agg(F.min("gone").alias("gone")), "deleted")
    joined = rows.join(maybe_broadcast(deleted, 200_000), "_key", "left").select("page_id", "url", "html", "gone")

    def extract(batches):
        for b in batches:
            texts = []
            for h, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                skip = set(gone or ())
                texts.append("\n".join(t for k, t in enumerate(main_lines(h)[1]) if k not in skip))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
