"""Main text of web pages by consensus: pages vote on the path of their main container per host, then all are read by it.

Each page scores its containers by the text they hold, less what is linked or boilerplate. A container is named by its
generalised path, the tags and classes from the root with numbers masked, so that pages made from one template agree. Votes are
added up per (host, path) in Spark, with partial sums in each task, so a host with a third of all pages costs no more
than another. In a second pass every page is read by its host's winning path; a page that lacks it, or holds next to
nothing there, is read by its own best container.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.batches import text_slices
from motefield.runtime import lookup_join

# Names below are those of HTML and of common templates (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title".split())
DROPPED = frozenset("nav footer aside form button select dialog menu".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main "
    "nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("html body main article section div td".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead "
    "menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
# Start tags that end an open element of the second set.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "legend", "summary"}
KEEPS_OPEN = frozenset("table ul ol dl article section main div body html".split())
WEIGHT = {"article": 1.3, "main": 1.2}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
WORD = re.compile(r"[A-Za-z][a-z]*")

# A page's container stands for its host's path if it holds this share of the page's best score.
LEAST_SHARE = 0.3
# Least part of its own best score that a page must hold at the winning path.
FAITH = 0.2


@dataclass(slots=True)
class Page:
    """Elements in document order, and what happens in the page: an element opens (its number), a text, an element closes (~number)."""

    tags: list[str] = field(default_factory=lambda: [""])
    paths: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    dropped: list[bool] = field(default_factory=lambda: [False])
    events: list = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def named(tag: str, found: dict[str, str]) -> str:
    """A tag with its classes, numbers masked."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").split()})
    return ".".join([tag, *classes])


def is_boilerplate(tag: str, found: dict[str, str]) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    words = WORD.findall(found.get("class", "") + " " + found.get("id", ""))
    return any(w.lower() in BOILERPLATE for w in words)


def parse(html: str) -> Page:
    """Read a page leniently: unclosed and stray tags are taken as browsers would, for the elements named above."""
    page, open_, at = Page(), [0], 0
    tags, events = page.tags, page.events

    def close(k: int) -> None:
        while len(open_) > k:
            events.append(~open_.pop())

    while True:
        match = TAG.search(html, at)
        if not match:
            break
        if match.start() > at:
            events.append(html[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            for k in range(len(open_) - 1, 0, -1):
                if tags[open_[k]] == tag:
                    close(k)
                    break
                if tag not in BLOCKS and tags[open_[k]] in KEEPS_OPEN:
                    break
            continue
        if tag in ENDS or tag in P_ENDS:
            for k in range(len(open_) - 1, 0, -1):
                inside = tags[open_[k]]
                if inside in ENDS.get(tag, ()) or (tag in P_ENDS and inside == "p"):
                    close(k)
                    break
                if inside in KEEPS_OPEN:
                    break
        if tag == "br":
            events.append(" ")
        if tag in VOID and tag != "hr":
            continue
        found = attributes(match[3]) if match[3].strip() else {}
        parent = open_[-1]
        tags.append(tag)
        page.parents.append(parent)
        page.paths.append(f"{page.paths[parent]}/{named(tag, found)}" if tag in CONTAINERS else page.paths[parent])
        page.dropped.append(tag in DROPPED or is_boilerplate(tag, found))
        number = len(tags) - 1
        events.append(number)
        if tag in RAW or tag == "hr" or match[3].endswith("/"):
            events.append(~number)
            if tag in RAW and not match[3].endswith("/"):
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        open_.append(number)
    if at < len(html):
        events.append(html[at:])
    close(1)
    keep_content(page)
    return page


def keep_content(page: Page) -> None:
    """Nothing that holds the article, the main part or its first heading is boilerplate, whatever it is called."""
    for i, tag in enumerate(page.tags):
        if tag in ("article", "main", "h1"):
            up = page.parents[i]
            while up > 0:
                if page.tags[up] not in DROPPED:
                    page.dropped[up] = False
                up = page.parents[up]
    for i, tag in enumerate(page.tags):
        if tag == "header":
            up = page.parents[i]
            while up > 0 and page.tags[up] not in ("article", "main"):
                up = page.parents[up]
            page.dropped[i] = up <= 0


def scores(page: Page) -> list[float]:
    """For each element its kept text without links, less the linked and dropped text within; 0 if it is no container."""
    good, bad = [0] * len(page.tags), [0] * len(page.tags)
    open_, drops, links = [0], 0, 0
    for e in page.events:
        if isinstance(e, str):
            size = len(e) - e.count(" ") if len(e) > 1 else 0
            if drops or links:
                bad[open_[-1]] += size
            else:
                good[open_[-1]] += size
            continue
        number, step = (e, 1) if e >= 0 else (~e, -1)
        if step > 0:
            open_.append(number)
        else:
            open_.pop()
        drops += step * page.dropped[number]
        links += step * (page.tags[number] == "a")
    for i in range(len(page.tags) - 1, 0, -1):
        good[page.parents[i]] += good[i]
        bad[page.parents[i]] += bad[i]
    return [max(0.0, (g - b) * WEIGHT.get(t, 1.0)) if t in CONTAINERS else 0.0 for g, b, t in zip(good, bad, page.tags)]


def best(values: list[float]) -> int:
    """The container with the highest score, the innermost of equals; 0, the whole page, if all are empty."""
    top = max(values)
    return max(i for i, v in enumerate(values) if v == top) if top > 0 else 0


def text_of(page: Page, roots: set[int]) -> str:
    """Blocks within the given elements, in page order, without what is dropped."""
    blocks, words = [], []
    inside = 1 if 0 in roots else 0
    drops = 0

    def flush() -> None:
        text = " ".join(unescape("".join(words)).split())
        if text:
            blocks.append(text)
        words.clear()

    for e in page.events:
        if isinstance(e, str):
            if inside and not drops:
                words.append(e)
            continue
        number, step = (e, 1) if e >= 0 else (~e, -1)
        if page.tags[number] in BLOCKS or number in roots:
            flush()
        elif page.tags[number] in ("td", "th"):
            words.append(" ")
        inside += step * (number in roots)
        drops += step * page.dropped[number]
    flush()
    return "\n\n".join(blocks)


def votes(html: str) -> dict[str, float]:
    """Paths of the containers that hold a good part of the page's best score, with that part."""
    page = parse(html)
    values = scores(page)
    top = max(values)
    out: dict[str, float] = {}
    if top > 0:
        first = best(values)
        for i, v in enumerate(values):
            if v >= LEAST_SHARE * top:
                share = v / top if i == first or v < top else 0.999
                out[page.paths[i]] = max(out.get(page.paths[i], 0.0), share)
    return out


def extract(html: str, winner: str | None) -> str:
    """Main text by the host's winning path, or by the page's own best container."""
    page = parse(html)
    values = scores(page)
    own = best(values)
    at = {i for i, path in enumerate(page.paths) if i and path == winner and page.tags[i] in CONTAINERS}
    if sum(values[i] for i in at) <= FAITH * values[own]:
        at = {own}
    return text_of(page, at)


def host_of(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, path`` with the most votes; equal votes go to the longer path, then to the later one in order.

    ``pages`` holds ``host`` and ``html``.
    """

    def vote(batches):
        for rows in text_slices(batches, "html"):
            sums: dict[tuple[str, str], float] = {}
            for host, html in zip(rows.column("host").to_pylist(), rows.column("html").to_pylist()):
                for path, share in votes(html).items():
                    sums[host, path] = sums.get((host, path), 0.0) + share
            hosts, paths = zip(*sums) if sums else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(sums.values()), pa.float64())], ["host", "path", "votes"])

    totals = pages.mapInArrow(vote, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return totals.groupBy("host").agg(F.max(F.struct("votes", F.length("path"), "path"))["path"].alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null page counts as empty and has an empty text; a null or odd url belongs to the host without a name; repeated rows
    stay repeated; an empty table gives an empty one; other columns are not read.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url")))
    winners = winning_paths(pages.select("host", "html"))

    def read(batches):
        for rows in text_slices(batches, "html"):
            texts = [extract(html, path) for html, path in zip(rows.column("html").to_pylist(), rows.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = dict(pages.dtypes)["page_id"]
    joined = lookup_join(pages, winners, ["host"], "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
