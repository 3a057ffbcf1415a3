"""The main text of web pages: what a site repeats goes, so do parts that say what they are, and the article's blocks stay.

Method.  Each pass reads a page into elements.  First pass: the subtree of every block element gets a hash of its tag and contents, and Spark
counts for each host on how many of its titles a subtree stands.  Titles are counted instead of pages, so that copies of one article
don't make its paragraphs look like a site's frame.  Subtrees on at least half of a host's titles (``SHARE``; three at least, ``LEAST``) are its template.
Second pass: they are deleted, and the text of what is left is joined.

Parts that say what they are (nav, footer, aside, form, script ..., and roles and class names for menus, adverts, comments and the like) are
left out in both passes, so nothing is counted that goes anyway; a part that holds the article isn't judged by its class.  A header goes
unless it stands in an article or holds the page's h1.  The text is that of the page's articles, else of its main part, else of its body.  A line
break (br) is white space inside a block; a table's cells are blocks.  White space is what Unicode calls so, no-break spaces included.

Counts are summed before they are shuffled, first by host, subtree and title, then by host and subtree, so a host or template that
fills a third of all pages is never one task.  At most 1 / ``SHARE`` times the subtrees of a title can be templates of a host; all hosts'
templates are broadcast while they are few (``BROADCAST``), and beyond that pages meet them by host, hot hosts where their pages stand.

Defined cases: null html is empty, and a page without text gives the empty text; a null url, or one without a host, belongs to the host ""; repeated
rows are pages of their own; unclosed elements end where HTML ends them; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import attach_groups, persist, tidied

#: A template stands on this share of its host's titles, and on so many of them.
SHARE, LEAST = 0.5, 3
#: Templates of all hosts that are broadcast (8 bytes each, and each host's name once); more of them are joined.
BROADCAST = 200_000

# HTML's elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
ENDS_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option summary tbody td tfoot th thead tr".split())
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"), "thead": ("td", "th", "tr"), "body": ("head",)}
BARRIERS, TABLE, NOTHING = frozenset("ul ol menu dl table body html".split()), frozenset(["table"]), frozenset()
# Elements, roles, and words of a class or id, that name a part which isn't the article's.
GONE = frozenset(
    "head script style title noscript template iframe noembed noframes nav footer aside form menu search dialog button select textarea input object "
    "embed svg canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu "
    "modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
HEADERS = frozenset("header masthead topbar".split())

_markup = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.DOTALL)
_attribute = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_invisible = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_word = re.compile(r"[a-z]+")
_ends = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in RAW}


@dataclass(slots=True)
class Element:
    tag: str
    above: int
    gone: bool = False
    named: bool = False  # for another part than the article, by its class
    header: bool = False
    scope: str = ""  # "article" or "main" for an element that is one
    holds: bool = False  # it is, or holds, the article
    heading: bool = False  # it is, or holds, an h1
    digest: int = 0
    parts: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    elements: list[Element]
    runs: list[tuple[int, str]]  # (element, text); a line end alone ends a block
    title: str


def _element(tag: str, above: int, attributes: str) -> Element:
    e = Element(tag, above, gone=tag in GONE, header=tag == "header", scope=tag if tag in ("article", "main") else "", heading=tag == "h1")
    for m in _attribute.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            words = _word.findall(value.lower())
            e.named = e.named or not NAMES.isdisjoint(words)
            e.header = e.header or not HEADERS.isdisjoint(words)
        elif name == "role":
            role = value.strip().lower()
            e.gone = e.gone or role in ROLES
            e.scope = role if role in ("article", "main") else e.scope
        elif name == "hidden" or name == "style" and _invisible.search(value):
            e.gone = True
    e.named = e.named and tag not in ("html", "body")
    return e


def _hold(elements: list[Element]) -> None:
    """Mark the articles and main parts and what they stand in: those that no class names for another part; if there are none, those
    in a part that is named so (a page's frame may name its sidebar), else those that are named so themselves."""
    under = [False]
    for e in elements[1:]:
        under.append(e.named or under[e.above])
    scoped = [(e, not e.named, not u) for e, u in zip(elements, under, strict=True) if e.scope]
    for e in [e for e, _, free in scoped if free] or [e for e, own, _ in scoped if own] or [e for e, _, _ in scoped]:
        e.holds = True
    for e in reversed(elements[1:]):
        elements[e.above].holds |= e.holds


def read(html: str) -> Page:
    """The elements and texts of a page, in order."""
    elements, open_, runs, title = [Element("", -1)], [0], [], ""
    counts: dict[str, int] = {}  # of open elements by tag
    at, end = 0, len(html)

    def close(count: int) -> None:
        for _ in range(count):
            e = elements[open_.pop()]
            counts[e.tag] -= 1
            if e.tag in BLOCK:
                runs.append((open_[-1], "\n"))
            above = elements[e.above]
            above.heading = above.heading or e.heading
            if e.parts:
                e.digest = xxhash.xxh64_intdigest(f"{e.tag}>{' '.join(e.parts)}".encode("utf-8", "surrogatepass"))
                above.parts.append(f"<{e.digest:x}>")
                e.parts = []

    def say(text: str) -> None:
        if text:
            text = references.unescape(text)
            runs.append((open_[-1], text))
            if words := text.split():
                elements[open_[-1]].parts.append(" ".join(words))

    def above_end(tags: tuple[str, ...], barriers: frozenset[str]) -> int:
        """How many open elements the end of the innermost of ``tags`` takes with it; none if a barrier is open inside it."""
        for t in tags:
            if counts.get(t):
                break
        else:
            return 0
        for i in range(len(open_) - 1, 0, -1):
            tag = elements[open_[i]].tag
            if tag in tags:
                return len(open_) - i
            if tag in barriers:
                break
        return 0

    while m := _markup.search(html, at):
        say(html[at:m.start()])
        at = m.end()
        tag, ending, attributes = (m[2], m[1], m[3]) if m[2] else (m[5], m[4], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            # the end of a block takes what is open in it along; that of another element doesn't reach beyond the block that it stands in
            if found := above_end((tag,), (NOTHING if tag == "table" else TABLE) if tag in BLOCK else BLOCK):
                close(found)
            elif tag in ("br", "p"):
                runs.append((open_[-1], " " if tag == "br" else "\n"))
            continue
        if tag in ENDS_P:
            close(above_end(("p",), BARRIERS))
        if tag in ENDS:
            while found := above_end(ENDS[tag], BARRIERS):
                close(found)
        if tag in BLOCK:
            runs.append((open_[-1], "\n"))
        if tag in VOID:
            runs.append((open_[-1], "" if tag == "wbr" else " "))
            continue
        elements.append(_element(tag, open_[-1], attributes))
        open_.append(len(elements) - 1)
        counts[tag] = counts.get(tag, 0) + 1
        if tag in RAW:
            found = _ends[tag].search(html, at)
            stop = found.start() if found else end
            if tag == "title" and not title:
                title = " ".join(references.unescape(html[at:stop]).split())
            elif tag not in GONE:
                say(html[at:stop])
            at = stop
    say(html[at:])
    close(len(open_) - 1)
    _hold(elements)
    return Page(elements, runs, title)


def _kept(page: Page, templates: frozenset[int]) -> list[bool]:
    """For each element whether it stays: neither it nor one above it goes."""
    out, inside = [True], [False]
    for e in page.elements[1:]:
        inside.append(inside[e.above] or e.scope == "article" and e.holds)
        header = e.header and not e.heading and not inside[-1]
        out.append(out[e.above] and not (e.gone or (e.named or header) and not e.holds or e.digest in templates))
    return out


def subtrees(page: Page) -> set[int]:
    """The hashes of the block elements that have contents and would stay, but for those that hold the article."""
    return {e.digest for e, kept in zip(page.elements, _kept(page, frozenset()), strict=True) if kept and e.digest and e.tag in BLOCK and not e.holds}


def article(page: Page, templates: frozenset[int] = frozenset()) -> str:
    """The text of the article, its blocks joined by line ends."""
    kept, shown = _kept(page, templates), []
    for scope in ("article", "main", ""):
        inside = [not scope]
        for e in page.elements[1:]:
            inside.append(inside[e.above] or e.scope == scope)
        shown = [a and b for a, b in zip(kept, inside, strict=True)]
        if any(shown[i] and t != "\n" and not t.isspace() for i, t in page.runs if t):
            break
    blocks, block = [], []
    for i, t in (*page.runs, (0, "\n")):
        if t == "\n":
            if words := "".join(block).split():
                blocks.append(" ".join(words))
            block = []
        elif shown[i]:
            block.append(t)
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host, subtree: the subtrees that stand on ``share`` of a host's titles, and on ``least`` at least.  A page without a title counts by its contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, titles, found = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = read(html or "")
                own = [None, *map(_signed, subtrees(page))]
                hosts += [host] * len(own)
                titles += [_signed(xxhash.xxh64_intdigest((page.title or html or "").encode("utf-8", "surrogatepass")))] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(titles, pa.int64())], names=["host", "subtree", "title"])

    marks = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(tidied(run), "host string, subtree long, title long")
    counted = persist(marks.distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("titles")).where(F.col("subtree").isNull() | (F.col("titles") >= least)), "subtree-counts")
    totals = counted.where("subtree is null").select("host", F.col("titles").alias("of"))
    total = totals.agg(F.sum("of")).first()[0] or 0
    rows = counted.where("subtree is not null")
    return attach_groups(rows, totals, "host", "of", total).where(F.col("titles") >= F.lit(share) * F.col("of")).select("host", "subtree")


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST, most: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    found = persist(templates(pages, share, least), "templates")
    each = found.groupBy("host").agg(F.collect_set("subtree").alias("templates"))
    rows = pages.withColumn("host", host_of(F.col("url")))
    if found.count() <= most:
        rows = rows.join(F.broadcast(each), "host", "left")  # at most ``most`` hashes
    else:
        held = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(each, "host")
        rows = attach_groups(rows, held, "host", "pages", rows.count())
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for html, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = frozenset()
                if known:
                    if (key := tuple(known)) not in sets:
                        sets = {key: frozenset(x % (1 << 64) for x in known)}  # pages of a host come in runs
                    own = sets[key]
                texts.append(article(read(html or ""), own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    texts = rows.select("page_id", "url", "html", "templates").mapInArrow(tidied(run), f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
