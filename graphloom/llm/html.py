"""Main text of web pages: elements that a site repeats are counted per host and removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, arrow_map

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: Elements whose content is not markup; it is skipped up to their end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that are never part of the article, wherever they stand.
OUTSIDE = {"nav", "aside", "footer", "menu", "dialog", "button", "select", "head"}
#: Words in a class, id or role that tell menus, notices and the like outside the article; "no-sidebar" and "has-sidebar" tell of the page.
NAMED = re.compile(
    r"(?:^|[\s_-])(?<!\bno-)(?<!\bhas-)(?<!\bwith-)(?<!\bwithout-)(?:ads?|adverts?|advertisement|banner|promo|sponsored|sponsor|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|"
    r"notices?|alert|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|comments?|disqus|contentinfo|complementary|search|login|signup)(?:$|[\s_-])"
)
#: Whole classes, ids and roles that tell adverts and readers' comments within the article too.
PROVED = set("ad ads advert adverts advertisement sponsored comment comments comment-list comments-list comments-area disqus disqus_thread".split())
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder svg g text tspan object".split())
#: Blocks of running text; inside the article these stay, however often they recur.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption"}
#: An open one of these ends when another of the same group begins.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
MAIN = {"article", "main"}


class Page:
    """One pass over a page: its blocks, and the hash of every block element's subtree that has text.

    Names never decide on what holds an article or main element. Within the article they do for
    adverts and comments; other names there, such as notices, only for subtrees that also recur.

    `drop` has the subtree hashes that recur on the page's host. After the pass `blocks` is the
    article's text (all of the body's where there is no article or main element), `subtrees` the
    set of hashes, `body` a hash of the text outside elements that are never part of the article.
    """

    def __init__(self, html: str, drop: frozenset[int] = frozenset()):
        self.drop, self.subtrees, self.blocks, self.main = drop, set(), [], []
        self.text: list[str] = []
        # of each open element: tag, blocks and main blocks at its start, what it holds, whether it is out, whether it is the
        # article's, what its name says of it, and how many articles had begun at its start
        self.open: list[tuple[str, int, int, list[str], bool, bool, str, int]] = [("", 0, 0, [], False, False, "", 0)]
        self.begun, at, raw = 0, 0, ""
        for m in TAG.finditer(html):
            tag = (m[2] or "").lower()
            if raw:
                if m[1] and tag == raw:
                    raw, at = "", m.end()
                continue
            if m.start() > at:
                self.text.append(html[at : m.start()])
            at = m.end()
            if not tag:
                continue
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                self.text.append(" ")
                raw = tag
            else:
                self.start(tag, m[3])
        if not raw:
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)  # a tag that the page breaks off in
            self.text.append(rest[: cut.start()] if cut else rest)
        self.flush()
        while len(self.open) > 1:
            self.close()
        self.has_main = self.begun > 0
        self.body = xxhash.xxh64_intdigest("\n".join(self.main if self.has_main else self.blocks))

    def flush(self) -> None:
        """What was read since the last border is a block."""
        if not self.text:
            return
        block = " ".join(unescape("".join(self.text)).split())
        self.text = []
        if block:
            parts, out, main = self.open[-1][3:6]
            parts.append(block)
            if not out:
                self.blocks.append(block)
                if main:
                    self.main.append(block)

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                self.text.append(" ")
            return
        self.flush()
        if tag in VOID:
            return
        if tag in CLOSES:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in CLOSES[tag]:
                    while len(self.open) > k:
                        self.close()
                    break
                if self.open[k][0] not in TEXT:
                    break
        elif self.open[-1][0] == "p":
            self.close()
        out, main = self.open[-1][4:6]
        out = out or tag in OUTSIDE or (tag == "header" and not main)
        name = "form" if tag == "form" else ""
        if not out and attributes and tag not in ("html", "body"):
            told = [(a or b or c).lower() for _, a, b, c in ATTRIBUTE.findall(attributes)]
            if main and any(PROVED & set(x.split()) for x in told):
                name = "proved"
            elif (tag not in MAIN or main) and any(NAMED.search(x) for x in told):
                name = "named"
        begun = self.begun
        if tag in MAIN and not out and name != "proved":
            main = True
            self.begun += 1
            begun += 1
        self.open.append((tag, len(self.blocks), len(self.main), [], out, main, name, begun))

    def end(self, tag: str) -> None:
        if tag in INLINE:
            return
        self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self.close()
                return

    def close(self) -> None:
        tag, blocks, mains, parts, out, main, name, begun = self.open.pop()
        if not parts:
            return
        value = xxhash.xxh64_intdigest("\x1f".join((tag, *parts))) >> 1
        self.open[-1][3].append(f"\x1e{value}")
        held = self.begun > begun  # an article within: then this is no menu, form or advert, but around it
        gone = not held and (name in ("form", "proved") or (name == "named" and not main))
        if tag not in ("html", "body") and tag not in MAIN and (name or not main or tag not in TEXT):
            self.subtrees.add(value)
            gone |= value in self.drop
        if gone and not out:
            del self.blocks[blocks:], self.main[mains:]


def host(url: str) -> F.Column:
    """The host of a URL, in lower case and without credentials and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, least: int = 5, share: float = 0.05, enough: int = 1000) -> DataFrame:
    """(host, drop): of each host the hashes of subtrees that recur on many of its pages.

    Those are on at least `least` pages and `share` of the host's; but on a large host `enough`
    pages suffice, if they are one in a thousand. So a host's list does not grow with it. Pages
    with the same text are one here, so copies of an article do not make it a template.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, bodies, hashes = [], [], []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                found = [None, *page.subtrees]
                hosts += [name] * len(found)
                bodies += [page.body >> 1] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(bodies, pa.int64())], ["host", "hash", "body"])

    seen = arrow_map(pages.select(host("url").alias("host"), "html"), work, "host string, hash long, body long").distinct()
    counts = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("hash").isNull() | (F.col("n") >= least))
    counts = Stage(pages.sparkSession, "html").keep(counts)
    whole = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    needed = F.greatest(F.least(share * F.col("pages"), F.lit(enough)), 0.001 * F.col("pages"))
    often = counts.where(F.col("hash").isNotNull() & (F.col("n") >= least)).join(whole, "host").where(F.col("n") >= needed)
    return often.groupBy("host").agg(F.collect_list("hash").alias("drop"))


def extract(pages: DataFrame, hosts_in_memory: int = 200_000) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the article's blocks in page order, joined by newlines.

    Left out are scripts, styles, menus, forms, headers and footers outside the article, asides,
    elements named as adverts, notices, comments and the like (see `Page`), and subtrees that recur
    on the host; running text within an article stays, however often it recurs. Columns other
    than the three are not read. White space inside a block is one space; character references are decoded; broken
    markup is read as far as it goes. Null and empty html give an empty text, repeated rows are
    extracted each, null urls count as one host; an empty table gives no rows. The lists of
    template hashes are sent to all executors where there are at most `hosts_in_memory` hosts
    with any (each list is bounded, see `templates`), and joined by host otherwise.
    """
    stage = Stage(pages.sparkSession, "html")
    lists = stage.keep(templates(pages))
    small = lists.count() <= hosts_in_memory
    rows = pages.select("page_id", "url", "html", host("url").alias("host")).join(F.broadcast(lists) if small else lists, "host", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset] = {}
        for batch in batches:
            texts = []
            for html, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                key = tuple(drop or ())
                if key not in known:
                    known = {key: frozenset(key)} | (known if len(known) < 256 else {})
                page = Page(html or "", known[key])
                texts.append("\n".join(page.main if page.has_main else page.blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(rows.select("page_id", "url", "html", "drop"), work, "page_id long, url string, text string, n_chars long")
