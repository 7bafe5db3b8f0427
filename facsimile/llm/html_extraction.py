"""Main text of web pages by removing each site's templates.

Every element's subtree gets a hash of its tag, attributes of style, text and
children. Spark counts, per host, beside how many distinct main contents each
hash occurs; subtrees beside at least a fiftieth of them (four at least) are the
site's template and are deleted. What page markup itself declares as menu,
header, footer, sidebar, notice, advert, form or comments goes as well, as such
parts may differ from page to page. Articles, what holds nearly all text of a
page, and plain paragraphs and headings inside an article are never template,
and copies of a page count once: an article that a site shows on many pages
stays an article.

Pages are parsed twice, once for the counts and once for the text, so only
hashes are shuffled, pre-aggregated by the map side.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import quoted
from facsimile.sources.staging import stage

LEAST_PAGES = 4
#: Of a host's distinct main contents; small, as a site may have many layouts.
LEAST_SHARE = 0.02
#: A subtree with this share of the text of a page's articles (or else its main part) is no template.
MOST = 0.8

#: A comment, a declaration, or a tag; quoted attribute values may hold any character.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
#: Elements whose content is text up to their own end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in (
    "script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul"
    .split())
_CELL = frozenset(("td", "th", "br", "option"))
#: Elements that close an open one of the second set, up to the third.
_CLOSES = {t: (frozenset(("p",)), frozenset(("button", "td", "th", "table", "article", "section", "div", "blockquote")))
           for t in _BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "li", "dd", "dt"}}
_CLOSES |= {
    "li": (frozenset(("li", "p")), frozenset(("ul", "ol", "menu", "dir"))),
    "dd": (frozenset(("dd", "dt", "p")), frozenset(("dl",))), "dt": (frozenset(("dd", "dt", "p")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))), "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))), "option": (frozenset(("option",)), frozenset(("select",))),
}
_SCOPE = frozenset(("table", "td", "th", "article", "main", "body", "html"))

#: Elements that never hold main text.
_DROPPED = frozenset(
    "head nav aside footer form button select input textarea script style template svg canvas object audio video map math menu "
    "noscript iframe title dialog datalist label fieldset noembed noframes".split())
_DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Class names and ids, whole, of parts that are no main text.
_DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr menu modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination popup "
    "promo promoted promotion related replies respond share sharing sidebar sidenav skyscraper social sponsor sponsored subscribe "
    "subscription toolbar widget widgets alert paywall cookie-notice cookie-banner cookie-bar cookie-consent cookie-popup ad-banner "
    "ad-container ad-slot ad-wrapper comment-list comments-area comment-form nav-bar nav-menu main-nav main-menu site-nav side-bar "
    "related-posts related-articles share-buttons social-share social-links newsletter-signup site-footer page-footer".split())
#: Never dropped by a name or role.
_KEPT = frozenset(("html", "body", "main", "article"))
#: Dropped outside an article only; inside, they hold its headline.
_DROPPED_OUTSIDE = frozenset(("header", "masthead", "topbar"))
_PLAIN = frozenset(
    "p h1 h2 h3 h4 h5 h6 li b i em strong a span u s small sub sup blockquote q cite code pre br hr td th tr dd dt mark abbr time img"
    .split())
_ROOTS = ("article", "main")


class Page:
    """One pass over a page's markup."""

    def __init__(self, html: str):
        self.parts: list[str | None] = []  # text; None ends a block
        self.hashes: list[tuple[int, int, int]] = []  # (first and end place in parts, subtree hash) of what may be template
        self.named: list[tuple[int, int]] = []  # places of what names declare as no main text
        self.roots: dict[str, list[tuple[int, int]]] = {t: [] for t in _ROOTS}
        # per open element: tag, place in parts, hash parts, dropped unread, may be template, dropped by name
        self.stack: list[tuple[str, int, list[bytes], bool, bool, bool]] = []
        self.dropped = 0
        self.inside = 0  # open articles
        self.last_root = -1  # where the last outermost article began
        self._read(html)
        while self.stack:
            self._close()
        for a, b in self.named:
            self.parts[a:b] = [""] * (b - a)
        self.sizes = [0]  # running sum of letters
        for part in self.parts:
            self.sizes.append(self.sizes[-1] + sum(map(len, (part or "").split())))

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        if text:
            self.parts.append(text)
            if self.stack:
                self.stack[-1][2].append(" ".join(text.split()).encode("utf-8", "replace"))

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            mark = _MARKUP.search(html, at)
            if mark is None:
                if not self.dropped:
                    self._text(html[at:])
                return
            if mark.start() > at and not self.dropped:
                self._text(html[at:mark.start()])
            at = mark.end()
            tag = mark[2]
            if tag is None:
                continue
            tag = tag.lower()
            if mark[1]:
                self._end(tag)
            elif tag in _RAW:
                at = _RAW[tag].search(html, at).end()
            else:
                self._start(tag, mark[3])
                if tag in _VOID or tag == "svg" and mark[3].endswith("/"):
                    self._close()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES:
            closes, until = _CLOSES[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name in closes:
                    while len(self.stack) > k:
                        self._close()
                    if tag not in ("li", "dd", "dt", "tr"):
                        break
                elif name in until:
                    break
        drop, named, style = tag in _DROPPED, False, b""
        if attributes and not self.dropped and not drop:
            drop, named, style = self._named(attributes)
            named = named and tag not in _KEPT
        if tag == "header" and not self.inside:
            drop = True
        if not self.dropped:
            if tag in _BLOCK:
                self.parts.append(None)
            elif tag in _CELL:
                self.parts.append(" ")
        plain = tag in _KEPT or (bool(self.inside) and tag in _PLAIN and not style)
        self.stack.append((tag, len(self.parts), [tag.encode(), style], drop, not (plain or self.dropped or drop), named))
        self.dropped += drop
        if tag in _ROOTS and not self.dropped:
            if not self.inside:
                self.last_root = len(self.parts)
            self.inside += 1

    def _named(self, attributes: str) -> tuple[bool, bool, bytes]:
        """Whether it is hidden, whether class, id or role say that this is no main text; and these for the hash."""
        style, named = [], False
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False, b""
            words = set(value.split())
            if name == "role":
                named = named or bool(words & _DROPPED_ROLES)
            elif name in ("class", "id"):
                named = named or bool(words & _DROPPED_NAMES or not self.inside and words & _DROPPED_OUTSIDE)
            style.append(f"{name}={' '.join(sorted(words))}")
        return False, named, ";".join(sorted(style)).encode()

    def _end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                while len(self.stack) > k:
                    self._close()
                return
            if name in _SCOPE and tag not in _SCOPE:
                return

    def _close(self) -> None:
        import xxhash

        tag, start, parts, drop, candidate, named = self.stack.pop()
        self.dropped -= drop
        if tag in _ROOTS and not drop and not self.dropped:
            self.inside -= 1
        if self.dropped or drop:
            return
        own = xxhash.xxh3_64_intdigest(b"\x00".join(parts)) - (1 << 63)
        if self.stack:  # also of a part that goes, or its parent's hash would change
            self.stack[-1][2].append(own.to_bytes(8, "little", signed=True))
        # an element around an outermost article is not dropped by its name
        if named and (self.inside or self.last_root < start):
            self.named.append((start, len(self.parts)))
        elif candidate and len(parts) > 2:
            self.hashes.append((start, len(self.parts), own))
        if tag in _ROOTS and len(self.parts) > start:
            self.roots[tag] = [r for r in self.roots[tag] if r[0] < start] + [(start, len(self.parts))]
        if tag in _BLOCK:
            self.parts.append(None)
        elif tag in _CELL:
            self.parts.append(" ")

    def _size(self, a: int, b: int) -> int:
        return self.sizes[b] - self.sizes[a]

    def _main(self) -> list[tuple[int, int]]:
        """What <main> holds, and articles beside it; the whole page where there is none."""
        mains = self.roots["main"]
        if not mains:
            return [(0, len(self.parts))]
        return sorted(mains + [(a, b) for a, b in self.roots["article"] if not any(x <= a < y for x, y in mains)])

    def _core(self) -> list[tuple[int, int]]:
        return self.roots["article"] or self._main()

    def _recurring(self) -> list[tuple[int, int, int]]:
        """Subtrees with text in the main part that may be template."""
        main = self._main()
        return [(a, b, h) for a, b, h in self.hashes if self._size(a, b) and any(x <= a <= y for x, y in main)]

    def candidates(self) -> list[int]:
        """Hashes, each once, of subtrees in the main part that may be template."""
        return sorted({h for _, _, h in self._recurring()})

    def content(self) -> int:
        """Digest of the articles' text (or else the main part's), by which copies of a page are known."""
        import xxhash

        text = self._blocks(self.parts, self._core())
        return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """Blocks of the main part without subtrees whose hash is in ``template``."""
        parts, core, spared = list(self.parts), self._core(), []
        most = MOST * sum(self._size(x, y) for x, y in core)
        for a, b, _ in sorted((r for r in self._recurring() if r[2] in template), key=lambda r: (r[0], -r[1])):
            if any(x <= a and b <= y for x, y in spared):
                continue
            if sum(self._size(max(a, x), max(a, x, min(b, y))) for x, y in core) >= most > 0:
                spared.append((a, b))
            else:
                parts[a:b] = [""] * (b - a)
        return self._blocks(parts, self._main())

    @staticmethod
    def _blocks(parts: list[str | None], places: list[tuple[int, int]]) -> str:
        """White space made single, blocks joined by line breaks."""
        blocks, block = [], []
        for a, b in places:
            for part in [*parts[a:b], None]:
                if part is not None:
                    block.append(part)
                elif block:
                    if text := " ".join("".join(block).split()):
                        blocks.append(text)
                    block = []
        return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without port and user; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def templates(pages: DataFrame) -> DataFrame:
    """(host, hashes): the subtrees that recur across a host's pages. ``pages`` has host and html."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(h or "") for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.content() for p in found], pa.int64()),
                 pa.array([p.candidates() for p in found], pa.list_(pa.int64()))], names=["host", "content", "hashes"])

    hashed = pages.select("host", "html").where(F.col("host").isNotNull()).mapInArrow(
        run, "host string, content long, hashes array<long>")
    # hash null: the host's pages; copies of a main content count once
    counted = hashed.select("host", "content", F.explode(F.concat(F.array(F.lit(None).cast("long")), "hashes")).alias("hash")).groupBy(
        "host", "hash").agg(F.count_distinct("content").alias("n"))
    counted = stage(counted.where((F.col("n") >= LEAST_PAGES)), "subtree-counts")
    total = counted.where(F.col("hash").isNull()).select("host", F.col("n").alias("pages"))
    recurring = counted.where(F.col("hash").isNotNull()).join(total, "host").where(
        F.col("n") >= LEAST_SHARE * F.col("pages"))
    # a hash beside a fiftieth of the contents: a host has at most fifty times as many as its average page
    return recurring.groupBy("host").agg(F.collect_list("hash").alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page gives an empty text. Pages without a host are their
    own: nothing recurs among them. Repeated rows count as pages and give a row
    each; an empty table gives an empty result.
    """
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).cast("string").alias("url"),
                        quoted(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    # staged, so its size is known: Spark broadcasts it where it is small and splits hot hosts where it is not
    known = stage(templates(rows), "site-templates")
    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "template")
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h or "").text(frozenset(t or ()))
                     for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
