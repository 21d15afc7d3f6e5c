"""Main text of web pages with a suffix array per host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.common import fresh, row_id, small_batches, written

#: Words that a repeated substring has at least.
LENGTH = 6
#: A run on more than this share of a host's distinct pages is boilerplate, on two pages at least.
SHARE = 0.5
#: A block is boilerplate if at most this share of its words, and fewer than ``LENGTH``, is outside such runs.
LEFT_OVER = 0.2
#: A block inside an article is boilerplate only if as a whole it is on this many distinct pages of the host, too, and
#: such blocks hold at most this share of the words of the article: beyond that the pages are copies of one article.
ARTICLE_PAGES, ARTICLE_SHARE = 10, 0.5
#: Fixed values of HTML: elements without an end tag, without text, that open a block of their
#: own, and that hold no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title iframe object svg canvas math audio video map select datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split())
ASIDE = frozenset("nav header footer aside form menu dialog button search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
#: Parts of a page that an article inside does not make text again.
SHUT_TAGS, SHUT_ROLES = frozenset("nav footer aside dialog".split()), frozenset("navigation contentinfo complementary dialog alertdialog".split())


def _joined(firsts: str, seconds: str) -> set[str]:
    return {a + b for a in firsts.split() for b in seconds.split()}


#: Whole class and id names, hyphens and underscores left out, of menus, side bars, footers, adverts and reader comments.
SHUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments disqus disqusthread footer menu nav navbar "
    "navigation promo promoted promotion related respond replies sidebar sponsor sponsored".split()
) | _joined("site main global primary secondary top", "nav navigation menu") | _joined("site global", "footer") | _joined(
    "ad ads advert", "banner block box slot unit") | _joined("comment comments", "area box form list section thread") | _joined(
    "related", "articles links posts stories") | _joined("sidebar", "nav menu widget") | _joined("footer", "links menu nav widgets")
#: The same of headers, notices and other parts that an article may stand in.
ASIDE_NAMES = SHUT_NAMES | frozenset(
    "banner consent cookie cookies disclaimer gdpr header masthead newsletter notice notices overlay popup share sharing signup social "
    "subscribe toolbar widget".split()
) | _joined("site global", "header") | _joined("cookie cookies gdpr consent", "banner bar consent message notice popup") | _joined(
    "share sharing social", "bar buttons icons links") | _joined("newsletter", "box form signup")
#: Names that inside an article mark its headline, and elements that only a form around a whole page has.
HEADER_NAMES, PAGE_PARTS = frozenset(("header", "masthead", "banner")), frozenset("article main nav header footer aside section h1".split())
#: What an open element closes when it starts.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup")}
#: Elements an implied end tag does not reach beyond.
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_NUMBER = re.compile(r"[-_]?[0-9]+\Z")

#: Text is inside the article, elsewhere, marked, inside a form, or marked and no article starts there.
CORE, OTHER, MARKED, FORM, SHUT = range(5)
#: In place of a position: the row of a page with or without an article, and of the first block inside an article;
#: the further blocks count on downwards.
ARTICLE, OPEN, INSIDE = -1, -2, -3


class _Blocks(HTMLParser):
    """Blocks of text in page order, each with its zone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # element, zone, whether silent
        self.zone, self.quiet = OTHER, False
        self.form = 0  # the first block of the form that is open
        self.parts: list[str] = []
        self.blocks: list[tuple[int, str]] = []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append((self.zone, text))

    def handle_starttag(self, tag, attrs):
        if tag == "p" or tag in BLOCKS:
            self.flush()
            self._close_implied("p", ("p",), ("article", "section", "div", "td", "th", "body", "main", "aside", "blockquote", "li", "dd"))
        if tag in CLOSES:
            self._close_implied(tag, CLOSES[tag], SCOPES.get(tag, ()))
        if tag in ("br", "wbr", "img", "input") and tag != "wbr":
            self.parts.append(" ")
        if tag in VOID:
            return
        if self.zone == FORM and tag in PAGE_PARTS:
            self._open_form()
        self.stack.append((tag, self.zone, self.quiet))
        self.quiet = self.quiet or tag in SILENT
        self.zone = self._zone(tag, dict(attrs))
        if self.zone == FORM and self.stack[-1][1] != FORM:
            self.form = len(self.blocks)

    def _open_form(self):
        """The form turns out to hold the page: what is in it counts as if there was no form."""
        first = next(i for i in range(len(self.stack), 0, -1) if self.stack[i - 1][1] != FORM)
        outer = self.stack[first - 1][1]
        self.blocks[self.form :] = [(outer if zone == FORM else zone, text) for zone, text in self.blocks[self.form :]]
        self.stack[first:] = [(name, outer if zone == FORM else zone, quiet) for name, zone, quiet in self.stack[first:]]
        self.zone = outer

    def _zone(self, tag, attrs):
        if self.zone == SHUT or tag in ("html", "body"):
            return self.zone
        role = (attrs.get("role") or "").lower()
        names = {_NUMBER.sub("", n).replace("-", "").replace("_", "") for n in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()}
        article = tag in ("article", "main")
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or tag in SHUT_TAGS or role in SHUT_ROLES or (not article and names & SHUT_NAMES):
            return SHUT
        if role in ASIDE_ROLES:
            return MARKED
        if article or role in ("main", "article") or "articlebody" in (attrs.get("itemprop") or "").lower():
            return CORE
        if self.zone == MARKED:
            return MARKED
        if self.zone == CORE:  # a headline inside the article stays
            names -= HEADER_NAMES
        if names & ASIDE_NAMES or (tag in ASIDE and tag != "form" and not (tag == "header" and self.zone == CORE)):
            return MARKED
        return FORM if tag == "form" else self.zone

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            self.parts.append(" ")
            return
        depth = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if depth is None:
            if tag == "p":
                self.flush()
            return
        self._unwind(depth)

    def _close_implied(self, tag, closed, scopes):
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in closed:
                self._unwind(i)
                return
            if name in scopes:
                return

    def _unwind(self, depth):
        if any(name in BLOCKS or zone != self.zone for name, zone, _ in self.stack[depth:]):
            self.flush()
        _, self.zone, self.quiet = self.stack[depth]
        del self.stack[depth:]

    def handle_data(self, data):
        if not self.quiet:
            self.parts.append(data)


def page_blocks(html: str) -> list[tuple[int, str]]:
    """``(zone, text)`` of every block of a page, white space made plain; a tag cut off at the end is no text."""
    parser = _Blocks()
    parser.feed(_CUT_OFF.sub("", html))
    parser.close()
    parser.flush()
    if all(zone not in (CORE, OTHER) for zone, _ in parser.blocks):  # a form is all there is
        return [(OTHER if zone == FORM else zone, text) for zone, text in parser.blocks]
    return parser.blocks


def suffix_keys(words: list[str], host: str, length: int) -> list[int]:
    """A key of the suffix of the host's stream that starts at each word, cut after ``length`` words.

    Suffixes with fewer words, at the end of a page, have no key: substrings never cross pages.
    """
    if len(words) < length:
        return []
    line = " ".join(words).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, seed = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest(host.encode())
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - length + 1].tolist(), ends[length - 1 :].tolist(), strict=True)]


def host_of(url: str | None) -> str:
    """Host of a URL in lower case; empty if there is none."""
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _open_words(blocks: list[tuple[int, str]]) -> list[str]:
    """The stream of a page: all words outside its article."""
    return [w for zone, text in blocks if zone != CORE for w in text.split()]


def block_keys(blocks: list[tuple[int, str]], host: str, length: int) -> list[tuple[int, int]]:
    """``(block, key)`` of the suffix at the first word of every block inside the article, cut where the block ends.

    Blocks of fewer than ``length`` words have none; blocks are numbered inside the article.
    """
    seed = xxhash.xxh3_64_intdigest(host.encode())
    inside = (text for zone, text in blocks if zone == CORE)
    return [(i, xxhash.xxh3_64_intdigest(text.encode(), seed)) for i, text in enumerate(inside) if text.count(" ") + 1 >= length]


def page_key(blocks: list[tuple[int, str]], host: str) -> int:
    """A key of what a page says on a host; copies that differ in marked blocks only have the same."""
    said = "\n".join(text for zone, text in blocks if zone in (CORE, OTHER))
    return xxhash.xxh3_64_intdigest(said.encode(), xxhash.xxh3_64_intdigest(host.encode()))


def _signed(keys: list[int]) -> pa.Array:
    return pa.array(np.array(keys, dtype=np.uint64).view(np.int64))


def _stream(length: int):
    """The suffixes of every page, and before them one row of the page itself (``at`` is ARTICLE or OPEN)
    and one of every block inside its article (``at`` is INSIDE less the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hosts, keys, suffixes, at = [], [], [], [], []
            for row, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks, host = page_blocks(page), host_of(url)
                found = suffix_keys(_open_words(blocks), host, length)
                inside = block_keys(blocks, host, length)
                n = len(found) + len(inside) + 1
                rows += [row] * n
                hosts += [xxhash.xxh3_64_intdigest(host.encode())] * n
                keys += [page_key(blocks, host)] * n
                suffixes += [0, *(key for _, key in inside), *found]
                at += [OPEN if article_text(blocks) is None else ARTICLE, *(INSIDE - i for i, _ in inside), *range(len(found))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), _signed(hosts), _signed(keys), _signed(suffixes), pa.array(at, pa.int32())],
                                             names=["row", "host", "page", "suffix", "at"])

    return run


def covered_words(starts: list[int], length: int) -> np.ndarray:
    """The words that the substrings of ``length`` words at ``starts`` cover."""
    if not starts:
        return np.zeros(0, dtype=np.int64)
    return np.unique(np.array(starts, dtype=np.int64)[:, None] + np.arange(length))


def article_text(blocks: list[tuple[int, str]]) -> str | None:
    """The text of the article elements; None if there are none."""
    kept = [text for zone, text in blocks if zone == CORE]
    return "\n".join(kept) if kept else None


def uncovered_article(blocks: list[str], repeated: set[int]) -> str:
    """The blocks of an article but for the ``repeated`` ones, unless these hold too much of it."""
    sizes = [len(text.split()) for text in blocks]
    if sum(sizes[i] for i in repeated) > ARTICLE_SHARE * sum(sizes):
        repeated = set()
    return "\n".join(text for i, text in enumerate(blocks) if i not in repeated)


def uncovered_text(blocks: list[tuple[int, str]], covered: np.ndarray) -> str:
    """The blocks that are not marked, each as a whole, without those that consist of covered words."""
    gone, kept, at = set(covered.tolist()), [], 0
    for zone, text in blocks:
        n = len(text.split())
        left = sum(i not in gone for i in range(at, at + n))
        if zone == OTHER and (left >= LENGTH or left > LEFT_OVER * n):
            kept.append(text)
        at += n
    return "\n".join(kept)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the article of a page, or all its blocks if it has none."""
    for batch in batches:
        found = [page_blocks(page) for page in batch.column(2).to_pylist()]
        kept = [[b for b in f if b[0] == CORE] or f for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([[z for z, _ in f] for f in kept], pa.list_(pa.int8())),
             pa.array([[t for _, t in f] for f in kept], pa.list_(pa.string()))], names=[*batch.schema.names[:2], "zones", "blocks"])


def _assemble(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, repeated = [], []
            for zones, blocks, starts, wide in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                wide = wide or []
                if CORE in zones:
                    texts.append(uncovered_article(blocks, {INSIDE - at for at in wide if at <= INSIDE}))
                else:
                    found = list(zip(zones, blocks, strict=True))
                    texts.append(uncovered_text(found, covered_words([at for at in wide if at >= 0], length)))
                repeated.append(len(covered_words([at for at in starts or [] if at >= 0], length)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(repeated, pa.int64())],
                names=[batch.schema.names[0], "text", "n_chars", "n_repeated"])

    return run


def _wide_runs(suffixes: DataFrame) -> DataFrame | None:
    """The suffixes on more than ``SHARE`` of the distinct pages of their host; None if no page needs them.

    Only hosts that have a page without an article are counted.
    """
    counted = suffixes.where(F.col("at").isin(ARTICLE, OPEN)).groupBy("host").agg(F.count_distinct("page").alias("n_pages"), F.min("at").alias("least"))
    hosts = written(counted.where(F.col("least") == OPEN).select("host", "n_pages"), "hosts")
    if hosts.isEmpty():
        return None
    held = suffixes.where("at >= 0").join(hosts, "host").select("suffix", "page", "n_pages").distinct()
    counts = held.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.max("n_pages").alias("n_pages"))
    return counts.where((F.col("n") >= 2) & (F.col("n") > F.col("n_pages") * SHARE)).select("suffix", F.lit(True).alias("wide"))


def _wide_blocks(suffixes: DataFrame) -> DataFrame | None:
    """``row`` and ``at`` of the blocks inside articles that are on ``ARTICLE_PAGES`` and on more than ``SHARE`` of the
    distinct pages of their host; None if there are none.

    Most blocks are on one page only and drop out before pages are counted.
    """
    inside = suffixes.where(F.col("at") <= INSIDE)
    seen = inside.groupBy("suffix").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    again = written(seen.where("low <> high").select("suffix"), "blocks")
    held = inside.join(again, "suffix").select("host", "suffix", "page").distinct()
    counts = held.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.max("host").alias("host")).where(F.col("n") >= ARTICLE_PAGES)
    pages = suffixes.where(F.col("at").isin(ARTICLE, OPEN)).select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    wide = written(counts.join(pages, "host").where(F.col("n") > F.col("n_pages") * SHARE).select("suffix"), "wide")
    return None if wide.isEmpty() else inside.join(wide, "suffix").select("row", "at")


def extract_text(pages: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pages`` without ``html``, with ``text``, its ``n_chars`` and ``n_repeated``.

    The words of a host's pages outside their articles form one stream. Its suffixes, cut after
    ``length`` words, are brought in order by a shuffle on host and suffix; an interval of
    equal ones with more than one page is a substring repeated across pages. Only the
    first and last page of an interval are kept, summed up before the shuffle, so a host or a
    menu that holds most pages fills no task. ``n_repeated`` counts the words that such
    substrings cover, on copies of a page, too.

    Of the text inside ``article`` or ``main`` a block goes only if the suffix that is the whole of it
    is on ``ARTICLE_PAGES`` and on more than ``SHARE`` of the distinct pages of the host, and never more than
    ``ARTICLE_SHARE`` of an article, since near copies of an article are articles, too; elements that are menus, headers, footers, adverts, notices,
    forms, scripts or comments by their name, role or whole class are never text, but for an
    article inside a wrapper that is no menu, side bar, footer, advert or comments. What a page without
    an article element has besides is its text, but for the blocks that consist of substrings on
    more than ``SHARE`` of the distinct pages of the host. Copies of a page count once there, so
    they keep their text; blocks go or stay as a whole, so nothing is cut out of a paragraph.

    Null html is an empty page, a null or odd URL is host "". Repeated rows count as pages of
    their own in ``n_repeated``. Columns of ``pages`` with one of the three names are replaced.
    """
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars", "n_repeated")]
    row, about = fresh("row", pages.columns), fresh("about", pages.columns)
    keyed = pages.withColumn(row, row_id())
    page = F.coalesce("html", F.lit("")).alias("html")
    suffixes = keyed.select(F.col(row).alias("row"), "url", page).mapInArrow(_stream(length), "row long, host long, page long, suffix long, at int")
    suffixes = written(suffixes, "suffixes")
    wide = _wide_runs(suffixes)
    words = suffixes.where("at >= 0").select("row", "suffix", "at")
    intervals = words.groupBy("suffix").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high").select("suffix")
    intervals = intervals.withColumn("wide", F.lit(False)) if wide is None else intervals.join(wide, "suffix", "left")
    starts = words.join(intervals, "suffix").groupBy("row").agg(
        F.collect_list("at").alias("starts"), F.collect_list(F.when(F.col("wide"), F.col("at"))).alias("wide"))
    blocks = _wide_blocks(suffixes)
    if blocks is not None:
        blocks = blocks.groupBy("row").agg(F.lit(None).cast("array<int>").alias("starts"), F.collect_list("at").alias("wide"))
        starts = starts.unionByName(blocks).groupBy("row").agg(
            F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("wide")).alias("wide"))
    parsed = keyed.select(F.struct(*rest).alias(about), F.col(row).alias("row"), page)
    schema = T.StructType([parsed.schema[about], T.StructField("row", T.LongType()), T.StructField("zones", T.ArrayType(T.ByteType())), T.StructField("blocks", T.ArrayType(T.StringType()))])
    joined = parsed.mapInArrow(_parse, schema).join(starts, "row", "left").select(about, "zones", "blocks", "starts", "wide")
    found = T.StructType([parsed.schema[about], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
                          T.StructField("n_repeated", T.LongType())])
    return joined.mapInArrow(_assemble(length), found).select(f"{about}.*", "text", "n_chars", "n_repeated")
