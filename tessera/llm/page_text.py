"""Main text of HTML pages: regions by markup, and boilerplate by a suffix array of each host."""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, scratch

#: Tokens of a run that counts as long, and tokens of a host, about, that one suffix array holds; a larger host has several, which are merged.
RUN, HOST_TOKENS = 8, 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside form button select menu dialog object audio video canvas".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = frozenset("article main".split())
#: Words of class and id names that mark what is no article.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "footer sidebar aside widget cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login social share sharing "
    "comment comments reply replies discussion disqus related recommended popup modal overlay pagination pager search form toolbar hidden".split()
)
#: Of those, words of layout: as a part of a name (has-sidebar, entry-header, search-results) they mark nothing.
LAYOUT_NAMES = frozenset(
    "banner nav navbar navigation menu header masthead footer sidebar aside widget search form toolbar hidden alert login signup social overlay modal pager pagination".split()
)
MAIN_NAMES = frozenset("articlebody article-body entry-content post-content post-body article-content story-body main-content".split())
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|<)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z0-9]+")
HEADING = re.compile(r"h[1-6]\Z")

#: NAMED is a drop by name outside a marked article. From REGION on the number of the article that a block is in, 0 for none or a main element's own text.
DROP, PROTECT, NAMED, REGION = 1, 2, 4, 8
#: What becomes of a block in the stream: out, in, in without shared runs; from 1 on the article that decides.
OUT, IN, UNMARKED = 0, -1, -2


def _kind(tag: str, attributes: str, inside_main: bool) -> int:
    """DROP, PROTECT or NAMED if an element starts a region of that kind."""
    named: set[str] = set()
    whole: set[str] = set()
    role = ""
    if attributes and attributes.strip("/ \n"):
        for m in ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "itemprop"):
                whole.update(value.split())
                if key != "itemprop":
                    named.update(NAME.findall(value))
            elif key == "role":
                role = value.strip()
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                return DROP
    if tag in DROPPED or role in DROPPED_ROLES or (tag == "header" and not inside_main):
        return DROP
    if tag not in ("body", "html", "main", "article") and not whole & MAIN_NAMES and (whole & DROPPED_NAMES or named & (DROPPED_NAMES - LAYOUT_NAMES)):
        return DROP if inside_main else NAMED
    return PROTECT if tag in MAIN or role in ("main", "article") or whole & MAIN_NAMES else 0


def blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, white space reduced, each with the kinds of region it is in and the number of its outermost article."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # element, kinds of it and what it is in
    held: list[str] = []
    kind_now = articles = 0

    def close() -> None:
        if held:
            words = "".join(held).split()
            if words:
                out.append((" ".join(words), kind_now))
            held.clear()

    at, n, lower = 0, len(page), None
    while at < n:
        m = PIECE.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            held.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ending, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCK or tag in RAW:
            close()
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if (stack[i - 1][1] if i else 0) != kind_now:
                        close()
                    del stack[i:]
                    break
        elif tag in RAW:
            lower = page.lower() if lower is None else lower
            if not attributes.endswith("/") or tag in ("script", "style", "textarea", "title"):
                end = lower.find(f"</{tag}", at)
                end = n if end < 0 else end
                stop = page.find(">", end)
                at = n if stop < 0 else stop + 1
        elif tag not in VOID:
            if tag in BLOCK:
                for i in range(len(stack) - 1, -1, -1):  # what a block's start closes
                    if stack[i][0] == "p" or (tag == "li" and stack[i][0] == "li"):
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
            above = stack[-1][1] if stack else 0
            own = _kind(tag, attributes, bool(above & PROTECT))
            kind = above | own
            if own & PROTECT and tag in BLOCK and tag != "main" and above < REGION and not re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I):
                articles += 1
                kind |= articles * REGION
            if kind != above:
                close()
            stack.append((tag, kind))
        kind_now = stack[-1][1] if stack else 0
    close()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


PARSED = pa.schema([
    ("chunk", pa.int64()), ("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("text", pa.string()),
    ("rest", pa.list_(pa.string())), ("kept", pa.list_(pa.int32())), ("tokens", pa.int64()),
])
PARSED_DDL = "chunk long, row long, page_id long, url string, host string, text string, rest array<string>, kept array<int>, tokens long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, row = uuid.uuid4().int >> 65, 0
    for b in arrow.full(batches):
        texts, rests, kepts = [], [], []
        for raw in b.column(2).to_pylist():
            found = blocks(raw.decode("utf-8", "replace"))
            left_out = DROP | NAMED if any(k & (DROP | NAMED | PROTECT) == PROTECT for _, k in found) else DROP  # the only article stays, whatever is around it
            main = [(t, k // REGION) for t, k in found if k & PROTECT and not k & left_out]
            if len({r for _, r in main if r}) > 1:  # the array tells which of them are the page's own
                texts.append(None)
                rest = [(t, (k // REGION or IN) if k & PROTECT and not k & left_out else OUT) for t, k in found]
            else:
                texts.append(" ".join(t for t, _ in main) if main else None)
                rest = [(t, OUT if main or k & (DROP | NAMED) else UNMARKED) for t, k in found if not k & PROTECT or k & left_out]
            rests.append([t for t, _ in rest])
            kepts.append([k for _, k in rest])
        n = b.num_rows
        yield arrow.batch(
            PARSED, chunk=np.full(n, chunk), row=np.arange(row, row + n), page_id=b.column(0), url=b.column(1), host=[host_of(u) for u in b.column(1).to_pylist()],
            text=texts, rest=rests, kept=kepts, tokens=[sum(len(t.split()) for t in r) for r in rests],
        )
        row += n


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` tokens, by prefix doubling; equal ranks share them all."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        step = min(width, depth - width)
        after = np.full(len(rank), -1, np.int64)
        after[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique((rank << 32) | (after + 1), return_inverse=True)[1].astype(np.int64)
        width += step
    return rank


class Index:
    """The suffix array of some pages' streams, which are concatenated, each ended by a token of its own. Suffixes that share their first
    ``run`` tokens stand together in it, as a group; where they come from distinct pages they are ``shared``."""

    def __init__(self, streams: list[list[str]], run: int = RUN):
        number: dict[str, int] = {}
        self.streams, self.run = streams, run
        self.sizes = np.array([len(s) for s in streams], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.page = np.repeat(np.arange(len(streams)), self.sizes + 1)
        tokens = np.empty(len(self.page), np.int64)
        for i, (s, at) in enumerate(zip(streams, self.bounds.tolist(), strict=False)):
            tokens[at : at + len(s)] = [number.setdefault(t, len(number)) for t in s]
            tokens[at + len(s)] = -1 - i
        rank = suffix_ranks(tokens, run)
        self.order = np.argsort(rank, kind="stable")  # the suffix array
        self.head = np.flatnonzero(np.diff(rank[self.order], prepend=-1))
        if len(self.head):
            by_page = self.page[self.order]
            self.shared = np.minimum.reduceat(by_page, self.head) != np.maximum.reduceat(by_page, self.head)
        else:
            self.shared = np.zeros(0, bool)

    def groups(self) -> tuple[np.ndarray, list[bytes]]:
        """The groups whose runs end within a page, and digests of their tokens."""
        at = self.order[self.head]
        page = self.page[at]
        place = at - self.bounds[page]
        own = np.flatnonzero(place + self.run <= self.sizes[page])
        found = zip(page[own].tolist(), place[own].tolist(), strict=True)
        return own, [hashlib.blake2b(" ".join(self.streams[p][i : i + self.run]).encode("utf-8", "replace"), digest_size=16).digest() for p, i in found]

    def covered(self) -> list[np.ndarray]:
        """Of each page's tokens: whether a shared run covers it."""
        at = self.order[np.repeat(self.shared, np.diff(np.append(self.head, len(self.order))))]
        marks = np.zeros(len(self.order) + self.run + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + self.run, -1)
        on = np.cumsum(marks)[: len(self.order)] > 0
        return [on[a : b - 1] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]


def covered(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """Of each page's tokens: whether a run of ``run`` tokens that another of the pages has too covers it."""
    return Index(streams, run).covered()


def unique_text(rest: list[str], kept: list[int], on: np.ndarray) -> str:
    """Unmarked blocks without shared runs. An article goes where shared runs cover all of it and not all of another article."""
    words = [block.split() for block in rest]
    ends = np.cumsum([len(w) for w in words]).tolist()
    spans = [on[e - len(w) : e] for e, w in zip(ends, words, strict=True)]
    own = {k for k, s in zip(kept, spans, strict=True) if k > 0 and not s.all()}
    out: list[str] = []
    for w, k, s in zip(words, kept, spans, strict=True):
        if k == UNMARKED:
            out += [x for x, c in zip(w, s, strict=True) if not c]
        elif k == IN or (k > 0 and (not own or k in own)):
            out += w
    return " ".join(out)


FOUND_DDL = "chunk long, row long, found string"
GROUPS_DDL = "host string, part long, group int, key binary, shared boolean"


def _opened(pages: pa.Table) -> tuple[pa.Table, Index]:
    """Pages in one order, whatever order they came in, and their array."""
    pages = pages.sort_by([("chunk", "ascending"), ("row", "ascending")])
    return pages, Index([[w for t in r for w in t.split()] for r in pages["rest"].to_pylist()])


def _texts(pages: pa.Table, index: Index) -> pa.Table:
    rest, kept, on = pages["rest"].to_pylist(), pages["kept"].to_pylist(), index.covered()
    wanted = [i for i, k in enumerate(kept) if any(k)]
    found = pa.array([unique_text(rest[i], kept[i], on[i]) for i in wanted], pa.string())
    return pages.select(["chunk", "row"]).take(pa.array(wanted, pa.int64())).append_column("found", found)


def _groups(pages: pa.Table) -> pa.Table:
    n, (_, index) = pages.num_rows, _opened(pages)
    own, keys = index.groups()
    host, part = (pa.repeat(pages[c][0], len(own)) if n else pages[c].combine_chunks() for c in ("host", "part"))
    return pa.table({"host": host, "part": part, "group": pa.array(own.astype(np.int32)), "key": pa.array(keys, pa.binary()), "shared": pa.array(index.shared[own])})


def _merged(pages: pa.Table, shared: pa.Table) -> pa.Table:
    """With the groups that are shared with other arrays of the host."""
    pages, index = _opened(pages)
    for x in shared["groups"].to_pylist():
        index.shared[x] = True
    return _texts(pages, index)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", host_tokens: int = HOST_TOKENS) -> DataFrame:
    """The main text of every page, blocks in page order joined by one space.

    Where markup names one article (an article element, a main element, or a name for its body), its blocks are
    the text, without what is marked in it as menu, comments, advert and so on; it is kept
    whole even if its passages occur on other pages, which have them as text too. Names do not drop an article element, nor what is around
    the only article; words of layout count as whole names only. Everything else of a page goes to the token stream
    of its host. There runs of RUN tokens that occur on distinct pages are boilerplate, and a page without a
    marked article keeps its unmarked blocks without them. A page on which markup names several articles, none
    within another, goes to the stream with them: those that shared runs cover from end to end are teasers or quotes of other pages
    and go, if another of the page's articles is its own; if none is (a copy of a page), all stay.

    A host of more than ``host_tokens`` tokens has several suffix arrays of about so many, over parts of its pages. They are merged by
    their groups: a run that the arrays of two parts have is on distinct pages. So the runs are the same at every size.

    Null and empty html have no text, html of any length is read whole, a null url or one without a host has the host "".
    Repeated rows are pages of their own, so pages that are copies of each other are boilerplate where no article is marked. There
    are no ties: a run is on distinct pages or not. What is no UTF-8 counts as U+FFFD. An empty table gives none. Only
    the three columns are read; the id is a long.

    Columns: page_id, url, text, n_chars.
    """
    src = arrow.narrowed(pages, page_id=F.col(id_col).cast("long"), url=F.col(url_col).cast("string"), html=arrow.raw(F.col(html_col)))
    parsed = scratch.keep(src.mapInArrow(_parse, PARSED_DDL), "pages")
    parts = F.ceil(F.col("n") / max(1, host_tokens)).cast("long")
    hosts = parsed.groupBy("host").agg(F.sum("tokens").alias("n")).filter("n > 0").select("host", parts.alias("parts"))
    dealt = parsed.select("chunk", "row", "host", "rest", "kept").join(hosts, "host").withColumn("part", F.pmod(F.xxhash64("chunk", "row"), "parts"))
    single = dealt.filter("parts = 1").groupBy("host").applyInArrow(lambda t: _texts(*_opened(t)), FOUND_DDL)
    found = single.unionByName(_several(dealt.filter("parts > 1").drop("parts")))
    marked = parsed.filter("text IS NOT NULL").select("page_id", "url", "text")
    other = parsed.filter("text IS NULL").select("chunk", "row", "page_id", "url").join(found, ["chunk", "row"], "left").select("page_id", "url", F.coalesce("found", F.lit("")).alias("text"))
    return marked.unionByName(other).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _several(pages: DataFrame) -> DataFrame:
    """The same for hosts of several arrays: their groups meet by what they begin with, and those that two arrays have, or one has on distinct pages, are shared."""
    groups = pages.groupBy("host", "part").applyInArrow(_groups, GROUPS_DDL)
    met = groups.groupBy("host", "key").agg(F.max("shared").alias("shared"), F.collect_list(F.struct("part", "group", "shared")).alias("x"))  # at most one of each part
    news = met.filter(F.col("shared") | (F.size("x") > 1)).select("host", F.explode("x").alias("x")).filter("not x.shared")
    news = news.groupBy("host", F.col("x.part").alias("part")).agg(F.collect_list("x.group").alias("groups"))  # at most a part's
    return pages.groupBy("host", "part").cogroup(news.groupBy("host", "part")).applyInArrow(_merged, FOUND_DDL)
