"""Main text of web pages, by differencing each page with the nearest URL of its host.

A page is read into lines, one for each block. Pages of a host are put in the order
of their URL paths, each is paired with the nearest of its neighbours there, and the
lines of both are aligned by their longest common subsequence: lines they share are
the site's, not the page's, and go.

Differencing line by line can't give the article where a site's menus, adverts and
footers change with each page, and it takes text from pages whose articles are copies.
So markup says first what may be text at all, and in which units: lines in marked parts
(menus, headers, footers, sidebars, notices, adverts, forms, comments) are none; a page
that declares articles has each of them as a unit; any other page has each of its lines
as one. Then every page is differenced, and units of which all lines are shared go:
site lines of pages without a declaration, teasers and boxes that a site declares as
articles on page after page. The longest declared article of a page always stays, whole.

Order, pairs and differences are made on narrow rows of ids and hashes of lines. Only
texts of pages that lose a unit move.

Defined cases: null html is empty and gives an empty text; a page without host, or
the only one of its host, has nothing to be compared with and keeps its open lines;
a null URL has no host; rows that repeat a page_id, or a URL, are pages of their own;
a neighbour that shares more than COPY of the page's open lines is a copy of it and
takes nothing, and neither does one that shares the longest declared article; lines of
declared articles are not the site's, so pages without a declaration lose nothing to them;
markup that is not closed ends with the page; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import row_numbers
from .common import cut, joined_by_id

#: A neighbour that shares more of a page's open lines than this is a copy of the page.
COPY = 0.8
#: Neighbours tried to each side.
REACH = 2

# Elements and words by which HTML pages mark their parts.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "select", "object", "math", "canvas", "audio", "video")
MARKED = frozenset("nav footer aside form menu dialog button search head".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKED_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay
    newsletter subscribe subscription sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar
    comment comments disqus respond replies reply related recommended share sharing social login signin signup search skip""".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end is often left out, and marked ones that a page may forget to close.
SHORT, UNCLOSED = frozenset("p li dt dd option".split()), frozenset("nav header head menu form".split())
#: Classes and ids that declare the article where no article or main element does.
DECLARING = frozenset("article-body article-content article-text articlebody entry-content post-content post-body story-body main-content page-content article_body post_content".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*[^>]*>", re.I) for name in RAW}
_WORDS = re.compile(r"[^a-z0-9]+")

#: What a line lies in.
OPEN, ARTICLE, MAIN, PART = 0, 1, 2, 3


def _marks(name: str, attributes: str, in_article: bool) -> int:
    """What an element's own markup says of the lines in it: OPEN if nothing."""
    if name in MARKED or (name == "header" and not in_article):
        return PART
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes or "hidden" in attributes else {}
    role = found.get("role", "").lower()
    if "hidden" in found or role in MARKED_ROLES or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return PART
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    whole = set(names.split())
    if not whole.isdisjoint(DECLARING) or found.get("itemprop", "").lower() == "articlebody":
        return MAIN
    said = " ".join(x for x in whole if not x.startswith(("has-", "with-", "no-", "is-")))
    if name not in ("html", "body") and said and (not MARKED_WORDS.isdisjoint(_WORDS.split(said)) or ("header" in whole and not in_article)):
        return PART
    if name == "article":
        return ARTICLE
    return MAIN if name == "main" or role == "main" else OPEN


def read_lines(page: str, declared: list[int] | None = None) -> tuple[list[str], list[int], bool, bool]:
    """The page's lines, what each lies in, and whether an article and whether a main part is declared; into ``declared`` the number of the declared part that each lies in."""
    lines: list[str] = []
    kinds: list[int] = []
    parts = 0
    run: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open elements, what their lines lie in, and what their own markup says
    now, at, end = OPEN, 0, len(page)
    article = main = False

    def close_line() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                lines.append(text)
                kinds.append(now)
                if declared is not None:
                    declared.append(parts)

    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            run.append(entities.unescape(page[at:]))
            break
        if token.start() > at:
            run.append(entities.unescape(page[at : token.start()]))
        at = token.end()
        closing, name, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])  # the latter where a quote is not closed
        if name is None:  # a comment or a declaration
            continue
        name = name.lower()
        if closing:
            if name in BLOCKS:
                close_line()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    now = stack[-1][1] if stack else OPEN
                    break
            continue
        if name in _RAW_END:
            if name == "title":
                close_line()
            if not attributes.rstrip().endswith("/"):
                done = _RAW_END[name].search(page, at)
                at = done.end() if done else end
            continue
        if name in BLOCKS:
            close_line()
        if name in VOID:
            continue
        own = _marks(name, attributes, now == ARTICLE)
        if name == "article" and own == ARTICLE and now == PART and all(x[0] in UNCLOSED for x in stack if x[2] == PART):
            stack = [x for x in stack if x[1] != PART]  # a menu or header that is not closed ends where the article begins
            now = stack[-1][1] if stack else OPEN
        inside = PART if PART in (own, now) else ARTICLE if ARTICLE in (own, now) else MAIN if MAIN in (own, now) else OPEN
        if inside != now:
            close_line()
            parts += inside in (ARTICLE, MAIN) and now in (OPEN, MAIN)
        if inside != now or (name in BLOCKS and name not in SHORT):
            stack.append((name, inside, own))
            now = inside
        article, main = article or inside == ARTICLE, main or inside == MAIN
    close_line()
    return lines, kinds, article, main


def units_of(page: str) -> tuple[list[str], list[str], list[int], bool]:
    """The page's units of text; its lines that are in no marked part, and the unit of each, -1 if none; whether it declares its units."""
    numbers: list[int] = []
    lines, kinds, article, main = read_lines(page, numbers)
    wanted = ARTICLE if article else MAIN if main else OPEN
    rows = [(line, kind == wanted, number) for line, kind, number in zip(lines, kinds, numbers, strict=True) if kind != PART]
    place = {x: i for i, x in enumerate(dict.fromkeys(i if wanted == OPEN else number for i, (_, own, number) in enumerate(rows) if own))}
    at = [place[i if wanted == OPEN else number] if own else -1 for i, (_, own, number) in enumerate(rows)]
    texts: list[list[str]] = [[] for _ in place]
    for (line, _, _), i in zip(rows, at, strict=True):
        if i >= 0:
            texts[i].append(line)
    return [" ".join(x) for x in texts], [line for line, _, _ in rows], at, wanted != OPEN


def settled(page: str) -> tuple[str, list[str] | None, list[str]]:
    """What markup alone says, for tests of it: the text, the open lines of a page that declares no article, and the lines outside a declared one."""
    units, lines, at, declared = units_of(page)
    return " ".join(units), None if declared else units, [line for line, i in zip(lines, at, strict=True) if i < 0] if declared else []


def shared(mine: list[int], other: list[int]) -> list[int]:
    """Places of ``mine`` that lie on a longest common subsequence with ``other``."""
    a, b, found = mine, other, []
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    found = [*range(head), *range(len(a) - tail, len(a))]
    inner, rest = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(inner) & set(rest)  # lines of one page alone are on no common subsequence
    at = [i for i, x in enumerate(inner) if x in both]
    x, y = np.array([inner[i] for i in at], dtype=np.int64), np.array([v for v in rest if v in both], dtype=np.int64)
    return sorted([*found, *(head + at[i] for i in _common(x, y))])


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of x with each beginning of y."""
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for v in x:
        best = row.copy()
        best[1:] = np.maximum(best[1:], np.where(y == v, row[:-1] + 1, 0))
        row = np.maximum.accumulate(best)
    return row


def _common(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of x on a longest common subsequence with y, by halves: memory stays in proportion to the lines."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        return [0] if (y == x[0]).any() else []
    half = len(x) // 2
    split = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
    return [*_common(x[:half], y[:split]), *(half + i for i in _common(x[half:], y[split:]))]


def _hash(lines: list[str]) -> list[int]:
    return [int.from_bytes(xxhash.xxh3_64_digest(x.encode("utf-8", "surrogatepass")), "little", signed=True) for x in lines]


_READ = "page_id long, url string, units array<string>, hashes array<bigint>, unit_of array<int>, longest int, declared boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("units", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64())), ("unit_of", pa.list_(pa.int32())), ("longest", pa.int32()), ("declared", pa.bool_())]
    )
    for batch in batches:
        found = [units_of(x or "") for x in batch.column("html").to_pylist()]
        longest = [max(range(len(x[0])), key=lambda i: len(x[0][i])) if x[0] and x[3] else -1 for x in found]
        columns = [[x[0] for x in found], [_hash(x[1]) for x in found], [x[2] for x in found], longest, [x[3] for x in found]]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), *columns], schema=schema)


def units_shared(mine: list[int], unit_of: list[int], longest: int, declared: bool, others: list[dict]) -> tuple[list[int], int]:
    """Units of a page that a neighbour shares whole, and their number of lines. ``others``: hashes, unit_of and declared of its neighbours, the nearest first."""
    left = Counter(i for i in unit_of if i >= 0)
    for other in others:
        lines = other["hashes"]
        if other["declared"] and not declared:
            lines = [h for h, i in zip(lines, other["unit_of"], strict=True) if i < 0]
        found = Counter(unit_of[i] for i in shared(mine, lines) if unit_of[i] >= 0)
        whole = [i for i, n in found.items() if n == left[i]]
        if longest in whole or (not declared and found.total() > COPY * left.total()):
            continue  # a copy of the page
        return sorted(whole), sum(left[i] for i in whole)
    return [], 0


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units that go from each page, and their number of lines."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("hashes", "unit_of", "longest", "declared", "others")), strict=True)
        found = [units_shared(*row) for row in rows]
        gone, n = pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.int64())
        yield pa.record_batch([batch.column("row"), gone, n], ["row", "gone", "n_shared"])


def place_of(url: str = "url") -> tuple:
    """Host and path of a URL, without scheme, query and fragment; null host if there is none."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(host != "", host).alias("host"), path.alias("path")


def _nearness(a, b):
    """Leading parts of two paths that are equal, then leading characters."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.eqNullSafe(v) & u.isNotNull()), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s.n + F.when(s.on & e, 1).otherwise(0)).alias("n"), (s.on & e).alias("on"))).n
    return F.struct(same(x, y).alias("parts"), same(F.split(a, ""), F.split(b, "")).alias("letters"))


def neighbours(pages: DataFrame) -> DataFrame:
    """row, other, near: for each row those before and after it in the order of host and path, REACH to either side. ``pages``: row, host, path."""
    placed = cut(row_numbers(pages.where(F.col("host").isNotNull()), [F.col("host"), F.col("path"), F.col("row")], "at"), "page-order").df
    step = F.explode(F.array(*[F.lit(x) for d in range(1, REACH + 1) for x in (-d, d)]))
    asking = placed.withColumn("step", step).withColumn("want", F.col("at") + F.col("step"))
    other = placed.select(F.col("at").alias("want"), F.col("row").alias("other"), F.col("host").alias("host2"), F.col("path").alias("path2"))
    met = asking.join(other, "want").where("host = host2")
    return met.select("row", "other", F.struct(_nearness(F.col("path"), F.col("path2")).alias("near"), (-F.abs("step")).alias("close"), (-F.col("step")).alias("before")).alias("near"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that the difference has deleted)."""
    read = cut(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_read, _READ).withColumn("row", F.monotonically_increasing_id()), "pages").df
    pairs = neighbours(read.select("row", *place_of()))
    lines = ("hashes", "unit_of", "declared")
    met = pairs.join(read.select(F.col("row").alias("other"), F.struct(*lines).alias("lines")), "other")
    others = met.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("near", "lines")), lambda a, b: F.when(a.near > b.near, -1).when(a.near < b.near, 1).otherwise(0)), lambda x: x.lines).alias("others"))
    differenced = read.select("row", *lines, "longest").join(others, "row").mapInArrow(_differenced, "row long, gone array<int>, n_shared long")
    gone = cut(differenced.where("n_shared > 0"), "gone-units").df
    ids = gone.select(F.col("row").alias("doc_id"))
    texts = read.select("page_id", "url", "units", "row")
    stay = joined_by_id(texts, ids, "row", "left_anti").select("page_id", "url", "units", F.lit(0).cast("long").alias("n_shared"))
    left = F.filter(F.transform("units", lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    lose = joined_by_id(texts, ids, "row", "left_semi").join(gone, "row").select("page_id", "url", left.alias("units"), "n_shared")
    whole = stay.unionByName(lose).withColumn("text", F.array_join(F.filter("units", lambda x: x != ""), " "))
    return whole.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")
