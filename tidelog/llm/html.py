"""HTML main text by differencing a page with its nearest neighbour by URL."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table, written
from .urls import host_of, path_of

#: Elements whose text is never content, and those that are page furniture.
SILENT = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object", "select", "button", "textarea"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"}
FURNITURE_NAMES = {"ad", "ads", "advert", "advertisement", "banner", "sidebar", "menu", "navbar", "nav", "footer", "header", "cookie", "cookies", "notice", "consent", "comments", "comment", "respond", "newsletter", "popup", "promo", "sponsored", "share", "social", "breadcrumb", "breadcrumbs", "related"}
MAIN = {"article", "main"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"} | FURNITURE
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Lines(HTMLParser):
    """Text lines of a page, one a block: (text, in main content, furniture).

    Open elements are kept with the places of each tag and counts of each kind, so
    a tag costs the same at any depth of nesting.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.count = {"silent": 0, "furniture": 0, "main": 0, "": 0}
        #: Places of main and furniture elements, which an inline end tag can't close.
        self.walls: list[int] = []
        self.now: list[str] = []
        self.lines: list[tuple[str, bool, bool]] = []

    def flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.lines.append((text, self.count["main"] > 0, self.count["furniture"] > 0))
        self.now = []

    def kind(self, tag, attrs) -> str:
        a = {k: (v or "").lower() for k, v in attrs}
        names = {*a.get("class", "").split(), a.get("id", "")}
        if tag in SILENT or "hidden" in a:
            return "silent"
        if tag == "header" and self.count["main"]:
            return ""  # an article's own headline
        if tag in FURNITURE or a.get("role") in FURNITURE_ROLES or names & FURNITURE_NAMES:
            return "furniture"
        return "main" if tag in MAIN or a.get("role") == "main" else ""

    def close_from(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.open) > place:
            tag, kind = self.open.pop()
            self.places[tag].pop()
            self.count[kind] -= 1
        while self.walls and self.walls[-1] >= place:
            self.walls.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag != "title" and self.places.get("head"):
                self.close_from(self.places["head"][0])  # </head> can be left out
        elif tag == "br":
            self.now.append(" ")
        if tag not in VOID:
            if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
                self.close_from(len(self.open) - 1)
            kind = self.kind(tag, attrs)
            if tag in MAIN | FURNITURE:
                self.walls.append(len(self.open))
            self.places.setdefault(tag, []).append(len(self.open))
            self.count[kind] += 1
            self.open.append((tag, kind))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        at = self.places.get(tag)
        if at and (tag in BLOCKS or not self.walls or self.walls[-1] < at[-1]):
            self.close_from(at[-1])

    def handle_data(self, data):
        if not self.count["silent"]:
            self.now.append(data)

    def parse_marked_section(self, i, report=1):
        """Sections such as <![x[ ]]> are comments up to the next > in HTML."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def lines_of(html: str | None) -> list[tuple[str, bool, bool]]:
    p = Lines()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.lines


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of a lie on a longest common subsequence with b: common ends
    first, then Hirschberg's division, whose memory is linear."""
    out = np.zeros(len(a), bool)

    def row(x, y):
        last = np.zeros(len(y) + 1, np.int32)
        for v in x:
            last[1:] = np.maximum.accumulate(np.maximum(last[1:], np.where(y == v, last[:-1] + 1, 0)))
        return last

    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out[i], i, k = True, i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            out[j - 1], j, m = True, j - 1, m - 1
        if i == j or k == m or not np.isin(a[i:j], b[k:m]).any():
            continue
        if j - i == 1:
            out[i] = True
            continue
        mid = (i + j) // 2
        left, right = row(a[i:mid], b[k:m]), row(a[mid:j][::-1], b[k:m][::-1])[::-1]
        cut = k + int((left + right).argmax())
        todo += [(i, mid, k, cut), (mid, j, cut, m)]
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one page is a copy of the other: nine tenths of their lines are shared."""
    return 10 * len(np.intersect1d(a, b)) >= 9 * max(len(np.unique(a)), len(np.unique(b)))


def aligned(rows: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, which of its lines are the site's own) of rows (host, row, lines' hashes)
    in URL order. A page is aligned with the last one before it that is no copy of it;
    the first ones of a host with the first after them that differs; a page alone on
    its host shares nothing. Row -1 is a page that another part answers for."""
    site = last = other = None
    wait: list[tuple[int, np.ndarray]] = []
    for host, row, h in rows:
        if host != site:
            yield from ((r, np.zeros(len(x), bool)) for r, x in wait)
            site, last, other, wait = host, None, None, []
        if last is not None and not alike(h, last):
            yield from ((r, shared(x, h)) for r, x in wait)
            other, wait = last, []
        if row != -1:
            if other is None:
                wait.append((row, h))
            else:
                yield row, shared(h, other)
        last = h
    yield from ((r, np.zeros(len(x), bool)) for r, x in wait)


def extract(pages: DataFrame) -> DataFrame:
    """Every row of pages: page_id, url, text, n_chars.

    Pages are sorted by host and URL path across partitions; each is aligned, by
    lines, with its nearest one that is no copy of it (see aligned()), and lines on
    the longest common subsequence are deleted as the site's own. Marks come before
    the alignment: lines inside an article or main element are content even where
    another page shares them, and lines inside navigation, headers, footers, asides,
    forms and the like never are. The alignment decides all other lines, so the texts
    of pages without such lines are not shuffled. Null html has no text; null urls
    are one host; repeated page_ids keep their own rows; other columns are ignored.
    """
    p = pages.select("page_id", "url", "html").withColumn("row", F.monotonically_increasing_id())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in rows_of(iter([y]), "html", 4 << 20)):
            text, state, hashes = [], [], []
            for html in b.column("html"):
                got = lines_of(html.as_py())
                # 1 content by its marks, 0 undecided, -1 never
                state.append([-1 if f else 1 if m else 0 for _, m, f in got])
                text.append([t for (t, _, _), s in zip(got, state[-1]) if s >= 0])
                hashes.append([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t, _, _ in got])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("page_id"), b.column("url"), pa.array([0 in s for s in state], pa.bool_()), pa.array(text, pa.list_(pa.string())), pa.array(state, pa.list_(pa.int8())), pa.array(hashes, pa.list_(pa.int64()))], ["row", "page_id", "url", "undecided", "lines", "state", "hashes"])

    kind = p.schema["page_id"].dataType.simpleString()
    parsed = written(p.mapInArrow(parse, f"row long, page_id {kind}, url string, undecided boolean, lines array<string>, state array<tinyint>, hashes array<long>"))
    narrow = parsed.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "undecided", "hashes")
    # Only hosts that have an undecided page need their pages in order.
    hosts = narrow.where("undecided").select(F.col("host").alias("of")).distinct()
    narrow = narrow.join(hosts, F.col("host") == F.col("of"), "left_semi").drop("undecided")
    # Written as sorted, so that what follows sees one set of partition borders.
    order = ["host", "path", "row"]
    sort = written(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    last = sort.groupBy("part").agg(F.max_by(F.struct("host", "hashes"), F.struct(*order)).alias("last"))
    # The part before may hold no rows of ours; ranks close such gaps. One row a part.
    ranks = [r[0] for r in sort.select("part").distinct().orderBy("part").collect()]
    chain = sort.sparkSession.createDataFrame(list(zip(ranks, ranks[1:])) or [(-1, -1)], "part int, next int")
    tails = chain.join(last, "part").select(F.col("next").alias("part"), F.col("last.host").alias("host"), F.lit("").alias("path"), F.lit(-1).cast("long").alias("row"), F.col("last.hashes").alias("hashes"))
    both = sort.select("part", "host", "path", "row", "hashes").unionByName(tails)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for part, host, row, h in zip(*(b.column(c).to_pylist() for c in ("part", "host", "row", "hashes"))):
                    yield (part, host), row, np.array(h, np.int64)

        found = aligned(rows())
        while got := list(itertools.islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int64()), pa.array([s.tolist() for _, s in got], pa.list_(pa.bool_()))], ["of", "shared"])

    # A tail sorts before its part's rows: row -1 comes first within the part.
    flags = both.repartition("part").sortWithinPartitions("part", (F.col("row") >= 0), "host", "path", "row").mapInArrow(align, "of long, shared array<boolean>")
    j = parsed.where("undecided").join(flags, F.col("row") == F.col("of"))
    lines = F.filter(F.arrays_zip(F.col("state").alias("s"), F.col("shared").alias("d")), lambda x: x["s"] >= 0)
    kept = F.filter(F.arrays_zip(F.col("lines").alias("t"), lines.alias("x")), lambda y: (y["x"]["s"] == 1) | ~y["x"]["d"])
    undecided = j.select("page_id", "url", F.array_join(F.transform(kept, lambda y: y["t"]), "\n").alias("text"))
    out = parsed.where("not undecided").select("page_id", "url", F.array_join("lines", "\n").alias("text")).unionByName(undecided)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
