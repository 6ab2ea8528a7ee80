"""Main text of pages by a site style tree.

The pages of a host are merged into one tree: elements with the same path of tags, classes and ids
fall together.  For every element of the tree two distributions over the host's different pages are
kept, which presentation (sequence of children) it has and which text it holds.  Their entropy,
relative to the most it could be, is the importance of the element: a menu that looks and reads the
same everywhere has 0, an article whose pages all differ has 1.  A branch of a page is removed if
no element in it reaches the threshold.

Entropy cannot see a menu of random links, and a site of two pages says little, so what an element
declares itself to be is a prior that wins over the counts: menus, footers, asides, forms, adverts,
notices and comments have importance 0, running text inside an article has 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.llm.dom import CONTENT_TAGS, Page, read_page
from basketloom.runtime import Scratch

THRESHOLD = 0.1
# fewer different pages of a host with an element say nothing about it
LEAST_PAGES = 4
# low-importance elements that are sent to every executor; more are joined by host
SENT_ELEMENTS = 500_000

FEATURES = "host string, page long, element long, style long, content long"
EXTRACTED = "page_id long, url string, text string, n_chars long"


def host_of(url: str | None) -> str:
    """The part between ``//`` and the next ``/``, lower-case; empty where there is none."""
    rest = (url or "").partition("//")[2]
    for end in "/?#":
        rest = rest.partition(end)[0]
    return rest.lower()


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def kept_by_role(page: Page) -> list[bool]:
    """Elements that can hold main text: none declared noise; only the article where there is one."""
    has_main = any(
        page.in_main[node] and not page.declared_noise[node] for node, _ in page.blocks
    )
    return [
        not noise and (main or not has_main)
        for noise, main in zip(page.declared_noise, page.in_main, strict=True)
    ]


def style_rows(host: str, html: str) -> Iterator[tuple]:
    """Per element path of a page: hashes of its presentation and of its own text."""
    page = read_page(html)
    styles: dict[int, list] = {}
    texts: dict[int, list[str]] = {}
    for key, children in zip(page.key, page.children, strict=True):
        styles.setdefault(key, []).append(children)
    for node, text in page.blocks:
        texts.setdefault(page.key[node], []).append(text)
    same = _hash(html)
    for key, style in styles.items():
        yield host, same, key, _hash(repr(style)), _hash("\n".join(texts.get(key, ())))


def main_text(html: str, low: frozenset[int]) -> str:
    """The text of a page without the branches that are declared noise or wholly of low importance."""
    page = read_page(html)
    allowed = kept_by_role(page)
    n = len(page.tag)
    important = [False] * n
    for node in range(n - 1, -1, -1):
        sure = page.in_main[node] and page.tag[node] in CONTENT_TAGS
        if allowed[node] and (sure or page.key[node] not in low):
            important[node] = True
        if important[node] and node:
            important[page.parent[node]] = True
    # a block goes if any element around it heads an unimportant branch
    alive = [False] * n
    for node in range(n):
        above = page.parent[node]
        alive[node] = important[node] and (node == 0 or alive[above])
    return "\n".join(text for node, text in page.blocks if alive[node] and allowed[node])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, element, n_pages, importance over all pages of each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for url, html in zip(*(batch.column(c).to_pylist() for c in ("url", "html"))):
                rows += style_rows(host_of(url), html or "")
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, [pa.string()] + [pa.int64()] * 4)],
                names=["host", "page", "element", "style", "content"],
            )

    # copies of a page count once
    seen = pages.select("url", "html").mapInArrow(run, FEATURES).distinct()
    entropy = None
    for feature in ("style", "content"):
        share = seen.groupBy("host", "element", feature).agg(F.count("*").alias("n"))
        part = share.select(
            "host",
            "element",
            F.when(F.lit(feature) == "style", F.col("n")).otherwise(0).alias("pages"),
            (F.col("n") * F.log("n")).alias(f"{feature}_term"),
        )
        entropy = part if entropy is None else entropy.unionByName(part, allowMissingColumns=True)
    summed = entropy.groupBy("host", "element").agg(
        F.sum("pages").alias("n_pages"),
        F.sum("style_term").alias("s"),
        F.sum("content_term").alias("c"),
    )
    most = F.log("n_pages")
    # H = log m - sum(n log n) / m, relative to log m
    relative = F.when(
        F.col("n_pages") > 1, (most - F.least("s", "c") / F.col("n_pages")) / most
    ).otherwise(1.0)
    return summed.select("host", "element", "n_pages", relative.alias("importance"))


def extract_main_text(
    pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    ``pages``: page_id, url, html; other columns are ignored.  Null or empty html gives an empty
    text, a null url an empty host of its own.  Blocks are joined by one line end, white space
    inside a block is one space, a ``br`` is white space.  Repeated pages are answered row by row,
    but count once in the tree.  No pages give no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "style-tree")
    low = scratch.keep(
        style_tree(pages)
        .where((F.col("n_pages") >= least_pages) & (F.col("importance") < threshold))
        .select("host", "element")
    )
    rows = pages.select("page_id", "url", "html")
    if low.count() <= SENT_ELEMENTS:
        by_host: dict[str, set[int]] = {}
        for r in low.collect():
            by_host.setdefault(r["host"], set()).add(r["element"])
        sent = spark.sparkContext.broadcast({h: frozenset(e) for h, e in by_host.items()})
        return rows.mapInArrow(_extractor(lambda: sent.value), EXTRACTED)
    lists = low.groupBy("host").agg(F.collect_set("element").alias("low"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"//([^/?#]*)", 1))
    joined = rows.withColumn("host", host).join(lists, "host", "left")
    return joined.mapInArrow(_extractor(None), EXTRACTED)


def _extractor(by_host):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing: frozenset[int] = frozenset()
        for batch in batches:
            urls, pages = (batch.column(c).to_pylist() for c in ("url", "html"))
            if by_host is None:
                low = [frozenset(x or ()) for x in batch.column("low").to_pylist()]
            else:
                sent = by_host()
                low = [sent.get(host_of(u), nothing) for u in urls]
            texts = [main_text(h or "", e) for h, e in zip(pages, low, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run
