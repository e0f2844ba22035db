"""Main text of pages by wrapper induction.

Per host the most frequent page shape is the wrapper's reference. Every page of the host
is aligned with it by simple tree matching, and per node of the reference all texts that
fill it are counted, equal pages once. A text that hardly a page lacks belongs to the
template, also beside varying ones of equal siblings; a slot that varies may be content.
The second pass aligns each page again and takes the varying texts of the article.

Shapes and hashes, not pages, are shuffled, with partial sums before every exchange, so
one large host is many partial rows and never a group. The templates are broadcast if
the planner finds their table small, else joined, and a hot host may be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import dom
from tidewire.llm.words import without
from tidewire.session import Scratch

#: A text is template if it fills a node on this share of the different pages that fill
#: it, two at least. On fewer than SURE_PAGES that are all of them, and then a page whose
#: text would mostly go keeps it: the pages may be copies of one story.
SAME, LEAST_PAGES, SURE_PAGES = 0.9, 2, 10
RESULT = ["text", "n_chars"]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for html in batch.column("_html").to_pylist():
            page = dom.parse(html or "")
            shape, number = dom.shape(page)
            found = dom.slots(page, number)
            whole = xxhash.xxh3_64_intdigest(html or "") - (1 << 63)
            rows.append((whole, shape, [n for n, _ in found], [t for _, t in found]))
        types = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("_host"), *columns], ["_host", "page", "shape", "nodes", "texts"])


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node of the reference, text) of every slot that aligns; once more without text."""
    for batch in batches:
        hosts, nodes, texts = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("_host", "reference", "shape", "nodes", "texts")]
        for host, reference, shape, own, filled in zip(*columns, strict=True):
            to = dom.align(reference, shape)
            found = [(to[n], t) for n, t in zip(own, filled, strict=True) if to[n] >= 0]
            found += [(n, None) for n in {n for n, _ in found}]
            hosts += [host] * len(found)
            nodes += [n for n, _ in found]
            texts += [t for _, t in found]
        types = (pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip((hosts, nodes, texts), types, strict=True)], ["_host", "node", "text"]
        )


def wrappers(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(_host, _reference, _constant): one row per host; ``pages`` has _host and _html."""
    shapes = scratch.keep(
        pages.mapInArrow(_shapes, "_host string, page long, shape string, nodes array<int>, texts array<long>"), "shapes"
    )
    counts = shapes.groupBy("_host", "shape").agg(F.count("*").alias("n"))
    best = counts.groupBy("_host").agg(F.max(F.struct("n", "shape")).alias("best"))
    reference = scratch.keep(best.select("_host", F.col("best.shape").alias("reference")), "reference")
    once = shapes.groupBy("_host", "page").agg(F.min(F.struct("shape", "nodes", "texts")).alias("x"))
    aligned = once.select("_host", "x.*").join(reference, "_host")
    filled = aligned.mapInArrow(_fill, "_host string, node int, text long")
    same = filled.groupBy("_host", "node", "text").agg(F.count("*").alias("n"))
    same = scratch.keep(same, "same")
    pages_of = same.where("text is null").select("_host", "node", F.col("n").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    constant = same.where("text is not null").join(pages_of, ["_host", "node"]).where(F.col("n") >= SAME * F.col("pages"))
    # hardly more than the texts of one page
    listed = constant.groupBy("_host").agg(F.collect_list(F.struct("node", "text", "pages")).alias("constant"))
    found = reference.join(listed, "_host", "left")
    kept = scratch.keep(
        found.select("_host", F.col("reference").alias("_reference"), F.col("constant").alias("_constant")), "wrappers"
    )
    scratch.drop("shapes", "reference", "same")
    return kept


def extract(
    spark: SparkSession, pages: DataFrame, html: str = "html", url: str = "url"
) -> DataFrame:
    """Every row with ``text`` and ``n_chars``; ``html`` itself does not return.

    White space inside a block is one space; blocks are in page order. Null or empty
    pages, and pages without an article, have an empty text. Rows without a host, null
    urls included, share one wrapper. Copies of a row get equal results. Input columns
    named as a result give way to it.
    """
    scratch = Scratch(spark, "pages")
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    kept = [c for c in without(pages, RESULT).columns if c != html]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("_host"), F.col(f"`{html}`").alias("_html"))
    found = wrappers(scratch, rows.select("_host", "_html"))
    result = T.StructType([rows.schema[c] for c in kept]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            columns = [batch.column(c).to_pylist() for c in ("_html", "_reference", "_constant")]
            for source, reference, constant in zip(*columns, strict=True):
                page = dom.parse(source or "")
                shape, number = dom.shape(page)
                template, sure = set(), True
                if constant:
                    named: dict[int, list] = {}
                    for x in constant:
                        named.setdefault(x["node"], []).append(x)
                    to = dom.align(reference, shape)
                    template = {(j, x["text"]) for j, i in enumerate(to) for x in named.get(i, ())}
                    sure = all(x["pages"] >= SURE_PAGES for x in constant)
                texts.append(dom.article(page, number, template, sure))
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in result.fields])

    joined = rows.join(found, "_host", "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], "_html", "_reference", "_constant").mapInArrow(run, result)
