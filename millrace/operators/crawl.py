"""Breadth-first crawl over a table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import url as U


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst: normalised links of each page to pages of its host, each once."""
    raw = pages.select(U.normalize_url(F.col(url)).alias("src"), F.explode(F.array_distinct(U.links(F.col(html)))).alias("link"))
    found = raw.select("src", U.normalize_url(U.resolve(F.col("link"), F.col("src"))).alias("dst"))
    return found.where(U.follows(F.col("dst"), F.col("src"))).distinct()


def crawl(pages: DataFrame, start: str, most_pages: int = 50, url: str = "url", html: str = "html") -> DataFrame:
    """url, depth of pages reached from ``start``, at most ``most_pages`` by depth, then address.

    A level is one join of the frontier, which the page limit bounds, with the links.
    """
    edges = page_links(pages, url, html)
    first = pages.select(U.normalize_url(F.col(url)).alias("u")).distinct()
    frontier = [r.u for r in first.where(F.col("u") == U.normalize_url(F.lit(start))).collect()]
    seen = {u: 0 for u in frontier}
    depth = 0
    while frontier and len(seen) < most_pages:
        depth += 1
        step = edges.where(F.col("src").isin(frontier)).select(F.col("dst").alias("u")).distinct().join(first, "u", "left_semi")
        new = [r.u for r in step.where(~F.col("u").isin(list(seen))).orderBy("u").limit(most_pages - len(seen)).collect()]
        seen |= {u: depth for u in new}
        frontier = new
    return pages.sparkSession.createDataFrame(sorted(seen.items(), key=lambda x: (x[1], x[0])), "url string, depth int")
