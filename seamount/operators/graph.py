"""Link graph: edges of pages, the crawler's link filter, and breadth-first depth from start pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamount.functions import text as T


#: What holds no links, whatever stands in it: comments, scripts and styles.
NO_LINKS = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])|\z)"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)"""
#: An a tag with an href, over the attributes before it; its value with its quotes, empty if there is none.
LINK = rf"""(?is)<a(?=[\s/])(?:[\s/"']*+(?!href(?![^\s=/>]))[^\s=>/"']++(?:\s*+=\s*+{_VALUE})?+)*+[\s/"']*+href(?![^\s=/>])(?:\s*+=\s*+({_VALUE}))?+"""


def links(pages: DataFrame) -> DataFrame:
    """page_id, src, href, url: each link of each page, as written and resolved."""
    found = F.explode(F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), NO_LINKS, " "), F.lit(LINK), F.lit(1)))
    rows = pages.select("page_id", F.col("url").alias("src"), found.alias("href"))
    return rows.withColumn("href", F.regexp_replace("href", r"""(?s)^(["'])(.*)\1$""", "$2")).withColumn("url", T.absolute_url("src", "href"))


def followed(href: Column, url: Column, prefix: str) -> Column:
    """Links under a prefix whose text has neither a scheme or namespace (``:``) nor a fragment (``#``)."""
    return url.startswith(prefix) & ~href.contains(":") & ~href.contains("#")


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = 1000) -> DataFrame:
    """url, depth, visit_count of what is reached from seeds (url) over edges (src, dst).

    Each level is a join of the last one with the edges less what was visited; a level is written to the shared folder of
    ``spark.checkpoint.dir`` before the next. max_pages: the search ends with the first page beyond so many; of the level in
    which that is, the pages that come first by url.
    """
    from seamount.sources.shared import keep

    edges = edges.select("src", "dst").where("src <> dst")
    frontier = keep(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "level")
    seen = frontier
    for depth in range(1, max_depth + 1):
        left = None if max_pages is None else max_pages + 1 - seen.count()
        if left is not None and left <= 0:
            break
        nxt = frontier.join(edges, frontier["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        fresh = nxt.join(seen, "url", "left_anti")
        frontier = keep((fresh if left is None else fresh.orderBy("url").limit(left)).withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    visits = seen.join(edges.distinct(), seen["url"] == edges["dst"], "left").groupBy(seen["url"], "depth").agg(F.count("src").alias("visit_count"))
    return visits.select("url", "depth", F.greatest("visit_count", F.lit(1)).alias("visit_count"))
