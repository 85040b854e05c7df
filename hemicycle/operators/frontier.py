"""S1 + S2: the pages a crawl reaches from its start pages, by following links.

Semi-naive reachability: a round joins only the URLs found in the round before
with the links of stored pages, drops those known by an anti join, and writes the
new ones with their depth. The links are extracted once. A URL that every page
links to is reduced within each page and by partial aggregates before the shuffle.

Defined results: a URL counts without its fragment; a page stored several times
counts once, with all its links; starts are the stored pages chosen by a Column;
``follow`` decides on the resolved URL of a link (a null drops it). URLs that are
not stored are reported, as a crawl would fetch them next, and lead no further.
Pages without URL or html have no links; without starts the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.functions import text as X
from hemicycle.plans.ranking import saved


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def links(pages: DataFrame) -> DataFrame:
    """(src, url): the distinct resolved links of every page."""
    hrefs = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(X.LINK_PATTERN), 1))
    ex = pages.where("url is not null").select("url", F.explode(hrefs).alias("href"))
    target = without_fragment(X.url_join(F.col("url"), F.replace(F.col("href"), F.lit("&amp;"), F.lit("&"))))
    return ex.select(without_fragment(F.col("url")).alias("src"), target.alias("url"))


def reachable(pages: DataFrame, starts: Column, follow: Column | None = None, max_depth: int | None = None) -> DataFrame:
    """(url, depth, stored) of the start pages and all URLs their links lead to; ``follow`` is a Column over ``url``."""
    edges = links(pages)
    edges = saved(edges.where("url <> ''" if follow is None else follow).distinct())
    found = saved(pages.where(starts & F.col("url").isNotNull()).select(without_fragment(F.col("url")).alias("url")).distinct()
                  .withColumn("depth", F.lit(0).cast("long")))
    known, depth = found, 0
    while (max_depth is None or depth < max_depth) and not found.isEmpty():
        depth += 1
        found = saved(found.select(F.col("url").alias("src")).join(edges, "src").select("url").distinct()
                      .join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        known = known.unionByName(found)
    at_hand = pages.where("url is not null").select(without_fragment(F.col("url")).alias("url")).distinct().withColumn("stored", F.lit(True))
    return known.join(at_hand, "url", "left").select("url", "depth", F.coalesce("stored", F.lit(False)).alias("stored"))
