"""Following links: what is reached from a set of pages, each page once, at its least depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reached(start: DataFrame, links: DataFrame, depth: int = 2, page: str = "url") -> DataFrame:
    """(page, depth) of the pages within `depth` links (src, dst) of those in start, which have depth 0.

    A step joins the pages found last with the links and takes out what was seen before; pages met twice count once.
    """
    seen = front = start.select(page).distinct().withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        found = front.join(links, front[page] == links["src"]).select(F.col("dst").alias(page)).distinct()
        front = found.join(seen.select(page), page, "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(front)
    return seen
