"""What if unknown clusters went to other categories: each route is a mapping of families, measured over all clusters at once.

Clusters are counted by category, family and severity first; routes meet those counts, so that their number costs no pass.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell of a grid is large from so many clusters, and how many a proportional sample takes.
LARGE_CELL, PROPORTIONAL = 10, 300

Routes = Mapping[str, Mapping[str, str | None]]


def _target(mapping: Mapping[str, str | None]) -> Column:
    """The category of a cluster under a route; null if the route leaves its family out."""
    unknown = F.coalesce(F.col("category") == "unknown", F.lit(False))
    out = F.when(~unknown, F.col("category"))
    for family, target in mapping.items():
        out = out.when(F.col("family") == family, F.lit(target).cast("string"))
    return out.otherwise(F.col("category"))


def grid(clusters: DataFrame, routes: Routes) -> DataFrame:
    """route, category, severity, clusters. Clusters without a category are in no route."""
    counted = clusters.groupBy("category", "family", "severity").agg(F.count("*").alias("n"))
    each = F.array(*(F.struct(F.lit(name).alias("route"), _target(mapping).alias("category")) for name, mapping in routes.items()))
    routed = counted.select(F.inline(each), "severity", "n").filter("category is not null")
    return routed.groupBy("route", "category", "severity").agg(F.sum("n").alias("clusters"))


def summary(clusters: DataFrame, routes: Routes, tabled: Collection[str]) -> DataFrame:
    """For each route that keeps a cluster: clusters, unknown ones and their share, those in a category with a table (new
    categories count as tabled), the same of critical and high ones, cells of the grid, large cells, unknown ones in a
    proportional sample, and the new categories."""
    c, n = F.col, F.sum("clusters")
    severe = c("severity").isin("critical", "high")
    expressible = c("category") != "unknown"
    new = expressible & ~c("category").isin(*tabled)
    over = lambda test: F.coalesce(F.sum(F.when(test, c("clusters"))), F.lit(0))
    out = grid(clusters, routes).groupBy("route").agg(
        n.alias("clusters"), over(c("category") == "unknown").alias("unknown"), over(expressible).alias("expressible"), over(severe).alias("severe"), over(severe & expressible).alias("severe_expressible"),
        F.count("*").alias("cells"), F.count_if(c("clusters") >= LARGE_CELL).alias("large_cells"), F.array_join(F.array_sort(F.collect_set(F.when(new, c("category")))), ",").alias("new_categories"),
    )
    return out.withColumns({"unknown_share": F.round(100.0 * c("unknown") / c("clusters"), 1), "proportional_unknown": F.bround(float(PROPORTIONAL) * c("unknown") / c("clusters"), 0).cast("long")})
