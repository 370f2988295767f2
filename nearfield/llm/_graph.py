"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``links(a, b)`` of long ids -> ``(id, component_id)`` for every id in a link; the component is its smallest id.

    Each step takes the minimum over a vertex's neighbours (combined on the map side) and joins it
    back to the edges, so a hub of any degree is a skewed join that can be split, never a group in
    one task. Edges are written to the scratch folder after each round. Loops, repeated links and
    links with nulls are ignored; an empty table gives an empty one.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(edges, f"{name}-0")
    seen, step = None, 0
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sums[0] == 0 or tuple(sums) == seen:
            break
        seen, step = tuple(sums), step + 1
        # large star: neighbours above u move to the smallest of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}-{step}-large")
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.save(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step}-large", f"{name}-{step - 1}")
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return ids.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
