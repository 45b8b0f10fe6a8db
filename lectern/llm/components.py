"""Connected components of an undirected edge table by alternating large-star and small-star steps.

Every step is a join and an aggregation; no component is ever gathered in one place. Hubs meet their least neighbour
by a broadcast: their links stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hub_join


def _with_least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`links` (u, v) with m, the least of u and its neighbours; and (u, m) of each u."""
    least = cut(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")))
    return hub_join(links, least, ["u"]), least.drop("n")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of `edges` (columns a, b: long); component is the smallest id
    reachable. Loops, repeats and nulls in `edges` are ignored."""
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(
            _with_least(both)[0]
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        near, least = _with_least(large)
        small = (
            near
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        now = cut(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    )
