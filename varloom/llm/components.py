"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm._common import written

#: A node with more than one in so many of all link ends is a hub; there are fewer hubs than this, so they are sent to all tasks.
MOST_HUBS = 10_000


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), of every node that has a link.

    Alternating large-star and small-star rounds, each two aggregations with map-side combine; the
    links become stars around the smallest nodes after a logarithmic number of rounds. The links of a hub stay
    where they are, its smallest neighbour is sent to them. Each round is
    written to the shared folder, which cuts the lineage. Only counts return to the driver.
    """
    e = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "links")
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        hub = F.col("n") * MOST_HUBS > 2 * e.count()
        hubs, others = (low.where(x).select("u", "m") for x in (hub, ~hub))
        near_hubs = both.join(F.broadcast(hubs), "u")
        rest = both.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(others, "u")
        large = near_hubs.unionByName(rest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        kept = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(kept, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = written(small.where("u != v").distinct(), "links")
        chained = new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        several = new.groupBy("u").count().where("count > 1")
        e = new
        if chained.isEmpty() and several.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
