"""Connected components by alternating large-star and small-star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.sources import drop_table, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns ``node`` and ``root`` (the smallest node reachable) for every node that has a link.

    Links with a null end and loops are ignored; repeated links and either direction are fine. Each
    round halves the depth of the forest, so rounds grow with the logarithm of the longest chain. All
    groupings are minima, which Spark combines before the shuffle, so a node with very many links is
    no hot spot. Nothing of the graph reaches the driver but a count and a checksum per round.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    )
    seen = _signature(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = materialize(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        mark = _signature(then)
        drop_table(now)
        now = then
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
