"""Connected components and places in an order, for groups that must not be gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.sources.working import Keep


def connected_components(edges: DataFrame, keep: Keep) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b) join to another; a component is named by its least node.

    Every node follows the least of its neighbours and of what these follow,
    until nothing changes: each round is two combinable minima and joins, and
    rounds grow with the logarithm of the longest path.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    links = keep(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    own = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not links.isEmpty():
        near = links.join(own.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = own.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("to"))
        # What the old component of a node may join, all its nodes join; then one step up from there.
        roots = keep(hooked.groupBy(F.col("old").alias("root")).agg(F.min("to").alias("to")))
        above = roots.select(F.col("root").alias("to"), F.col("to").alias("top"))
        short = roots.join(above, "to", "left").select("root", F.coalesce("top", "to").alias("to"))
        new = keep(own.join(short, own["component"] == short["root"]).select("node", F.col("to").alias("component")))
        own = new
        if roots.where(F.col("to") != F.col("root")).isEmpty():
            break
    return own


def numbered_within(df: DataFrame, group: str, order: list[str], out: str, keep: Keep) -> DataFrame:
    """``df`` with ``out``: the place of each row in its group, from 0, by ``order`` (nulls first).

    Ranges of the order are numbered where they are, and only how many rows of a
    group each range has is added up, so one group may be in many tasks.
    """
    ranged = keep(df.repartitionByRange(group, *order).withColumn("range_", F.spark_partition_id()))
    before = Window.partitionBy("group_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(F.col(group).alias("group_"), "range_").agg(F.count(F.lit(1)).alias("n_"))
    starts = sizes.select("group_", F.col("range_").alias("at_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    within = Window.partitionBy("range_", group).orderBy(*order)
    joined = ranged.join(starts, ranged[group].eqNullSafe(starts["group_"]) & (F.col("range_") == F.col("at_")))
    return joined.withColumn(out, F.row_number().over(within) - 1 + F.col("start_")).drop("range_", "group_", "at_", "start_")
