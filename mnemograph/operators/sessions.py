"""Sessions that end where the host resets them: gaps and islands without one window over all rows.

Rows are sorted by ranges, so a range ends wherever rows fill it, within one
stream as well. Starts and places are counted within ranges; a row for each
range carries what the ranges before it had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.sources.working import Keep


def by_resets(turns: DataFrame, order: list[str], reset: Column, keep: Keep, scope: list[str] | None = None) -> DataFrame:
    """``turns`` with ``session``, from 1 through all rows, and ``place`` in it, from 1.

    A session begins with each row that ``reset`` holds for, with the first row of
    each value of the ``scope`` columns, and with the first row of all. Rows come
    in the order of ``scope`` and ``order``, nulls first; a null scope is one of its
    own. Rows that are equal in both take any order among themselves. A null ``reset``
    is none; without rows the result is empty. Columns of ``turns`` named ``session``
    or ``place`` are replaced.
    """
    within = F.struct(*scope) if scope else F.struct(F.lit(0).alias("all"))
    kept = [c for c in turns.columns if c not in ("session", "place")]
    rows = turns.select(F.struct(*kept).alias("turn"), within.alias("scope"), F.struct(*order).alias("at"), F.coalesce(reset, F.lit(False)).alias("reset"))
    rows = keep(rows.repartitionByRange("scope", "at").sortWithinPartitions("scope", "at").withColumn("row", F.monotonically_increasing_id()))
    own = Window.partitionBy("part").orderBy("row")
    rows = rows.withColumn("part", F.shiftright("row", 33)).withColumn("before", F.lag("scope").over(own))
    rows = rows.withColumn("start", F.col("reset") | (F.col("before").isNotNull() & (F.col("before") != F.col("scope"))))
    starts = _carried(rows)
    rows = rows.join(F.broadcast(starts), "part").withColumn("start", F.col("start") | (F.col("opens") & (F.col("row") == F.col("first"))))
    nth = F.col("row") - F.col("first") + F.col("n_before")
    rows = rows.withColumn("nth", nth).withColumn("session", F.col("sessions_before") + F.count_if("start").over(own))
    began = F.coalesce(F.max(F.when(F.col("start"), F.col("nth"))).over(own), F.col("began_before"))
    return rows.select("turn.*", "session", (F.col("nth") - began + 1).alias("place"))


def _carried(rows: DataFrame) -> DataFrame:
    """A row for each range: whether its first row begins a session, and what the ranges before it hold. As many rows as ranges."""
    each = rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("row").alias("first"),
        F.min_by("scope", "row").alias("opening"),
        F.max_by("scope", "row").alias("closing"),
        F.min_by("reset", "row").alias("reset"),
        F.count_if("start").alias("starts"),
        F.max(F.when(F.col("start"), F.col("row"))).alias("last"),
    )
    by_part = Window.orderBy("part")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    closed = F.lag("closing").over(by_part)
    each = each.withColumn("opens", ~F.col("reset") & (closed.isNull() | (closed != F.col("opening"))))
    each = each.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    began = F.coalesce("last", F.when(F.col("opens"), F.col("first"))) - F.col("first") + F.col("n_before")
    each = each.withColumn("began", began)
    return each.select(
        "part",
        "first",
        "opens",
        "n_before",
        F.coalesce(F.sum(F.col("starts") + F.col("opens").cast("long")).over(earlier), F.lit(0)).alias("sessions_before"),
        F.max("began").over(earlier).alias("began_before"),
    )
