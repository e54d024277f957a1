"""Corrections by event time: two streams joined within a horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_validity_stream(facts: DataFrame, corrections: DataFrame, horizon: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(id, valid_at, invalid_us): each fact of a stream, once, with the first correction after it.

    ``facts`` is (id, subject_id, object_id, valid_at), ``corrections`` is
    (subject_id, object_id, ts); both may be streams. ``invalid_us`` (microseconds
    since 1970) is the first correction of the same subject and object that is
    later than ``valid_at`` by at most ``horizon``; null if there is none.

    A fact is given out once both watermarks have passed its horizon, so state
    holds what the horizon and ``late`` span and no more. Rows that come later
    than their stream's watermark are left out: a late fact is not given out, a
    late correction ends nothing. Rows with a null time, id or object are no part
    of the stream; facts given out equal those of ``graph.with_validity`` wherever
    its correction is within the horizon. Repeated facts are one.
    """
    own = facts.where("id is not null and object_id is not null and valid_at is not null").select("id", "subject_id", "object_id", "valid_at").withWatermark("valid_at", late)
    other = corrections.where("object_id is not null and ts is not null").select(F.col("subject_id").alias("s"), F.col("object_id").alias("o"), "ts").withWatermark("ts", late)
    within = (F.col("ts") > F.col("valid_at")) & (F.col("ts") <= F.col("valid_at") + F.expr(f"interval {horizon}"))
    joined = own.join(other, (F.col("subject_id") == F.col("s")) & (F.col("object_id") == F.col("o")) & within, "leftOuter")
    # One event time goes on from here: that of the fact.
    joined = joined.select("id", "valid_at", F.unix_micros("ts").alias("us"))
    return joined.groupBy("id", "valid_at").agg(F.min("us").alias("invalid_us"))
