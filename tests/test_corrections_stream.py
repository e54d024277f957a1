"""The stream of corrections equals the batch form for rows in time; late rows do nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemograph.operators import graph
from mnemograph.plans.views import corrections, raw_facts
from mnemograph.streaming.corrections_stream import with_validity_stream

SF = "/root/testdata/sf0.001"
COLS = ["id", "subject_id", "object_id", "valid_at"]


def written(df, path, parts, at):
    """``df`` as files in the order of time, one a part; a file source reads the oldest first."""
    import os

    rows = [tuple(r) for r in df.sort(at).collect()]
    size = -(-len(rows) // parts)
    for i in range(parts):
        df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
        for f in os.listdir(f"{path}/{i:03d}"):
            os.utime(f"{path}/{i:03d}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return path + "/*"


def run(spark, out, sink, cp):
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return {r["id"]: r["invalid_us"] for r in spark.read.schema("id string, valid_at timestamp, invalid_us long").parquet(sink).collect()}


def test_stream_equals_batch(spark, tmp_path):
    facts = raw_facts(spark, SF).select(COLS).where("object_id is not null")
    fixes = corrections(spark, SF).where("object_id is not null").select("subject_id", "object_id", "ts")
    f, c = written(facts, str(tmp_path / "f"), 3, "valid_at"), written(fixes, str(tmp_path / "c"), 3, "ts")
    read = lambda path, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(spark, with_validity_stream(read(f, facts), read(c, fixes), "2 days", "1 hour"), str(tmp_path / "sink"), str(tmp_path / "cp"))
    batch = graph.with_validity(facts, fixes).withColumn("near", F.col("invalid_at") <= F.col("valid_at") + F.expr("interval 2 days"))
    want = {r["id"]: (r["valid_at"], r["us"]) for r in batch.select("id", "valid_at", F.when(F.col("near"), F.unix_micros("invalid_at")).alias("us")).collect()}
    assert got and all(want[i][1] == us for i, us in got.items())
    # What is not given out is what is still open when both streams end.
    end = min(facts.agg(F.max("valid_at")).first()[0], fixes.agg(F.max("ts")).first()[0]) - timedelta(days=2, hours=1, minutes=1)
    assert {i for i, (at, _) in want.items() if at < end} <= set(got)
    assert any(us is not None for us in got.values()) and any(us is None for us in got.values())


def test_late_rows_and_restart(spark, tmp_path):
    t = datetime(2024, 1, 1)
    day = timedelta(days=1)
    f_schema, c_schema = "id string, subject_id string, object_id string, valid_at timestamp", "subject_id string, object_id string, ts timestamp"

    def step(facts, fixes):
        spark.createDataFrame(facts, f_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        spark.createDataFrame(fixes, c_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        out = with_validity_stream(spark.readStream.schema(f_schema).parquet(str(tmp_path / "f")), spark.readStream.schema(c_schema).parquet(str(tmp_path / "c")), "1 day", "1 hour")
        return run(spark, out, str(tmp_path / "sink"), str(tmp_path / "cp"))

    # The second correction is first in time; one at the same instant as its fact is not later.
    assert step([("a", "s", "o", t), ("b", "s", None, t), ("c", "s", "p", t)], [("s", "o", t + day / 2), ("s", "o", t + day / 4), ("s", "p", t)]) == {}
    # The query starts anew from its checkpoint, and time goes on: what was open is given out.
    got = step([("x", "z", "z", t + 9 * day)], [("z", "z", t + 9 * day)])
    micros = int((t + day / 4 - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert got == {"a": micros, "c": None}
    # A fact and a correction behind the watermark do nothing.
    assert step([("late", "s", "o", t), ("y", "z", "z", t + 20 * day)], [("z", "z", t + 20 * day), ("s", "o", t + day / 8)]) == {"a": micros, "c": None, "x": None}
