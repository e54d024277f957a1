"""Working tables: frames that are written under the shared folder and read again, so that they are computed once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Keep = Callable[[DataFrame], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="mnemograph-")


def keeper(spark: SparkSession) -> Keep:
    """A function that writes a frame to a folder of this call and returns what was written."""
    root, count = f"{shared_folder(spark)}/mnemograph-{uuid.uuid4().hex}", [0]

    def keep(df: DataFrame) -> DataFrame:
        count[0] += 1
        path = f"{root}/{count[0]:03d}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
