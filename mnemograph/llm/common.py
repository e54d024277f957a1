"""Shared tools of the training-data operators.

* :class:`Workspace` cuts lineage: a frame is written as Parquet under the
  folder that ``spark.checkpoint.dir`` names and read back, so a lost executor
  costs one task and never an upstream recomputation.
* :func:`gapless_rank` numbers the rows of each group 0, 1, 2, ... without ever
  bringing a whole group into one task.
* :func:`connected_components` is the alternating large-star / small-star
  algorithm on DataFrames; links never leave the executors.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset a temporary
    folder serves in local mode (tests); on a cluster that would not be shared,
    so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="mnemograph-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Workspaces that a :func:`swept` block will close, the innermost block last.
_MADE: list[list[Workspace]] = []


class Workspace:
    """Written tables of one operator call, under the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/mnemograph-{uuid.uuid4().hex}"
        self.count = 0
        if _MADE:
            _MADE[-1].append(self)

    def put(self, df: DataFrame, tag: str = "t") -> DataFrame:
        """Write ``df`` and return the written table; its lineage ends here."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{tag}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.mnemograph_path = path
        return out

    def drop(self, *written: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in written:
            _delete(self.spark, df.mnemograph_path)

    def close(self) -> None:
        """Delete all tables; for callers that have written the result elsewhere."""
        _delete(self.spark, self.root)


@contextmanager
def swept() -> Iterator[None]:
    """Tables that operators write within the block are deleted at its end: results must have been written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for ws in _MADE.pop():
            ws.close()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(ws: Workspace, df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with two long columns that tell its rows apart and are the same whenever it is read.

    For Parquet files they are a hash of the file's path and the row's index in
    it. Any other frame is written first.
    """
    file, nr = names
    try:
        out = df.withColumns({file: F.xxhash64("_metadata.file_path"), nr: F.col("_metadata.row_index")})
        return out if "_metadata" not in df.columns else _fixed(ws, df, file, nr)
    except AnalysisException:
        return _fixed(ws, df, file, nr)


def _fixed(ws: Workspace, df: DataFrame, file: str, nr: str) -> DataFrame:
    return ws.put(df.withColumns({file: F.lit(0).cast("long"), nr: F.monotonically_increasing_id()}), "numbered")


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes that may be broadcast.
BROADCAST_BYTES = 32 << 20


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a hashed relation."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 24
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        each = 16 * max(1, len(kind.elementType)) if isinstance(kind.elementType, T.StructType) else 16
        return F.greatest(F.size(value), F.lit(0)).cast("long") * each + 24
    return F.lit(8).cast("long")


def small(written: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A frame, marked for broadcast if its measured size is at most ``limit`` bytes.

    Beyond that it is returned as it is, and the join shuffles both sides.
    """
    each = sum((_width(col(f.name), f.dataType) for f in written.schema), F.lit(32).cast("long"))
    size = written.agg(F.sum(each)).first()[0] or 0
    return F.broadcast(written) if size <= limit else written


def large(df: DataFrame) -> DataFrame:
    """A frame that no join may broadcast.

    Spark judges by the size of the files below, which says little once rows are
    exploded or were well compressed; the driver would build the whole relation.
    """
    return df.hint("merge")


def block_bits(rows: int, rows_per_block: int) -> int:
    """Bits of a uniform key so that a block of it holds about ``rows_per_block`` rows."""
    return max(0, math.ceil(math.log2(max(1, rows) / rows_per_block)))


def gapless_rank(df: DataFrame, group: list[str], key: str, tie: str, bits: int, out: str) -> DataFrame:
    """Number the rows of each group from 0, in the order of (key, tie).

    ``key`` is a long spread evenly over its range (a hash); its upper ``bits``
    bits name a block. Blocks are counted with a combinable aggregate, a running
    sum over the counts gives each block its offset, and only one block is ever
    sorted in a task. ``df`` must be a written table, as it is read twice.
    """
    block, before, n = fresh(df, "block", "before", "n")
    blocked = df.withColumn(block, F.shiftrightunsigned(col(key), 64 - bits) if bits else F.lit(0).cast("long"))
    running = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*group, block)
        .agg(F.count(F.lit(1)).alias(n))
        .withColumn(before, F.coalesce(F.sum(n).over(running), F.lit(0)))
        .drop(n)
    )
    within = Window.partitionBy(*group, block).orderBy(col(key), col(tie))
    return (
        blocked.join(offsets, [*group, block])
        .withColumn(out, F.row_number().over(within) - 1 + F.col(before))
        .drop(block, before)
    )


def connected_components(ws: Workspace, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternates large-star and small-star until the edge set no longer changes;
    it is then one star for each component. Rounds grow with the logarithm of
    the number of nodes. Minima are combinable aggregates that are joined back,
    so a hub is split by the adaptive skew join and never gathered in one task.
    """
    now = ws.put(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
        "links",
    )
    seen = None
    # Least neighbours are two rows a link at most, each of about 64 bytes in a hashed relation.
    bounded = lambda df: df if 128 * sign[0] <= BROADCAST_BYTES else large(df)
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        seen = sign
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = (
            now.join(bounded(least), F.col("lo") == F.col("u"))
            .where(F.col("hi") != F.col("m"))
            .select("hi", F.col("m").alias("lo"))
            .distinct()
        )
        wide = ws.put(wide, "large-star")
        least = wide.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = (
            wide.join(bounded(least), F.col("hi") == F.col("u"))
            .where(F.col("lo") != F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
            .distinct()
        )
        old, now = now, ws.put(small, "small-star")
        ws.drop(old, wide)
