"""Plain Lloyd clustering of vectors in whole numbers.

Every component becomes an integer once. A round broadcasts the centroids, a
pass of ``mapInPandas`` takes the squared differences to each centroid in NumPy
(the lowest number wins a tie) and gives back sums for each partition, never its
vectors; the sums merge in a ``groupBy``. Whole numbers have no order of
summation, so every layout of the table and every rerun gives the same clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, col

SCALE, CLUSTERS, ROUNDS = 256, 40, 5
#: Bits of the limbs that sums travel in.
LIMB = 30
#: Numbers that are held at once while vectors are compared with one centroid.
CELLS = 1 << 18
LONG = (1 << 63) - 1


def whole(x: Column, scale: int) -> Column:
    """Components as whole numbers, floor(scale * x), in doubles, which hold each of them exactly."""

    def floored(v: Column) -> Column:
        wide = v.cast("double") * F.lit(float(scale))
        # Beyond 2 ** 52 a double is whole as it is, and may not fit the long that floor gives.
        return F.when(F.abs(wide) < F.lit(float(1 << 52)), F.floor(wide).cast("double")).otherwise(wide)

    return F.transform(x, floored)


def sound(x: Column) -> Column:
    """Whether a vector is there, with no null or non-finite component."""
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def plain_limit(size: int) -> int:
    """Below this, squared differences of ``size`` components add up within 64 bits."""
    return math.isqrt((1 << 61) // max(1, size))


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of 64-bit numbers, or of Python's where squares could overflow."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    if np.abs(x).max(initial=0) < plain_limit(x.shape[1]):
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def plain(centroids: np.ndarray) -> np.ndarray:
    """Centroids as 64-bit numbers where that is safe."""
    limit = plain_limit(centroids.shape[1])
    return centroids.astype(np.int64) if all(abs(v) < limit for v in centroids.flat) else centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it) of each row; the lowest number wins a tie."""
    if x.dtype != centroids.dtype:
        x, centroids = x.astype(object), centroids.astype(object)
    home, least = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    step = max(1, CELLS // max(1, x.shape[1]))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        apart = np.stack([np.square(part - c).sum(axis=1) for c in centroids], axis=1)
        home[at : at + step] = own = np.argmin(apart, axis=1)
        least[at : at + step] = apart[np.arange(len(part)), own]
    return home, least


def limbs(sums: np.ndarray) -> list[np.ndarray]:
    """Sums (Python numbers) as limbs of ``LIMB`` bits, the last one signed: limbs of many sums add up within 64 bits."""
    out = []
    while np.abs(sums).max(initial=0) >> LIMB:
        out.append((sums & ((1 << LIMB) - 1)).astype(np.int64))
        sums = sums >> LIMB
    return [*out, sums.astype(np.int64)]


def _starts(vectors: DataFrame, size: int, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest SHA-256 of ``seed:key``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    drawn = vectors.select(name.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([[int(v) for v in r["v"]] for r in drawn], object).reshape(len(drawn), size)


def _sums(vectors: DataFrame, shared: Broadcast, size: int) -> dict[int, list[int]]:
    """{cluster: sums of its components, and the number of its vectors}, of clusters that have any."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = plain(shared.value)
        total = np.zeros((len(centroids), size + 1), object)
        for batch in batches:
            x = matrix(batch["v"])
            home, _ = nearest(x, centroids)
            for c in np.unique(home):
                own = x[home == c]
                total[c, :size] += own.sum(axis=0).astype(object)
                total[c, size] += len(own)
        used = np.flatnonzero(total[:, size])
        for i, limb in enumerate(limbs(total[used])):
            places = {"cluster": np.repeat(used, size + 1), "position": np.tile(np.arange(size + 1), len(used))}
            yield pd.DataFrame(places | {"limb": i, "total": limb.ravel()})

    parts = vectors.select("v").mapInPandas(partial, "cluster long, position long, limb long, total long")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "position", "limb").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["cluster"], [0] * (size + 1))[r["position"]] += r["total"] << (LIMB * r["limb"])
    return out


def cluster(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    size: int = 64,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = 2,
    scale: int = SCALE,
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid (decimal numbers as strings) of each vector that is kept.

    Kept are vectors of ``size`` components, none null or non-finite. Centroids
    start as the ``k`` vectors whose ``seed:key`` has the smallest SHA-256. A
    round assigns every vector and moves each non-empty centroid to the floor of
    its mean; after the last one vectors are assigned again.

    What comes to the driver and what is broadcast are k * size numbers.

    Defined cases: null vectors and those of another size or with a null or
    non-finite component (before or after scaling) have no row; a null key comes
    last among the starts; repeated rows are separate vectors, and their
    components order them where keys are equal; with fewer vectors than ``k``
    there are as many clusters; an empty table gives an empty table. Texts and
    other columns are not read. Sums and distances of any size are exact while
    they are compared; a distance or an inertia beyond a long is given as the
    largest long.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession)
    named = df.select(col(key).alias("key"), whole(col(vector), scale).alias("v"))
    kept = named.where((F.size("v") == size) & sound(F.col("v")))
    # The numbers of rows are fixed by writing them.
    rows = ws.put(kept.withColumn("row", F.monotonically_increasing_id()), "rows")

    centroids = _starts(rows, size, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)
        total = _sums(rows, shared, size)
        shared.unpersist()
        moved = [[s // total[c][size] for s in total[c][:size]] if c in total else list(old) for c, old in enumerate(centroids)]
        centroids = np.array(moved, object).reshape(centroids.shape)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = plain(shared.value)
        for batch in batches:
            home, apart = nearest(matrix(batch["v"]), own)
            yield pd.DataFrame({"row": batch["row"], "cluster": home, "distance": np.minimum(apart, LONG).astype(np.int64)})

    placed = ws.put(rows.select("row", "v").mapInPandas(assign, "row long, cluster int, distance long"), "placed")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    every = min(LONG, sum(int(r["s"]) for r in sums))
    about = [(r["cluster"], min(LONG, int(r["s"])), every, [str(v) for v in centroids[r["cluster"]]]) for r in sums]
    schema = "cluster int, cluster_inertia long, inertia long, centroid array<string>"
    # A row for each cluster, k at most.
    clusters = F.broadcast(spark.createDataFrame(about, schema))
    out = rows.select("row", "key").join(placed, "row").join(clusters, "cluster")
    return out.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
