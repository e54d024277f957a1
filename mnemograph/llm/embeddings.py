"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per group.

Vectors only meet within their label. Centroids are fitted on a bounded sample.
A vector lives in the cell of its nearest centroid and looks into each cell whose
border is within half the threshold's angle. No link is lost: the border of
cells i and j is a plane through the origin; if x lives in i and its partner y
in j, the arc between them crosses it, so the angles of x and of y to the plane
add up to at most that of the arc, and one of the two is at most half of it.
That one looks into the other's cell.

Cells are cut into blocks of bounded size; blocks of a cell meet pairwise, so a
hot cell is many small products, and a meeting gives back a count and a
connection for each vector, never its pairs. Equal vectors of a label are one
class with a weight before anything is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.llm.common import Workspace, col, connected_components

#: Vectors that the centroids are fitted on, at most, and vectors for each centroid.
SAMPLE, PER_CELL = 20_000, 512
#: Bytes of the vectors that the centroids are fitted on, at most, in double precision.
FIT_BYTES = 64 << 20
ITERATIONS = 8
#: Vectors in a block and their bytes in double precision, at most; rows of a block that are multiplied at once.
BLOCK, BLOCK_BYTES, STRIP = 8192, 8 << 20, 128


def fit_centroids(x: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; starts from evenly spaced rows."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(iterations):
        home = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def between(c: np.ndarray) -> np.ndarray:
    """Distances of unit centroids from each other."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * c @ c.T))


def cells_of(x: np.ndarray, c: np.ndarray, threshold: float, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, mask of the other cells to look into) of unit vectors; ``apart`` is :func:`between` of ``c``.

    Of two vectors with a cosine of ``threshold`` or more and different homes, one looks into the other's home.
    """
    near = x @ c.T
    home = np.argmax(near, axis=1)
    gap = np.take_along_axis(near, home[:, None], 1) - near
    # The sine of the angle to a border is the gap over the distance of the centroids.
    reach = math.sin(math.acos(max(-1.0, min(1.0, threshold))) / 2) + 1e-9
    look = gap <= reach * (between(c) if apart is None else apart)[home] + 1e-12
    look[np.arange(len(x)), home] = False
    return home, look


def _unit(vectors: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one size as unit rows in double precision; scaled first, so no norm overflows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy().astype(np.float64).reshape(-1, size)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
) -> DataFrame:
    """One row per row of ``df``: key, n_links, component_id, kept.

    Two rows link if their labels are equal and not null and their cosine, in
    double precision, is at least ``threshold``.

    Defined cases: a vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, as does one of another size; its
    row has no links and its own key as component. Rows with equal keys are
    separate vectors. A null key takes part in links; a component's id is its
    smallest key that is not null. Texts and other columns are not read; an
    empty table gives an empty table.
    """
    ws = Workspace(df.sparkSession)
    # Floats travel as floats; whatever else there is becomes double.
    kind = df.schema[vector].dataType
    wide = not isinstance(kind.elementType, T.FloatType)
    v = F.transform(col(vector), lambda v: v.cast("double")) if wide else col(vector)
    named = df.select(col(key).alias("key"), col(label).cast("string").alias("label"), v.alias("v"))
    odd = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.col("label").isNotNull() & (F.size("v") > 0) & ~odd & F.exists("v", lambda v: v != 0)
    named = named.withColumn("class", F.when(sound, F.sha2(F.concat_ws("|", "label", F.array_join("v", ",")).cast("binary"), 256)))
    rows = ws.put(named, "rows")

    classes = (
        rows.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.first("label").alias("label"), F.first("v").alias("v"), F.size(F.first("v")).alias("size"), F.count(F.lit(1)).alias("weight"), F.min("key").alias("least"))
    )
    classes = ws.put(classes, "classes")
    centroids = _centroids(classes)
    met = ws.put(_meetings(ws, classes, centroids, threshold), "met")
    degree = met.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("across"))
    joined = connected_components(ws, met.select("a", "b"), "a", "b").withColumnRenamed("node", "class")
    member = classes.select("class", "weight", "least").join(degree, "class", "left").join(joined, "class", "left")
    member = member.withColumn("root", F.coalesce("component", "class"))
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(roots, "root").select(
        "class", (F.col("weight") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"), "component_id"
    )
    member = ws.put(member, "members")
    out = rows.select("key", "class").join(member, "class", "left")
    component = F.coalesce("component_id", "key")
    return out.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )


def _centroids(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids for each vector size, from at most ``SAMPLE`` classes drawn evenly by hash.

    The number of centroids is twice the square root of the classes over
    ``PER_CELL``, at least one; it needs only their count. Vectors of another
    size than the 64 most common ones share one cell for their size.
    """
    out = {}
    for size, n in ((r[0], r[1]) for r in classes.groupBy("size").count().orderBy(F.desc("count")).limit(64).collect()):
        most = max(1, min(SAMPLE, FIT_BYTES // (8 * size)))
        share = min(1.0, most / n)
        drawn = classes.where((F.col("size") == size) & (F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
        # The share is a bound in expectation; the limit makes it one for certain.
        table = drawn.orderBy("class").limit(2 * most).select("v").toArrow()
        x = _unit(table["v"], size) if table.num_rows else np.ones((1, size))
        k = round(2 * math.sqrt(n / PER_CELL)) if n > PER_CELL else 1
        out[size] = fit_centroids(x, min(k, len(x) // 4 or 1))
    return out


def _meetings(ws: Workspace, classes: DataFrame, centroids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(a, b, links): a class, one that it is connected with, and the weight of what it links with, by meeting of blocks.

    A meeting gives back one row for each class that links there, never its
    pairs. Two vectors of different cells may meet in either's cell; if both
    meetings take place, that in the smaller cell counts.
    """

    apart = {size: between(c) for size, c in centroids.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                c = centroids.get(int(size), np.ones((1, int(size))))
                home, look = cells_of(_unit(own["v"], int(size)), c, threshold, apart.get(int(size)))
                i, j = np.nonzero(look)
                take = np.concatenate([np.arange(len(home)), i])
                looks = [bits.tobytes() for bits in np.packbits(look, axis=1)]
                out = [own[n].take(pa.array(take)) for n in ("class", "label", "size", "v", "weight")]
                out += [pa.array(np.concatenate([home, j])), pa.array(home[take]), pa.array(looks, pa.binary()).take(pa.array(take))]
                yield pa.RecordBatch.from_arrays(out, ["class", "label", "size", "v", "weight", "cell", "home", "looks"])

    source = classes.select("class", "label", "size", "v", "weight")
    schema = classes.select("class", "label", "size", "v", "weight").schema.add("cell", "long").add("home", "long").add("looks", "binary")
    seats = ws.put(source.mapInArrow(assign, schema), "seats")
    where = ["label", "size", "cell"]
    # Rows of a cell are dealt into blocks by hash.
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (F.col("size") * 8))))
    counts = seats.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).select(*where, F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    seats = seats.join(counts, where).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # Block i meets blocks i, i+1, ...: a row goes to the meeting with each block of its cell once.
    meet = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q")),
    )
    sent = seats.withColumn("m", F.explode(meet)).select(*where, "m.p", "m.q", "block", "class", "weight", "home", "looks", "v")

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        cell, p, q = key[2].as_py(), key[3].as_py(), key[4].as_py()
        block, home, weight = (table[n].to_numpy() for n in ("block", "home", "weight"))
        looks = np.frombuffer(b"".join(table["looks"].to_pylist()), np.uint8).reshape(len(home), -1)
        x = _unit(table["v"], key[1].as_py())
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        n_links, least = np.zeros(len(home), np.int64), np.arange(len(home))
        for at in range(0, len(left), STRIP):
            rows = left[at : at + STRIP]
            i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
            a, b = rows[i], right[j]
            # One of the two must live here; within a block each pair counts in one order.
            good = ((home[a] == cell) | (home[b] == cell)) & ((p != q) | (a < b))
            a, b = a[good], b[good]
            host, guest = np.where(home[a] == cell, a, b), np.where(home[a] == cell, b, a)
            there = home[guest]
            also = (looks[host, there >> 3] >> (7 - (there & 7)) & 1).astype(bool) & (there != cell)
            good = ~also | (cell < there)
            a, b = a[good], b[good]
            np.add.at(n_links, a, weight[b])
            np.add.at(n_links, b, weight[a])
            least = _joined(least, a, b)
        hit = np.flatnonzero(n_links)
        names = table["class"].combine_chunks()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(hit)), names.take(pa.array(least[hit])), pa.array(n_links[hit])], ["a", "b", "links"])

    return sent.groupBy(*where, "p", "q").applyInArrow(compare, "a string, b string, links long")


def _joined(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of the groups after joining those of a and b: the smallest row of each group."""
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            return least
        new = least.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
        while (new[new] != new).any():
            new = new[new]
        least = new
