"""Pairs of vectors by dot product, in blocks that bounds from pivots leave: neither all pairs of a group nor a whole group in one task.

A pivot p of length one splits a vector x into its part along p, x.p, and the rest,
of length r. The product of two vectors is then at most (x.p)(y.p) + r s, with s the
rest of y; for unit vectors that is the cosine of the difference of their angles to p.
Vectors of a group are sorted by their nearest pivot and by how near it is, and
cut into blocks; a block knows the least and greatest x.p and the greatest r for each
pivot. Blocks whose bound stays below the threshold for some pivot are not multiplied.

Cells (all blocks of a group by their nearest pivot) meet first, at most PIVOTS squared
in a group, then blocks of cells that may reach each other. Pivots come from a
bounded sample; they decide how much is left out and never what is found.

Null groups and ids, null, empty and zero vectors, and vectors with null or non-finite
components pair with nothing; vectors of different sizes do not pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.sources.working import Keep

#: Vectors that pivots are taken from, pivots, rows and bytes of a block, rows that a cell must fill to end a block, salts of a cell's blocks.
SAMPLE, PIVOTS, ROWS, BYTES, FEW, SALTS = 1024, 16, 1024, 4 << 20, 128, 16
#: Products that are held at once, and what rounding to six digits and of bounds may need.
PRODUCTS, SLACK = 1 << 20, 1e-6


def usable(vectors: DataFrame, group: str, id_: str, embedding: str) -> DataFrame:
    """(g, size, id, v) of the vectors that can pair with others; ``v`` in double precision."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(group).alias("g"), F.size(v).alias("size"), F.col(id_).alias("id"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | x.isNaN() | (F.abs(x) == float("inf")))
    return rows.where(F.col("g").isNotNull() & F.col("id").isNotNull() & (F.col("size") > 0)).where(~odd & F.exists("v", lambda x: x != 0))


def pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Unit pivots by size of vector, far from each other, of the SAMPLE rows with the smallest hashes of their ids."""
    by_size: dict[int, list[list[float]]] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("size", "v").collect():
        by_size.setdefault(r["size"], []).append(r["v"])
    out = {}
    for size, found in by_size.items():
        x = np.array(found)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        chosen = [0]
        near = x @ x[0]
        while len(chosen) < PIVOTS and near.min() < 1 - 1e-9:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        out[size] = x[chosen]
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), size)


def _changes(*columns: pa.Array) -> np.ndarray:
    """True at rows that differ from the one before, and at the first."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _with(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in more.items())])


def blocks(rows: DataFrame, own: dict[int, np.ndarray], keep: Keep) -> DataFrame:
    """(g, size, id, v, block, head): ``head`` (n, cell, lo, hi, r) stands at the first row of a block only.

    Ranges end within a group, a cell and among equal vectors (by id), so a hot one is many partitions.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("size").to_numpy()
            cell, at = np.zeros(len(sizes), dtype=np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes):
                if int(size) in own:
                    where = np.flatnonzero(sizes == size)
                    x = _matrix(b.column("v").take(pa.array(where)), int(size))
                    along = x @ own[int(size)].T
                    cell[where] = along.argmax(axis=1)
                    at[where] = along.max(axis=1) / np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(at)], names=[*b.schema.names, "cell", "at"])

    head = T.StructType([T.StructField("n", T.LongType()), T.StructField("cell", T.IntegerType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("lo", "hi", "r"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            groups = np.append(np.flatnonzero(_changes(b.column("g"), b.column("size"))), n)
            cell, sizes = b.column("cell").to_numpy(), b.column("size").to_numpy()
            first, heads = b.column("row").to_numpy(), [None] * n
            block = np.zeros(n, dtype=np.int64)
            for start, end in zip(groups[:-1], groups[1:], strict=True):
                size = int(sizes[start])
                most = min(ROWS, max(1, BYTES // (8 * size)))
                turns = start + 1 + np.flatnonzero(cell[start + 1 : end] != cell[start : end - 1])
                while start < end:
                    stop = min(start + most, end)
                    inside = turns[(turns >= start + FEW) & (turns < stop)]
                    stop = int(inside[0]) if len(inside) else stop
                    x = _matrix(b.column("v").slice(start, stop - start), size)
                    along = x @ own[size].T if size in own else np.zeros((len(x), 0))
                    squares = (x * x).sum(axis=1, keepdims=True)
                    rest = np.sqrt(np.maximum(squares - along * along, 0)) + 1e-7 * np.sqrt(squares)
                    heads[start] = {"n": stop - start, "cell": int(cell[start]), "lo": along.min(axis=0).tolist(), "hi": along.max(axis=0).tolist(), "r": rest.max(axis=0).tolist()}
                    block[start:stop] = first[start]
                    start = stop
            kind = pa.struct([("n", pa.int64()), ("cell", pa.int32()), *((k, pa.list_(pa.float64())) for k in ("lo", "hi", "r"))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("g", "size", "id", "v")), pa.array(block), pa.array(heads, type=kind)], names=["g", "size", "id", "v", "block", "head"])

    told = rows.mapInArrow(near, _with(rows.schema, cell=T.IntegerType(), at=T.DoubleType()))
    order = ("g", "size", "cell", "at", "id")
    told = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    return keep(told.mapInArrow(cut, _with(rows.schema, block=T.LongType(), head=head)))


def _reaches(a: str, b: str, minimum: float) -> Column:
    """Whether no pivot's bound rules out that a vector of ``a`` and one of ``b`` come to ``minimum``."""

    def bound(p: Column) -> Column:
        x0, x1, y0, y1 = (F.get(f"{side}.{end}", p) for side in (a, b) for end in ("lo", "hi"))
        return F.greatest(x0 * y0, x0 * y1, x1 * y0, x1 * y1) + F.get(f"{a}.r", p) * F.get(f"{b}.r", p)

    every = F.sequence(F.lit(0), F.lit(PIVOTS - 1))
    return F.forall(every, lambda p: F.coalesce(bound(p) >= minimum - SLACK, F.lit(True)))


def _cells(heads: DataFrame) -> DataFrame:
    def each(f, end: str) -> Column:
        return F.array(*[f(F.get(f"head.{end}", F.lit(p))) for p in range(PIVOTS)])

    own = heads.groupBy("g", "size", F.col("head.cell").alias("cell")).agg(each(F.min, "lo").alias("lo"), each(F.max, "hi").alias("hi"), each(F.max, "r").alias("r"))
    return own.select("g", "size", F.struct("cell", "lo", "hi", "r").alias("c"))


def meetings(left: DataFrame, right: DataFrame | None, minimum: float, keep: Keep) -> DataFrame:
    """(a, b, products): blocks of ``left`` and ``right`` that have to be multiplied. Without ``right``, of ``left`` with itself, a <= b."""
    x = left.where(F.col("head").isNotNull()).select("g", "size", "block", "head")
    y = x if right is None else right.where(F.col("head").isNotNull()).select("g", "size", "block", "head")
    reach = _cells(x).withColumnRenamed("c", "x").join(_cells(y).withColumnRenamed("c", "y"), ["g", "size"])
    reach = reach.where(_reaches("x", "y", minimum)).select("g", "size", F.col("x.cell").alias("from_cell"), F.col("y.cell").alias("to_cell"))
    # A cell of very many blocks is dealt over salts on one side; the heads of the other go to each.
    a = x.select("g", "size", F.col("head.cell").alias("from_cell"), F.col("block").alias("a"), F.col("head").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    b = y.select("g", "size", F.col("head.cell").alias("to_cell"), F.col("block").alias("b"), F.col("head").alias("q"), F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    met = a.join(reach, ["g", "size", "from_cell"]).join(b, ["g", "size", "to_cell", "salt"])
    met = met.where(F.col("a") <= F.col("b")) if right is None else met
    n = F.col("p.n") * F.col("q.n")
    own = F.lit(right is None) & (F.col("a") == F.col("b"))
    return keep(met.where(_reaches("p", "q", minimum)).select("a", "b", F.when(own, F.expr("p.n * (p.n - 1) div 2")).otherwise(n).alias("products")))


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows, summed in the order of components as an expression sums them."""
    out = np.empty(len(i))
    step = max(1, PRODUCTS // max(1, x.shape[1]))
    for s in range(0, len(i), step):
        out[s : s + step] = np.cumsum(x[i[s : s + step]] * y[j[s : s + step]], axis=1)[:, -1]
    return out


def _found(x: np.ndarray, y: np.ndarray, minimum: float, best: bool, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, products) at ``minimum`` or more; ``best``: for each row of x what may come first after rounding."""
    step = max(1, PRODUCTS // len(y))
    for s in range(0, len(x), step):
        near = x[s : s + step] @ y.T
        hit = near >= minimum - SLACK
        if itself:
            hit &= np.arange(len(y))[None, :] > np.arange(s, s + len(near))[:, None]
        if best:
            hit &= near >= near.max(axis=1, keepdims=True) - 2 * SLACK
        i, j = np.nonzero(hit)
        product = _exact(x, y, i + s, j)
        if best and len(i):
            # Rows of y stand in the order of their ids: of equal products the first is enough.
            order = np.lexsort((j, product, i))
            i, j, product = i[order], j[order], product[order]
            fresh = np.append(True, (i[1:] != i[:-1]) | (product[1:] != product[:-1]))
            i, j, product = i[fresh], j[fresh], product[fresh]
        yield i + s, j, product


def products(left: DataFrame, right: DataFrame | None, minimum: float, keep: Keep, best: bool = False) -> DataFrame:
    """(x, y, product): ids and products at ``minimum`` or a little less, which rounding may bring to it.

    Without ``right`` each pair of ``left`` comes once, in any order. ``best``
    leaves out what cannot be the first of its block for a row of ``left``. A
    task reads its block pairs in order and holds one at a time.
    """
    met = meetings(left, right, minimum, keep)
    other, itself = (left if right is None else right), right is None
    kinds = {"x": left.schema["id"].dataType, "y": other.schema["id"].dataType}
    none = {n: F.lit(None).cast(t) for n, t in kinds.items()}
    ones = left.join(met.withColumnRenamed("a", "block"), "block").select(F.col("block").alias("a"), "b", F.lit(0).alias("side"), F.col("id").alias("x"), none["y"].alias("y"), "v")
    twos = (met.where("a <> b") if itself else met).withColumnRenamed("b", "block")
    twos = other.join(twos, "block").select("a", F.col("block").alias("b"), F.lit(1).alias("side"), none["x"].alias("x"), F.col("id").alias("y"), "v")
    rows = ones.unionByName(twos).repartition("a", "b").sortWithinPartitions("a", "b", "side", "x", "y")

    def multiply(pair: pa.Table) -> Iterator[pa.RecordBatch]:
        second = int(np.searchsorted(pair.column("side").combine_chunks().to_numpy(), 1))
        size = len(pair.column("v")[0])
        x = _matrix(pair.column("v").slice(0, second), size)
        alone = itself and second == pair.num_rows
        y = x if alone else _matrix(pair.column("v").slice(second), size)
        names = pair.column("x").slice(0, second).combine_chunks()
        others = pair.column("x").slice(0, second).combine_chunks() if alone else pair.column("y").slice(second).combine_chunks()
        for i, j, product in _found(x, y, minimum, best, alone):
            for s in range(0, len(i), PRODUCTS >> 4):
                t = slice(s, s + (PRODUCTS >> 4))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i[t])), others.take(pa.array(j[t])), pa.array(product[t])], names=["x", "y", "product"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            if b.num_rows == 0:
                continue
            starts = np.append(np.flatnonzero(_changes(b.column("a"), b.column("b"))), b.num_rows)
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                now = (b.column("a")[start].as_py(), b.column("b")[start].as_py())
                if held and now != key:
                    yield from multiply(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(b.slice(start, end - start))
        if held:
            yield from multiply(pa.Table.from_batches(held))

    schema = T.StructType([T.StructField("x", kinds["x"]), T.StructField("y", kinds["y"]), T.StructField("product", T.DoubleType())])
    return rows.mapInArrow(task, schema)
