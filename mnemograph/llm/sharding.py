"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows are dealt into source blocks. The number of rows that block p sends to
shard s is drawn so that the matrix has the law that a uniform permutation of
all rows would give it: row sums are the block sizes, column sums the exact
shard sizes. Each block permutes its own rows and cuts them at the drawn counts,
the rows are exchanged, and every shard permutes what it has received, piece by
piece of an evenly spread key.

Everything that touches rows is a DataFrame expression. Only the block sizes
(at most 2 ** ``MATRIX_BITS`` longs) come to the driver, where the
matrix is drawn; it goes back as a table of one row for each block.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, block_bits, col, fresh, gapless_rank

#: Rows that one source block or one piece of a shard holds, about.
ROWS_PER_BLOCK = 1 << 14
#: There are at most 2 ** MATRIX_BITS source blocks; beyond that the blocks grow, so the driver's matrix does not.
MATRIX_BITS = 14


def hypergeometric(rng: random.Random, marked: int, others: int, drawn: int) -> int:
    """How many of ``drawn`` balls are marked, drawn without return from an urn.

    Inverts the distribution outward from its mode with exact ratios of
    neighbouring probabilities, so the work is a few standard deviations and no
    factorial is ever computed.
    """
    low, high = max(0, drawn - others), min(drawn, marked)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (marked + 1) // (marked + others + 2)))

    def up(k: int) -> float:
        return (marked - k) * (drawn - k) / ((k + 1) * (others - drawn + k + 1))

    ups, downs = [], []
    p, k = 1.0, mode
    while k < high and (p := p * up(k)) > 1e-18:
        k += 1
        ups.append(p)
    p, k = 1.0, mode
    while k > low and (p := p / up(k - 1)) > 1e-18:
        k -= 1
        downs.append(p)
    u = rng.random() * (1.0 + math.fsum(ups) + math.fsum(downs)) - 1.0
    if u < 0:
        return mode
    for step, p in enumerate(ups, 1):
        if (u := u - p) < 0:
            return mode + step
    for step, p in enumerate(downs, 1):
        if (u := u - p) < 0:
            return mode - step
    return mode


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """A matrix of counts with the given row and column sums, with the law of a uniform permutation."""
    rng = random.Random(seed)
    left = list(shards)
    total = sum(left)
    matrix = []
    for size in sizes:
        row, need, urn = [], size, total
        for have in left:
            got = hypergeometric(rng, have, urn - have, need)
            row.append(got)
            need -= got
            urn -= have
        left = [x - y for x, y in zip(left, row, strict=True)]
        total -= size
        matrix.append(row)
    return matrix


def exact_sizes(rows: int, n_shards: int) -> list[int]:
    """Shard sizes at most one apart."""
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def uniform_shards(
    df: DataFrame,
    n_shards: int,
    seed: int = 42,
    shard: str = "shard",
    slot: str = "slot",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``df`` with the columns ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in its shard).

    Law ``rows``: every shard has floor or ceiling of rows / ``n_shards`` rows,
    and every such assignment and order is equally likely over seeds.

    Defined cases: nulls, empty and very long values are payload and change
    nothing; repeated rows are separate rows, each with a place of its own (a
    uniform shuffle keeps no group together); an empty table gives an empty
    table; with fewer rows than shards the last shards are empty. Columns named
    like the new ones raise ``ValueError``; helper columns avoid every clash.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    if {shard.lower(), slot.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"df already has a column {shard} or {slot}")
    ws = Workspace(df.sparkSession)
    row, source, deal, mix = fresh(df.withColumns({shard: F.lit(0), slot: F.lit(0)}), "row", "source", "deal", "mix")

    # Row numbers are fixed by writing them; keys come from them, so equal rows spread as any others do.
    written = ws.put(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    total = written.count()
    bits = min(MATRIX_BITS, block_bits(total, rows_per_block))
    rows = written.withColumn(deal, F.xxhash64(F.lit(seed), F.lit("deal"), F.col(row)))
    rows = rows.withColumn(source, F.shiftrightunsigned(F.col(deal), 64 - bits) if bits else F.lit(0).cast("long"))

    sizes = {r[0]: r[1] for r in rows.groupBy(source).count().collect()}
    matrix = communication_matrix([sizes[p] for p in sorted(sizes)], exact_sizes(total, n_shards), seed)
    ends = [(p, [sum(line[: s + 1]) for s in range(n_shards)]) for p, line in zip(sorted(sizes), matrix, strict=True)]
    cuts = df.sparkSession.sql(
        "SELECT inline(from_json(:cuts, 'array<struct<p: bigint, ends: array<bigint>>>'))",
        args={"cuts": "[" + ",".join(f'{{"p":{p},"ends":{e}}}' for p, e in ends) + "]"},
    )

    local = Window.partitionBy(source).orderBy(F.col(deal), F.col(row))
    sent = (
        rows.join(cuts, F.col(source) == cuts["p"])
        .withColumn(shard, F.row_number().over(local))
        .withColumn(shard, F.size(F.filter(cuts["ends"], lambda e: e < F.col(shard))))
        .select(*[col(c) for c in df.columns], row, shard)
    )
    sent = ws.put(sent.withColumn(mix, F.xxhash64(F.lit(seed), F.lit("mix"), F.col(row))), "sent")
    ws.drop(written)
    placed = gapless_rank(sent, [shard], mix, row, block_bits(total, rows_per_block * n_shards), slot)
    return placed.select(*[col(c) for c in df.columns], F.col(shard).cast("int"), F.col(slot).cast("long"))
