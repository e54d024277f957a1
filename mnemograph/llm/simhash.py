"""Near-duplicate documents by SimHash, joined through segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of segment
popcounts (each 0, 1 or 2) embeds it in a grid. The Manhattan distance of two
vectors never exceeds the Hamming distance of their fingerprints, so a range
join with Manhattan distance at most 3 loses no pair, and the pairs it finds are
verified exactly.

The range join works on half vectors. If two vectors are within 3, one of their
halves is within 1, so each fingerprint looks into its own cell and into the
cells one step away, in either half. Popcounts are kept in unary (0 -> 00,
1 -> 01, 2 -> 11): the Manhattan distance of two packed vectors is then the
number of bits in which they differ, and a step is the flip of one bit.

Equal fingerprints are one class before anything is joined, so copies of a text
never meet each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, col, connected_components, fresh, large, numbered, small

SEED = 42
LOW = 0x5555555555555555
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Hashes counted at once.
CHUNK = 1 << 16


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles of a whole text; 0 where there are no words."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return _majority(np.fromiter((digest(s.encode("utf-8", "surrogatepass"), SEED) for s in shingles), np.uint64))


def fingerprints(docs: DataFrame, text: str, out: str, shingle: int = 3) -> DataFrame:
    """``docs`` without ``text`` and with the signed long ``out``, the fingerprint of each whole text."""
    kept = [c for c in docs.columns if c != text]
    source = docs.select(*[col(c) for c in kept], col(text))
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(at)]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], signed], [*batch.schema.names[:at], out])

    schema = docs.select(*[col(c) for c in kept]).schema
    return source.mapInArrow(run, schema.add(out, "long"))


def _unary_counts(f: Column) -> Column:
    """Popcounts of the 2-bit segments of a long, each in unary."""
    high = F.shiftrightunsigned(f, 1)
    some = f.bitwiseOR(high).bitwiseAND(F.lit(LOW))
    both = f.bitwiseAND(high).bitwiseAND(F.lit(LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _half(counts: Column, half: int) -> Column:
    low = F.lit(0xFFFFFFFF)
    return (F.shiftrightunsigned(counts, 32) if half else counts).bitwiseAND(low)


def _steps(cell: Column) -> Column:
    """A half cell and those one step away: flips of one bit that leave every count in unary."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: cell.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    lows = F.lit(LOW & 0xFFFFFFFF)
    # A count is in unary unless its high bit is set and its low bit is not.
    sound = F.filter(flips, lambda c: F.shiftrightunsigned(c, 1).bitwiseAND(lows).bitwiseAND(F.bitwise_not(c)) == 0)
    return F.array_append(sound, cell)


def links(fps: DataFrame, fp: str, max_distance: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b as signed longs, that differ in at most ``max_distance`` <= 3 bits.

    ``fps`` holds each fingerprint once. Cells are joined with an equi-join that
    the adaptive skew join may split; the Manhattan bound and the exact distance
    are conditions of that join, so only true links leave it. A pair met in
    both halves leaves it once: the second half skips what the first one finds.
    Neither side is broadcast: they hold 2 and about 50 rows a fingerprint, which
    the size of its file does not tell.
    """
    met = near_rows(fps.select(F.col(fp).alias("f")), "f", max_distance, lambda a, b: a("f") < b("f"))
    return met.select(F.col("a_f").alias("a"), F.col("b_f").alias("b"))


def near_rows(rows: DataFrame, fp: str, max_distance: int, wanted: Callable[[Callable, Callable], Column]) -> DataFrame:
    """Pairs of rows whose fingerprints differ in at most ``max_distance`` <= 3 bits, columns as a_<name> and b_<name>.

    ``wanted`` gets two functions from names to columns and says which pairs to
    return; both orders of a pair meet, so it should hold for one of them.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("half cells are only searched one step around: max_distance must be 0 to 3")
    halves = F.array(*[F.struct(F.lit(h).alias("h"), _half(F.col("v"), h).alias("c")) for h in (0, 1)])
    vectors = rows.withColumn("v", _unary_counts(F.col(fp))).withColumn("x", F.explode(halves))
    here = vectors.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns], F.col("v").alias("va"), "x.h", "x.c")
    around = vectors.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns], F.col("v").alias("vb"), "x.h", F.explode(_steps(F.col("x.c"))).alias("c"))
    apart = F.col("va").bitwiseXOR(F.col("vb"))
    first_half_near = F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF))) <= 1
    near = (
        wanted(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
        & (F.bit_count(apart) <= max_distance)
        & (F.bit_count(F.col(f"a_{fp}").bitwiseXOR(F.col(f"b_{fp}"))) <= max_distance)
        & ((here["h"] == 0) | ~first_half_near)
    )
    met = here.join(large(around), (here["h"] == around["h"]) & (here["c"] == around["c"]) & near)
    return met.select(*[f"{side}_{c}" for side in "ab" for c in rows.columns])


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_distance: int = 3
) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id (smallest key reachable).

    Documents link where their fingerprints differ in at most ``max_distance``
    bits; a component is what links join.

    Defined cases: a null, empty or blank text has fingerprint zero and links
    like any other; repeated rows share a component; a null key is returned and
    is never the smallest unless the component has no other; texts are read
    whole; other columns are not read; an empty table gives an empty table.
    """
    ws = Workspace(docs.sparkSession)
    named = docs.select(col(key).alias("key"), col(text).alias("text"))
    prints = ws.put(fingerprints(named, "text", "f", shingle), "fingerprints")
    classes = ws.put(prints.groupBy("f").agg(F.min("key").alias("least")), "classes")
    pairs = ws.put(links(classes, "f", max_distance), "pairs")
    joined = connected_components(ws, pairs, "a", "b")
    # Classes without a link are components of their own.
    member = classes.join(large(joined), classes["f"] == joined["node"], "left").select(
        "f", "least", F.coalesce("component", "f").alias("root")
    )
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = ws.put(member.join(large(roots), "root").select("f", "component_id"), "members")
    return prints.join(large(member), "f").select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest key, of equal keys one row.

    Rows with a null key stay only in groups that have no other key.
    """
    ws = Workspace(docs.sparkSession)
    where = fresh(docs, "file", "nr")
    rows = numbered(ws, docs, where)
    named = rows.select(*[F.col(w).alias(n) for w, n in zip(where, ("file", "nr"), strict=True)], col(key).alias("key"), col(text).alias("text"))
    prints = ws.put(fingerprints(named, "text", "f", shingle), "fingerprints")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "file", "nr"))
    classes = ws.put(prints.groupBy("f").agg(first.alias("first")), "classes")
    joined = connected_components(ws, ws.put(links(classes, "f", max_distance), "pairs"), "a", "b")
    member = classes.join(large(joined), classes["f"] == joined["node"], "left").select("first", F.coalesce("component", "f").alias("root"))
    stay = member.groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.nr")
    # What goes is far less than what stays, so the texts need not be shuffled to leave it out.
    gone = ws.put(prints.select("file", "nr").join(large(stay), ["file", "nr"], "left_anti"), "gone")
    return rows.join(small(gone.select(F.col("file").alias(where[0]), F.col("nr").alias(where[1]))), where, "left_anti").drop(*where)
