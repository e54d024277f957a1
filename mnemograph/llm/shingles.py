"""Near copies of documents: shingle sets, SimHash and MinHash candidates, exact similarity.

Two documents are near copies if the Jaccard similarity of their sets of word
shingles reaches a threshold. Candidates come in two ways, and each is verified
on the whole shingle sets. Sets whose SimHash differs in at most ``MAX_BITS``
bits meet in the cells of segment popcounts (``simhash``), which loses none of
them; but at a similarity of 0.8 ten bits are usual. For the rest, sets meet
that share one of ``BANDS`` keys, each of ``ROWS`` smallest hashes. A pair at
0.8 is missed by the keys with a probability of (1 - 0.8 ** 4) ** 24, about three
in a million, and a nearer one with less. The keys come first, as the cells then
need not give the pairs of what is one group already.

Equal sets are one class before anything is joined, so copies of a text never
meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, col, connected_components, fresh, large, numbered, small
from mnemograph.llm.simhash import _LOWER, _WORD, SEED, _majority, near_rows

BANDS, ROWS = 24, 4
#: Differing SimHash bits within which the cells of popcounts lose no pair.
MAX_BITS = 3
#: Shingles hashed at once.
CHUNK = 1 << 12
_DRAWN = np.random.RandomState(SEED).randint(0, 1 << 32, (4, BANDS * ROWS), np.uint64)
#: Hash i of x is FACTORS[i] * x + OFFSETS[i]; odd factors make each a permutation of the 64-bit numbers.
FACTORS, OFFSETS = (_DRAWN[0] << np.uint64(32) | _DRAWN[1]) | np.uint64(1), _DRAWN[2] << np.uint64(32) | _DRAWN[3]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The hashes of the word shingles of a whole text, ascending, each once; of a shorter text all words are one."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    shingles = {" ".join(words)} if len(words) <= size else set(map(" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    return np.unique(np.fromiter((digest(s.encode("utf-8", "surrogatepass"), SEED) for s in shingles), np.uint64, len(shingles)))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed long for each band; none for an empty set, which is similar to no other."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, (FACTORS[:, None] * shingles[None, at : at + CHUNK] + OFFSETS[:, None]).min(axis=1), out=least)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(file, nr, key, c, n, f, bands): a digest of each document's shingle set, its size, its SimHash and its band keys."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch["text"]]
            digests = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            prints = pa.array(np.array([_majority(s) for s in sets], np.uint64).view(np.int64))
            columns = [*(batch[c] for c in ("file", "nr", "key")), digests, pa.array([len(s) for s in sets], pa.int64()), prints, bands]
            yield pa.RecordBatch.from_arrays(columns, ["file", "nr", "key", "c", "n", "f", "bands"])

    return docs.mapInArrow(run, f"file long, nr long, key {kind}, c binary, n long, f long, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, s): the shingle hashes of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def _verified(ws: Workspace, pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets are similar. Only documents of such a pair are read again."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = ws.put(classes.join(ids, "id").select("id", "first.file", "first.nr"), "wanted")
    sets = ws.put(_sets(docs.join(small(wanted), ["file", "nr"]).select("id", "text"), shingle), "sets")
    sa = sets.select(F.col("id").alias("a"), F.col("s").alias("x"))
    sb = sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9
    return ws.put(pairs.join(sa, "a").join(sb, "b").where(near).select("a", "b"), "similar")


def _sizes_allow(na: Column | str, nb: Column | str, similarity: float) -> Column:
    return F.least(na, nb) >= F.greatest(na, nb) * similarity - 1e-6


def print_links(ws: Workspace, classes: DataFrame, groups: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame | None:
    """Similar pairs (a, b) of different groups whose SimHash differs in at most ``MAX_BITS`` bits, or None if there are none.

    ``groups`` names the component of each class that has one; the others are groups of their own.
    """
    apart = classes.join(large(groups), classes["id"] == groups["node"], "left").select("id", "n", "f", F.coalesce("component", "id").alias("g"))
    met = near_rows(
        ws.put(apart, "apart"), "f", MAX_BITS, lambda a, b: (a("id") < b("id")) & (a("g") != b("g")) & _sizes_allow(a("n"), b("n"), similarity)
    )
    met = ws.put(met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "met-by-print")
    return _verified(ws, met, classes, docs, shingle, similarity) if met.count() else None


def links(ws: Workspace, classes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of class ids whose connected components are those of all similar pairs.

    First each class meets the smallest id of its bucket. What that joins is one
    group, and only pairs of different groups are left to compare, so a large
    group of near copies does not give all its pairs.
    """
    close = _sizes_allow("na", "nb", similarity)
    keyed = classes.select("id", "n", F.explode("bands").alias("k"))
    tops = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "n")).alias("top"))
    tops = ws.put(tops.where("m > 1").select("k", F.col("top.id").alias("a"), F.col("top.n").alias("na")), "tops")
    seats = ws.put(keyed.join(small(tops.select("k")), "k"), "seats")
    met = seats.select("k", F.col("id").alias("b"), F.col("n").alias("nb")).join(tops, "k").where((F.col("a") != F.col("b")) & close)
    met = ws.put(met.select("a", "b").distinct(), "met")
    first = _verified(ws, met, classes, docs, shingle, similarity)
    groups = ws.put(connected_components(ws, first, "a", "b"), "groups").withColumnRenamed("node", "id")
    grouped = ws.put(seats.join(groups, "id", "left").select("k", "id", "n", F.coalesce("component", "id").alias("g")), "grouped")
    heads = tops.select("k", F.col("a").alias("id")).join(groups, "id", "left").select("k", F.coalesce("component", "id").alias("gt"))
    apart = grouped.join(heads, "k").where("g != gt").select("k", F.col("id").alias("a"), F.col("n").alias("na"), F.col("g").alias("ga"))
    rest = grouped.select("k", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb"))
    left = apart.join(rest, (apart["k"] == rest["k"]) & (F.col("ga") != F.col("gb")) & close)
    left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    left = ws.put(left, "left")
    ws.drop(seats, grouped)
    return first.unionByName(_verified(ws, left, classes, docs, shingle, similarity)) if left.count() else first


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest key, of equal keys one row.

    Two documents link if the Jaccard similarity of their shingle sets reaches
    ``similarity``; a group is what links join.

    Defined cases: rows with a null key stay only in groups that have no other
    key; null, empty and blank texts are copies of each other; texts are read
    whole; an empty table gives an empty table.
    """
    ws = Workspace(docs.sparkSession)
    where = fresh(docs, "file", "nr")
    rows = numbered(ws, docs, where)
    named = rows.select(*[F.col(w).alias(n) for w, n in zip(where, ("file", "nr"), strict=True)], col(key).alias("key"), col(text).alias("text"))
    prints = ws.put(_prints(named, shingle), "prints")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "file", "nr"))
    classes = prints.groupBy("c").agg(first.alias("first"), F.first("n").alias("n"), F.first("f").alias("f"), F.first("bands").alias("bands"))
    classes = ws.put(classes.select(F.monotonically_increasing_id().alias("id"), "first", "n", "f", "bands"), "classes")
    found = links(ws, classes, named, shingle, similarity)
    joined = connected_components(ws, found, "a", "b")
    more = print_links(ws, classes, joined, named, shingle, similarity)
    if more is not None:
        joined = connected_components(ws, found.unionByName(more), "a", "b")
    member = classes.join(joined, classes["id"] == joined["node"], "left").select("first", F.coalesce("component", "id").alias("root"))
    stay = member.groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.nr")
    # What goes is far less than what stays, so the texts need not be shuffled to leave it out.
    gone = ws.put(prints.select("file", "nr").join(stay, ["file", "nr"], "left_anti"), "gone")
    return rows.join(small(gone.select(F.col("file").alias(where[0]), F.col("nr").alias(where[1]))), where, "left_anti").drop(*where)
