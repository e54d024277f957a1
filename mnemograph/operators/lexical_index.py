"""A stored inverted index for BM25: blocks of postings with their maxima, changed with the texts, and a top-k that leaves blocks out.

Documents of a pool lie in segments of about ``SEGMENT``, like lengths together. A
block is what one segment holds of one term: how many documents that is, the most
that any has of the term, the length of the shortest, and the postings. A search
reads these heads of blocks first. They bound what any document of a segment can score,
whatever the average length has become since; the best segments by bound are
scored, and of the others only those whose bound reaches the k-th score found.

A change touches segments: those that lose a document are written without it,
new documents get segments of their own, and segments that have become small are
packed again from their postings; no text that stays is read again.

Everything is a DataFrame of two tables, so it can be stored anywhere; ``Store``
keeps them beside the facts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.functions.text import tokens
from mnemograph.schema import INDEX_BLOCKS, INDEX_PLACES
from mnemograph.sources.working import Keep

K1, B = 1.2, 0.75
#: Documents of a segment, about; several segments of a pool with fewer than a quarter of it are packed again.
SEGMENT = 64
#: Segments of a query that are scored before any is left out, for each document that is asked for: each may hold one good one.
PROBES = 2
#: Characters that one task makes words of, about.
PART_CHARS = 8 << 20

#: Columns of the two tables, and those of a block that a bound needs.
BLOCKS, PLACES = INDEX_BLOCKS.names, INDEX_PLACES.names
HEADS = [c for c in BLOCKS if c != "docs"]


@dataclass
class LexicalIndex:
    """Tables of any number of pools; a pool is what ``graph_id`` names, null included."""

    blocks: DataFrame
    places: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(graph_id, segment, term, id, tf, dl), a row for each document of each block."""
        return self.blocks.select("graph_id", "segment", "term", F.inline("docs"))

    def statistics(self) -> DataFrame:
        """(g, n, avgdl) of each pool that has any word."""
        n = self.places.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
        words = self.blocks.groupBy(F.col("graph_id").alias("g")).agg(F.sum("words").alias("all_words"))
        return words.join(n, F.col("g").eqNullSafe(F.col("graph_id"))).select("g", "n", (F.col("all_words") / F.col("n")).alias("avgdl"))


def _sign(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _kind(chars: Column) -> Column:
    """Lengths within a fifth of each other, about, are of one kind: a block's shortest document is then near to all of it."""
    return F.floor(F.log2(chars + F.lit(1.0)) * 4)


def _kinds(docs: DataFrame) -> DataFrame:
    """(g, kind, n, before): how many of a pool's documents (graph_id, chars) are of a kind, and of shorter ones."""
    kinds = docs.groupBy(F.col("graph_id").alias("g"), _kind(F.col("chars")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    # A pool has a kind for each quarter of a power of two, some hundred at most.
    return kinds.withColumn("before", F.sum("n").over(Window.partitionBy("g").orderBy("kind")) - F.col("n"))


def _placed(docs: DataFrame, kinds: DataFrame, generation: str) -> DataFrame:
    """``docs`` (graph_id, id, chars, ...) with ``segment``: runs of a pool's documents by length.

    Documents of one kind are spread by hash over the segments that it fills, so
    a row needs the counts of kinds only, and no list is ever in order.
    """
    share = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    at = F.floor((F.col("before") + share * F.col("n")) / SEGMENT)
    joined = docs.withColumn("kind_", _kind(F.col("chars"))).join(kinds, F.col("graph_id").eqNullSafe(F.col("g")) & (F.col("kind_") == F.col("kind")))
    return joined.select(*docs.columns, F.concat_ws("-", F.lit(generation), at.cast("string")).alias("segment"))


def _blocks(postings: DataFrame) -> DataFrame:
    """Blocks of (graph_id, segment, term, id, tf, dl); one has as many postings as its segment has documents at most."""
    counts = F.count(F.lit(1)).alias("df"), F.max("tf").alias("most"), F.min("dl").alias("least"), F.sum("tf").alias("words")
    return postings.groupBy("graph_id", "segment", "term").agg(*counts, F.collect_list(F.struct("id", "tf", "dl")).alias("docs")).select(*BLOCKS)


def build(docs: DataFrame, keep: Keep, generation: str = "0") -> LexicalIndex:
    """The index of ``docs`` (graph_id, id, text); ids are unique within a pool.

    ``keep`` writes a frame and reads it again; ``generation`` names the
    segments and must be another one at each change. A null text has no words.
    """
    sized = docs.select("graph_id", "id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    sizes = keep(sized.select("graph_id", "id", "chars", _sign(F.col("text")).alias("sign")))
    kinds = keep(_kinds(sizes))
    places = keep(_placed(sizes, kinds, generation).select(*PLACES))
    # Whole texts are dealt by segment once, and counting needs no other exchange; words are made after it. They become
    # many more bytes there than texts have, so the number of partitions is not left to the size of the exchange.
    n = max(docs.sparkSession.sparkContext.defaultParallelism, (sizes.agg(F.sum("chars")).first()[0] or 0) // PART_CHARS)
    dealt = _placed(sized, kinds, generation).select("graph_id", "segment", "id", "text").repartition(n, "segment").sortWithinPartitions("graph_id", "segment")
    words = dealt.select("graph_id", "segment", "id", tokens(F.col("text")).alias("w"))
    kind = {c: docs.schema[c].dataType.simpleString() for c in ("graph_id", "id")}
    schema = f"graph_id {kind['graph_id']}, segment string, term string, df long, most long, least long, words long, docs array<struct<id:{kind['id']},tf:long,dl:long>>"
    return LexicalIndex(keep(words.mapInArrow(_counted, schema)), places)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (graph_id, segment, id, w) that come segment by segment; a word is no row before its block is one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([*held, batch])
        names = list(zip(rows["graph_id"].to_pylist(), rows["segment"].to_pylist(), strict=True))
        # The last segment may go on in the next batch.
        last = len(names) - 1
        while last and names[last - 1] == names[-1]:
            last -= 1
        held = [rows.slice(last)]
        if last:
            yield _blocks_of(rows.slice(0, last), names[:last])
    for rows in held:
        yield _blocks_of(rows, [None] * rows.num_rows)


def _blocks_of(rows: pa.RecordBatch, names: list) -> pa.RecordBatch:
    """The blocks of whole segments; ``names`` tell where one ends."""
    segment = np.cumsum([0] + [a != b for a, b in zip(names, names[1:], strict=False)])
    words = rows["w"].flatten().dictionary_encode()
    dl = rows["w"].value_lengths().fill_null(0).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(rows.num_rows), dl)
    n, kinds = rows.num_rows, max(1, len(words.dictionary))
    keys, tf = np.unique((segment[doc] * kinds + words.indices.to_numpy()) * n + doc, return_counts=True)
    block, doc = np.divmod(keys, n)
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    at = pa.array(doc[starts])
    found = pa.StructArray.from_arrays([rows["id"].take(pa.array(doc)), pa.array(tf, pa.int64()), pa.array(dl[doc])], ["id", "tf", "dl"])
    ends = np.append(starts, len(keys))
    each = [np.diff(ends), *(f.reduceat(x, starts) if len(starts) else x[:0] for f, x in ((np.maximum, tf), (np.minimum, dl[doc]), (np.add, tf)))]
    term = words.dictionary.take(pa.array(block[starts] % kinds))
    docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
    return pa.RecordBatch.from_arrays([rows["graph_id"].take(at), rows["segment"].take(at), term, *(pa.array(x, pa.int64()) for x in each), docs], BLOCKS)


def refreshed(index: LexicalIndex, docs: DataFrame, keep: Keep, generation: str) -> LexicalIndex:
    """The index of ``docs``, made from ``index`` by what differs: documents that came, went or have another text.

    Segments that nothing of this concerns are copied as they are.
    """
    now = docs.select("graph_id", "id", "text").withColumn("sign", _sign(F.col("text")))
    then = index.places.select(F.col("graph_id").alias("g"), F.col("id").alias("i"), F.col("sign").alias("s"), "segment")
    both = keep(now.join(then, F.col("graph_id").eqNullSafe(F.col("g")) & (F.col("id") == F.col("i")) & (F.col("sign") == F.col("s")), "full"))
    came, went = both.where("i is null"), both.where("id is null").select("g", F.col("segment").alias("gone_from"), F.col("i").alias("gone"))
    every = keep(both.where("i is not null").groupBy("g", "segment").agg(F.count("id").alias("left"), F.max(F.col("id").isNull()).alias("hurt")))
    few = F.col("left") < SEGMENT // 4
    pools = every.where(few).groupBy(F.col("g").alias("pool")).agg(F.count(F.lit(1)).alias("several"))
    every = every.join(pools, F.col("g").eqNullSafe(F.col("pool")), "left").withColumn("small", few & (F.col("several") > 1))
    touched = keep(every.where("hurt or small").select("g", F.col("segment").alias("s"), F.coalesce("small", F.lit(False)).alias("small")))
    small = touched.where("small")

    def of(df: DataFrame, segments: DataFrame, how: str) -> DataFrame:
        return df.join(segments, df["graph_id"].eqNullSafe(segments["g"]) & (df["segment"] == segments["s"]), how)

    def staying(df: DataFrame) -> DataFrame:
        return df.join(went, df["graph_id"].eqNullSafe(went["g"]) & (df["segment"] == went["gone_from"]) & (df["id"] == went["gone"]), "left_anti")

    open_ = keep(staying(LexicalIndex(of(index.blocks, touched, "left_semi"), index.places).postings))
    places = staying(index.places)
    thinned = of(open_, small, "left_anti")
    # Documents of small segments move: their terms are known, so their texts need not be.
    moving = keep(of(places, small, "left_semi").drop("segment"))
    moved = keep(_placed(moving, _kinds(moving), f"{generation}m").select(*PLACES))
    home = moved.select(F.col("graph_id").alias("g"), F.col("id").alias("i"), F.col("segment").alias("home"))
    loose = of(open_, small, "left_semi").join(home, F.col("graph_id").eqNullSafe(F.col("g")) & (F.col("id") == F.col("i")))
    rewritten = _blocks(thinned.unionByName(loose.withColumn("segment", F.col("home")).select(*thinned.columns)))
    new = build(came.select("graph_id", "id", "text"), keep, generation)
    return LexicalIndex(
        keep(of(index.blocks, touched, "left_anti").unionByName(rewritten).unionByName(new.blocks)),
        keep(of(places, small, "left_anti").unionByName(moved).unionByName(new.places)),
    )


# -- searches ------------------------------------------------------------------


def _impact(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


@dataclass
class Search:
    """Queries (query_id, graph_id, text) over an index; ``blocks`` are what of it they may touch, without postings."""

    index: LexicalIndex
    queries: DataFrame
    keep: Keep
    k1: float = K1
    b: float = B

    def __post_init__(self) -> None:
        asked = self.queries.select("query_id", F.col("graph_id").alias("g"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        heads = self.keep(self.index.blocks.select(*HEADS).join(asked.select("term").distinct(), "term", "left_semi"))
        frequency = heads.groupBy(F.col("graph_id").alias("g"), "term").agg(F.sum("df").alias("of_all"))
        stats = self.index.statistics()
        weighed = asked.join(frequency, asked["g"].eqNullSafe(frequency["g"]) & (asked["term"] == frequency["term"])).select("query_id", asked["g"], asked["term"], "of_all")
        weighed = weighed.join(stats, weighed["g"].eqNullSafe(stats["g"])).select(weighed["*"], "n", "avgdl")
        idf = F.log((F.col("n") - F.col("of_all") + 0.5) / (F.col("of_all") + 0.5) + 1)
        #: (query_id, g, term, idf, avgdl): what is asked, as far as any document has it.
        self.terms = self.keep(weighed.select("query_id", "g", "term", idf.alias("idf"), "avgdl"))
        met = heads.join(self.terms, heads["graph_id"].eqNullSafe(self.terms["g"]) & (heads["term"] == self.terms["term"]))
        bound = F.sum(F.col("idf") * _impact(F.col("most"), F.col("least"), F.col("avgdl"), self.k1, self.b))
        #: (query_id, g, segment, bound): no document of the segment scores more.
        self.bounds = self.keep(met.groupBy("query_id", "g", "segment").agg(bound.alias("bound")))

    def scores(self, where: DataFrame | None = None) -> DataFrame:
        """(query_id, id, bm25) of documents that share a term with a query, in the segments ``where`` (query_id, segment), or in all."""
        blocks = self.index.blocks
        own = blocks.join(self.terms, blocks["graph_id"].eqNullSafe(self.terms["g"]) & (blocks["term"] == self.terms["term"])).select("query_id", "segment", "idf", "avgdl", "docs")
        if where is not None:
            own = own.join(where, ["query_id", "segment"], "left_semi")
        own = own.select("query_id", "idf", "avgdl", F.inline("docs"))
        part = F.col("idf") * _impact(F.col("tf"), F.col("dl"), F.col("avgdl"), self.k1, self.b)
        return own.groupBy("query_id", "id").agg(F.greatest(F.round(F.sum(part), 6), F.lit(0.0)).alias("bm25"))

    def looked_at(self, limit: int, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(scores, segments): scores in the segments that can hold one of the ``limit`` best, and these segments.

        The k-th best score among the first segments is a floor under the k-th
        best of all, so a segment whose bound is less is never read. What is only
        equal may hold the smaller id and stays.
        """
        probes = PROBES * limit if probes is None else probes
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment")
        ranked = self.keep(self.bounds.withColumn("nth", F.row_number().over(best)))
        first = ranked.where(F.col("nth") <= probes)
        found = self.keep(self.scores(first.select("query_id", "segment")))
        own = Window.partitionBy("query_id").orderBy(F.desc("bm25"))
        floor = found.withColumn("k", F.row_number().over(own)).where(F.col("k") == limit).select("query_id", F.col("bm25").alias("floor"))
        rest = ranked.where(F.col("nth") > probes).join(floor, "query_id", "left")
        # Scores are rounded to six digits, and sums of doubles differ by their order.
        rest = self.keep(rest.where(F.col("floor").isNull() | (F.col("bound") + 2e-6 >= F.col("floor"))).select("query_id", "segment"))
        return found.unionByName(self.scores(rest)), first.select("query_id", "segment").unionByName(rest)

    def top(self, limit: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, bm25, rank): the ``limit`` best documents of each query, ties by id."""
        scored, _ = self.looked_at(limit, probes)
        own = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "id")
        return scored.withColumn("rank", F.row_number().over(own).cast("long")).where(F.col("rank") <= limit)
