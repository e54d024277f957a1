"""BM25 of a stated set of queries as blocked products: of each document only the words that some query asks for.

Texts are read once. What is left of a document is its length and the numbers and
counts of its asked words; nothing is exploded, and no pair of a query and a
document becomes a row unless it is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.functions.text import tokens
from mnemograph.operators.nearest import Best, rounded

#: Weights of a block of queries, and cells of documents and words, or documents and queries, that are held at once.
WEIGHTS, CELLS = 1 << 22, 1 << 21


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, terms): what each of ``queries`` (query_id, text) asks for, as a set."""
    return queries.select("query_id", F.coalesce(F.array_distinct(tokens(F.col("text"))), F.array().cast("array<string>")).alias("terms"))


def block_size(terms: DataFrame, most: int) -> tuple[int, int]:
    """(queries, queries of a block) of ``terms`` (query_id, terms), so that the weights of a block are bounded, about."""
    n, words = terms.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    return n, max(1, min(most, int((WEIGHTS / max(1.0, (words or 0) / max(1, n))) ** 0.5)))


def count_asked(docs: DataFrame, vocabulary: list[str], key: str = "id") -> DataFrame:
    """(key, dl, t, tf) of ``docs`` (key, text): length in words, numbers in ``vocabulary`` of the asked words, and counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            words = batch["w"]
            t = pc.index_in(words.flatten(), value_set=known)
            hit = np.flatnonzero(t.is_valid().to_numpy(zero_copy_only=False))
            sizes = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)[hit]
            pair, n = np.unique(row * np.int64(len(known) + 1) + t.take(pa.array(hit)).to_numpy(zero_copy_only=False), return_counts=True)
            row, own = np.divmod(pair, len(known) + 1)
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (own, n)]
            yield pa.RecordBatch.from_arrays([batch[key], words.value_lengths().cast(pa.int64()), *lists], [key, "dl", "t", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, tokens(F.col("text")).alias("w")).mapInArrow(count, f"{key} {kind}, dl long, t array<int>, tf array<int>")


@dataclass
class Statistics:
    """Of a pool, for the words that are asked for: how many documents there are and have each, and their mean length."""

    n: int
    avgdl: float
    df: np.ndarray

    @classmethod
    def of(cls, counted: DataFrame, words: int) -> Statistics:
        n, avgdl = counted.agg(F.count(F.lit(1)), F.avg("dl")).first()
        df = np.zeros(words, np.int64)
        for r in counted.select(F.explode("t").alias("t")).groupBy("t").count().toLocalIterator():
            df[r["t"]] = r["count"]
        return cls(n, avgdl or 0.0, df)

    def idf(self, t: np.ndarray) -> np.ndarray:
        return np.log((self.n - self.df[t] + 0.5) / (self.df[t] + 0.5) + 1)


class Words:
    """The weights of a block of queries, each a list of numbers of words; ``n`` of them."""

    def __init__(self, queries: list[list[int]], stats: Statistics, k1: float, b: float):
        self.n, self.k1, self.b, self.avgdl = len(queries), k1, b, stats.avgdl
        self.own = np.unique(np.array([t for q in queries for t in q], np.int64))
        self.weights = np.zeros((self.n, len(self.own)))
        for i, q in enumerate(queries):
            if q:
                self.weights[i, np.searchsorted(self.own, q)] = stats.idf(np.array(q, np.int64))

    def scores(self, batch: pa.RecordBatch, key: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(keys, scores, a row for each query) of some documents at a time, not rounded; 0 where no word is shared."""
        step = max(1, CELLS // max(1, self.n, len(self.own)))
        for at in range(0, batch.num_rows, step):
            own = batch.slice(at, step)
            t, tf = (own[c].flatten().to_numpy() for c in ("t", "tf"))
            row = np.repeat(np.arange(own.num_rows), own["t"].value_lengths().to_numpy())
            place = np.searchsorted(self.own, t)
            there = place < len(self.own)
            there[there] = self.own[place[there]] == t[there]
            row, place, tf = row[there], place[there], tf[there]
            dl = own["dl"].fill_null(0).to_numpy()[row]
            cells = np.zeros((own.num_rows, len(self.own)))
            cells[row, place] = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl)) if len(row) else 0.0
            yield own[key], self.weights @ cells.T

    def strips(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, scores with six digits), as :class:`mnemograph.operators.hybrid._Vectors` gives similarities."""
        for nth, found in self.scores(batch, "nth"):
            yield nth.to_numpy(), rounded(found)

    def top(self, batches: Iterator[pa.RecordBatch], ids: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
        """(query_id, id, bm25): of documents in the order of ids, the ``limit`` best that share a word with a query."""
        best, kind = Best(self.n, limit), None
        for batch in batches:
            kind = batch.schema.field("id").type
            for own, found in self.scores(batch, "id"):
                # A score may round to 0; what shares no word comes after that.
                best.add(own, np.where(found > 0, found, -1.0), None)
        if kind is not None:
            q, found, scores = best.rows()
            own = pa.array(np.flatnonzero(pc.greater_equal(scores, 0.0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)).take(own), pa.array(found, kind).take(own), scores.take(own)], ["query_id", "id", "bm25"])
