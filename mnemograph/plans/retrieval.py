"""Sessions over a memory graph: compilation, per-turn block, predicate-scoped block, reranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.functions.parsing import decode_order
from mnemograph.functions.text import joined_lines
from mnemograph.functions.vector import embed
from mnemograph.operators import graph
from mnemograph.operators.search import hybrid, with_floor

Reranker = Callable[[str, list[str]], list[str]]


def chat_reranker(complete: Callable[[str], str]) -> Reranker:
    """Orders candidates by asking a chat model; any failure leaves them as they are."""

    def rerank(query: str, candidates: list[str]) -> list[str]:
        if len(candidates) <= 1:
            return candidates
        listed = "\n".join(f"{i}. {c}" for i, c in enumerate(candidates, 1))
        try:
            order = decode_order(complete(f"Order these facts by how well they help with: {query}\n{listed}\nAnswer with a JSON array of their numbers."), len(candidates))
        except Exception:  # noqa: BLE001  whatever the service does, the search result stands
            return candidates
        return candidates if order is None else [candidates[i - 1] for i in order]

    return rerank


@dataclass
class Session:
    """One conversation. Its compilation is computed once, with the number of active facts then."""

    facts: DataFrame
    word_vectors: DataFrame | None = None
    fact_limit: int = 20
    #: Also compare which facts are active, not only how many.
    strict_gate: bool = False
    _memo: tuple[str, int, int] | None = field(default=None, repr=False)

    def start(self) -> None:
        """A new session: forget the compilation."""
        self._memo = None

    def _counts(self) -> tuple[int, int]:
        row = graph.active(self.facts).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("id").cast("decimal(38,0)")), F.lit(0))).first()
        return int(row[0]), int(row[1])

    def compilation(self) -> str:
        if self._memo is None:
            text = graph.compilation(self.facts, self.fact_limit).first()[0] or ""
            self._memo = (text, *self._counts())
        return self._memo[0]

    def exhaustive(self) -> bool:
        """Whether the compilation holds all active facts: then no search can add any."""
        if self._memo is None:
            return False
        _, n, sign = self._memo
        live, live_sign = self._counts()
        return n <= self.fact_limit and live == n and (not self.strict_gate or live_sign == sign)

    def per_turn(self, query: str, excluding: str = "", limit: int = 5, reranker: Reranker | None = None) -> str | None:
        """Facts that a turn needs beside the compilation; None if there are none to add."""
        if self.exhaustive():
            return None
        pool = without_known(graph.active(self.facts), excluding)
        block = self._block(query, pool, limit, floor=False)
        if block is None or reranker is None:
            return block
        # Each line is a candidate; an answer that is not the same set of lines is not taken.
        before = block.split("\n")
        after = reranker(query, before)
        return "\n".join(after) if set(after) == set(before) else block

    def scoped(self, query: str, predicate: str, limit: int = 3) -> str | None:
        """Facts of one predicate that share a content term with the query; scores are relative to that predicate."""
        return self._block(query, graph.active(self.facts).where(F.col("predicate") == predicate), limit, floor=True)

    def _block(self, query: str, pool: DataFrame, limit: int, floor: bool) -> str | None:
        spark = self.facts.sparkSession
        vector, coverage = [], 0.0
        if self.word_vectors is not None:
            one = spark.createDataFrame([("q", query)], "id string, text string")
            row = embed(one, self.word_vectors).first()
            vector, coverage = list(row["embedding"]), float(row["coverage"])
        docs = pool.select("id", F.col("fact_text").alias("text"), "embedding")
        literal = F.array(*map(F.lit, vector)).cast("array<float>") if vector else F.array().cast("array<float>")
        best = hybrid(query, literal, docs, limit, coverage)
        best = with_floor(best) if floor else best
        text = best.join(docs.select("id", "text"), "id").agg(joined_lines(F.struct(-F.col("rrf"), F.col("id")), F.col("text")).alias("t")).first()[0]
        return text or None


def without_known(facts: DataFrame, compilation: str) -> DataFrame:
    """Facts whose text is nowhere within the compilation, as a substring."""
    return facts.where(~F.contains(F.lit(compilation), F.col("fact_text")))


@dataclass
class ContextCache:
    """When a remote prompt cache is used: long texts only, again for the same text and model."""

    create: Callable[[str, str, int], str]
    refresh: Callable[[str, int], None]
    least_chars: int = 4000
    ttl_seconds: int = 3600
    _last: tuple[str, str, str] | None = field(default=None, repr=False)

    def name(self, text: str, model: str) -> str | None:
        if len(text) < self.least_chars:
            return None
        if self._last and self._last[:2] == (text, model):
            try:
                self.refresh(self._last[2], self.ttl_seconds)
            except Exception:  # noqa: BLE001  a cache that could not be refreshed may still be there
                pass
            return self._last[2]
        try:
            name = self.create(text, model, self.ttl_seconds)
        except Exception:  # noqa: BLE001  without a cache the text is sent itself
            return None
        self._last = (text, model, name)
        return name

    def reset(self) -> None:
        self._last = None
