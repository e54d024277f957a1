"""Chat turns as a stream: each micro-batch is folded into the stored graph.

State is the stored graph itself, so a restart goes on from the last complete
version. A batch that is replayed after it was stored finds its episodes there
and leaves them out, so its facts are not merged twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemograph.operators import graph, ingest, lexical_index
from mnemograph.schema import natural_id
from mnemograph.sources.store import Store, joined, part_of

Extractor = Callable[[DataFrame], DataFrame]


def merge_turns(store: Store, turns: DataFrame, extract: Extractor, vectors: dict[str, list[float]] | None = None) -> int:
    """Fold a batch of chat turns; the store's version after it.

    ``extract`` gives (graph_id, episode_seq, facts) of turns. It is asked once,
    and its answer is written before anything uses it; so is what the fold gives.
    Only partitions of graphs in the batch are read and written again; episodes
    are added. All tables, the index of active facts among them, change with one
    manifest, or none does: a batch that is replayed after a failure starts from
    the tables it started from.
    """
    parts = [r[0] for r in turns.select(part_of(F.col("graph_id"))).distinct().collect()]  # at most PARTS
    seen = store.read("episodes", parts).select(F.col("id").alias("episode_id"))
    new = turns.withColumn("episode_id", natural_id(F.col("graph_id"), F.lit("episode"), F.col("episode_seq")))
    new = store.keep(new.join(seen, "episode_id", "left_anti").drop("episode_id"))
    try:
        clean = store.keep(ingest.clean_facts(new, store.keep(extract(new))))
        parts = [r[0] for r in clean.select(part_of(F.col("graph_id"))).distinct().collect()]
        if not parts:
            return store.version()
        now = store.manifest()
        entities, facts, _ = ingest.merge(clean, store.read("entities", parts), store.read("facts", parts), vectors, keep=store.keep)
        rewritten = {str(p) for p in parts}
        index = lexical_index.refreshed(stored_index(store, parts), graph.active(facts).select("graph_id", "id", F.col("fact_text").alias("text")), store.keep, str(store.version() + 1))
        changed = {"entities": entities, "facts": facts, "blocks": index.blocks, "places": index.places}
        for table, df in changed.items():
            now[table] = {p: f for p, f in now[table].items() if p not in rewritten} | store.stage(table, df)
        now["episodes"] = joined(now["episodes"], store.stage("episodes", ingest.episodes(new, clean)))
        return store.commit(now)
    finally:
        store.sweep()


def stored_index(store: Store, parts: list[int] | None = None) -> lexical_index.LexicalIndex:
    """The index of the active facts of all graphs, or of those in some partitions."""
    return lexical_index.LexicalIndex(store.read("blocks", parts), store.read("places", parts))


def ingest_stream(turns: DataFrame, store: Store, extract: Extractor, checkpoint: str, vectors: dict[str, list[float]] | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the stream; ``turns`` is a streaming frame of chat turns."""

    def batch(df: DataFrame, _: int) -> None:
        merge_turns(store, df, extract, vectors)

    writer = turns.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fact_counts(facts: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Facts by predicate and time window of a stream of facts; later ones than the watermark are left out."""
    timed = facts.withWatermark("valid_at", late)
    return timed.groupBy(F.window("valid_at", window), "predicate").agg(F.count(F.lit(1)).alias("n"))
