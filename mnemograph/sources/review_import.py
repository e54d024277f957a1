"""Corrections that people wrote into the review table, taken back into the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.operators import graph, ingest, lexical_index
from mnemograph.sources.review_table import clear_body
from mnemograph.sources.store import Store, joined, part_of
from mnemograph.streaming.ingest_stream import stored_index


def outcomes(rows: DataFrame, clean: DataFrame, failed: DataFrame) -> DataFrame:
    """(page_id, status, cleared) of review rows with their ``episode_seq``.

    A row without any fact is done, as is one whose facts were applied; one with
    a correction that corrected nothing is left for its author.
    """
    found = clean.select("episode_seq").distinct().withColumn("found", F.lit(True))
    lost = failed.select("episode_seq").distinct().withColumn("lost", F.lit(True))
    out = rows.join(found, "episode_seq", "left").join(lost, "episode_seq", "left")
    status = F.when(F.col("found").isNull(), "no_facts").when(F.col("lost"), "unmatched").otherwise("applied")
    return out.select("page_id", status.alias("status"), (status != "unmatched").alias("cleared"))


def import_corrections(
    store: Store,
    rows: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    graph_id: str,
    at,
    first_seq: int,
    send: Callable[[str, str, str], str] | None = None,
    vectors: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Apply review rows (page_id, correction_notes) to a graph at the time ``at``; the outcome of each.

    A note is an episode of its own, numbered from ``first_seq`` in the order of
    page ids, and goes through the same extraction and fold as a chat turn. The
    flag of each row that is done is cleared with ``send`` after the graph is
    stored: a failure between the two applies a note again, which changes nothing.
    """
    spark = rows.sparkSession
    # A review is written by hand: its rows are few, and each is answered with one request.
    notes = sorted((r["page_id"], r["correction_notes"]) for r in rows.select("page_id", "correction_notes").collect())
    turns = spark.createDataFrame([(graph_id, first_seq + k, t or "", "", p) for k, (p, t) in enumerate(notes)], "graph_id string, episode_seq long, user_text string, assistant_text string, page_id string")
    turns = turns.withColumns({"occurred_at": at, "known_user_name": F.lit(None).cast("string")})
    try:
        clean = store.keep(ingest.clean_facts(turns, store.keep(extract(turns.drop("page_id")))))
        part = spark.range(1).select(part_of(F.lit(graph_id))).first()[0]
        entities, facts, failed = ingest.merge(clean, store.read("entities", [part]), store.read("facts", [part]), vectors, keep=store.keep)
        index = lexical_index.refreshed(stored_index(store, [part]), graph.active(facts).select("graph_id", "id", F.col("fact_text").alias("text")), store.keep, str(store.version() + 1))
        now = store.manifest()
        for table, df in {"entities": entities, "facts": facts, "blocks": index.blocks, "places": index.places}.items():
            now[table] = {p: f for p, f in now[table].items() if p != str(part)} | store.stage(table, df)
        now["episodes"] = joined(now["episodes"], store.stage("episodes", ingest.episodes(turns.drop("page_id"), clean)))
        done = outcomes(turns.select("page_id", "episode_seq"), clean, failed).orderBy("page_id").collect()
        store.commit(now)
    finally:
        store.sweep()
    for r in done:
        if send is not None and r["cleared"]:
            send("PATCH", f"/pages/{r['page_id']}", clear_body())
    return spark.createDataFrame(done, "page_id string, status string, cleared boolean")
