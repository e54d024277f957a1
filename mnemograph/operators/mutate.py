"""Edits of the graph as functions of frames: each returns the new frame and one row with the number affected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.operators import vector_join
from mnemograph.sources.working import Keep, keeper

#: Least similarity for a correction without an object, and for a duplicate.
CORRECTION, DUPLICATE = 0.5, 0.85


def _affected(df: DataFrame, hit: Column) -> DataFrame:
    return df.agg(F.coalesce(F.count_if(hit), F.lit(0)).alias("affected"))


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Unconditional append."""
    return df.unionByName(rows, allowMissingColumns=True)


def update_entity(entities: DataFrame, id_: str, name: str, summary: str) -> tuple[DataFrame, DataFrame]:
    """New name and summary; embedding and aliases stay."""
    hit = F.col("id") == id_
    new = entities.withColumns({"name": F.when(hit, F.lit(name)).otherwise(F.col("name")), "summary": F.when(hit, F.lit(summary)).otherwise(F.col("summary"))})
    return new, _affected(entities, hit)


def update_fact(facts: DataFrame, id_: str, fact_text: str) -> tuple[DataFrame, DataFrame]:
    """New text of a fact, active or not; its embedding stays as it was."""
    hit = F.col("id") == id_
    return facts.withColumn("fact_text", F.when(hit, F.lit(fact_text)).otherwise(F.col("fact_text"))), _affected(facts, hit)


def delete_entity(entities: DataFrame, facts: DataFrame, id_: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts, affected) without the entity and the facts that it is an end of."""
    hit = F.col("id") == id_
    end = (F.col("subject_id") == id_) | F.col("object_id").eqNullSafe(id_)
    return entities.where(~hit), facts.where(~end), _affected(entities, hit)


def delete_all(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables, empty."""
    return tuple(t.limit(0) for t in tables)


def _ended(facts: DataFrame, hit: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(hit, F.lit(False)) & F.col("invalid_at").isNull()
    return facts.withColumn("invalid_at", F.when(hit, at).otherwise(F.col("invalid_at"))), _affected(facts, hit)


def invalidate_predicate(facts: DataFrame, subject_id: str, predicate: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Ends all active facts of a subject and predicate."""
    return _ended(facts, (F.col("subject_id") == subject_id) & (F.col("predicate") == predicate), at)


def invalidate_object(facts: DataFrame, subject_id: str, object_id: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Ends all active facts of a subject and object."""
    return _ended(facts, (F.col("subject_id") == subject_id) & (F.col("object_id") == object_id), at)


def invalidate_fact(facts: DataFrame, id_: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Ends one fact if it is active."""
    return _ended(facts, F.col("id") == id_, at)


def _least(minimum: float) -> None:
    if minimum <= 0:
        raise ValueError("a least similarity of 0 or less would be all pairs")


def nearest(facts: DataFrame, corrections: DataFrame, minimum: float = CORRECTION, keep: Keep | None = None) -> DataFrame:
    """(correction_id, id, similarity): for each correction the active subject-only fact nearest to it, if near enough.

    ``corrections`` is (correction_id, subject_id, embedding). Blocks of a
    subject's facts that bounds leave are multiplied (:mod:`vector_join`); the best
    of each correction, by six digits and then by id, is a combinable aggregate.
    What cannot pair there (null, zero, odd vectors) is near nothing.
    """
    _least(minimum)
    keep = keep or keeper(facts.sparkSession)
    own = vector_join.usable(facts.where(F.col("invalid_at").isNull() & F.col("object_id").isNull()), "subject_id", "id", "embedding")
    asked = keep(vector_join.usable(corrections, "subject_id", "correction_id", "embedding"))
    own = keep(own.join(asked.select("g").distinct(), "g", "left_semi"))
    pivots = vector_join.pivots(own)
    found = vector_join.products(vector_join.blocks(asked, pivots, keep), vector_join.blocks(own, pivots, keep), minimum, keep, best=True)
    scored = found.select(F.col("x").alias("correction_id"), F.col("y").alias("id"), F.round("product", 6).alias("similarity"))
    best = scored.where(F.col("similarity") >= minimum).groupBy("correction_id").agg(F.max("similarity").alias("similarity"), F.min_by("id", F.struct(-F.col("similarity"), "id")).alias("id"))
    return best.select("correction_id", "id", "similarity")


def invalidate_nearest(facts: DataFrame, corrections: DataFrame, at: Column, minimum: float = CORRECTION, keep: Keep | None = None) -> DataFrame:
    """``facts`` with what :func:`nearest` finds ended."""
    hit = nearest(facts, corrections, minimum, keep).select("id", F.lit(True).alias("hit")).distinct()
    return facts.join(hit, "id", "left").withColumn("invalid_at", F.when(F.col("hit"), at).otherwise(F.col("invalid_at"))).select(facts.columns)


def exact_duplicates_removed(facts: DataFrame) -> DataFrame:
    """The first of facts with equal subject and text, whatever case; object and predicate do not count."""
    first = F.min(F.struct("valid_at", "id", F.struct(*facts.columns).alias("f")))
    return facts.groupBy("subject_id", F.lower("fact_text").alias("key")).agg(first.alias("m")).select("m.f.*")


def near_duplicate_pairs(vectors: DataFrame, group: str, id_: str, embedding: str, minimum: float = DUPLICATE, keep: Keep | None = None) -> DataFrame:
    """(a, b, similarity), a < b: vectors of a group that are at least as similar as ``minimum``.

    Blocks that bounds leave are multiplied (:mod:`vector_join`), not all pairs of
    a group. Rows of equal id do not pair; null, zero and odd vectors pair with nothing.
    """
    _least(minimum)
    keep = keep or keeper(vectors.sparkSession)
    rows = keep(vector_join.usable(vectors, group, id_, embedding))
    found = vector_join.products(vector_join.blocks(rows, vector_join.pivots(rows), keep), None, minimum, keep)
    pairs = found.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("product", 6).alias("similarity"))
    return pairs.where(F.col("similarity") >= minimum)


def supersession(facts: DataFrame) -> DataFrame:
    """``facts`` with ``superseded_at``: when the next fact of the subject and predicate begins."""
    own = Window.partitionBy("subject_id", "predicate").orderBy("valid_at", "id")
    return facts.withColumn("superseded_at", F.lead("valid_at").over(own))
