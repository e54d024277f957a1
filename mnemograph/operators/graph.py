"""Reading the graph: active facts, degrees, ranking, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.functions.text import joined_lines
from mnemograph.schema import kind


def active(facts: DataFrame) -> DataFrame:
    """Facts without an end of validity; no clock is consulted. The filter reaches the Parquet scan."""
    return facts.where(F.col("invalid_at").isNull())


def facts_as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts valid at an instant: begun by then and not ended by then."""
    return facts.where((F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))


def with_validity(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """``facts`` with ``invalid_at``: the first correction of the same subject and object after ``valid_at``.

    ``corrections`` is (subject_id, object_id, ts). Facts without an object have
    none and pass by. One shuffle on (subject, object): facts and corrections
    are put in one order, the newest first, and each fact takes the least
    correction so far, which is a running minimum: linear in a key's rows.
    """
    cols = [c for c in facts.columns if c != "invalid_at"]
    open_ = facts.where("object_id is null").select(*cols, F.lit(None).cast("timestamp").alias("invalid_at"))
    own = facts.where("object_id is not null").select(F.struct(*cols).alias("f"), "subject_id", "object_id", F.col("valid_at").alias("t"), F.lit(None).cast("timestamp").alias("c"))
    other = corrections.where("object_id is not null").select(F.lit(None).cast(own.schema["f"].dataType).alias("f"), "subject_id", "object_id", F.col("ts").alias("t"), F.col("ts").alias("c"))
    # At one instant facts come before corrections: a correction at the same instant is not later.
    order = [F.desc("t"), F.col("c").isNotNull()]
    later = Window.partitionBy("subject_id", "object_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = own.unionByName(other).withColumn("invalid_at", F.min("c").over(later)).where("f is not null")
    return joined.select("f.*", "invalid_at").unionByName(open_).select(*cols, "invalid_at")


def degrees(facts: DataFrame) -> DataFrame:
    """(entity_id, degree): how often an entity is subject or object; a loop counts twice."""
    ends = facts.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id"))
    return ends.where("entity_id is not null").groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))


def with_degree(facts: DataFrame) -> DataFrame:
    """``facts`` with the ``degree`` of their subject."""
    return facts.join(degrees(facts).withColumnRenamed("entity_id", "subject_id"), "subject_id").select(*facts.columns, "degree")


def ranked() -> list[Column]:
    """Order of facts with a degree: well-connected subjects first, then the newest, then by id."""
    return [F.desc("degree"), F.desc("valid_at"), F.asc("id")]


def top_facts(facts: DataFrame, limit: int = 20) -> DataFrame:
    """The first facts of the ranking, with their ``rank`` from 1: a top-k that is merged from partial ones."""
    best = with_degree(facts).orderBy(*ranked()).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*ranked())).cast("long"))


def compilation(facts: DataFrame, limit: int = 20) -> DataFrame:
    """One row, ``compilation``: the texts of the top active facts, one a line."""
    top = top_facts(active(facts), limit)
    return top.agg(joined_lines(F.col("rank"), F.col("fact_text")).alias("compilation"))


def nodes(entities: DataFrame) -> DataFrame:
    """Every entity as a node, isolated ones included."""
    return entities.select("id", "name", kind(F.col("kind")).alias("kind"))


def links(facts: DataFrame) -> DataFrame:
    """Active facts with an object as links; ends need not exist."""
    own = active(facts).where(F.col("object_id").isNotNull())
    return own.select(F.col("subject_id").alias("source"), F.col("object_id").alias("target"), F.col("predicate").alias("label"))


def graph_json(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """One row, ``json``: all nodes and links. It is one document by nature; large graphs use nodes() and links()."""
    n = nodes(entities).agg(F.sort_array(F.collect_list(F.struct("id", "name", "kind"))).alias("nodes"))
    e = links(facts).agg(F.sort_array(F.collect_list(F.struct("source", "target", "label"))).alias("links"))
    return n.join(e).select(F.to_json(F.struct("nodes", "links")).alias("json"))


def graph_lines(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """``json``: one row for each node and each link, for graphs of any size."""
    n = nodes(entities).select(F.to_json(F.struct(F.struct("id", "name", "kind").alias("node"))).alias("json"))
    return n.unionByName(links(facts).select(F.to_json(F.struct(F.struct("source", "target", "label").alias("link"))).alias("json")))


def export_rows(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Review-table rows of active facts whose subject exists."""
    subjects = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"), kind(F.col("kind")).alias("kind"))
    return (
        active(facts)
        .join(subjects, "subject_id")
        .select(
            "subject_name",
            "kind",
            "fact_text",
            F.col("valid_at").alias("valid_from"),
            F.lit(False).alias("needs_review"),
            F.lit("").alias("correction_notes"),
        )
    )


def orphans(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Active facts whose subject does not exist."""
    return active(facts).join(entities.select(F.col("id").alias("subject_id")), "subject_id", "left_anti").select(facts.columns)
