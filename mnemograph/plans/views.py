"""The driver tables read as a memory graph, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.operators.graph import with_validity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, the same in every session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.concat(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1))
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"),
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_id"),
        F.when(F.col("event_type").isin("purchase", "click", "error"), k).alias("object_id"),
        F.col("event_type").alias("predicate"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of events, before any correction."""
    what = F.concat_ws(" ", "predicate", F.coalesce("object_id", F.lit("session")))
    return _events(spark, sf_dir).where("predicate <> 'error'").select(
        "id",
        "event_id",
        "subject_id",
        "object_id",
        "predicate",
        what.alias("what"),
        F.concat_ws(" ", what, F.col("cents").cast("string")).alias("fact_text"),
        F.col("ts").alias("valid_at"),
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("predicate = 'error'").select("id", "event_id", "subject_id", "object_id", "ts")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the end that the next correction of subject and object gives them."""
    return with_validity(raw_facts(spark, sf_dir), corrections(spark, sf_dir))


def with_vectors(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds ``embedding``: that of row event_id modulo the number of vectors."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count(F.lit(1)).alias("n_vectors"))
    return df.join(n).withColumn("vec_id", F.col("event_id") % F.col("n_vectors")).join(vectors, "vec_id").drop("vec_id", "n_vectors")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of events, named after customers where there is one, and the keys that events mention."""
    ends = _events(spark, sf_dir)
    users = ends.select(F.col("subject_id").alias("id")).distinct()
    names = read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"), "c_name")
    users = users.join(names, "id", "left").select("id", F.coalesce("c_name", "id").alias("name"), F.lit("user").alias("kind"))
    keys = ends.where("object_id is not null").select(F.col("object_id").alias("id")).distinct()
    return users.unionByName(keys.select("id", F.col("id").alias("name"), F.lit("other").alias("kind")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a query."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it."""
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").where("role <> 'system'")
    turns = turns.withColumns({"next_role": F.lead("role").over(own), "assistant_text": F.lead("text").over(own)})
    return turns.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user_text"), "assistant_text")


#: The same as SQL. Every query takes what it needs of these.
SQL = {
    "ev": """ev AS (SELECT 'f' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, event_id, 'u' || CAST(user_id AS VARCHAR) AS subject_id,
        CASE WHEN event_type IN ('purchase', 'click', 'error') THEN 'k' || regexp_extract(props, '([0-9]+)', 1) END AS object_id,
        event_type AS predicate, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""",
    "raw": """raw AS (SELECT id, event_id, subject_id, object_id, predicate, predicate || ' ' || coalesce(object_id, 'session') AS what,
        predicate || ' ' || coalesce(object_id, 'session') || ' ' || CAST(cents AS VARCHAR) AS fact_text, ts AS valid_at FROM ev WHERE predicate <> 'error')""",
    "facts": """facts AS (SELECT r.*, (SELECT min(c.ts) FROM ev c WHERE c.predicate = 'error' AND c.subject_id = r.subject_id
        AND c.object_id = r.object_id AND c.ts > r.valid_at) AS invalid_at FROM raw r)""",
    "active": "active AS (SELECT * FROM facts WHERE invalid_at IS NULL)",
    "degrees": """degrees AS (SELECT entity_id, count(*) AS degree FROM (SELECT subject_id AS entity_id FROM active
        UNION ALL SELECT object_id FROM active WHERE object_id IS NOT NULL) GROUP BY entity_id)""",
    "top": """top AS (SELECT a.*, row_number() OVER (ORDER BY d.degree DESC, a.valid_at DESC, a.id) AS rank
        FROM active a JOIN degrees d ON d.entity_id = a.subject_id)""",
    "entities": """entities AS (SELECT u.id, coalesce(c.c_name, u.id) AS name, 'user' AS kind FROM (SELECT DISTINCT subject_id AS id FROM ev) u
        LEFT JOIN customer c ON 'u' || CAST(c.c_custkey AS VARCHAR) = u.id
        UNION ALL SELECT DISTINCT object_id, object_id, 'other' FROM ev WHERE object_id IS NOT NULL)""",
    "vectors": """vectors AS (SELECT f.*, CAST(e.embedding AS DOUBLE[]) AS embedding FROM facts f JOIN embeddings e
        ON e.vec_id = f.event_id % (SELECT count(*) FROM embeddings))""",
    "episodes": """episodes AS (SELECT conv_id, turn, text AS user_text, assistant_text FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS assistant_text
        FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')""",
}
_NEEDS = {"raw": ["ev"], "facts": ["ev", "raw"], "active": ["facts"], "degrees": ["active"], "top": ["active", "degrees"], "entities": ["ev"], "vectors": ["facts"]}


def with_(names: str, extra: str = "") -> str:
    """A WITH clause of views and what they need, each once, in order; ``extra`` are more of them."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names.split():
        add(n)
    parts = [SQL[n] for n in wanted] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
