"""Tables of the memory graph: explicit schemas and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("user", "subject", "other")

ENTITIES = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("external_ref", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

EPISODES = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("id", T.StringType(), False),
        T.StructField("raw_text", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
    ]
)

FACTS = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("id", T.StringType(), False),
        T.StructField("subject_id", T.StringType(), False),
        T.StructField("object_id", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("fact_text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("valid_at", T.TimestampType()),
        T.StructField("invalid_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)


#: The lexical index: blocks of postings, and where documents lie; ``words`` counts repeats, ``chars`` is the length and ``sign`` a hash of a text.
INDEX_BLOCKS = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("df", T.LongType()),
        T.StructField("most", T.LongType()),
        T.StructField("least", T.LongType()),
        T.StructField("words", T.LongType()),
        T.StructField("docs", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())]))),
    ]
)

INDEX_PLACES = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("chars", T.LongType()),
        T.StructField("sign", T.LongType()),
    ]
)

CHAT_TURNS = T.StructType(
    [
        T.StructField("graph_id", T.StringType()),
        T.StructField("episode_seq", T.LongType()),
        T.StructField("user_text", T.StringType()),
        T.StructField("assistant_text", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("known_user_name", T.StringType()),
    ]
)

EXTRACTED_FACT = T.StructType(
    [
        T.StructField("subjectName", T.StringType(), False),
        T.StructField("objectName", T.StringType()),
        T.StructField("predicate", T.StringType(), False),
        T.StructField("factText", T.StringType(), False),
        T.StructField("isCorrection", T.BooleanType(), False),
    ]
)

REVIEW_ROWS = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("subject_name", T.StringType()),
        T.StructField("correction_notes", T.StringType()),
    ]
)

EXPORT_ROWS = T.StructType(
    [
        T.StructField("subject_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("fact_text", T.StringType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("needs_review", T.BooleanType()),
        T.StructField("correction_notes", T.StringType()),
    ]
)


def kind(raw: Column) -> Column:
    """A stored kind; whatever is not known reads as ``other``."""
    return F.when(raw.isin(*KINDS), raw).otherwise("other")


def natural_id(*parts: Column) -> Column:
    """An id that a retried task computes again, from a natural key; nulls and lengths are kept apart."""
    tagged = [F.when(p.isNull(), "-").otherwise(F.concat(F.length(p.cast("string")), F.lit(":"), p.cast("string"))) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *tagged), 256), 1, 32)
