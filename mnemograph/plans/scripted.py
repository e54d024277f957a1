"""Scripted inputs of the queries whose input is model output."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.functions.parsing import parse_extraction
from mnemograph.operators import ingest as fold
from mnemograph.schema import CHAT_TURNS, ENTITIES, FACTS
from mnemograph.sources.models import ExternalExtractor
from mnemograph.sources.review_table import parse_review_rows

_A = {"subjectName": "Ana", "objectName": None, "predicate": "likes", "factText": "drinks green tea", "isCorrection": False}
_B = {"subjectName": "Ana", "objectName": "north room", "predicate": "rents", "factText": "rents the north room", "isCorrection": True}

#: (id, what a model said); only answers that are exactly one array of sound facts count.
OUTPUTS = [
    (1, f"Here you are: {json.dumps([_A, _B])} Done."),
    (2, "not json at all"),
    (3, "[]"),
    (4, json.dumps([{**_A, "predicate": None}])),
    (5, json.dumps([_A, {**_B, "factText": 7}])),
    (6, f"{json.dumps([_A])} and {json.dumps([_B])}"),
    (7, json.dumps([{**_A, "extra": 1}])),
    (8, json.dumps([{k: v for k, v in _B.items() if k != "objectName"}])),
    (9, "[null]"),
    (10, str([_A]).replace("None", "null").replace("False", "false")),
    (11, json.dumps([{**_A, "isCorrection": "false"}])),
]
PARSED_SQL = [
    "(1, 0, 'Ana', NULL, 'drinks green tea', false)",
    "(1, 1, 'Ana', 'north room', 'rents the north room', true)",
    "(7, 0, 'Ana', NULL, 'drinks green tea', false)",
    "(8, 0, 'Ana', NULL, 'rents the north room', true)",
]
PARSED_SQL[0] = "(1::BIGINT, 0::BIGINT, 'Ana', NULL, 'drinks green tea', false)"

ORDERS = [
    (1, "[3, 1, 2]", ["a", "b", "c"]),
    (2, "I think [2, 1].", ["a", "b"]),
    (3, "[1, 1, 2]", ["a", "b", "c"]),
    (4, "[1, 2]", ["a", "b", "c"]),
    (5, "[1, 2, 3, 1]", ["a", "b", "c"]),
    (6, "[1, 2] or [2, 1]", ["a", "b"]),
    (7, "no idea", ["a", "b"]),
    (8, "[2.0, 1]", ["a", "b"]),
]
ORDERS_SQL = ["(1::BIGINT, 'c/a/b')", "(2, 'b/a')", "(3, 'a/b/c')", "(4, 'a/b/c')", "(5, 'a/b/c')", "(6, 'a/b')", "(7, 'a/b')", "(8, 'a/b')"]

#: Synonyms share an axis.
_VOCABULARY = [["purchase", "bought"], ["click", "opened"], ["the"], ["item"], ["gave"], ["up"], ["rents"], ["north"], ["room"], ["drinks", "sips"], ["green"], ["tea"], ["keeps"], ["cat"]]
VECTORS = {w: [float(k == i) for k in range(len(_VOCABULARY))] for i, group in enumerate(_VOCABULARY) for w in group}


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], ENTITIES), spark.createDataFrame([], FACTS)


def ingest(spark: SparkSession, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts, failed): purchases and clicks of each user as facts, errors as corrections, one graph for each user.

    There is no word table, so facts are equal by their texts only; no name is
    within another, so each is found by itself.
    """
    return fold.merge(_clean(events), *empty_graph(spark))


def ingest_people(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The entities of :func:`ingest`."""
    return fold.merge_people(_clean(events), empty_graph(spark)[0])


def _clean(events: DataFrame) -> DataFrame:
    k = F.concat(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1))
    own = events.where("event_type in ('purchase', 'click', 'error')").select(
        F.col("user_id").cast("string").alias("graph_id"),
        F.col("event_id").alias("episode_seq"),
        F.concat_ws(" ", "event_type", k).alias("user_text"),
        F.lit("ok").alias("assistant_text"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.lit(None).cast("string").alias("known_user_name"),
        F.array(
            F.struct(
                F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subjectName"),
                k.alias("objectName"),
                F.col("event_type").alias("predicate"),
                F.concat_ws(" ", "event_type", k).alias("factText"),
                (F.col("event_type") == "error").alias("isCorrection"),
            )
        ).alias("facts"),
    )
    turns = own.select(*CHAT_TURNS.names)
    return fold.clean_facts(turns, own.select("graph_id", "episode_seq", "facts"))


_RESPONSE = {
    "results": [
        {"id": "page-1", "properties": {"Name": {"title": [{"plain_text": "Ana"}]}, "Correction Notes": {"rich_text": [{"plain_text": "gave up "}, {"plain_text": "the north room"}]}}},
        {"id": "page-2", "properties": {"Name": {"title": [{"plain_text": "Bob"}]}, "Correction Notes": {"rich_text": [{"plain_text": "keeps no cat"}]}}},
        {"id": "page-3", "properties": {"Name": {"title": []}}},
        {"properties": {}},
    ]
}
_NOTES = {
    "page-1": [{"subjectName": "Ana", "objectName": None, "predicate": "rents", "factText": "gave up the north room", "isCorrection": True}],
    "page-2": [{"subjectName": "Bob", "objectName": None, "predicate": "keeps", "factText": "keeps no cat", "isCorrection": True}],
}


def _fact(subject: str, text: str, predicate: str, object_: str | None = None, wrong: bool = False) -> tuple:
    return subject, object_, predicate, text, wrong


#: (day, facts) of the turns of one graph, as they arrive. The last one is late.
_STORY = [
    (1, [_fact("Ana", "drinks green tea", "drinks"), _fact("it", "is nice", "is")]),
    (2, [_fact("Ana", "sips green tea", "drinks"), _fact("Ana", "DRINKS GREEN TEA", "drinks")]),
    (3, [_fact("Ana Ruiz", "rents the north room", "rents", "north room"), _fact("Bob", "keeps the cat", "keeps")]),
    (4, [_fact("Ana", "gave up the north room", "rents", "north room", True)]),
    (5, [_fact("Bob", "keeps no cat", "keeps", None, True), _fact("Bob", "paints", "paints", None, True)]),
    (6, []),
    (8, [_fact("Ana", "rents the north room", "rents", "north room")]),
    (7, [_fact("Ana", "left the north room", "rents", "north room", True)]),
]
FOLDED_FACTS = [("Ana", "drinks green tea", False), ("Ana", "rents the north room", True), ("Ana", "rents the north room", False), ("Bob", "keeps the cat", True)]
FOLDED_ENTITIES = [("Ana", "Ana Ruiz", "user"), ("Bob", "", "user"), ("north room", "", "other")]
FOLDED_FAILED = [(4, "paints"), (7, "left the north room")]
FOLDED_EPISODES = [(f"user: day {d}\nassistant: ok",) for d, said in _STORY if said]


def _story(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    kind = "array<struct<subjectName:string,objectName:string,predicate:string,factText:string,isCorrection:boolean>>"
    rows = spark.createDataFrame([(k, d, said) for k, (d, said) in enumerate(_STORY)], f"episode_seq long, day int, facts {kind}")
    own = rows.select(
        F.lit("g").alias("graph_id"),
        "episode_seq",
        F.concat(F.lit("day "), F.col("day").cast("string")).alias("user_text"),
        F.lit("ok").alias("assistant_text"),
        F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("occurred_at"),
        F.lit(None).cast("string").alias("known_user_name"),
        "facts",
    )
    return own.select(*CHAT_TURNS.names), own.select("graph_id", "episode_seq", "facts")


def folded(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts, failed) of the story: all but the last turn, then the last one, which is late."""
    turns, extractions = _story(spark)
    state, failed = empty_graph(spark), []
    for late in (False, True):
        own = turns.where(F.col("episode_seq") == len(_STORY) - 1) if late else turns.where(F.col("episode_seq") < len(_STORY) - 1)
        entities, facts, lost = fold.merge(fold.clean_facts(own, extractions), *state, VECTORS)
        state = entities, facts
        failed.append(lost)
    return *state, failed[0].unionByName(failed[1])


def folded_episodes(spark: SparkSession) -> DataFrame:
    turns, extractions = _story(spark)
    return fold.episodes(turns, fold.clean_facts(turns, extractions))


def import_corrections(spark: SparkSession) -> DataFrame:
    """(page_id, status, cleared): the outcome of each reviewed row, against a graph with one fact about Ana."""
    bodies = spark.createDataFrame([(json.dumps(_RESPONSE),)], "body string")
    rows = parse_review_rows(bodies)
    answers = spark.createDataFrame([(k, json.dumps(v)) for k, v in _NOTES.items()], "page_id string, output string")
    found = rows.join(answers, "page_id", "left").select("page_id", parse_extraction(F.coalesce("output", F.lit("[]"))).alias("facts"))
    number = F.regexp_extract("page_id", "([0-9]+)", 1).cast("long")
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    turns = rows.select(F.lit("g").alias("graph_id"), number.alias("episode_seq"), F.col("correction_notes").alias("user_text"), F.lit("").alias("assistant_text"), at.alias("occurred_at"), F.lit(None).cast("string").alias("known_user_name"))
    start = spark.createDataFrame([("g", 0, [{"subjectName": "Ana", "objectName": None, "predicate": "rents", "factText": "rents the north room", "isCorrection": False}])], "graph_id string, episode_seq long, facts array<struct<subjectName:string,objectName:string,predicate:string,factText:string,isCorrection:boolean>>")
    before = spark.createDataFrame([("g", 0, "", "", None, None)], CHAT_TURNS).withColumn("occurred_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    entities, facts, _ = fold.merge(fold.clean_facts(before, start), *empty_graph(spark), VECTORS)
    extractions = found.select(F.lit("g").alias("graph_id"), number.alias("episode_seq"), "facts")
    _, _, failed = fold.merge(fold.clean_facts(turns, extractions), entities, facts, VECTORS)
    outcome = found.join(failed.select(F.concat(F.lit("page-"), F.col("episode_seq").cast("string")).alias("page_id")).distinct().withColumn("failed", F.lit(True)), "page_id", "left")
    status = F.when(F.size("facts") == 0, "no_facts").when(F.col("failed"), "unmatched").otherwise("applied")
    return outcome.select("page_id", status.alias("status"), (status != "unmatched").alias("cleared"))


class SentenceChat:
    """A written model: every sentence of what the user said is a fact about its first word, and one that begins with "No" a correction."""

    def complete(self, messages: list, system: str | None = None) -> list[dict]:
        said = messages[-1][1][0]["text"].removeprefix("user: ").split("\nassistant: ")[0]
        sentences = [t for t in (part.strip(" ") for part in re.split(r"[.!?\n]+", said)) if t]
        facts = [{"subjectName": t.split(" ")[0], "objectName": None, "predicate": "said", "factText": t, "isCorrection": t.startswith("No ")} for t in sentences]
        return [{"text": json.dumps(facts)}]


def sentence_extractor() -> ExternalExtractor:
    return ExternalExtractor(SentenceChat())
