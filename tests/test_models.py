"""Model adapters, settings, the import of corrections and the store, all without a network."""

import json
import time

import pytest
from pyspark.sql import functions as F

from mnemograph.operators import graph
from mnemograph.schema import CHAT_TURNS, FACTS
from mnemograph.settings import DEFAULT_NAME, MemorySettings, Persona
from mnemograph.sources import models, review_import, review_table
from mnemograph.sources.store import Store
from mnemograph.streaming.ingest_stream import merge_turns

VECTORS = {w: [float(w == x) for x in ("tea", "room", "cat")] for w in ("tea", "room", "cat")}
KIND = "graph_id string, episode_seq long, facts array<struct<subjectName:string,objectName:string,predicate:string,factText:string,isCorrection:boolean>>"


def said(text, wrong=False, object_=None):
    return ("Ana", object_, "p", text, wrong)


def as_json(*facts):
    names = ("subjectName", "objectName", "predicate", "factText", "isCorrection")
    return json.dumps([dict(zip(names, f, strict=True)) for f in facts])


def turns(spark, *seqs):
    rows = [("g", s, f"text {s}", "ok", None, None) for s in seqs]
    return spark.createDataFrame(rows, CHAT_TURNS).withColumn("occurred_at", (F.lit(1_700_000_000) + F.col("episode_seq") * 60).cast("timestamp"))


def test_remote_chat():
    sent = []

    def send(method, path, body):
        sent.append((method, path, json.loads(body)))
        return json.dumps({"candidates": [{"content": {"parts": [{"text": "hello"}]}}]})

    chat = models.RemoteChat(send, "m-1")
    talk = [("user", [{"text": "a"}]), ("assistant", [{"text": "b"}]), ("user", [{"image": "x"}, {"text": "c"}]), ("user", [])]
    assert chat.complete(talk, "sys") == [{"text": "hello"}] and list(chat.stream(talk)) == ["hello"]
    assert sent[0][:2] == ("POST", "/models/m-1:generateContent")
    assert sent[0][2] == {"contents": [{"role": "user", "parts": [{"text": "a"}]}, {"role": "model", "parts": [{"text": "b"}]}], "systemInstruction": {"parts": [{"text": "sys"}]}}
    chat.complete(talk, "sys", cached="c/1")
    assert sent[-1][2]["cachedContent"] == "c/1" and "systemInstruction" not in sent[-1][2]


@pytest.mark.parametrize("body", ["", "x", "[]", "{}", '{"candidates": []}', '{"candidates": [{"content": {"parts": [{"text": 1}]}}]}'])
def test_answers_without_text(body):
    assert models.answer_text(body) == "" and models.cache_name(body) is None


def test_cache_client():
    sent = []
    client = models.CacheClient(lambda *x: sent.append(x) or '{"name": "cachedContents/1"}')
    assert client.create("sys", "m", 60) == "cachedContents/1"
    client.refresh("cachedContents/1", 30)
    assert [(m, p, json.loads(b)) for m, p, b in sent] == [
        ("POST", "/cachedContents", {"model": "models/m", "systemInstruction": {"parts": [{"text": "sys"}]}, "ttl": "60s"}),
        ("PATCH", "/cachedContents/1", {"ttl": "30s"}),
    ]
    with pytest.raises(ValueError):
        models.CacheClient(lambda *_: "{}").create("sys", "m", 60)


class Written:
    """A chat model that gives written answers."""

    def __init__(self, parts):
        self.parts, self.systems = parts, []

    def complete(self, messages, system=None):
        self.systems.append(system)
        return self.parts


def test_extractors_and_their_choice():
    chat = Written([{"text": as_json(said("grows figs"))}])
    assert models.ExternalExtractor(chat).extract("x")[0]["factText"] == "grows figs" and chat.systems[0]
    assert models.ExternalExtractor(Written([{"image": 1}])).extract("x") == []
    order = []
    local = models.LocalExtractor(lambda: order.append("load") or chat, lambda work: order.append("turn") or models.one_at_a_time()(work))
    assert len(local.extract("x")) == 1 and order == ["turn", "load"]
    settings = MemorySettings(secrets={})
    remote = {"gemini": lambda key: Written([{"text": key}])}
    assert models.make_extractor(settings, local, remote) is local
    assert settings.select("extraction", "gemini") and not settings.select("extraction", "gemini") and settings.chat == "local"
    assert models.make_extractor(settings, local, remote) is local
    settings.set_key("gemini", "k")
    assert models.make_extractor(settings, local, remote).chat.parts == [{"text": "k"}]
    settings.clear_key("gemini")
    assert settings.key("gemini") is None and MemorySettings(extraction="odd", secrets={}).extraction == "local"
    with pytest.raises(ValueError):
        settings.select("extraction", "odd")


def test_persona():
    p = Persona()
    assert p.name == DEFAULT_NAME and p.user_name == ""
    assert p.update_user_name("  Ana\n") and p.user_name == "Ana" and not p.update_user_name("Ana ")
    assert p.update("Nia", "calm") and not p.update("Nia", "calm")


def test_each_turn_is_asked_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Model:
        def extract(self, text):
            calls.add(1)
            if "1" in text:
                raise RuntimeError("no answer")
            return [dict(subjectName="Ana", objectName=None, predicate="p", factText=text.split("\n")[0], isCorrection=False)]

    store = Store(spark, f"file://{tmp_path}/g")
    merge_turns(store, turns(spark, 0, 1, 2), models.extraction_of(Model), VECTORS)
    assert calls.value == 3 and store.read("facts").count() == 2 and store.read("episodes").count() == 2
    assert not (tmp_path / "g" / "working").exists()


def test_replay_after_a_lost_write(spark, tmp_path, monkeypatch):
    """A batch that dies between its writes leaves the tables as they were, and its replay corrects once."""
    answers = spark.createDataFrame([("g", 0, [said("room tea")]), ("g", 1, [said("room")]), ("g", 2, [said("no room", wrong=True)])], KIND)
    extract = lambda df: df.select("graph_id", "episode_seq").join(answers, ["graph_id", "episode_seq"])
    store = Store(spark, f"file://{tmp_path}/g")
    merge_turns(store, turns(spark, 0, 1), extract, VECTORS)
    before, stage, show = store.version(), Store.stage, lambda: sorted((r["fact_text"], r["invalid_at"] is None) for r in store.read("facts").collect())
    was = show()

    def dying(self, table, df):
        if table == "episodes":
            raise OSError("lost")
        return stage(self, table, df)

    monkeypatch.setattr(Store, "stage", dying)
    with pytest.raises(OSError):
        merge_turns(store, turns(spark, 2), extract, VECTORS)
    assert store.version() == before and show() == was
    monkeypatch.setattr(Store, "stage", stage)
    for _ in range(2):
        merge_turns(store, turns(spark, 2), extract, VECTORS)
        assert show() == [("room", False), ("room tea", True)]
    assert store.read("episodes").count() == 3


def test_only_touched_partitions_are_written(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g")
    rows = turns(spark, 0, 1, 2, 3).withColumn("graph_id", F.concat(F.lit("g"), F.col("episode_seq").cast("string")))
    extract = lambda df: df.select("graph_id", "episode_seq", F.array(F.struct(F.lit("Ana").alias("subjectName"), F.lit(None).cast("string").alias("objectName"), F.lit("p").alias("predicate"), F.col("user_text").alias("factText"), F.lit(False).alias("isCorrection"))).alias("facts"))
    merge_turns(store, rows, extract, VECTORS)
    before = store.manifest()["facts"]
    merge_turns(store, rows.where("episode_seq = 0").withColumn("episode_seq", F.lit(9).cast("long")).withColumn("user_text", F.lit("more")), extract, VECTORS)
    after = store.manifest()["facts"]
    assert sum(before[p] != after[p] for p in before) == 1 and store.read("facts").count() == 5


def test_import_of_corrections(spark, tmp_path):
    store, sent = Store(spark, f"file://{tmp_path}/g"), []
    first = spark.createDataFrame([("g", 0, [said("rents a room")])], KIND)
    merge_turns(store, turns(spark, 0), lambda df: df.select("graph_id", "episode_seq").join(first, ["graph_id", "episode_seq"]), VECTORS)

    class Model:
        def extract(self, text):
            return [dict(subjectName="Ana", objectName=None, predicate="p", factText=w, isCorrection=True) for w in ("room", "cat") if w in text]

    rows = spark.createDataFrame([("p1", "no room"), ("p2", "no cat"), ("p3", None)], "page_id string, correction_notes string")
    done = review_import.import_corrections(store, rows, models.extraction_of(Model), "g", F.lit("2030-01-01").cast("timestamp"), 10, lambda *x: sent.append(x) or "{}", VECTORS)
    assert [tuple(r) for r in done.collect()] == [("p1", "applied", True), ("p2", "unmatched", False), ("p3", "no_facts", True)]
    assert [p for _, p, _ in sent] == ["/pages/p1", "/pages/p3"] and json.loads(sent[0][2]) == json.loads(review_table.clear_body())
    assert graph.active(store.read("facts")).count() == 0 and store.read("episodes").count() == 3


def test_all_pages_of_a_query():
    asked = []

    def send(method, path, body):
        asked.append(json.loads(body).get("start_cursor"))
        return json.dumps({"results": [{"id": len(asked)}], "has_more": len(asked) < 3, "next_cursor": f"c{len(asked)}"})

    assert [r["id"] for r in review_table.all_pages(send, "/q", {})] == [1, 2, 3] and asked == [None, "c1", "c2"]


def test_validity_is_linear_in_a_key(spark):
    n = 80_000
    own = spark.range(n).select(*[(F.lit("s") if f.name == "subject_id" else F.lit("o") if f.name == "object_id" else F.col("id").cast("timestamp") if f.name == "valid_at" else F.col("id").cast("string") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in FACTS])
    wrong = spark.range(n // 2).select(F.lit("s").alias("subject_id"), F.lit("o").alias("object_id"), (F.col("id") * 2).cast("timestamp").alias("ts"))
    began = time.time()
    ended = graph.with_validity(own, wrong)
    got = ended.agg(F.count("invalid_at"), F.sum(F.unix_seconds("invalid_at") - F.unix_seconds("valid_at"))).first()
    assert tuple(got) == (n - 2, (n - 2) * 3 // 2) and time.time() - began < 20
