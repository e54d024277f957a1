"""Entities of a fold: of each name the first and the last mention are resolved, and no fact need be folded."""

from mnemograph.operators import ingest
from mnemograph.operators.ingest import People
from mnemograph.schema import ENTITIES
from mnemograph.sources.working import keeper

CLEAN = "graph_id string, occurred_at timestamp, episode_seq long, pos int, fact struct<subjectName:string,objectName:string,predicate:string,factText:string,isCorrection:boolean>"


def test_people_are_those_of_every_mention(spark):
    from datetime import datetime, timedelta

    names = ["Ann Lee", "Ann", "Bo", "ann lee", "Ann", "Bo", "Ann Lee", "ANN", "Bo", "Ann"] * 3
    rows = [("g", datetime(2024, 1, 1) + timedelta(days=i), i, 0, (n, "Bo" if i % 4 == 0 else None, "p", f"text {i}", False)) for i, n in enumerate(names)]
    plain = People("g")
    for _, _, _, _, (subject, object_, _, text, _) in rows:
        plain.upsert(subject, text, "user", [])
        if object_ is not None:
            plain.upsert(object_, text, "other", [])
    want = {(e["id"], e["name"], e["kind"], e["summary"], tuple(sorted(e["aliases"])), e["seq"]) for e in plain.entities}
    written, seen = keeper(spark), []
    people = ingest.merge_people(spark.createDataFrame(rows, CLEAN), spark.createDataFrame([], ENTITIES), keep=lambda df: seen.append(written(df)) or seen[-1])
    assert {(r["id"], r["name"], r["kind"], r["summary"], tuple(sorted(r["aliases"])), r["seq"]) for r in people.collect()} == want
    # Two mentions of each of five names and no more were resolved; all 38 were before.
    resolved = next(df for df in seen if "ref" in df.columns and "role" in df.columns)
    assert resolved.where("ref is not null").count() <= 10
