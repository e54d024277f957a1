"""The lexical index and searches of many queries against plain versions of the whole job."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemograph.operators import graph, hybrid, lexical_index, search
from mnemograph.schema import CHAT_TURNS
from mnemograph.sources.store import Store
from mnemograph.sources.working import keeper
from mnemograph.streaming.ingest_stream import merge_turns, stored_index

POOLED = "graph_id string, id string, text string"


def plain_scores(queries, docs):
    """{(query, id): score} of documents that share a term; lists of (query, pool, text) and (pool, id, text)."""
    pools, out = defaultdict(list), {}
    for pool, id_, text in docs:
        pools[pool].append((id_, (text or "").lower().split()))
    for q, pool, text in queries:
        own = pools[pool]
        mean = sum(len(w) for _, w in own) / len(own) if own else 0
        df = Counter(t for _, w in own for t in set(w))
        for id_, w in own:
            tf = Counter(w)
            shared = [t for t in set(text.lower().split()) if tf[t]]
            part = (math.log((len(own) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in shared)
            if shared:
                out[q, id_] = round(sum(part), 5)
    return out


def pool(rng, name, n, words=300):
    """Texts of a few common and many rare words."""
    own = lambda: " ".join(f"w{min(int(rng.expovariate(0.03)), words)}" for _ in range(rng.randint(1, 25)))
    return [(name, f"{name}{i:05d}", own()) for i in range(n)]


@pytest.fixture(scope="module")
def pooled():
    rng = random.Random(12)
    docs = pool(rng, "a", 900) + pool(rng, "b", 40) + [(None, f"n{i}", f"w{i % 7} w1") for i in range(30)]
    docs += [("a", "empty", ""), ("a", "null", None), ("c", "only", "w1 w2"), ("a", "a2", docs[0][2]), ("a", "a1", docs[0][2])]
    queries = [(i, p, f"w{rng.randint(0, 9)} w{rng.randint(90, 120)} w{rng.randint(0, 9)}") for i, p in enumerate(["a"] * 15 + ["b", "c", None, "d"])]
    return docs, queries


def built(spark, docs):
    return lexical_index.build(spark.createDataFrame(docs, POOLED).repartition(3), keeper(spark))


def searched(spark, index, queries):
    return lexical_index.Search(index, spark.createDataFrame(queries, "query_id int, graph_id string, text string"), keeper(spark))


def expected(docs, queries, limit):
    ranked = defaultdict(list)
    for (q, id_), s in plain_scores(queries, docs).items():
        ranked[q].append((-s, id_))
    return {(q, id_, n) for q, rows in ranked.items() for n, (_, id_) in enumerate(sorted(rows)[:limit], 1)}


def found(rows):
    return {(r["query_id"], r["id"], r["rank"]) for r in rows}


def test_index_scores_and_skips(spark, pooled, monkeypatch):
    monkeypatch.setattr(lexical_index, "SEGMENT", 8)
    docs, queries = pooled
    s = searched(spark, built(spark, docs), queries)
    got = {(r["query_id"], r["id"]): r["bm25"] for r in s.scores().collect()}
    want = plain_scores(queries, docs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    scored, segments = s.looked_at(5)
    assert found(s.top(5).collect()) == expected(docs, queries, 5)
    # Most segments that hold a word of a query are never scored.
    n, every = segments.count(), s.bounds.count()
    assert n < 0.6 * every, (n, every)
    assert scored.count() < 0.7 * len(want)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_a_changed_index_is_that_of_the_texts_now(spark, pooled, monkeypatch):
    monkeypatch.setattr(lexical_index, "SEGMENT", 8)
    docs, queries = pooled
    old = built(spark, docs)
    rng = random.Random(13)
    now = [d for d in docs if not (d[0] == "b" and int(d[1][1:]) % 5) and d[1] not in ("a00003", "only", "null")]
    now = [(p, i, "w1 w70 w1") if i == "a00004" else (p, i, t) for p, i, t in now] + pool(rng, "e", 12) + [("a", "new", "w5 w5 w90")]
    new = lexical_index.refreshed(old, spark.createDataFrame(now, POOLED), keeper(spark), "1")
    fresh = built(spark, now)
    counted = ("graph_id", "term", "id", "tf", "dl")
    assert as_set(new.postings, *counted) == as_set(fresh.postings, *counted) and new.postings.count() == fresh.postings.count()
    assert as_set(new.places, "graph_id", "id", "chars", "sign") == as_set(fresh.places, "graph_id", "id", "chars", "sign")
    assert as_set(new.blocks, *lexical_index.HEADS) == as_set(lexical_index._blocks(new.postings), *lexical_index.HEADS)
    assert found(searched(spark, new, queries).top(5).collect()) == expected(now, queries, 5)
    # Of pool a three segments lose a document; all others are as they were.
    before, after = (as_set(i.postings.where("graph_id = 'a'"), "segment") for i in (old, new))
    kept = as_set(old.postings.where("graph_id = 'a'"), *new.postings.columns) & as_set(new.postings.where("graph_id = 'a'"), *new.postings.columns)
    assert len(before & after) >= len(before) - 3 and len(kept) > 0.9 * old.postings.where("graph_id = 'a'").count()
    # Of pool b eight documents are left; segments with fewer than a quarter of what fits were packed again into one.
    left = [r["count"] for r in new.places.where("graph_id = 'b'").groupBy("segment").count().collect()]
    assert sum(left) == 8 and sum(n < lexical_index.SEGMENT // 4 for n in left) <= 1


def test_index_of_nothing(spark):
    index = built(spark, [])
    assert searched(spark, index, [(1, "a", "w1")]).top(3).collect() == []
    again = lexical_index.refreshed(index, spark.createDataFrame([("a", "1", "w1")], POOLED), keeper(spark), "1")
    assert found(searched(spark, again, [(1, "a", "w1")]).top(3).collect()) == {(1, "1", 1)}
    gone = lexical_index.refreshed(again, spark.createDataFrame([], POOLED), keeper(spark), "2")
    assert gone.blocks.count() == gone.places.count() == 0


def said(subject, text, wrong=False, object_=None):
    return {"subjectName": subject, "objectName": object_, "predicate": "p", "factText": text, "isCorrection": wrong}


def test_the_store_keeps_the_index_of_active_facts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    answers = {0: [said("Ana", "keeps a red cat")], 1: [said("Ana", "rents the mill", object_="mill")], 2: [said("Bo", "keeps a dog")], 3: [said("Ana", "left the mill", True, "mill")]}
    kind = "graph_id string, episode_seq long, facts array<struct<subjectName:string,objectName:string,predicate:string,factText:string,isCorrection:boolean>>"

    def extract(turns):
        told = spark.createDataFrame([(g, n, a) for g in ("g", "h") for n, a in answers.items()], kind)
        return told.join(turns.select("graph_id", "episode_seq"), ["graph_id", "episode_seq"])

    for batch in ([("g", 0), ("g", 1)], [("h", 2), ("g", 2)], [("g", 3)], [("g", 3)]):
        rows = [(g, n, "u", "a", datetime(2024, 1, 1) + timedelta(days=n), None) for g, n in batch]
        merge_turns(store, spark.createDataFrame(rows, CHAT_TURNS), extract)
        index = stored_index(store)
        active = graph.active(store.read("facts"))
        docs = [(r["graph_id"], r["id"], r["fact_text"]) for r in active.collect()]
        assert as_set(index.places, "graph_id", "id") == {d[:2] for d in docs}
        queries = [(1, "g", "keeps the mill"), (2, "h", "keeps the mill")]
        assert found(searched(spark, index, queries).top(3).collect()) == expected(docs, queries, 3)
    assert len(docs) == 3


# -- many hybrid searches ------------------------------------------------------


def plain_hybrid(queries, docs, limit):
    """{(query, id, rank, rrf)}; lists of (query, text, vector, coverage) and (id, text, vector)."""
    scores = plain_scores([(q, None, t or "") for q, t, _, _ in queries], [(None, i, t) for i, t, _ in docs])
    out = set()
    for q, _, v, trust in queries:
        word = {i: scores.get((q, i), 0.0) for i, _, _ in docs}
        near = {i: round(sum(a * b for a, b in zip(v, w, strict=True)), 6) if v and w and len(v) == len(w) else 0.0 for i, _, w in docs}
        total = dict.fromkeys(word, 0.0)
        for own in [word, near] if trust >= 0.5 else [word]:
            for n, i in enumerate(sorted(own, key=lambda i: (-own[i], i)), 1):
                total[i] += 1 / (60 + n)
        best = sorted(((-round(s, 6), i) for i, s in total.items()))[:limit]
        out |= {(q, i, n, -s) for n, (s, i) in enumerate(best, 1)}
    return out


def vector(rng, n=4):
    v = [rng.gauss(0, 1) for _ in range(n)]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v]


def test_hybrid_many_equals_all_ranks(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "QUERIES", 4)
    rng = random.Random(14)
    docs = [(f"{i:04d}", t, vector(rng)) for i, (_, _, t) in enumerate(pool(rng, "x", 400))]
    docs += [(f"t{i}", docs[7][1], docs[7][2]) for i in range(30)] + [(f"u{i}", "w3", None) for i in range(20)] + [("v1", None, vector(rng)), ("v2", "", []), ("v3", "w1 w2", vector(rng, 3))]
    queries = [(i, f"w{rng.randint(0, 9)} w{rng.randint(60, 130)}", vector(rng), 1.0) for i in range(6)]
    queries += [(10, "w1 w100", vector(rng), 0.2), (11, "nothing of it", vector(rng), 0.0), (12, None, vector(rng), 1.0), (13, "w5", [], 1.0), (14, docs[7][1], docs[7][2], 1.0), (15, "w2", vector(rng, 3), 1.0)]
    asked = spark.createDataFrame(queries, "query_id int, text string, embedding array<double>, coverage double")
    rows = spark.createDataFrame(docs, "id string, text string, embedding array<double>").repartition(3)
    for limit in (1, 7):
        got = hybrid.hybrid_many(asked, rows, keeper(spark), limit).collect()
        assert {(r["query_id"], r["id"], r["rank"], r["rrf"]) for r in got} == plain_hybrid(queries, docs, limit)
        assert all(r["similarity"] == 0.0 for r in got if r["query_id"] in (10, 11))
    assert hybrid.hybrid_many(asked, rows.limit(0), keeper(spark)).collect() == []
    assert hybrid.hybrid_many(asked.limit(0), rows, keeper(spark)).collect() == []


def test_best_of_many_queries_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(search.asked_words, "WEIGHTS", 40)
    monkeypatch.setattr(search.asked_words, "CELLS", 60)
    rng = random.Random(15)
    docs = [(i, t) for i, (_, _, t) in enumerate(pool(rng, "x", 300))] + [(1000 + i, "w1 w2") for i in range(40)] + [(2000, ""), (2001, "w7 W7 w8")]
    queries = [(i, f"w{rng.randint(0, 9)} w{rng.randint(60, 130)} w{i}") for i in range(12)] + [(20, "nothing of it"), (21, ""), (22, None), (23, "w1 w1 w2")]
    asked = spark.createDataFrame(queries, "query_id int, text string")
    rows = spark.createDataFrame(docs, "id long, text string").repartition(3)
    best = search.bm25_top(asked, rows, 5, keeper(spark))
    want = expected([(None, *d) for d in docs], [(q, None, t or "") for q, t in queries], 5)
    assert found(best.collect()) == want
    assert not any(j in best._jdf.queryExecution().toString() for j in ("SortMergeJoin", "BroadcastHashJoin"))
    # A null text counts as a document and not in the mean length, as in SQL.
    some = rows.unionByName(spark.createDataFrame([(3000, None)], "id long, text string"))
    plain = search.top(search.bm25(asked.where("text is not null"), some), "bm25", 5)
    assert as_set(plain, "query_id", "id", "bm25", "rank") == as_set(search.bm25_top(asked, some, 5, keeper(spark)), "query_id", "id", "bm25", "rank")
    assert search.bm25_top(asked, rows.limit(0), 5, keeper(spark)).collect() == search.bm25_top(asked.limit(0), rows, 5, keeper(spark)).collect() == []


def test_words_become_no_rows_before_their_block(spark):
    """Blocks came from a row for each word, counted, gathered and sorted, before."""
    docs = [("a", str(i), f"w{i % 3} w1 w1") for i in range(50)] + [("a", "null", None), (None, "n", "w1 x")]
    plans = []
    lexical_index.build(spark.createDataFrame(docs, POOLED).repartition(3), lambda df: plans.append(df._jdf.queryExecution().toString()) or keeper(spark)(df))
    assert not any("Generate" in p or "ObjectHashAggregate" in p for p in plans)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_segments_that_go_on_in_the_next_batch(rows):
    """Each segment gives its blocks once, however its documents come."""
    import pyarrow as pa

    names = [("a", "0-0"), ("a", "0-0"), ("a", "0-1"), (None, "0-1"), (None, "0-2"), (None, "0-2"), (None, "0-2"), ("b", "0-2")]
    texts = [["x", "y", "x"], ["y"], [], None, ["z"], ["z", "z"], ["x"], ["x"]]
    batch = pa.RecordBatch.from_arrays([pa.array([g for g, _ in names]), pa.array([s for _, s in names]), pa.array(range(len(names)), pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["graph_id", "segment", "id", "w"])
    out = [r for b in lexical_index._counted(batch.slice(i, rows) for i in range(0, len(names), rows)) for r in b.to_pylist()]
    got = {(r["graph_id"], r["segment"], r["term"]): (r["df"], r["most"], r["least"], r["words"], sorted((d["id"], d["tf"], d["dl"]) for d in r["docs"])) for r in out}
    assert len(out) == len(got) and got == {
        ("a", "0-0", "x"): (1, 2, 3, 2, [(0, 2, 3)]),
        ("a", "0-0", "y"): (2, 1, 1, 2, [(0, 1, 3), (1, 1, 1)]),
        (None, "0-2", "z"): (2, 2, 1, 3, [(4, 1, 1), (5, 2, 2)]),
        (None, "0-2", "x"): (1, 1, 1, 1, [(6, 1, 1)]),
        ("b", "0-2", "x"): (1, 1, 1, 1, [(7, 1, 1)]),
    }
