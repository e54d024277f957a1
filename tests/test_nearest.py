"""Nearest rows of many queries against plain lists, and what a search may keep."""

import math
import random
from functools import cmp_to_key

from mnemograph.operators import nearest, search


def similar(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    if None in a or None in b:
        return None
    s = sum(x * y for x, y in zip(a, b, strict=True))
    return s if not math.isfinite(s) else math.copysign(math.floor(abs(s) * 1e6 + 0.5) / 1e6, s) + 0.0


def before(a, b):
    """NaN, numbers from above, null; then ids."""
    kind = lambda s: 2 if s is None else 0 if math.isnan(s) else 1
    x, y = (kind(a[0]), -a[0] if kind(a[0]) == 1 else 0, a[1]), (kind(b[0]), -b[0] if kind(b[0]) == 1 else 0, b[1])
    return (x > y) - (x < y)


def told(s):
    return "nan" if s is not None and math.isnan(s) else s


def test_nearest_of_odd_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 400)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    monkeypatch.setattr(nearest, "PRODUCTS", 21)
    rng = random.Random(5)
    rows = {i: [rng.choice([-1.0, 0.0, 0.5, 1.0, 0.0078125]) for _ in range(3)] for i in range(120)}
    rows |= {200 + i: rows[7] for i in range(20)} | {300: None, 301: [], 302: [1.0], 303: [1.0, None, 2.0], 304: [math.inf, 1.0, 0.0], 305: [math.nan, 0.0, 0.0], 306: [-math.inf, 0.0, 1.0], 307: [1e300, 1.0, 1.0]}
    docs = spark.createDataFrame(list(rows.items()), "id long, embedding array<double>").repartition(5)
    asked = {i: rows[i] for i in (0, 7, 11, 42, 300, 301, 302, 303, 304, 305, 306)}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, embedding array<double>")
    for limit in (1, 10):
        got = {(r["query_id"], r["id"], told(r["similarity"]), r["rank"]) for r in search.cosine_top(queries, docs, limit).collect()}
        want = set()
        for q, v in asked.items():
            best = sorted(((similar(v, w), i) for i, w in rows.items()), key=cmp_to_key(before))[:limit]
            want |= {(q, i, told(s), n) for n, (s, i) in enumerate(best, 1)}
        assert got == want
    assert search.cosine_top(queries, docs.limit(0), 3).collect() == search.cosine_top(queries.limit(0), docs, 3).collect() == []


def test_no_pair_becomes_a_row(spark):
    """Every pair was a row of a join and an expression of 64 products before."""
    docs = spark.range(400).selectExpr("id", "array(cast(id as float), 1f) as embedding")
    plan = search.cosine_top(docs.selectExpr("id as query_id", "embedding"), docs, 2)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
