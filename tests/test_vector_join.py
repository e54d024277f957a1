"""Pairs of vectors in blocks against brute force; how many products bounds leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemograph.operators import mutate, vector_join
from mnemograph.sources.working import keeper

ROWS = "id long, label string, embedding array<double>"


def clustered(n, clusters=8, size=16, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    x = centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, size)) * np.linalg.norm(centres, axis=1).mean() / size**0.5
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(rows, minimum):
    out = {}
    for i, (a, g, x) in enumerate(rows):
        for b, h, y in rows[i + 1 :]:
            if g is not None and g == h and a != b and x and y and len(x) == len(y) and None not in x + y:
                p = float(np.dot(x, y))
                if np.isfinite(p) and round(p, 6) >= minimum:
                    out[min(a, b), max(a, b)] = p
    return out


def check(spark, rows, minimum):
    got = mutate.near_duplicate_pairs(spark.createDataFrame(rows, ROWS), "label", "id", "embedding", minimum).collect()
    want = brute(rows, minimum)
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
    assert all(r["similarity"] == pytest.approx(want[r["a"], r["b"]], abs=1e-6) for r in got)


@pytest.mark.parametrize("minimum", [0.3, 0.9])
def test_pairs_equal_brute_force(spark, minimum):
    x = clustered(500)
    hot = [(i, "hot" if i % 3 else "cold", v.tolist()) for i, v in enumerate(x)]
    scaled = [(1000 + i, "long", (3 * v).tolist()) for i, v in enumerate(x[:60])]
    copies = [(2000 + i, "hot", x[0].tolist()) for i in range(40)]
    check(spark, hot + scaled + copies, minimum)


def test_odd_vectors_pair_with_nothing(spark):
    one = [1.0, 0.0]
    rows = [(1, "a", one), (2, "a", one), (2, "a", one), (3, "a", None), (4, "a", []), (5, "a", [0.0, 0.0]), (6, "a", [1.0, None]), (7, "a", [float("nan"), 1.0]), (8, "a", [float("inf"), 1.0]), (9, "a", [1.0, 0.0, 0.0]), (10, None, one), (11, "b", one)]
    got = mutate.near_duplicate_pairs(spark.createDataFrame(rows, ROWS), "label", "id", "embedding", 0.5)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, 2), (1, 2)]
    none = mutate.near_duplicate_pairs(spark.createDataFrame([], ROWS), "label", "id", "embedding", 0.5)
    assert none.columns == ["a", "b", "similarity"] and none.count() == 0
    with pytest.raises(ValueError):
        mutate.near_duplicate_pairs(none.withColumnRenamed("similarity", "embedding"), "a", "b", "embedding", 0.0)


def test_bounds_leave_out_most_products(spark):
    """One group of eight tight clusters: an eighth of the pairs are within clusters, and less than a quarter is multiplied; all links are found."""
    n = 6000
    x = clustered(n)
    rows = spark.createDataFrame([(i, "one", v.tolist()) for i, v in enumerate(x)], ROWS)
    keep = keeper(spark)
    own = keep(vector_join.usable(rows, "label", "id", "embedding"))
    cut = vector_join.blocks(own, vector_join.pivots(own), keep)
    assert cut.groupBy("block").count().agg(F.max("count")).first()[0] <= vector_join.ROWS
    assert cut.count() == n
    compared = vector_join.meetings(cut, None, 0.9, keep).agg(F.sum("products")).first()[0]
    linked = mutate.near_duplicate_pairs(rows, "label", "id", "embedding", 0.9).count()
    near = np.triu(np.round(x @ x.T, 6) >= 0.9, 1)
    assert linked == near.sum() and linked <= compared < n * (n - 1) / 2 / 4


def test_nearest_equals_brute_force(spark):
    x = clustered(400, seed=5)
    facts = [(f"f{i:03d}", f"s{i % 3}", None, None, v.tolist()) for i, v in enumerate(x[:300])]
    facts += [(f"g{i:03d}", "s0", None, None, x[0].tolist()) for i in range(30)]
    facts += [("ended", "s0", None, "2024-01-01", x[301].tolist()), ("object", "s1", "o", None, x[301].tolist())]
    asked = [(i, f"s{i % 4}", v.tolist()) for i, v in enumerate(x[300:])] + [(900, "s0", x[0].tolist()), (901, "s0", None)]
    own = spark.createDataFrame(facts, "id string, subject_id string, object_id string, invalid_at string, embedding array<double>")
    wrong = spark.createDataFrame(asked, "correction_id long, subject_id string, embedding array<double>")
    want = {}
    for c, s, v in asked:
        scored = [(-round(float(np.dot(v, w)), 6), f) for f, t, o, e, w in facts if v and s == t and o is None and e is None]
        if scored and -min(scored)[0] >= 0.6:
            want[c] = min(scored)
    got = {r["correction_id"]: (-r["similarity"], r["id"]) for r in mutate.nearest(own, wrong, 0.6).collect()}
    assert {c: f for c, (_, f) in got.items()} == {c: f for c, (_, f) in want.items()} and got[900][1] == "f000"
    assert all(got[c][0] == pytest.approx(want[c][0], abs=2e-6) for c in want)
