"""Lloyd clusters, hard negatives and mixes against plain versions of the whole job."""

import hashlib
import math
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemograph.llm import centroids, mixing, negatives
from mnemograph.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"


def whole(v):
    """Floors of 256 times each component, or None if a component is not a finite number."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * x) if abs(x) < 2**40 else int(x) * 256 for x in v]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op3_embeddings", "op11_centroids", "op12_negatives", "op13_mixing"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(str(list(r)) for r in got.select(columns).collect())
    assert rows and rows == sorted(str(list(r)) for r in want.select(", ".join(columns)).fetchall())


# -- clusters ------------------------------------------------------------------


def lloyd(rows, size, k, rounds, seed=2):
    """[(key, cluster, distance, inertia of the cluster, inertia, centroid)] in plain Python."""
    kept = [(key, w) for key, v in rows if (w := whole(v)) is not None and len(w) == size]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    own = [w for _, w in sorted(kept, key=name)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    home = lambda v: min((apart(v, c), i) for i, c in enumerate(own))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[home(v)[1]].append(v)
        own = [[sum(x) // len(members[i]) for x in zip(*members[i], strict=True)] if i in members else c for i, c in enumerate(own)]
    placed = [(key, *home(v)[::-1]) for key, v in kept]
    sums = defaultdict(int)
    for _, c, d in placed:
        sums[c] += d
    top = lambda n: min(n, 2**63 - 1)
    return [(key, c, top(d), top(sums[c]), top(sum(sums.values())), [str(x) for x in own[c]]) for key, c, d in placed]


def clusters(spark, rows, **how):
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], VECTORS).repartition(3)
    return [tuple(r) for r in centroids.cluster(df, "vec_id", "embedding", **how).collect()]


def order(rows):
    return sorted(rows, key=str)


def test_lloyd_equals_a_plain_version(spark):
    rng = random.Random(1)
    rows = [(n, [rng.gauss(n % 5, 1) for _ in range(6)]) for n in range(300)]
    rows += [(5, rows[5][1])] * 150 + [(None, [0.5] * 6), (None, [0.25] * 6)]
    rows += [(900, None), (901, [1.0] * 5), (902, [1.0] * 5 + [None]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [])]
    assert order(clusters(spark, rows, size=6, k=7, rounds=3)) == order(lloyd(rows, 6, 7, 3))


def test_lloyd_with_fewer_vectors_than_clusters_and_with_none(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])]
    got = clusters(spark, rows, size=2, k=9, rounds=2)
    assert order(got) == order(lloyd(rows, 2, 9, 2))
    # Equal vectors share the lower number, and the centroid of the other stays.
    assert len({r[1] for r in got}) == 2
    assert clusters(spark, [(1, None)], size=2, k=3, rounds=2) == []


def test_lloyd_sums_numbers_of_any_size(spark):
    rng = random.Random(2)
    rows = [(n, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 37) for _ in range(3)]) for n in range(40)]
    assert order(clusters(spark, rows, size=3, k=4, rounds=3)) == order(lloyd(rows, 3, 4, 3))


def test_limbs_add_up():
    rng = random.Random(3)
    values = np.array([rng.randint(-(2**200), 2**200) for _ in range(50)] + [0, -1, 2**30], object)
    parts = centroids.limbs(values)
    assert all(np.abs(p).max() <= 2**30 for p in parts)
    assert (sum(p.astype(object) << (centroids.LIMB * i) for i, p in enumerate(parts)) == values).all()


# -- hard negatives ------------------------------------------------------------


def plain_negatives(rows, every, positives=5, negatives=5, low=80, high=100):
    """The result as a sorted list; rows are (key, vector, label)."""
    last = lambda k: (k is None, k or 0)
    take = [(i, k, w, lab) for i, (k, v, lab) in enumerate(rows) if lab is not None and (w := whole(v)) is not None]
    out = []
    for i, k, q, lab in take:
        if k is None or k % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, w, strict=True)), key, other) for j, key, w, other in take if j != i and len(w) == len(q)]
        ranked = sorted(scored, key=lambda s: (-s[0], last(s[1])))
        for ps, pk, _ in [s for s in ranked if s[2] == lab][:positives]:
            fit = [s for s in ranked if s[2] != lab and low * ps <= 100 * s[0] <= high * ps]
            out += [(k, pk, n, nk, ps, ns) for n, (ns, nk, _) in enumerate(fit[:negatives], 1)]
    return order(out)


def mined(spark, rows, every, **how):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return order(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **how).collect())


def near_rows(n, seed, size=4, labels=3):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    return [(k, [x + rng.gauss(0, 0.2) for x in middle[k % 6]], rng.randrange(labels)) for k in range(n)]


def test_negatives_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "TREE_ROWS", 70)
    monkeypatch.setattr(negatives, "ANCHORS", 9)
    rows = near_rows(400, 4)
    # A third of all rows is one vector, under two labels; and some repeated rows and keys.
    rows += [(1000 + n, rows[0][1], n % 2) for n in range(200)] + [rows[10]] * 7 + [(None, rows[20][1], 1)] * 3
    rows += [(2000, None, 1), (2010, [1.0] * 4, None), (2020, [None] * 4, 1), (2030, [float("nan")] * 4, 1), (2040, [1.0] * 3, 1), (2050, [0.9] * 3, 2), (2060, [1.1] * 3, 1), (2070, [], 1)]
    want = plain_negatives(rows, 10)
    assert len(want) > 500
    assert mined(spark, rows, 10) == want


def test_negatives_with_other_numbers(spark):
    rows = near_rows(120, 5, labels=60)
    assert mined(spark, rows, 7, positives=2, negatives=9, low=-50, high=130) == plain_negatives(rows, 7, 2, 9, -50, 130)


def test_negatives_of_huge_numbers_and_of_none(spark):
    rng = random.Random(6)
    rows = [(k, [rng.uniform(1, 2) * 4e5 for _ in range(3)], k % 2) for k in range(60)]
    assert mined(spark, rows, 6) == plain_negatives(rows, 6)
    assert mined(spark, [(1, [1.0], 1)], 2) == []
    assert mined(spark, [(2, [1.0], 1)], 2) == []


def test_bounds_leave_rows_out():
    """Of rows in tight groups, an anchor is multiplied with few, and finds the same as among all."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(40, 16)) * 200
    x = np.floor(np.repeat(middle, 100, axis=0) + rng.normal(size=(4000, 16)))
    label = np.array([str(n % 2) for n in range(4000)])
    key = rng.permutation(4000)
    tree = negatives.BallTree(x, label, key, np.arange(4000))
    at = np.arange(0, 4000, 50)
    n = len(at)
    of = negatives.Searches(x[at], np.arange(n), label[at], at, np.full(n, -negatives.LONG), np.full(n, negatives.LONG), at)
    best = negatives.Best(n, 5)
    compared = negatives.search(tree, best, of, True)
    score = (x[at] @ x.T).astype(np.int64)
    for i in range(n):
        other = [j for j in range(4000) if label[j] == label[at[i]] and j != at[i]]
        first = sorted(other, key=lambda j: (-score[i, j], key[j]))[:5]
        assert best.place[i].tolist() == first
    assert compared < 0.25 * n * 4000


# -- mixes ---------------------------------------------------------------------

DOCS = "doc_id long, text string, source string"


def dealt(sizes, weights=(5, 2, 1), share=1.0, most=3):
    """{source: target}: the rule as it is told, one round after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()) * share, set(names)
    while open_:
        each = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if each * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: each * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return out


def mixed(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, DOCS).repartition(parts, "doc_id") if rows else spark.createDataFrame([], DOCS)
    return mixing.mix(df, **how).collect()


def check(rows, got, shares):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, greatest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
        greatest[s] = max(greatest[s], size(t))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["size"]) for r in got) == sorted((k is None, k or 0, s or "", size(t)) for k, t, s in rows)
    for i, share in enumerate(shares):
        aims, taken = dealt(sizes, share=share), defaultdict(int)
        for r in got:
            assert r["source_size"] == sizes[r["source"]]
            assert r["targets"][i] == pytest.approx(aims[r["source"]])
            assert r["takes"][i] <= 3 * r["size"] and (r["takes"][i] == 0 if not r["size"] else r["takes"][i] % r["size"] == 0)
            taken[r["source"]] += r["takes"][i]
        for s in sizes:
            assert abs(taken[s] - aims[s]) <= greatest[s] / 2 + 1e-6, s
    for r in got:
        assert sorted(r["takes"]) == [r["takes"][i] for i in sorted(range(len(shares)), key=lambda i: shares[i])]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(8)
    rows = [(n, " ".join(["w"] * rng.randint(0, 30)), f"s{n % 11}" if n % 3 else "hot") for n in range(3000)]
    rows += [(n, "one word \t two\x0bthree", None) for n in range(3000, 3050)] + [(3050, "w " * 5000, "s3"), (3051, None, "s4"), (3052, "", ""), (3053, "x", ""), (3054, "alone " * 40, "z")]
    return rows


def test_a_mix_comes_near_its_targets(spark, many, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 4)
    monkeypatch.setattr(mixing, "DIGITS", 15)
    shares = (1.0, 0.25, 0.6)
    check(many, mixed(spark, many, shares=shares), shares)


def test_a_mix_takes_by_hash(spark, many):
    """What is taken is what a sort by hash and a running sum would take; and again on another layout."""
    rows = [r for r in many if r[1]]
    got = mixed(spark, rows)
    check(rows, got, (1.0,))
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
    for own in by_source.values():
        before, whole_times = 0, int(own[0]["targets"][0] // own[0]["source_size"])
        rest = own[0]["targets"][0] - whole_times * own[0]["source_size"]
        for r in sorted(own, key=lambda r: hashlib.md5(f"42:{r['doc_id']}".encode()).hexdigest()):
            assert r["takes"][0] == r["size"] * (whole_times + (2 * before + r["size"] <= 2 * rest))
            before += r["size"]
    assert order(got) == order(mixed(spark, rows, parts=5))


def test_rows_of_one_key_are_told_apart(spark):
    rows = [(7, "a b c", "one")] * 400 + [(None, "d e", "two")] * 300 + [(n, "f", "three") for n in range(5)]
    got = mixed(spark, rows)
    check(rows, got, (1.0,))
    assert len({r["takes"][0] for r in got if r["source"] == "two"}) == 2


def test_mixes_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [(r["targets"], r["takes"]) for r in mixed(spark, [(1, "", "a"), (2, None, None)])] == [([0.0], [0])] * 2


def test_a_mix_among_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5, "q"), (2, "c", "y", 6, "r")], "doc_id int, text string, source string, size int, file string")
    assert {(r["doc_id"], r["size"]) for r in mixing.mix(df).collect()} == {(1, 2), (2, 1)}
