"""Operators against plain versions of the whole job, without the candidates' own gates."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from mnemograph.llm import pii

# -- the pipeline's near copies ------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def near_texts():
    """Documents and copies of them with ever more words replaced."""
    rng = random.Random(11)

    def words(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]

    texts = []
    for _ in range(40):
        base = words(rng.randint(40, 300))
        texts.append(" ".join(base))
        for edits in range(1, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = words(1)[0]
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts + [texts[5], "", "  "]


def test_pipeline_keeps_one_of_all_near_copies(spark, near_texts):
    import corpus_pipeline

    sets = [shingles(t) for t in near_texts]
    root = list(range(len(sets)))

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    found = 0
    for a, b in combinations(range(len(sets)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            found += 1
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert found > 300
    want = {n for n in range(len(sets)) if top(n) == n}
    docs = spark.createDataFrame(list(enumerate(near_texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_near_copies_meet_by_simhash_too(spark, near_texts, monkeypatch):
    """Without any band key, pairs within three bits of SimHash are still found, by the cells of popcounts."""
    import corpus_pipeline
    import numpy as np
    import xxhash

    from mnemograph.llm import shingles as operator
    from mnemograph.llm import simhash

    sets = [shingles(t) for t in near_texts]
    prints = [simhash._majority(np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64)) for s in sets]
    least = list(range(len(sets)))
    found = 0
    for a, b in combinations(range(len(sets)), 2):
        if sets[a] == sets[b] or ((prints[a] ^ prints[b]).bit_count() <= 3 and jaccard(sets[a], sets[b]) >= 0.8):
            found += sets[a] != sets[b]
            x, y = sorted((least[a], least[b]))
            least = [x if n == y else n for n in least]
    assert found > 20
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(operator, "links", lambda ws, *rest: ws.put(none))
    docs = spark.createDataFrame(list(enumerate(near_texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(least)


# -- spelled digits of any number ----------------------------------------------


@pytest.mark.parametrize(
    ("kind", "found"),
    [
        ("phone", "+49 30 one two three 4567"),
        ("phone", "+1 (415) 555 zero one nine nine"),
        ("phone", "+49 30 12 34 five six 7"),
        ("phone", "+1 (four one five) 555 0199"),
        ("phone", "plus 49 30 one two three 4567"),
        ("phone", "plus one (415) 555 0199"),
        ("ip", "one nine two dot one six eight dot one dot seven"),
        ("ip", "192.168.one.7"),
        ("card", "4111 1111 1111 one one one one"),
        ("card", "4111 1111 1111 111 one"),
    ],
)
def test_mixed_digits_are_found(kind, found):
    text = f"Write to {found} today, not on one of 12 days."
    base, every = pii.find(text)
    assert not base[kind]
    assert pii.masked(text, every) == text.replace(found, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["one of 12", "un 12 345 678 un", "two plus two (four)", "page one. two dots", "4111 1111 1111 one one one two"])
def test_spelled_digits_in_prose_stay(text):
    assert not any(pii.find(text)[1].values())


# -- the registered query of line dedup ----------------------------------------


def test_line_query_returns_the_texts(spark, tmp_path):
    from mnemograph.llm.queries import op8_lines

    rows = [(1, "one line of words\n\nanother line"), (2, "One  line of words\nlast"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["text"]) for r in op8_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 3, rows[0][1]), 2: (2, 1, "last"), 3: (0, 0, None)}


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_similarity_is_by_characters_at_every_length(spark):
    """The bounds that are tried first change nothing, and 256 characters are no border."""
    from pyspark.sql import functions as F

    from mnemograph.llm.lines import alike

    rng = random.Random(5)
    pairs = []
    for size in (5, 100, 159, 160, 161, 250, 256, 257, 300, 700, 1300, 1500):
        a = "".join(rng.choice("abcde fgh") for _ in range(size))
        for share in (0.0, 0.1, 0.19, 0.21, 0.5):
            b = list(a)
            for at in rng.sample(range(size), round(share * size)):
                b[at] = "z"
            pairs.append((a, "".join(b)))
        pairs.append((a, a[: round(size * 0.79)]))
        pairs.append((a, a[: -(-size * 81 // 100)]))
        words = a.split(" ")
        for gone in range(0, len(words), max(1, len(words) // 3)):
            pairs.append((a, " ".join(words[:gone] + words[gone + 1 :])))
            pairs.append((a, " ".join(words[:gone] + ["a", "a", "a"] + words[gone:])))
            pairs.append((a, " ".join(words[:gone] + ["q" * rng.randint(1, size // 3 + 1)] + words[gone + 1 :])))
    pairs += [("a a a a a a", "a a a a a a a"), ("a a", "a"), ("a b a", "a"), ("x", "y")]
    got = {r["i"] for r in alike(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string"), "x", "y", 0.8).collect()}
    assert 0 < len(got) < len(pairs)
    for i, (a, b) in enumerate(pairs):
        assert (i in got) == (plain_edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_lines_of_very_many_words(spark, monkeypatch):
    """Lines with a counter for each bit have the fingerprints of packed counters, and near ones link."""
    from mnemograph.llm import lines

    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = list(base)
    near[7] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near) + "\nshort line"), (3, "something else here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    monkeypatch.setattr(lines, "VAST", 500)
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()} == want
    assert want[2] == "short line"


# -- cells of vectors lose no link ---------------------------------------------


@pytest.mark.parametrize("free", [2, 3, 8, 64])
def test_one_of_two_partners_looks_across_every_border(free):
    """Vectors that fill few of 64 directions, with partners just within the threshold."""
    import numpy as np

    from mnemograph.llm.embeddings import cells_of, fit_centroids

    rng = np.random.default_rng(free)
    plane = np.linalg.qr(rng.normal(size=(64, free)))[0].T
    x = rng.normal(size=(20_000, free))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= np.sum(side * x, axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * side
    x, y = x @ plane, y @ plane
    c = fit_centroids(x, 24)
    (home_x, look_x), (home_y, look_y) = cells_of(x, c, 0.93), cells_of(y, c, 0.93)
    rows = np.arange(len(x))
    met = (home_x == home_y) | look_x[rows, home_y] | look_y[rows, home_x]
    assert met.all() and (home_x != home_y).any()


@pytest.mark.parametrize("free", [3, 8])
def test_vector_query_finds_all_links(spark, free, monkeypatch):
    import numpy as np

    from mnemograph.llm import embeddings

    monkeypatch.setattr(embeddings, "PER_CELL", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rng = np.random.default_rng(free)
    x = rng.normal(size=(500, free)) @ rng.normal(size=(free, 24))
    x = np.concatenate([x, x[:40] + 0.05 * rng.normal(size=(40, 24))])
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93) & (np.arange(540)[:, None] % 2 == np.arange(540) % 2) & ~np.eye(540, dtype=bool)
    assert links.sum() > 100
    least = np.arange(540)
    while True:
        new = np.minimum(least, np.where(links, least[None, :], 540).min(axis=1))
        if (new == least).all():
            break
        least = new
    for i in range(540):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i].sum(), least[i], least[i] == i)


# -- the packing program -------------------------------------------------------


def histogram(kind):
    rng = random.Random(3)
    if kind == "few lengths":
        return Counter(rng.choice([130, 205, 290, 333, 401, 455, 512, 600]) for _ in range(20_000))
    if kind == "260 to 520":
        return Counter(rng.randint(260, 520) for _ in range(20_000))
    # Perfect packings of six triples, 1,000 of each.
    return Counter(n for _ in range(6) for n in perfect(rng) for _ in range(1000))


def perfect(rng):
    a, b = rng.randint(250, 400), rng.randint(250, 400)
    return a, b, 1024 - a - b


@pytest.mark.parametrize("kind", ["few lengths", "260 to 520", "perfect triples"])
def test_program_reaches_its_bound_from_either_start(kind):
    from mnemograph.llm import packing

    counts = histogram(kind)
    plain = len(packing.best_fit(list(counts.elements()), 1024))
    for start in (0.1, 1.0):
        found = packing.program(counts, 1024, start)
        assert found.bound <= found.value <= 1.01 * found.bound
        need = [counts[int(n)] for n in found.lengths]
        assert (found.uses @ found.patterns >= [x * (1 - 1e-9) for x in need]).all()
        assert (found.patterns @ found.lengths <= 1024).all()
        whole = packing.solve(counts, 1024, start)
        covered = Counter()
        for pattern, n in whole.items():
            covered.update({k: n * c for k, c in Counter(pattern).items()})
        assert covered == counts
        assert found.bound - 1e-6 <= sum(whole.values()) <= min(1.01 * found.bound, plain)


def test_both_ways_of_the_knapsack_agree(monkeypatch):
    import numpy as np

    from mnemograph.llm import packing

    rng = np.random.default_rng(8)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 40, 9))
        values = rng.random(len(lengths)) * lengths
        worth = []
        for few in (0, 100):
            monkeypatch.setattr(packing, "FEW_LENGTHS", few)
            copies = packing.best_pattern(values, lengths, 64)
            assert copies @ lengths <= 64
            worth.append(copies @ values)
        assert worth[0] == pytest.approx(worth[1])


# -- co-training ---------------------------------------------------------------


def pages_of_two_kinds(n, seed):
    """(id, text, label): good ones are in lines and hold some words, bad ones in one line with others; the views see one each."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = i % 2
        words = [f"{'good' if good else 'poor'}{rng.randrange(300)}" if rng.random() < 0.1 else f"common{rng.randrange(150)}" for _ in range(rng.randint(20, 60))]
        lines = rng.random() < (0.95 if good else 0.05)
        rows.append((i, "".join(w + ("\n" if lines and k % 6 == 5 else " ") for k, w in enumerate(words)), good))
    return rows


def test_both_views_teach_and_gain(spark):
    """Few labels: what is passed on goes both ways, and the mix is better than either view alone."""
    import numpy as np

    from mnemograph.llm import quality

    rows = pages_of_two_kinds(3000, 3)
    buckets = {}
    x = np.stack([quality.text_features(t, buckets) for _, t, _ in rows])
    f = np.stack([quality.page_features(t, {}) for _, t, _ in rows])
    y = np.array([q for *_, q in rows], float)
    few, rest = slice(0, 240), slice(240, 3000)
    got = []
    pool = quality.pool_of(x[rest], f[rest])

    def listening(models, base):
        got.append(pool(models, base))
        return got[-1]

    taught = quality.co_train(x[few], f[few], y[few], listening)
    for pupil in (0, 1):
        for label in (0.0, 1.0):
            assert sum(len(r) for lessons in got for p, r, v in lessons if (p, v) == (pupil, label)) > 50
    alone = quality.co_train(x[few], f[few], y[few], None)

    def right(p):
        return ((p >= 0.5) == y[rest]).mean()

    by_text, by_page, both = map(right, taught.scores(x[rest], f[rest]))
    before = [right(p) for p in alone.scores(x[rest], f[rest])]
    assert by_text > before[0] + 0.04
    assert both >= max(by_text, by_page) and both > max(before[:2])

    # The same on Spark, where every document without a label is looked at.
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:240]], "doc_id long, quality int")
    scored = {r["doc_id"]: r["quality_score"] for r in quality.classify(docs, labels).collect()}
    assert right(np.array([scored[i] for i in range(240, 3000)])) >= both - 0.01


def test_spark_passes_on_what_the_list_does(spark, monkeypatch):
    import numpy as np

    from mnemograph.llm import quality

    rows = pages_of_two_kinds(400, 5)
    monkeypatch.setattr(quality, "PER_ROUND", 60)
    seen = []
    whole = quality.co_train

    def spying(x, f, y, pool, rounds=2):
        def lessons(models, base):
            found = pool(models, base)
            seen.append((models, base, found))
            return found

        return whole(x, f, y, lessons, rounds)

    monkeypatch.setattr(quality, "co_train", spying)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(399, rows[399][1]), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:40]], "doc_id long, quality int")
    quality.classify(docs, labels).count()
    buckets = {}
    x = np.stack([quality.text_features(t, buckets) for _, t, _ in rows[40:]])
    f = np.stack([quality.page_features(t, {}) for _, t, _ in rows[40:]])
    pool = quality.pool_of(x, f)
    assert len(seen) == 2
    for models, base, found in seen:
        want = pool(models, base)
        key = lambda lessons: {(p, v): sorted(r.tobytes() for r in rows_) for p, rows_, v in lessons}
        assert key(found) == key(want)


# -- spans that hold others ----------------------------------------------------


def test_a_found_span_may_hold_base_spans():
    text = "Write to john dot smith@example.com now"
    base, every = pii.find(text)
    assert base["email"] == [(18, 35)] and every["email"] == [(9, 35), (18, 35)]
    assert pii.masked(text, every) == "Write to <EMAIL> now"


def test_long_disguised_addresses():
    local, host = " dot ".join("abcdefgh"), " dot ".join(["mail"] * 9 + ["org"])
    text = f"at {local} at {host} x"
    _, every = pii.find(text)
    assert len(every["email"]) == 1


# -- every query of the subpackage, and every stage, on small and odd tables ---


ODD = [
    (1, "Write to a@b.org or 10.0.0.1, 4111 1111 1111 1111 or +49 30 1234567.\nA line of several words here", "en", "s", 0),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, "word " * 3000, "en", "t", 1),
    (5, "word " * 3000, "en", "t", 1),
    (5, "word " * 3000, "en", "t", 1),
    (6, "the same line\nthe same line\n\nanother one of them", "de", "s", 2),
    (7, "x" * 900, "de", "s", 2),
    (8, "y" + "x" * 900, "de", "s", 2),
]
KIND = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd_dir(spark, tmp_path_factory, request):
    at = tmp_path_factory.mktemp(request.param)
    rows = ODD if request.param == "odd" else []
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, 0), (6, 1), (7, 0), (None, 1)] if rows else [], "doc_id long, quality int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    vectors = [(1, [1.0, 0.0], "a"), (2, [0.99, 0.05], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [1.0, float("nan")], "a"), (6, [1.0, 0.0], None), (7, [1.0, 0.0], "b")]
    spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<double>, label string").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return str(at), rows


def test_queries_on_odd_tables(spark, odd_dir):
    import hashlib
    import zlib

    from mnemograph.llm.queries import QUERIES

    at, rows = odd_dir
    got = {n: q(spark, at).collect() for n, q in QUERIES.items()}
    assert {n: len(r) for n, r in got.items() if n not in ("op3_embeddings", "op6_packing")} == {n: len(rows) for n in got if n not in ("op3_embeddings", "op6_packing")}
    if not rows:
        assert not got["op3_embeddings"] and not got["op6_packing"]
        return
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    assert [tuple(r)[:4] for r in sorted(got["op3_embeddings"])] == [(1, 1, 1, True), (2, 1, 1, False), *((k, 0, k, True) for k in (3, 4, 5, 6, 7))]
    for r in got["op5_ogg"]:
        payload = raw[r["doc_id"]] + bytes(-len(raw[r["doc_id"]]) % 64 or (0 if raw[r["doc_id"]] else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    for r in got["op7_suffixes"]:
        copied, hit = r["doc_id"] in (4, 5), r["doc_id"] in (4, 5, 7, 8)
        assert r["n_bytes"] == len(raw[r["doc_id"]]) and r["repeats"] == hit and (r["n_removed"] == r["n_bytes"]) == (copied or r["doc_id"] == 7 or not r["n_bytes"])
        assert r["kept_sha256"] == hashlib.sha256(b"y" if r["doc_id"] == 8 else b"" if hit else raw[r["doc_id"]]).hexdigest()
    sizes = sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got["op9_sharding"])
    assert sizes == sorted((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["n_spans"]) for r in got["op4_pii"]}[1] == (1, 1, 1, 1, 4)
    places = {}
    for r in got["op6_packing"]:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 1024
    assert {r["component_id"] for r in got["op2_simhash"] if r["doc_id"] in (2, 3)} == {2}
    assert all(r["ids"] is None or r["n_ids"] == len(r["ids"]) for r in got["op1_sentencepiece"])


def test_stages_on_odd_tables(spark, odd_dir):
    import corpus_pipeline

    at, rows = odd_dir
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumnRenamed("lang", "lang")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "packing":
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        kept = [r["doc_id"] for r in out.collect()]
        assert set(kept) <= {r[0] for r in rows}
        if name in ("lines", "personal_data"):
            assert sorted(kept) == sorted(r[0] for r in rows)
        if name == "near_duplicates" and rows:
            assert sorted(kept) == [1, 2, 4, 6, 7, 8]
        if name == "packing":
            assert set(kept) == {r[0] for r in rows}


def test_pipeline_leaves_only_its_last_table(spark, odd_dir):
    import glob

    import corpus_pipeline

    at, rows = odd_dir
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{root}/*/*"))
    out = corpus_pipeline.run(spark, at)
    assert len({r["doc_id"] for r in out.collect()}) > 0 if rows else out.count() == 0
    assert [p.rsplit("-", 1)[1] for p in set(glob.glob(f"{root}/*/*")) - before] == ["packing"]
