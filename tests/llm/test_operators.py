"""Each training-data operator against a brute-force version, and on its defined odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.llm import common, lines, media, packing, pieces, pii, quality, sharding, simhash, suffixes
from mnemograph.llm import embeddings as vectors

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, an empty, a blank and a long one."""
    rng = random.Random(7)
    texts = ["\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    passage = prose(rng, 100)
    texts += [texts[0], texts[0], texts[1] + " end", f"{prose(rng, 30)}\n{passage}\n{prose(rng, 5)}", f"{passage} {prose(rng, 9)}"]
    texts += [None, "", "  \n\t ", "x", prose(rng, 20000), "ab" * 900, "Ünïcode — ж 漢字 🎉 " * 30]
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """The corpus, with columns whose names clash with those that operators like to use."""
    rows = [(*r, "clash", 1) for r in corpus]
    schema = T.StructType([*DOCS.fields, T.StructField("row", T.StringType()), T.StructField("f", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


# -- shared tools --------------------------------------------------------------


def components_of(pairs, nodes):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        at[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    got = common.connected_components(common.Workspace(spark), spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    pairs = [p for p in pairs if p[0] != p[1]]
    want = components_of(pairs, {n for p in pairs for n in p})
    assert {r[0]: r[1] for r in got.collect()} == want


def test_connected_components_of_nothing(spark):
    assert common.connected_components(common.Workspace(spark), spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# -- 9 -------------------------------------------------------------------------


def test_hypergeometric_law():
    rng = random.Random(1)
    drawn = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20000))
    for k in range(5):
        want = math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4)
        assert abs(drawn[k] / 20000 - want) < 0.015
    assert sharding.hypergeometric(rng, 10**11, 9 * 10**11, 10**6) == pytest.approx(10**5, abs=3000)


def test_matrix_sums():
    sizes, shards = [7, 0, 100, 13, 5], sharding.exact_sizes(125, 8)
    m = sharding.communication_matrix(sizes, shards, 3)
    assert [sum(r) for r in m] == sizes and [sum(c) for c in zip(*m, strict=True)] == shards


@pytest.mark.parametrize("n", [0, 3, 500])
def test_shards(spark, n):
    df = spark.range(n).withColumn("source", F.lit("x")).withColumn("mix", F.lit(None).cast("string"))
    rows = sharding.uniform_shards(df, 7, rows_per_block=32).collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert [len(slots[s]) for s in range(7)] == sharding.exact_sizes(n, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_uniform(spark):
    seen = Counter()
    for seed in range(12):
        for r in sharding.uniform_shards(spark.range(40), 4, seed=seed, rows_per_block=8).collect():
            seen[r["id"] < 20, r["shard"]] += 1
    assert all(abs(n - 60) < 30 for n in seen.values())


def test_shards_keep_repeated_rows(spark):
    rows = sharding.uniform_shards(spark.createDataFrame([(1, None)] * 50, "a int, b string"), 4).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 50


# -- 5 -------------------------------------------------------------------------


def ogg_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(2)
    for n in (0, 1, 7, 300):
        data = rng.randbytes(n)
        assert media.page_checksum(data) == ogg_crc(data)


@pytest.mark.parametrize("n", [64, 4096, 4160, 64 * 1024, 65025 * 3 + 55, 255 * 64])
def test_ogg_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = media.write_ogg(payload, n - 3)
    assert media.read_samples(data)[:2] == (payload, n - 3)
    streams = media.read_ogg(data)
    assert streams[media.SAMPLES_SERIAL].times(media.RATE)[-1] == n / media.RATE


@pytest.mark.parametrize("length", [0, 254, 255, 256, 510, 65025, 65026, 200000])
def test_packets_of_any_length(length):
    packets = [(b"head", 0), (b"a" * length, 5), (b"", 6), (b"z", 9)]
    got = media.read_ogg(b"".join(media.stream_pages(7, packets)))[7]
    assert got.packets == [p for p, _ in packets] and got.marks[-1] == (9, 4)


def test_faults_are_found():
    data = media.write_ogg(bytes(range(256)) * 40, 10000)
    for at in (3, 30, 200, len(data) - 1):
        with pytest.raises(media.OggError):
            media.read_samples(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(media.OggError):
        media.read_ogg(data[:-5])
    page = data.index(b"OggS", 1)
    with pytest.raises(media.OggError):
        media.read_ogg(data[page:])


def test_media_query(docs, corpus):
    got = media.read_media(media.to_media(docs, "doc_id", "text"), "doc_id").collect()
    want = Counter()
    for k, t in corpus:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want[k, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({r["media_sha256"] for r in got}) == len({r["payload_sha256"] for r in got})


# -- 1 -------------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b", "\n\t x", "日本語テキスト🎉", "a" * 3000, " " * 50 + "x", "É́ ñ", "he said: don't", "\0", "aé" * 500]


def test_pieces_equal_the_library(corpus):
    import sentencepiece

    texts = [t for _, t in corpus if t is not None] + [t for t in ODD if "\0" not in t]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = {}
    for _ in range(2):  # the second time from the cache
        got = [x.tolist() for x in pieces.encode_texts(pieces.Model(PIECES), texts, cache)]
        assert got == library.encode(texts)


def test_viterbi_is_best():
    model = pieces.Model(PIECES, pieces.UNIGRAM)

    def best(word, memo):
        if not word:
            return 0.0
        if word not in memo:
            options = [(model.scores[model.ids[word[:n]]], n) for n in range(1, len(word) + 1) if word[:n] in model.ids]
            if word[0] not in model.ids:
                options.append((model.unknown_score, 1))
            memo[word] = max(s + best(word[n:], memo) for s, n in options)
        return memo[word]

    words = [" thereby", " therefore", " theory", " zß漢", "  the", "the"]
    for word, parts in model.segment(words):
        assert "".join(parts) == word
        score = sum(model.scores[model.ids[p]] if p in model.ids else model.unknown_score for p in parts)
        assert score == pytest.approx(best(word, {}))


def test_pieces_round_trip(spark, docs, corpus):
    coded = pieces.encode(docs, "doc_id", "text", PIECES)
    back = pieces.decode(coded, "doc_id", PIECES).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(corpus)
    both = pieces.encode(docs, "doc_id", "text", PIECES, with_text=True).collect()
    assert sorted(map(str, both)) == sorted(map(str, back))
    assert pieces.encode(docs.limit(0), "doc_id", "text", PIECES).count() == 0


# -- 4 -------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=d: 13 <= len(d) <= 19 and plain_luhn(d),
                "phone": lambda d=d: 9 <= len(d) <= 15,
            }[kind]
            if good():
                out[kind].append(m.span())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_detectors_equal_the_patterns(seed):
    rng = random.Random(seed)
    cards = ["4111 1111 1111 1111", "4845168114407329", "9807-9157-6280-4490", "378282246310005"]
    parts = ["a", "b.c", "@", ".", "-", " ", "  ", "+", "(", ")", "1", "12", "255", "256", "007", "1.2.3.4", "x@y.zz", "+1 (017) 555-7713", "é", "_%", *cards]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        base, every = pii.find(text)
        assert base == base_spans(text), text
        assert all(set(base[k]) <= set(every[k]) for k in base), text


DISGUISED = {
    "write john dot smith (at) mail dot example dot com now": ("email", "john dot smith (at) mail dot example dot com"),
    "x john [at] example [dot] org.": ("email", "john [at] example [dot] org"),
    "ask bob at example dot com today": ("email", "bob at example dot com"),
    "ask john@exаmple.com": ("email", "john@exаmple.com"),
    "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ!": ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    "call plus one five five five one two three four five six seven": ("phone", "plus one five five five one two three four five six seven"),
    "it is four one one one 1111 1111 1111.": ("card", "four one one one 1111 1111 1111"),
    "at 10[.]0[.]0[.]12 ok": ("ip", "10[.]0[.]0[.]12"),
    "at 192 dot 168 dot 1 dot 77 ok": ("ip", "192 dot 168 dot 1 dot 77"),
}


@pytest.mark.parametrize("text", DISGUISED)
def test_disguises(text):
    kind, found = DISGUISED[text]
    base, every = pii.find(text)
    assert [text[s:e] for s, e in every[kind]] == [found]
    assert pii.masked(text, every) == text.replace(found, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["he is at home. dot matrix", "one two three", "meet at noon", "version 1.2.3", "Привет мир, как дела", "at a dot b"])
def test_clean_texts_stay(text):
    assert not any(pii.find(text)[1].values())


def test_long_odd_texts_are_fast():
    for text in ("1" * 200_000, "1.2" * 60_000, "+1 " * 60_000, "a" * 200_000 + "@", "a@" * 60_000, "one " * 40_000, " at " * 40_000, "a dot b " * 20_000):
        pii.find(text)


def test_pii_query(docs, corpus):
    got = pii.scan(docs, "doc_id", "text").collect()
    want = Counter((k, hashlib.sha256(pii.joined(base_spans(t or "")).encode()).hexdigest()) for k, t in corpus)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    assert pii.scan(docs.limit(0), "doc_id", "text").count() == 0
    masked = pii.mask(docs, "text")
    assert masked.columns == docs.columns and masked.where("text is null").count() == sum(t is None for _, t in corpus)


# -- 2 -------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash_query(docs, corpus):
    got = simhash.near_duplicates(docs, "doc_id", "text").collect()
    prints = [plain_fingerprint(t) for _, t in corpus]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((k, f"{f:016x}") for (k, _), f in zip(corpus, prints, strict=True))
    n = len(corpus)
    at = components_of([(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], range(n))
    least = {}
    for i, (k, _) in enumerate(corpus):
        if k is not None:
            least[at[i]] = min(k, least.get(at[i], k))
    want = Counter((k, least.get(at[i])) for i, (k, _) in enumerate(corpus))
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want


def test_links_of_near_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    prints = set(base)
    for f in base:
        for _ in range(12):
            prints.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    prints = sorted(lines._signed(f) for f in prints)
    near = lambda k: {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= k}
    df = spark.createDataFrame([(f,) for f in prints], "f long")
    for k in (0, 2, 3):
        got = [tuple(r) for r in simhash.links(df, "f", k).collect()]
        assert len(got) == len(set(got)) and set(got) == near(k)
    meet = {tuple(sorted((a, b))): False for a, b in near(3)}
    keyed = df.select("f", F.explode(lines._block_keys(F.col("f"))).alias("k"))
    for r in keyed.alias("x").join(keyed.alias("y"), "k").select("x.f", "y.f").distinct().collect():
        meet[tuple(sorted(r))] = True
    assert all(meet[p] for p in near(3))


def test_links_are_never_broadcast(spark):
    """The file of 200 fingerprints is far below Spark's threshold, as that of 300,000 is; their cells are not."""
    prints = common.Workspace(spark).put(spark.range(200).select(F.xxhash64("id").alias("f")))
    pairs = simhash.links(prints, "f")
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_many_links_are_not_broadcast(spark, monkeypatch):
    edges = [(n, n + 1) for n in range(0, 60) if n % 7]
    df = spark.createDataFrame(edges, "a long, b long")
    want = components_of(edges, {n for e in edges for n in e})
    joins = []
    put = common.Workspace.put
    monkeypatch.setattr(common.Workspace, "put", lambda self, df, tag="t": joins.append(df._jdf.queryExecution().executedPlan().toString()) or put(self, df, tag))
    for limit, met in ((common.BROADCAST_BYTES, True), (0, False)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        joins.clear()
        got = common.connected_components(common.Workspace(spark), df, "a", "b").collect()
        assert {r["node"]: r["component"] for r in got} == want
        assert any("Join" in p for p in joins) and any("BroadcastHashJoin" in p for p in joins) == met


def test_keep_one(spark, docs, corpus):
    got = simhash.keep_one(docs, "doc_id", "text", shingle=3)
    assert got.columns == docs.columns
    prints = [plain_fingerprint(t) for _, t in corpus]
    n = len(corpus)
    at = components_of([(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], range(n))
    assert got.count() == len(set(at.values()))
    assert got.limit(0).count() == 0 and simhash.keep_one(docs.limit(0), "doc_id", "text").count() == 0


# -- 3 -------------------------------------------------------------------------


def plain_vector_rows(rows, threshold=0.93):
    unit = []
    for _, v, label in rows:
        good = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if good else None
        unit.append(x / np.linalg.norm(x) if good else None)
    n = len(rows)
    pairs = [
        (i, j)
        for i in range(n)
        for j in range(i)
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    ]
    at, count = components_of(pairs, range(n)), Counter(i for p in pairs for i in p)
    least = {}
    for i, r in enumerate(rows):
        least[at[i]] = min(r[0], least.get(at[i], r[0]))
    return Counter((r[0], count[i], least[at[i]], r[0] == least[at[i]]) for i, r in enumerate(rows))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, kind, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 8)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        c = rng.normal(size=32)
        rows += [(len(rows) + i, np.float32(c + rng.normal(size=32) * 0.12).tolist(), g % 3) for i in range(1 + g % 5)]
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2]), (902, rows[0][1], 2), (902, rows[0][1], None)]
    rows += [(903, None, 1), (904, [], 1), (905, [0.0] * 32, 1), (906, [float("nan")] * 32, 1), (907, [1.0, None], 1), (908, [float("inf"), 1.0], 1)]
    rows += [(909, [1.0, 2.0], 1), (910, [2.0, 4.0], 1), (911, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], f"vec_id long, embedding array<{kind}>, label int, size string")
    got = vectors.near_duplicates(df).collect()
    assert Counter(tuple(r) for r in got) == plain_vector_rows(rows)


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# -- 6 -------------------------------------------------------------------------


def test_best_pattern_is_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 15), 4, replace=False))
        values = rng.random(4)
        got = packing.best_pattern(values, lengths, 20)
        assert got @ lengths <= 20

        def value(room, k=0, lengths=lengths, values=values):
            return 0.0 if k == 4 else max(c * values[k] + value(room - c * lengths[k], k + 1) for c in range(room // lengths[k] + 1))

        assert got @ values == pytest.approx(value(20))


@pytest.mark.parametrize("seed", range(3))
def test_solution_covers_all(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 400) for n in rng.sample(range(1, 101), 40)}
    patterns = packing.solve(counts, 100)
    used = Counter()
    for p, times in patterns.items():
        assert sum(p) <= 100
        for n in p:
            used[n] += times
    assert used == counts
    assert sum(patterns.values()) <= len(packing.best_fit([n for n, c in counts.items() for _ in range(c)], 100)) + 1


def test_solution_meets_the_volume_bound():
    rng = random.Random(9)
    counts = Counter(min(1024, int(rng.lognormvariate(5, 1)) + 1) for _ in range(60_000))
    used = sum(packing.solve(counts, 1024).values())
    assert used <= 1.002 * sum(n * c for n, c in counts.items()) / 1024 + 1


def test_packing_query(spark, docs, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = Counter()
    for k, text in corpus:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for i, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[k, i, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    for ranks in (None, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        rows = packing.pack(docs, "doc_id", "text", path, ranks, 2, 64).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        held = defaultdict(list)
        for r in rows:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for spans in held.values():
            end = 0
            for o, n in sorted(spans):
                assert o == end
                end += n
            assert end <= 64
    assert packing.pack(docs.limit(0), "doc_id", "text", path).count() == 0


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.cut(16, 8) == [(0, 8), (8, 8)]


# -- 7 -------------------------------------------------------------------------


def plain_repeats(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


def plain_later(texts, width):
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if t[i : i + width] in seen:
                gone[i : i + width] = True
            seen.add(t[i : i + width])
        out.append(gone)
    return out


def test_suffix_order():
    rng = random.Random(4)
    for _ in range(20):
        s = np.array([rng.randrange(3) for _ in range(80)])
        order, ranks = suffixes.suffix_array(s, 200)
        text = s.tolist()
        assert order.tolist() == sorted(range(80), key=lambda i: text[i:])
        lcp = np.zeros(80, np.int64)
        lcp[1:] = suffixes.common_prefix(ranks, order[:-1], order[1:])
        earlier, later = suffixes.longest_factors(order, lcp)

        def match(i, j, text=text):
            n = 0
            while max(i, j) + n < 80 and text[i + n] == text[j + n]:
                n += 1
            return n

        for k, i in enumerate(order.tolist()):
            assert earlier[k] == max((match(i, j) for j in range(i)), default=0)
            assert later[k] == max((match(i, j) for j in range(i + 1, 80)), default=0)


def test_keep_first():
    a, b = b"0123456789" * 2, b"xx0123456789yy"
    assert suffixes.keep_first([a, b], 10) == [b"0123456789", b"xxyy"]


@pytest.mark.parametrize("crowd", [512, 1])
def test_repeats_query(docs, corpus, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "SCAN", 1000)
    texts = [(t or "").encode() for _, t in corpus]
    want = Counter()
    for (k, _), t, gone in zip(corpus, texts, plain_repeats(texts, 100), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        want[k, len(t), spans, bytes(np.frombuffer(t, np.uint8)[~gone])] += 1
    rows = suffixes.repeats(docs, "doc_id", "text", 100).collect()
    assert Counter((r["doc_id"], r["n_bytes"], tuple(tuple(s) for s in r["spans"]), bytes(r["kept"])) for r in rows) == want
    first = Counter()
    ordered = sorted(range(len(texts)), key=lambda i: (corpus[i][0] is None, corpus[i][0] or 0, i))
    for i, gone in zip(ordered, plain_later([texts[i] for i in ordered], 100), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        first[corpus[i][0], spans, bytes(np.frombuffer(texts[i], np.uint8)[~gone])] += 1
    assert Counter((r["doc_id"], tuple(tuple(s) for s in r["later"]), bytes(r["kept_first"])) for r in rows) == first
    assert any(r["later"] and r["kept_first"] for r in rows)


def test_factor_lengths():
    rng = random.Random(9)
    texts = [bytes(rng.randrange(97, 99) for _ in range(60)) for _ in range(4)] + [b"a" * 50]
    joined = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]

    def match(x, y):
        a, b = texts[x[0]][x[1] :], texts[y[0]][y[1] :]
        return next((n for n, (c, d) in enumerate(zip(a, b, strict=False)) if c != d), min(len(a), len(b)))

    for k, (earlier, later) in enumerate(suffixes.factors(texts, 7)):
        for i in range(len(texts[k])):
            before = max((match((k, i), p) for p in joined if p < (k, i)), default=0)
            after = max((match((k, i), p) for p in joined if p > (k, i)), default=0)
            # Shorter matches than the width are of no interest and may be reported as none.
            assert earlier[i] == (before if before >= 7 else 0) and later[i] == (after if after >= 7 else 0)


@pytest.mark.parametrize(("scan", "crowd"), [(64, 4096), (1 << 15, 1)])
def test_passages(spark, scan, crowd, monkeypatch):
    """Runs of 20 words that stand in another row, below the width in bytes, however spaced; a text's own repeats do not count."""
    monkeypatch.setattr(suffixes, "SCAN_WORDS", scan)
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rng = random.Random(12)

    def words(n):
        return [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)]

    shared, near, own = words(25), words(300), words(30)
    texts = [" ".join(words(200)) for _ in range(20)] + ["", None, "a b", " ".join(shared), " ".join(shared[:19])]
    texts += [" ".join(words(k) + shared[k % 4 : 20 + k % 5] + words(30)) for k in range(9)] + ["\n".join(words(9) + shared[2:24]) + "\t \n"]
    texts += [" ".join([*near[:k], "X", *near[k + 1 :]]) for k in (40, 150, 260)] + [" ".join(own * 3), " ".join(words(50))] + [" ".join(words(60))] * 2 + ["c d"] * 2
    split = [(t or "").split() for t in texts]
    holders = defaultdict(set)
    for k, w in enumerate(split):
        for i in range(len(w) - 19):
            holders[tuple(w[i : i + 20])].add(k)
    want = {}
    for k, w in enumerate(split):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            if len(holders[tuple(w[i : i + 20])]) > 1:
                gone[i : i + 20] = True
        want[k] = (len(suffixes._runs(gone)), int(gone.sum()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_passages"], r["n_passage_words"]) for r in suffixes.repeats(df, "doc_id", "text", 400, passage=20).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 15 and want[texts.index(" ".join(own * 3))] == (0, 0)
    assert suffixes.repeats(df, "doc_id", "text", 400).where("n_passages is not null").count() == 0


def test_no_repeats(docs):
    assert suffixes.repeats(docs.limit(0), "doc_id", "text").count() == 0


# -- 8 -------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_similar(a, b):
    return plain_distance(a, b) <= math.floor(0.2 * max(len(a), len(b)) + 1e-9)


def plain_line_print(norm):
    words = set(norm.split(" "))
    ones = Counter()
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=42).intdigest()
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(words))


def plain_meet(differ):
    """Whether fingerprints that differ in these bits share two of five blocks and are within eight bits."""
    same = [differ >> at & (1 << n) - 1 for at, n in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))].count(0)
    return same >= 2 and differ.bit_count() <= 8


def plain_kept(rows):
    """rows: (order, text) in file order -> kept positions of each."""
    first, blank = {}, []
    for i, (k, t) in enumerate(rows):
        for p, line in enumerate([] if t is None else t.split("\n")):
            norm = re.sub(r"[ \t\r\f\x0b]+", " ", line.lower()).strip(" ")
            if not norm:
                blank.append((i, p))
                continue
            here = (k is None, k or 0, i, p)
            first[norm] = min(here, first.get(norm, here))
    norms = sorted(first)
    prints = {n: plain_line_print(n) for n in norms}
    pairs = [
        (a, b)
        for a in norms
        for b in norms
        if a < b and plain_meet(prints[a] ^ prints[b]) and plain_similar(a, b)
    ]
    groups = components_of(pairs, norms)
    best = {}
    for n in norms:
        best[groups[n]] = min(first[n], best.get(groups[n], first[n]))
    kept = defaultdict(list)
    for _, _, i, p in best.values():
        kept[i].append(p)
    for i, p in blank:
        kept[i].append(p)
    return [sorted(kept[i]) for i in range(len(rows))], len(pairs)


def test_lines(spark, tmp_path):
    rng = random.Random(11)
    # Many different words, so that one edit is few bits: a word counts once for a line.
    base = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(rng.randint(20, 60))) for _ in range(12)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(base)
            if rng.random() < 0.5:
                words = line.split()
                words[rng.randrange(len(words))] += rng.choice(["s", "", "x"])
                line = " ".join(words)
            own.append(rng.choice([line, line.upper(), f"  {line}\t", "", prose(rng, 6)]))
        rows.append((i * 7 % 60, "\n".join(own)))
    rows += [(None, rows[0][1]), (5, None), (6, ""), rows[3], (7, "\n\n"), (8, base[0])]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, file string").coalesce(1).write.parquet(path)
    want, linked = plain_kept(rows)
    assert linked > 5
    texts = Counter()
    for (k, t), kept in zip(rows, want, strict=True):
        own = [] if t is None else t.split("\n")
        texts[k, None if t is None else "\n".join(own[p] for p in kept), len(own), len(kept)] += 1
    got = lines.dedup_lines(spark.read.parquet(path)).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_kept"]) for r in got) == texts
    report = Counter()
    for (k, t), kept in zip(rows, want, strict=True):
        own = [] if t is None else t.split("\n")
        report[k, len(own), tuple(p for p in kept if own[p].strip())] += 1
    found = lines.line_report(spark.read.parquet(path)).collect()
    assert Counter((r["doc_id"], r["n_lines"], tuple(r["kept"])) for r in found) == report
    assert all(r["n_kept"] == len(r["kept"]) for r in found)
    # A frame that is no file gives as many lines.
    memory = lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r["n_kept"] for r in memory) == sum(r["n_kept"] for r in got)


def test_lines_with_a_changed_word(spark):
    """Recall against edit similarity alone: half of the lines of 20 to 60 words with one word changed go, and no other."""
    rng = random.Random(8)
    base = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(rng.randint(20, 60))) for _ in range(200)]
    near = []
    for line in base:
        words = line.split()
        words[rng.randrange(len(words))] = f"changed{rng.randrange(99)}"
        near.append(" ".join(words))
    assert all(plain_similar(a, b) for a, b in zip(base, near, strict=True))
    differ = [plain_line_print(a) ^ plain_line_print(b) for a, b in zip(base, near, strict=True)]
    docs = spark.createDataFrame([*enumerate(base), *enumerate(near, 1000)], "doc_id long, text string")
    gone = {r["doc_id"] for r in lines.dedup_lines(docs).collect() if r["n_kept"] == 0}
    assert gone == {1000 + i for i, x in enumerate(differ) if plain_meet(x)}
    assert len(gone) >= len(base) / 2 and len(gone) > sum(x.bit_count() <= 3 for x in differ)


def test_lines_against_edit_similarity_alone(spark):
    """No gate of bits in the brute force: what goes is similar to something. How much is missed is not bounded here."""
    rng = random.Random(21)
    texts = []
    for _ in range(20):
        words = [f"{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(rng.randint(10, 40))]
        texts.append(" ".join(words))
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 10)):
            other[at] = f"{rng.choice(WORDS)}{rng.randrange(99)}"
        texts.append(" ".join(other))
        texts.append(" ".join(words[: math.ceil(len(words) * 0.85)]))
    texts = sorted(set(texts))
    similar = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) + 5 and plain_similar(x, y)}
    group = components_of(sorted(similar), range(len(texts)))
    gone = {r["doc_id"] for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r["n_kept"] == 0}
    ought = {i for i in range(len(texts)) if group[i] != i}
    assert gone and gone <= ought


def test_long_lines(spark):
    rng = random.Random(3)
    a = prose(rng, 600)
    words = a.split()
    b = " ".join([*words[:100], "other", *words[101:]])
    c = prose(random.Random(9), 600)
    df = spark.createDataFrame([(a, b), (a, c), (a, a)], "x string, y string")
    df = df.select(F.monotonically_increasing_id().alias("i"), "x", "y")
    ids = [r[0] for r in df.sort("i").select("i").collect()]
    assert sorted(r[0] for r in lines.alike(df, "x", "y", 0.8).collect()) == [ids[0], ids[2]]


def test_no_lines(docs):
    empty = lines.dedup_lines(docs.limit(0))
    assert empty.count() == 0 and empty.columns == [*docs.columns, "n_lines", "n_kept"]


# -- 10 ------------------------------------------------------------------------


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = i % 4 > 0
        text = "\n".join(prose(rng, 12).capitalize() + "." for _ in range(4))
        out.append((i, text if good else text.upper().replace(" ", "!! "), rng.choice(["a", "b"]) if good else rng.choice(["b", "c"]), len(text), int(good)))
    return out


def test_quality_held_out(spark):
    rows = labelled(600, 1)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, n_chars int")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:300]] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    right = [(got[r[0]]["quality_score"] >= 0.5) == bool(r[4]) for r in rows[300:]]
    assert sum(right) / len(right) > 0.97
    again = {r["doc_id"]: r["quality_score"] for r in quality.classify(docs.repartition(3), labels).collect()}
    assert all(abs(again[k] - r["quality_score"]) < 1e-6 for k, r in got.items())


def test_the_views_teach_each_other():
    rng = np.random.default_rng(0)
    n, pool = 60, 3000
    y, hidden = (np.arange(n) % 2).astype(float), (np.arange(pool) % 2).astype(float)

    def view(labels, width):
        return (rng.normal(size=(len(labels), width)) + 1.2 * (labels[:, None] - 0.5) * (np.arange(width) < 4)).astype(np.float32)

    x, f, px, pf = view(y, 40), view(y, 40), view(hidden, 40), view(hidden, 40)
    alone = quality.co_train(x, f, y, None)
    taught = quality.co_train(x, f, y, quality.pool_of(px, pf))
    accuracy = lambda m: ((m.scores(px, pf)[2] >= 0.5) == hidden).mean()
    assert accuracy(taught) >= accuracy(alone) - 0.01 and accuracy(taught) > 0.85


def test_quality_odd_cases(spark, docs, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none)
    assert got.columns[:4] == docs.columns and {r["quality_score"] for r in got.collect()} == {1.0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == len(corpus)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_alike(spark):
    """The same rows as the plain distance tells, and each list of words is split once a row."""
    rng = random.Random(8)
    rows = [("", ""), ("", "a"), ("a b", "a b"), ("x" * 9, "x" * 8 + "y"), ("a a a", "a a"), ("é ü ñ ç", "é ü ñ c")]
    for _ in range(400):
        w = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 90))]
        v = list(w)
        for _ in range(rng.randrange(0, 3 + len(w))):
            at = rng.randrange(len(v) + 1)
            v[at : at + rng.randrange(2)] = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 9)))] * rng.randrange(2)
        rows.append((" ".join(w), " ".join(v)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, x string, y string")
    plain = F.levenshtein("x", "y") <= F.floor(F.greatest(F.char_length("x"), F.char_length("y")) * 0.2 + 1e-9)
    want = sorted(r["i"] for r in df.where(plain).collect())
    out = lines.alike(df, "x", "y", 0.8)
    assert sorted(r["i"] for r in out.collect()) == want and 50 < len(want) < 350 and out.columns == ["i"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(x") == 1
