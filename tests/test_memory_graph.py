"""The memory graph on small inline data: functions, search, resolution, edits, merge, retrieval, sources, streaming."""

import json
import random
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemograph.functions import parsing, prompt, text
from mnemograph.functions.vector import COVERAGE, coverage, dot, embed
from mnemograph.operators import graph, ingest, mutate, names, resolve, search
from mnemograph.plans import scripted
from mnemograph.plans.retrieval import ContextCache, Session, chat_reranker, without_known
from mnemograph.schema import CHAT_TURNS, ENTITIES, EPISODES, FACTS, kind, natural_id
from mnemograph.sources import review_table
from mnemograph.sources.store import Store
from mnemograph.streaming.ingest_stream import fact_counts, ingest_stream, merge_turns

T0 = datetime(2024, 1, 1)
WORDS = [["likes", "prefers", "preferred"], ["letters", "answers"], ["the"], ["user"], ["weather"], ["is"], ["sunny"], ["today"], ["how"], ["should"], ["be"], ["handled"], ["loud"], ["music"], ["holds"], ["b"], ["7"], ["permit"], ["never"], ["again"], ["curt"], ["completely"], ["unrelated"], ["sentence"], ["short"]]
VECTORS = {w: [float(k == i) for k in range(len(WORDS))] for i, group in enumerate(WORDS) for w in group}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def fact(id_, subject, object_=None, predicate="p", fact_text=None, at=0, ended=None, embedding=(), graph_id="g"):
    return (graph_id, id_, subject, object_, predicate, fact_text or f"text {id_}", list(map(float, embedding)), T0 + timedelta(minutes=at), ended, at)


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACTS)


def entity(id_, name, seq, kind_="other", aliases=(), ref=None):
    return ("g", id_, name, "", kind_, [], list(aliases), ref, seq)


def word_table(spark):
    return spark.createDataFrame(list(VECTORS.items()), "word string, vec array<float>")


# -- functions -----------------------------------------------------------------


def test_tokens(spark):
    assert value(spark, text.tokens(F.lit("Héllo, wörld! 42-times a_b"))) == ["héllo", "wörld", "42", "times", "a", "b"]
    assert value(spark, text.tokens(F.lit(""))) == [] and value(spark, text.tokens(F.lit("!?"))) == []
    assert value(spark, text.content_terms(F.lit("How should the webhook be handled, webhook?"))) == ["webhook", "handled"]


MATCHES = [("Iker", "Iker Ríos", True), ("Iker Rios", "Iker Ríos", True), ("IR", "Iker Ríos", True), ("Iker", "Maria", False), ("Iker Perez", "Maria Rios", False), ("", "x", False), ("B-7 permit", "permit", True), ("ir", "Iker A Rios", True), ("the user", "User", True)]


@pytest.mark.parametrize(("a", "b", "want"), MATCHES)
def test_names_match(spark, a, b, want):
    assert value(spark, text.names_match(F.lit(a), F.lit(b))) is want and value(spark, text.names_match(F.lit(b), F.lit(a))) is want
    assert names.matches(a, b) is want and names.matches(b, a) is want


def test_names_fold_alike(spark):
    """Every letter below U+3000, by the expression and in Python; tokens too, of letters that the JVM knows."""
    letters = [c for c in map(chr, range(0x21, 0x3000)) if unicodedata.category(c)[0] in "LMN"]
    c = F.concat(F.lit("ab"), F.col("c"), F.lit("cd"))
    known = F.regexp_like("c", F.lit(r"[\p{L}\p{M}\p{N}]"))
    for r in spark.createDataFrame([(x,) for x in letters], "c string").select("c", text.folded(c).alias("f"), known.alias("known"), F.array_join(text.tokens(text.folded(c)), " ").alias("t")).collect():
        assert r["f"] == names.fold(f"ab{r['c']}cd")
        assert not r["known"] or r["t"] == " ".join(names.lower_tokens(names.fold(f"ab{r['c']}cd")))
    for a, b in [("Łukasz", "Lukasz"), ("Søren", "Soren"), ("Đorđe", "Dorde"), ("Άννα", "Αννα"), ("Фёдор", "Федор")]:
        assert names.matches(a, b) and value(spark, text.names_match(F.lit(a), F.lit(b)))
    assert not names.matches("ﬁn", "fin") and not value(spark, text.names_match(F.lit("ﬁn"), F.lit("fin")))


def test_dot_and_embedding(spark):
    assert value(spark, dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0 and value(spark, dot(F.array().cast("array<float>"), F.array().cast("array<float>"))) == 0
    rows = [(1, "the user likes curt letters"), (2, "the user prefers short curt answers"), (3, "the weather is sunny today"), (4, ""), (5, "webhook"), (6, "how should webhook idempotency be handled"), (7, "the is")]
    got = {r[0]: r for r in embed(spark.createDataFrame(rows, "id int, text string"), word_table(spark)).collect()}
    sim = ingest.similarity
    assert sim(got[1][1], got[2][1]) == pytest.approx(0.913, abs=1e-3) and sim(got[1][1], got[3][1]) == pytest.approx(0.2, abs=1e-3)
    assert (got[4][1], got[4][2]) == ([], 0.0) and (got[5][1], got[5][2]) == ([], 0.0)
    assert got[6][2] == pytest.approx(1 / 3) and got[7][2] == 1.0 and got[6][2] < COVERAGE
    fold = ingest.word_embedder(VECTORS)
    assert all(fold(t) == pytest.approx(list(got[i][1]), abs=1e-6) for i, t in rows)
    known = F.array(*map(F.lit, VECTORS))
    assert value(spark, coverage(F.lit(rows[5][1]), known)) == pytest.approx(1 / 3)


A = {"subjectName": "Ana", "objectName": None, "predicate": "likes", "factText": "grows figs", "isCorrection": False}


def test_strict_parsing(spark):
    good = f"sure: {json.dumps([A, {**A, 'isCorrection': True}])}!"
    bad = ["not json", "[]", "[null]", json.dumps([A, {**A, "predicate": None}]), json.dumps([{**A, "factText": 1}]), f"{json.dumps([A])} and {json.dumps([A])}", str([A]), "][", "[NaN]", None]
    rows = spark.createDataFrame([(i, o) for i, o in enumerate([good, *bad])], "id int, o string")
    got = {r[0]: r[1] for r in rows.select("id", parsing.parse_extraction(F.col("o"))).collect()}
    assert [x["isCorrection"] for x in got[0]] == [False, True] and all(got[i] == [] for i in range(1, len(bad) + 1))
    assert parsing.decode_order("[3, 1, 2]", 3) == [3, 1, 2] and parsing.decode_order("so [2, 1] it is", 2) == [2, 1]
    for answer, n in (("[1,1,2]", 3), ("[1,2]", 3), ("[1,2,3,4]", 3), ("[1,2,3,1]", 3), ("none", 2), ("[1,2] or [2,1]", 2), ("[true, 2]", 2), ("[]", 0)):
        assert parsing.decode_order(answer, n) is None
    assert value(spark, parsing.json_field(F.lit('{"id": "a"}'), "$.id")) == "a" and value(spark, parsing.json_field(F.lit("{"), "$.id")) is None


@pytest.mark.parametrize(("s", "o", "t", "junk"), [("I", None, "x", True), ("Ana", "you", "x", True), ("Ana", None, "The current date is 1", True), ("Ana", None, "at 5 o'clock", True), ("I ", None, "x", False), ("Ana", "Bob", "grows figs", False)])
def test_junk(spark, s, o, t, junk):
    assert value(spark, text.is_junk(F.lit(s), F.lit(o).cast("string"), F.lit(t))) is junk


def test_prompts(spark):
    assert value(spark, prompt.memory_section(F.lit(None).cast("string"))) == "" == value(spark, prompt.knowledge_section(F.lit("")))
    assert value(spark, prompt.knowledge_section(F.lit("x"))).endswith("\nx")
    assert "2. b" in value(spark, prompt.rerank_prompt(F.lit("q"), F.array(F.lit("a"), F.lit("b"))))
    message = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("hi").alias("text")), F.struct(F.lit("tool").alias("role"), F.lit("x").alias("text")))
    body = json.loads(value(spark, prompt.generate_body(F.lit("sys"), message, F.lit(None).cast("string"))))
    assert [c["role"] for c in body["contents"]] == ["model", "user"] and body["systemInstruction"]["parts"][0]["text"] == "sys"
    cached = json.loads(value(spark, prompt.generate_body(F.lit("sys"), message, F.lit("c/1"))))
    assert cached["cachedContent"] == "c/1" and "systemInstruction" not in cached
    assert value(spark, text.episode_text(F.lit("u"), F.lit("a"), F.lit("Daniel"))) == "Known user name: Daniel\nuser: u\nassistant: a"
    assert "Ada" in value(spark, prompt.identity_preamble(F.lit("Ada"), F.lit("Kind."), F.lit(T0)))


def test_ids_agree(spark):
    for parts in (("g", "fact", 3, "x"), ("g", None, "é"), ("a|b",)):
        assert value(spark, natural_id(*[F.lit(p) for p in parts])) == ingest.make_id(*parts)
    assert value(spark, kind(F.lit("odd"))) == "other"


# -- the graph -----------------------------------------------------------------


def test_degrees_and_ranking(spark):
    own = facts(spark, fact("1", "a", "b"), fact("2", "a", "c"), fact("3", "b"), fact("4", "d", "d"))
    assert {r[0]: r[1] for r in graph.degrees(own).collect()} == {"a": 2, "b": 2, "c": 1, "d": 2}
    ranked = graph.top_facts(facts(spark, fact("1", "a", "b", at=1), fact("2", "a", "c", at=2), fact("3", "z", at=9)), 2)
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == ["2", "1"]
    many = facts(spark, *[fact(f"{i:02}", f"s{i}", at=i) for i in range(25)])
    lines = graph.compilation(many, 5).first()[0].split("\n")
    assert len(lines) == 5 and lines[0] == "text 24" and "text 00" not in lines
    tied = facts(spark, fact("b", "x"), fact("a", "y"))
    assert [r["id"] for r in graph.top_facts(tied, 2).orderBy("rank").collect()] == ["a", "b"]


def test_exports(spark):
    people = spark.createDataFrame([entity("a", "Ana", 0, "user"), entity("b", "Bob", 1, "weird")], ENTITIES)
    own = facts(spark, fact("1", "a", "b", "knows"), fact("2", "a"), fact("3", "gone"), fact("4", "a", "b", ended=T0))
    body = json.loads(graph.graph_json(people, own).first()[0])
    assert len(body["nodes"]) == 2 and body["links"] == [{"source": "a", "target": "b", "label": "knows"}]
    rows = graph.export_rows(own, people).collect()
    assert {(r["subject_name"], r["kind"], r["needs_review"], r["correction_notes"]) for r in rows} == {("Ana", "user", False, "")} and len(rows) == 2
    assert [r["id"] for r in graph.orphans(own, people).collect()] == ["3"]
    page = json.loads(review_table.page_bodies(graph.export_rows(own, people), "db").first()[0])
    assert page["parent"] == {"database_id": "db"} and page["properties"]["Valid From"]["date"]["start"] == "2024-01-01T00:00:00Z"


def test_validity(spark):
    own = facts(spark, fact("1", "a", "k", at=0), fact("2", "a", "k", at=10), fact("3", "a", at=0), fact("4", "a", "k", at=5)).drop("invalid_at")
    wrong = spark.createDataFrame([("a", "k", T0 + timedelta(minutes=5)), ("a", None, T0 + timedelta(minutes=7)), ("a", "k", T0 + timedelta(minutes=8))], "subject_id string, object_id string, ts timestamp")
    got = graph.with_validity(own, wrong)
    ends = {r["id"]: r["invalid_at"] for r in got.collect()}
    assert ends == {"1": T0 + timedelta(minutes=5), "2": None, "3": None, "4": T0 + timedelta(minutes=8)}
    at = F.lit(T0 + timedelta(minutes=6))
    assert {r["id"] for r in graph.facts_as_of(got, at).collect()} == {"3", "4"}


def test_edits(spark):
    people = spark.createDataFrame([entity("a", "Ana", 0), entity("b", "Bob", 1)], ENTITIES)
    own = facts(spark, fact("1", "a", "b", "p", embedding=[1]), fact("2", "a", None, "q"), fact("3", "b", None, "q"), fact("4", "c", "a"), fact("5", "a", "b", ended=T0))
    new, n = mutate.update_entity(people, "a", "Anna", "s")
    assert n.first()[0] == 1 and {r["name"] for r in new.collect()} == {"Anna", "Bob"}
    assert mutate.update_entity(people, "x", "n", "s")[1].first()[0] == 0
    new, n = mutate.update_fact(own, "1", "new")
    row = new.where("id = '1'").first()
    assert (row["fact_text"], row["embedding"], n.first()[0]) == ("new", [1.0], 1)
    left, kept, n = mutate.delete_entity(people, own, "a")
    assert left.count() == 1 and [r["id"] for r in kept.collect()] == ["3"] and n.first()[0] == 1
    at = F.lit(T0).cast("timestamp")
    assert mutate.invalidate_predicate(own, "a", "q", at)[1].first()[0] == 1
    new, n = mutate.invalidate_object(own, "a", "b", at)
    assert n.first()[0] == 1 and graph.active(new).count() == 3
    new, n = mutate.invalidate_fact(own, "2", at)
    assert n.first()[0] == 1 and mutate.invalidate_fact(new, "2", at)[1].first()[0] == 0
    assert [t.count() for t in mutate.delete_all(people, own)] == [0, 0]
    assert mutate.append(own, own.where("id = '1'")).count() == 6


def test_nearest_and_duplicates(spark):
    embed_ = ingest.word_embedder(VECTORS)
    own = facts(spark, fact("1", "u", fact_text="holds the B-7 permit", embedding=embed_("holds the B-7 permit")), fact("2", "u", fact_text="prefers loud music", embedding=embed_("prefers loud music")))
    wrong = spark.createDataFrame([("c", "u", embed_("never again holds the B-7 permit")), ("d", "u", embed_("weather"))], "correction_id string, subject_id string, embedding array<float>")
    got = mutate.nearest(own, wrong).collect()
    assert [(r["correction_id"], r["id"], r["similarity"]) for r in got] == [("c", "1", pytest.approx(5 / 35**0.5, abs=1e-5))]
    assert [r["id"] for r in graph.active(mutate.invalidate_nearest(own, wrong, F.lit(T0))).collect()] == ["2"]
    twice = facts(spark, fact("2", "u", fact_text="Grows Figs", at=1), fact("1", "u", "o", fact_text="grows figs"), fact("3", "v", fact_text="grows figs"))
    assert sorted(r["id"] for r in mutate.exact_duplicates_removed(twice).collect()) == ["1", "3"]
    near = mutate.near_duplicate_pairs(own.unionByName(facts(spark, fact("3", "u", embedding=embed_("really likes loud music")))), "subject_id", "id", "embedding")
    assert [(r["a"], r["b"]) for r in near.collect()] == [("2", "3")]


# -- names ---------------------------------------------------------------------


def test_resolution(spark):
    people = spark.createDataFrame([entity("1", "Iker", 0, aliases=["Iker Ríos"]), entity("2", "Maria Lopez", 1, ref="abc"), entity("3", "iker", 2)], ENTITIES)
    asked = spark.createDataFrame([("IKER RÍOS",), ("ML",), ("Lopez",), ("Pedro",), ("iker",), ("",), (None,)], "name string")
    got = {r["name"]: (r["id"], r["how"]) for r in resolve.resolve(asked, people).collect()}
    assert got == {"IKER RÍOS": ("1", "exact"), "ML": ("2", "fuzzy"), "Lopez": ("2", "fuzzy"), "Pedro": (None, None), "iker": ("1", "exact"), "": (None, None)}
    refs = spark.createDataFrame([("abc",), ("x",)], "external_ref string")
    assert [tuple(r) for r in resolve.by_reference(refs, people).collect()] == [("abc", "2")]


def test_fuzzy_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    parts = ["ana", "bob", "gómez", "gomez", "li", "x", "al", "ag", "bg"]
    pool = sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(40)})
    frame = spark.createDataFrame([(n,) for n in pool], "name string")
    got = {tuple(r) for r in resolve.fuzzy_pairs(frame, frame).collect()}
    assert got == {(a, b) for a in pool for b in pool if names.matches(a, b)}


def test_a_frequent_token_is_no_key(spark):
    """Half the names hold one token. They are compared at their rarer ones, and pairs equal those of all with all."""
    rng = random.Random(4)
    some = [f"w{rng.randrange(300)} v{rng.randrange(300)}" for _ in range(400)]
    own = sorted({*some[:200], *[f"{n} common" for n in some[100:300]], "common", "wv", "other unheard"})
    half = [n for n in own if "common" in n]
    frame = spark.createDataFrame([(n,) for n in own], "name string")
    wanted = {(x, y) for x in own for y in own if names.matches(x, y)}
    assert {tuple(r) for r in resolve.fuzzy_pairs(frame, frame).collect()} == wanted
    compared = resolve.fuzzy_candidates(frame, frame).count()
    # Each of the pairs that match comes at most twice by containment; all with the token would be len(half) ** 2.
    assert compared < 4 * len(wanted) < len(half) ** 2


# -- search --------------------------------------------------------------------


def test_bm25(spark):
    docs = spark.createDataFrame([("1", "the user likes curt letters"), ("2", "completely unrelated sentence")], "id string, text string")
    got = {r[0]: r[1] for r in search.bm25_scores(F.lit("curt letters"), docs).collect()}
    assert got["1"] > 0 and got["2"] == 0
    assert {r[1] for r in search.bm25_scores(F.lit("zzz"), docs).collect()} == {0.0} and search.bm25_scores(F.lit("a"), docs.limit(0)).count() == 0
    assert search.bm25_scores(F.lit(""), docs).count() == 2


def hybrid_docs(spark):
    embed_ = ingest.word_embedder(VECTORS)
    rows = [("strong", "the user likes curt letters"), ("text", "curt letters completely unrelated sentence"), ("vector", "prefers answers")]
    return spark.createDataFrame([(i, t, embed_(t)) for i, t in rows], "id string, text string, embedding array<float>"), F.array(*map(F.lit, embed_("likes curt letters"))).cast("array<float>")


def test_hybrid(spark):
    docs, vector = hybrid_docs(spark)
    assert search.hybrid("curt letters", vector, docs, 3).first()["id"] == "strong"
    assert search.hybrid("curt letters", vector, docs, 2).count() == 2
    low = search.hybrid("curt letters", vector, docs, 3, coverage=0.0).collect()
    by_text = [r[0] for r in search.bm25_scores(F.lit("curt letters"), docs).orderBy(F.desc("bm25"), "id").collect()]
    assert [r["id"] for r in low] == by_text and {r["similarity"] for r in low} == {0.0}
    assert {r["id"] for r in search.with_floor(search.hybrid("curt letters", vector, docs, 3)).collect()} == {"strong", "text"}


def test_row_order_changes_nothing(spark):
    docs, vector = hybrid_docs(spark)
    want = search.hybrid("curt letters", vector, docs, 3).collect()
    assert search.hybrid("curt letters", vector, docs.orderBy(F.desc("id")).repartition(3), 3).collect() == want


# -- the ordered merge ---------------------------------------------------------

FACT_TYPE = "graph_id string, episode_seq long, facts array<struct<subjectName:string,objectName:string,predicate:string,factText:string,isCorrection:boolean>>"


def turns(spark, n, graph_id="g"):
    return spark.createDataFrame([(graph_id, i, f"u{i}", f"a{i}", T0 + timedelta(minutes=i), None) for i in range(n)], CHAT_TURNS)


def said(s, t, o=None, wrong=False, p="likes"):
    return {"subjectName": s, "objectName": o, "predicate": p, "factText": t, "isCorrection": wrong}


def run(spark, *groups, start=None):
    extracted = spark.createDataFrame([("g", i, list(g)) for i, g in enumerate(groups)], FACT_TYPE)
    clean = ingest.clean_facts(turns(spark, len(groups)), extracted)
    people, own = start or scripted.empty_graph(spark)
    new = ingest.merge(clean, people, own, VECTORS)
    return [sorted(t.collect(), key=str) for t in new], clean


def test_merge_cases(spark):
    (people, own, failed), clean = run(spark, [said("Iker", "prefers loud music")], [said("Iker Ríos", "really likes loud music"), said("I", "x")], [said("Iker", "holds the B-7 permit")], [said("IR", "never again holds the B-7 permit", wrong=True), said("Iker", "weather today", wrong=True)])
    assert [(e["name"], e["aliases"], e["kind"]) for e in people] == [("Iker", ["Iker Ríos", "IR"], "user")]
    assert {f["fact_text"]: f["invalid_at"] is None for f in own} == {"prefers loud music": True, "holds the B-7 permit": False}
    assert [f["factText"] for f in failed] == ["weather today"]
    stored = ingest.episodes(turns(spark, 4), clean)
    assert stored.count() == 4 and stored.columns == EPISODES.names
    (people, own, failed), _ = run(spark, [said("Ana", "lives in Rome", "Rome"), said("Ana", "lives in Rome", "Rome")], [said("Ana", "left Rome", "Rome", wrong=True)])
    assert len(own) == 1 and own[0]["invalid_at"] is not None and not failed and {e["kind"] for e in people} == {"user", "other"}


class PlainGraph:
    """The merge as plain lists that are read from front to back, for comparison."""

    def __init__(self):
        self.people, self.facts, self.failed = [], [], 0

    def person(self, name, kind_):
        for p in self.people:
            if name.lower() in [n.lower() for n in (p["name"], *p["aliases"])]:
                return p
        for p in self.people:
            if any(names.matches(name, n) for n in (p["name"], *p["aliases"])):
                p["aliases"] += [name] if name not in p["aliases"] else []
                return p
        self.people.append({"name": name, "aliases": [], "kind": kind_})
        return self.people[-1]

    def merge(self, f, embed_):
        s = self.person(f["subjectName"], "user")
        o = f["objectName"] and self.person(f["objectName"], "other")
        v = embed_(f["factText"])
        live = [x for x in self.facts if x["on"] and x["s"] is s]
        if f["isCorrection"]:
            if o:
                hit = [x for x in live if x["o"] is o]
            else:
                best = max([x for x in live if not x["o"]], key=lambda x: ingest.similarity(x["v"], v), default=None)
                hit = [best] if best and ingest.similarity(best["v"], v) >= 0.5 else []
            for x in hit:
                x["on"] = False
            self.failed += not hit
        elif not any(x["t"].lower() == f["factText"].lower() or ingest.similarity(x["v"], v) >= 0.85 for x in live):
            self.facts.append({"s": s, "o": o, "t": f["factText"], "v": v, "on": True})


@pytest.mark.parametrize("seed", range(4))
def test_merge_equals_plain_lists(spark, seed):
    rng = random.Random(seed)
    who = ["Iker", "Iker Ríos", "IR", "Maria", "maria lopez", "Rios", "ML", "Ana Gil"]
    what = ["likes loud music", "prefers loud music", "holds the B-7 permit", "never again holds the permit", "is sunny", "the weather is sunny today", "curt letters", "short answers"]
    groups = [[said(rng.choice(who), rng.choice(what), rng.choice([None, None, *who]), rng.random() < 0.3) for _ in range(rng.randint(0, 3))] for _ in range(25)]
    (people, own, failed), clean = run(spark, *groups)
    plain, embed_ = PlainGraph(), ingest.word_embedder(VECTORS)
    for g in groups:
        for f in g:
            plain.merge(f, embed_)
    assert sorted((p["name"], tuple(p["aliases"]), p["kind"]) for p in plain.people) == sorted((e["name"], tuple(e["aliases"]), e["kind"]) for e in people)
    by_id = {e["id"]: e["name"] for e in people}
    assert sorted((x["s"]["name"], x["t"], x["on"]) for x in plain.facts) == sorted((by_id[f["subject_id"]], f["fact_text"], f["invalid_at"] is None) for f in own)
    assert plain.failed == len(failed)
    # The same facts in two runs, the second on what the first has left.
    half = len(groups) // 2
    extracted = lambda a, b: spark.createDataFrame([("g", i, g) for i, g in enumerate(groups) if a <= i < b], FACT_TYPE)
    people1, own1, _ = ingest.merge(ingest.clean_facts(turns(spark, len(groups)), extracted(0, half)), *scripted.empty_graph(spark), VECTORS)
    _, own2, _ = ingest.merge(ingest.clean_facts(turns(spark, len(groups)), extracted(half, 99)), people1, own1, VECTORS)
    assert sorted(r["fact_text"] for r in own2.collect()) == sorted(f["fact_text"] for f in own)


def test_external_reference():
    g = ingest.People("g")
    first = g.upsert("Jane Doe", "a", "other", [], "abc")
    assert g.upsert("Jane Smith", "b", "other", [], "abc") == first and g.entities[0]["summary"] == "b" and len(g.entities) == 1
    g.upsert("Maria", "c", "other", [])
    assert len(g.entities) == 2


# -- sessions ------------------------------------------------------------------


def test_session(spark):
    own = facts(spark, *[fact(f"{i:02}", "u", predicate="deal" if i % 2 else "rule", fact_text=f"fact number {i}", at=i) for i in range(3)])
    s = Session(own, word_table(spark))
    assert not s.exhaustive() and len(s.compilation().split("\n")) == 3 and s.exhaustive()
    assert s.per_turn("fact number") is None
    s.facts = mutate.append(own, facts(spark, fact("99", "u", fact_text="likes curt letters", at=99)))
    assert "curt" not in s.compilation() and not s.exhaustive()
    assert s.per_turn("curt letters", excluding=s.compilation()) == "likes curt letters"
    s.start()
    assert "curt" in s.compilation()
    many = Session(facts(spark, *[fact(f"{i:02}", "u", at=i) for i in range(10)]), fact_limit=5)
    many.compilation()
    assert not many.exhaustive()
    assert s.scoped("which rule number", "rule").startswith("fact number") and s.scoped("spf dkim", "rule") is None and s.scoped("x", "absent") is None


def test_gate_by_content(spark):
    own = facts(spark, fact("1", "a"), fact("2", "a"))
    for strict, want in ((False, True), (True, False)):
        s = Session(own, strict_gate=strict)
        s.compilation()
        s.facts = facts(spark, fact("1", "a"), fact("3", "a"))
        assert s.exhaustive() is want


def test_exclusion_is_by_substring(spark):
    own = facts(spark, fact("1", "u", fact_text="grows figs"), fact("2", "u", fact_text="grows figs very much"))
    assert [r["id"] for r in without_known(own, "grows figstrees").collect()] == ["2"]


def test_rerank(spark):
    own = facts(spark, *[fact(str(i), "u", fact_text=f"curt {i}", at=i) for i in range(3)])
    s = Session(own, fact_limit=1)
    s.compilation()
    plain = s.per_turn("curt")
    assert s.per_turn("curt", reranker=chat_reranker(lambda p: "[3, 2, 1]")).split("\n") == plain.split("\n")[::-1]
    assert s.per_turn("curt", reranker=lambda q, c: [*c[:-1], "foreign"]) == plain
    assert s.per_turn("curt", reranker=chat_reranker(lambda p: 1 / 0)) == plain


def test_context_cache():
    made, touched = [], []
    c = ContextCache(lambda t, m, ttl: made.append((t, m)) or f"c{len(made)}", lambda n, ttl: touched.append(n), least_chars=5)
    assert c.name("abc", "m") is None and not made
    assert c.name("abcdef", "m") == "c1" == c.name("abcdef", "m") and touched == ["c1"]
    assert c.name("abcdef", "other") == "c2" and c.name("ghijkl", "other") == "c3"
    c.reset()
    assert c.name("ghijkl", "other") == "c4"
    assert ContextCache(lambda *a: 1 / 0, lambda *a: None, 1).name("x", "m") is None


# -- sources, sinks, streams ---------------------------------------------------


def test_review_rows(spark, tmp_path):
    body = json.dumps(scripted._RESPONSE)
    rows = review_table.parse_review_rows(spark.createDataFrame([(body,), ("{}",)], "body string")).collect()
    assert {(r["page_id"], r["subject_name"], r["correction_notes"]) for r in rows} == {("page-1", "Ana", "gave up the north room"), ("page-2", "Bob", "keeps no cat"), ("page-3", "", "")}
    path = tmp_path / "r.json"
    path.write_text(body)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(review_table.ReviewTable)
    got = spark.read.format("review_table").option("path", str(path)).load().where("needs_review = true")
    assert {r["page_id"] for r in got.collect()} == {"page-1", "page-2", "page-3"}
    outcome = {r["page_id"]: (r["status"], r["cleared"]) for r in scripted.import_corrections(spark).collect()}
    assert outcome == {"page-1": ("applied", True), "page-2": ("unmatched", False), "page-3": ("no_facts", True)}


def test_export(spark):
    sent = []

    def send(method, path, body):
        sent.append((method, path, json.loads(body)))
        return '{"id": "db-1"}'

    people = spark.createDataFrame([entity("a", "Ana", 0, "user")], ENTITIES)
    assert review_table.export(facts(spark, fact("1", "a"), fact("2", "zz")), people, "page", send) == "db-1"
    assert [p for _, p, _ in sent] == ["/databases", "/pages"] and json.loads(review_table.clear_body())["properties"]["Needs Review"]["checkbox"] is False
    assert json.loads(review_table.query_body())["filter"]["checkbox"]["equals"] is True


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/graph")
    assert store.read("facts").count() == 0 and store.version() == -1
    store.append("facts", facts(spark, fact("1", "a")))
    store.append("facts", facts(spark, fact("2", "a", ended=T0)))
    assert store.version() == 1 and store.read("facts").count() == 2
    assert [(f.name, f.dataType) for f in store.read("facts").schema] == [(f.name, f.dataType) for f in FACTS]
    plan = graph.active(store.read("facts")).select("id")._jdf.queryExecution().toString()
    assert "IsNull(invalid_at)" in plan
    store.delete_all()
    assert store.read("facts").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    own = turns(spark, 6)
    answers = {0: [said("Ana", "grows figs")], 1: [said("Ana", "GROWS FIGS")], 2: [], 3: [said("Bob", "holds the permit")], 4: [said("Bob", "never again holds the permit", wrong=True)], 5: [said("Ana", "is sunny")]}
    table = spark.createDataFrame([("g", k, v) for k, v in answers.items()], FACT_TYPE)
    extract = lambda df: df.select("graph_id", "episode_seq").join(table, ["graph_id", "episode_seq"])
    for i in range(3):
        own.where((F.col("episode_seq") >= 2 * i) & (F.col("episode_seq") < 2 * i + 2)).coalesce(1).write.parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(CHAT_TURNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    store = Store(spark, f"file://{tmp_path}/stream")
    ingest_stream(stream, store, extract, str(tmp_path / "cp"), VECTORS).awaitTermination()
    _, want, _ = ingest.merge(ingest.clean_facts(own, table), *scripted.empty_graph(spark), VECTORS)
    show = lambda df: sorted((r["fact_text"], r["invalid_at"] is None) for r in df.collect())
    assert show(store.read("facts")) == show(want) and store.read("episodes").count() == 5
    merge_turns(store, own, extract, VECTORS)  # all of it again: nothing changes
    assert show(store.read("facts")) == show(want) and store.read("episodes").count() == 5


def test_windowed_counts(spark, tmp_path):
    path = str(tmp_path / "facts")
    facts(spark, *[fact(str(i), "a", at=20 * i) for i in range(9)]).coalesce(1).write.parquet(path)
    counts = fact_counts(spark.readStream.schema(FACTS).parquet(path))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.sql("select n from counts order by window").collect()][:2] == [3, 3]
