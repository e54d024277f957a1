"""The ordered merge of extracted facts into a graph.

Whether a fact is new depends on the facts before it, and resolving a name on
the entities before it, so a graph is folded in order. But a name can only meet
names that it matches, and a fact only facts of its subject. So names are
resolved in parts, the connected components of names that match each other, and
facts are folded subject by subject, each in the order of time, episode and place
of the fact; numbers that count through the whole graph are given afterwards. No
graph is ever one group.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.functions.text import STOPWORDS, episode_text, is_junk
from mnemograph.functions.text import initials as name_initials_of
from mnemograph.functions.text import name_tokens as name_tokens_of
from mnemograph.operators.components import connected_components, numbered_within
from mnemograph.operators.mutate import CORRECTION, DUPLICATE
from mnemograph.operators.names import fold, initials, lower_tokens, matches, name_tokens
from mnemograph.schema import ENTITIES, FACTS, natural_id
from mnemograph.sources.working import Keep, keeper

Embedder = Callable[[str], list[float]]
#: Rows that a task gives back at once.
ROWS = 4096


def word_embedder(vectors: dict[str, list[float]]) -> Embedder:
    """Unit mean of the vectors of known words."""

    def embed(text: str) -> list[float]:
        known = [np.asarray(vectors[w], float) for w in lower_tokens(text) if w in vectors]
        if not known:
            return []
        mean = np.sum(known, axis=0) / len(known)
        size = float(np.sqrt(mean @ mean))
        return (mean / size if size else mean).astype(np.float32).tolist()

    return embed


def similarity(a: list[float], b: list[float]) -> float:
    return float(np.dot(np.asarray(a, float), np.asarray(b, float))) if len(a) and len(a) == len(b) else 0.0


def make_id(*parts: object) -> str:
    """The same id as :func:`mnemograph.schema.natural_id`."""
    tagged = "|".join("-" if p is None else f"{len(str(p))}:{p}" for p in parts)
    return hashlib.sha256(tagged.encode()).hexdigest()[:32]


@dataclass
class People:
    """Entities in their order, with the indexes that keep a merge from reading all of them; ``new_id`` names a new one."""

    graph_id: str | None
    entities: list[dict] = field(default_factory=list)
    by_name: dict[str, int] = field(default_factory=dict)
    by_key: dict[str, list[int]] = field(default_factory=dict)
    by_ref: dict[str, int] = field(default_factory=dict)
    new_id: Callable[[int, str], str] | None = None

    def add_entity(self, e: dict) -> int:
        at = len(self.entities)
        self.entities.append(e)
        for n in (e["name"], *e["aliases"]):
            self._know(n, at)
        if e.get("external_ref") is not None:
            self.by_ref.setdefault(e["external_ref"], at)
        return at

    def _know(self, name: str, at: int) -> None:
        key = name.lower()
        self.by_name[key] = min(at, self.by_name.get(key, at))
        own = name_tokens(name)
        for k in {*own, *([initials(name)] if len(own) > 1 else [])}:
            self.by_key.setdefault(k, []).append(at)

    def find(self, name: str) -> tuple[int | None, bool]:
        """(place, exact) of the first entity of an equal, else of a matching name."""
        at = self.by_name.get(name.lower())
        if at is not None:
            return at, True
        own = name_tokens(name)
        keys = {*own, *([initials(name)] if len(own) > 1 else [])}
        for at in sorted({a for k in keys for a in self.by_key.get(k, ())}):
            e = self.entities[at]
            if any(matches(name, n) for n in (e["name"], *e["aliases"])):
                return at, False
        return None, False

    def upsert(self, name: str, summary: str, kind: str, embedding: list[float], external_ref: str | None = None) -> str:
        """Find or add an entity; its id. A reference that is known wins and renames."""
        if external_ref is not None and (at := self.by_ref.get(external_ref)) is not None:
            e = self.entities[at]
            e |= {"name": name, "summary": summary, "embedding": embedding}
            self._know(name, at)
            return e["id"]
        at, exact = self.find(name)
        if at is None:
            seq = len(self.entities)
            id_ = self.new_id(seq, name) if self.new_id else make_id(self.graph_id, "entity", seq, name)
            at = self.add_entity({"graph_id": self.graph_id, "id": id_, "name": name, "summary": summary, "kind": kind, "embedding": embedding, "aliases": [], "external_ref": None, "seq": seq})
        elif exact:
            self.entities[at] |= {"summary": summary, "embedding": embedding}
        else:
            e = self.entities[at]
            e["summary"] = summary
            if name not in e["aliases"]:
                e["aliases"].append(name)
                self._know(name, at)
        e = self.entities[at]
        if external_ref is not None:
            e["external_ref"] = external_ref
            self.by_ref[external_ref] = at
        return e["id"]


class Told:
    """The facts of one subject, in order; vectors of running ones lie in a matrix for each size."""

    def __init__(self, duplicate: float, correction: float):
        self.duplicate, self.correction = duplicate, correction
        self.facts: list[dict] = []
        self.running: dict[int, None] = {}
        self.texts: Counter = Counter()
        self.vectors: dict[int, tuple[np.ndarray, list[int]]] = {}

    def add(self, f: dict) -> None:
        at = len(self.facts)
        self.facts.append(f)
        self.running[at] = None
        self.texts[f["fact_text"].lower()] += 1
        size = len(f["embedding"])
        if size:
            rows, places = self.vectors.get(size, (np.zeros((4, size)), []))
            if len(places) == len(rows):
                rows = np.concatenate([rows, np.zeros_like(rows)])
            rows[len(places)] = f["embedding"]
            places.append(at)
            self.vectors[size] = rows, places

    def _end(self, at: int, when: object) -> None:
        f = self.facts[at]
        f["invalid_at"] = when
        if when is not None:
            del self.running[at]
            self.texts[f["fact_text"].lower()] -= 1

    def _similar(self, vector: list[float]) -> dict[int, float]:
        """Similarity of running facts with a vector of this size; any other has 0."""
        if len(vector) not in self.vectors:
            return {}
        rows, places = self.vectors[len(vector)]
        scores = rows[: len(places)] @ np.asarray(vector, float)
        return {at: float(x) for at, x in zip(places, scores, strict=True) if at in self.running}

    def merge(self, f: dict, wrong: bool) -> bool:
        """Apply one fact; False if it is a correction that corrects nothing."""
        at = f["valid_at"]
        scores = self._similar(f["embedding"])
        if not wrong:
            known = self.texts[f["fact_text"].lower()] > 0 or (self.running and max(scores.values(), default=0.0) >= self.duplicate)
            if not known and not (self.running and self.duplicate <= 0):
                self.add(f)
            return True
        # What begins after the correction is not what it is about: it has only come late.
        told = [i for i in self.running if self.facts[i]["valid_at"] is None or at is None or self.facts[i]["valid_at"] <= at]
        if f["object_id"] is not None:
            hit = [i for i in told if self.facts[i]["object_id"] == f["object_id"]]
        else:
            free = [i for i in told if self.facts[i]["object_id"] is None]
            best = max(free, key=lambda i: scores.get(i, 0.0), default=None)
            hit = [best] if best is not None and scores.get(best, 0.0) >= self.correction else []
        for i in hit:
            self._end(i, at)
        return bool(hit)


def clean_facts(turns: DataFrame, extractions: DataFrame) -> DataFrame:
    """(graph_id, occurred_at, episode_seq, pos, fact): facts of each turn in order, junk gone.

    ``turns`` is a table of chat turns, ``extractions`` (graph_id, episode_seq,
    facts) what a model has found in them.
    """
    joined = turns.select("graph_id", "episode_seq", "occurred_at").join(extractions, ["graph_id", "episode_seq"])
    one = joined.select("graph_id", "occurred_at", "episode_seq", F.posexplode("facts").alias("pos", "fact"))
    return one.where(~is_junk(F.col("fact.subjectName"), F.col("fact.objectName"), F.col("fact.factText")))


def episodes(turns: DataFrame, clean: DataFrame) -> DataFrame:
    """Episodes of the turns that gave any fact; summaries are the first 200 characters."""
    own = turns.join(clean.select("graph_id", "episode_seq").distinct(), ["graph_id", "episode_seq"], "left_semi")
    text = episode_text(F.col("user_text"), F.col("assistant_text"), F.col("known_user_name"))
    return own.select("graph_id", natural_id(F.col("graph_id"), F.lit("episode"), F.col("episode_seq")).alias("id"), text.alias("raw_text"), F.left(text, F.lit(200)).alias("summary"), "occurred_at")


def _fields(schema) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in schema)


def name_parts(names: DataFrame, keep: Keep) -> DataFrame:
    """(graph_id, name, part) of ``names`` (graph_id, name, also): names of one graph that may meet have one part.

    Names meet that are equal but for case, whose tokens are contained in each
    other's, of which one is the other's initials, or that are given as ``also``
    of each other. A set of tokens is looked for at its rarest token only: what
    contains it has that one, and a token that half of all names have is the
    rarest of very few sets.
    """
    own = names.select("graph_id", F.explode(F.array_compact(F.array("name", "also"))).alias("name")).distinct()
    t = F.array_sort(name_tokens_of(F.col("name")))
    # A name without tokens is met by its equals only.
    node = F.when(F.size("t") > 0, F.concat(F.lit("t"), F.array_join("t", " "))).otherwise(F.concat(F.lit("n"), F.lower("name")))
    graph = F.when(F.col("graph_id").isNull(), "-").otherwise(F.concat(F.length("graph_id").cast("string"), F.lit(":"), F.col("graph_id")))
    named = own.withColumn("t", t).withColumn("i", name_initials_of(F.col("name")))
    named = keep(named.withColumn("g", graph).withColumn("node", F.concat("g", F.lit("|"), node)))
    sets = named.where(F.size("t") > 0).select("g", "node", "t").distinct()
    holds = sets.select("g", "node", "t", F.explode("t").alias("token"))
    many = holds.groupBy("g", "token").agg(F.count(F.lit(1)).alias("n"))
    rarest = holds.join(many, ["g", "token"]).groupBy("g", "node").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("t").alias("small"))
    within = rarest.select("g", "token", F.col("node").alias("a"), "small").join(holds.select("g", "token", F.col("node").alias("b"), "t"), ["g", "token"])
    within = within.where((F.col("a") != F.col("b")) & (F.size(F.array_except("small", "t")) == 0)).select("a", "b")
    short = sets.where(F.size("t") == 1).select("g", F.col("node").alias("a"), F.element_at("t", 1).alias("i"))
    initial = named.where("i <> ''").select("g", "i", F.col("node").alias("b")).distinct().join(short, ["g", "i"]).select("a", "b")
    one = names.where("also is not null").select("graph_id", "name", F.col("also").alias("other"))
    at = named.select(F.col("graph_id").alias("g1"), F.col("name").alias("n1"), F.col("node").alias("m"))
    given = one.join(at, F.col("graph_id").eqNullSafe(F.col("g1")) & (F.col("name") == F.col("n1"))).select("graph_id", "other", F.col("m").alias("a"))
    given = given.join(at, F.col("graph_id").eqNullSafe(F.col("g1")) & (F.col("other") == F.col("n1"))).select("a", F.col("m").alias("b"))
    joined = connected_components(within.unionByName(initial).unionByName(given), keep)
    return keep(named.join(joined, "node", "left").select("graph_id", "name", F.coalesce("component", "node").alias("part")))


def _resolved(clean: DataFrame, entities: DataFrame, vectors: dict[str, list[float]] | None, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(entities after the batch, facts with subject_id and object_id)."""
    place = ("t", "s", "p")
    subject = clean.select("graph_id", *place, F.lit(0).alias("role"), F.col("fact.subjectName").alias("name"), F.col("fact.factText").alias("text"))
    object_ = clean.where("fact.objectName is not null").select("graph_id", *place, F.lit(1).alias("role"), F.col("fact.objectName").alias("name"), F.col("fact.factText").alias("text"))
    # A name that was mentioned is known from then on, so what later mentions change is what the last of them sets.
    order = F.struct(*place, "role", "text")
    ends = subject.unionByName(object_).groupBy("graph_id", "name").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    mentions = keep(ends.select("graph_id", "name", F.explode(F.array_distinct(F.array("first", "last"))).alias("m")).select("graph_id", "m.*", "name"))
    aliases = entities.select("graph_id", "name", F.explode_outer("aliases").alias("also"))
    names = mentions.select("graph_id", "name", F.lit(None).cast("string").alias("also")).unionByName(aliases).distinct()
    parts = name_parts(names, keep)
    of = lambda df: df.join(parts.select(F.col("graph_id").alias("g"), F.col("name").alias("n"), "part"), F.col("graph_id").eqNullSafe(F.col("g")) & (F.col("name") == F.col("n"))).drop("g", "n")
    none = F.lit(None).cast(f"struct<{_fields(ENTITIES)}>")
    known = of(entities).select("part", "graph_id", F.lit(None).cast("timestamp").alias("t"), F.col("seq").alias("s"), F.lit(-1).alias("p"), F.lit(-1).alias("role"), F.struct(*ENTITIES.names).alias("entity"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text"))
    asked = of(mentions).select("part", "graph_id", *place, "role", none.alias("entity"), "name", "text")
    # Parts without a mention pass through.
    active = asked.select("part").distinct()
    rows = known.join(active, "part", "left_semi").unionByName(asked)

    rows = rows.withColumn("new", F.col("role") >= 0).repartition("part").sortWithinPartitions("part", "new", "t", "s", "p", "role")

    columns = {"graph_id": "graph_id", "t": "t", "s": "s", "p": "p", "role": "role", "ref": "name", "name": "name", "entity": "entity"}

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = word_embedder(vectors or {})
        made: dict[str, dict] = {}

        def finished(people: People) -> list[dict]:
            # An entity that was there has no role; a new one has the place of the mention that made it.
            old = {"t": None, "s": 0, "p": 0, "role": -1}
            return [{"graph_id": people.graph_id, **made.get(e["id"], old), "ref": None, "entity": e} for e in people.entities]

        out: list[dict] = []
        part, people = None, None
        for kinds, r in _in_turn(batches):
            if people is None or r["part"] != part:
                out += finished(people) if people else []
                part, people = r["part"], People(r["graph_id"])
                made.clear()
            if r["new"]:
                here = f"+{r['s']}:{r['p']}:{r['role']}"
                people.new_id = lambda _, __, here=here: here
                had, at = len(people.entities), {n: r[n] for n in ("t", "s", "p", "role")}
                ref = people.upsert(r["name"], r["text"], "other" if r["role"] else "user", embed(r["name"]))
                if len(people.entities) > had:
                    made[ref] = at
                out.append({"graph_id": r["graph_id"], **at, "ref": ref, "name": r["name"], "entity": None})
            else:
                people.add_entity({**r["entity"], "aliases": _list(r["entity"]["aliases"]), "embedding": _list(r["entity"]["embedding"])})
            if len(out) >= ROWS:
                yield _batch(out, kinds, columns)
        if people:
            out += finished(people)
            yield _batch(out, kinds, columns)

    schema = f"graph_id string, t timestamp, s long, p int, role int, ref string, name string, entity struct<{_fields(ENTITIES)}>"
    done = keep(rows.mapInArrow(resolve, schema))
    counts = entities.groupBy(F.col("graph_id").alias("g")).agg(F.count(F.lit(1)).alias("had"))
    new = numbered_within(done.where("ref is null and role >= 0"), "graph_id", ["t", "s", "p", "role"], "nth", keep)
    new = new.join(counts, F.col("graph_id").eqNullSafe(F.col("g")), "left").withColumn("seq", F.col("nth") + F.coalesce("had", F.lit(0)))
    number = natural_id(F.col("graph_id"), F.lit("entity"), F.col("seq"), F.col("entity.name"))
    new = keep(new.select("graph_id", F.col("entity.id").alias("ref"), number.alias("id"), "entity", F.col("seq").alias("new_seq")))
    made = new.select(*[F.col("id") if n == "id" else F.col("new_seq").alias("seq") if n == "seq" else F.col(f"entity.{n}").alias(n) if n != "graph_id" else F.col(n) for n in ENTITIES.names])
    passed = of(entities).join(active, "part", "left_anti").select(*ENTITIES.names)
    after = passed.unionByName(done.where("ref is null and role < 0").select("entity.*")).unionByName(made)
    ids = new.select(F.col("graph_id").alias("g"), F.col("ref").alias("made"), "id")
    told = done.where("ref is not null").select(F.col("graph_id").alias("g0"), F.col("name").alias("told"), "ref").distinct()
    told = told.join(ids, F.col("g0").eqNullSafe(F.col("g")) & (F.col("ref") == F.col("made")), "left")
    told = keep(told.select(F.col("g0").alias("g"), "told", F.coalesce("id", "ref").alias("whose")))
    facts = clean
    for role, field_ in (("subject_id", "subjectName"), ("object_id", "objectName")):
        named = told.select("g", "told", F.col("whose").alias(role))
        facts = facts.join(named, F.col("graph_id").eqNullSafe(F.col("g")) & (F.col(f"fact.{field_}") == F.col("told")), "left").drop("g", "told")
    return after, facts.where("subject_id is not null or object_id is not null")


def _timed(clean: DataFrame) -> DataFrame:
    return clean.select("graph_id", F.col("occurred_at").alias("t"), F.col("episode_seq").alias("s"), F.col("pos").alias("p"), "fact")


def merge_people(clean: DataFrame, entities: DataFrame, vectors: dict[str, list[float]] | None = None, keep: Keep | None = None) -> DataFrame:
    """The entities that :func:`merge` gives, which do not depend on any fact being folded."""
    keep = keep or keeper(clean.sparkSession)
    clean = keep(_timed(clean))
    touched = clean.select(F.col("graph_id").alias("g")).distinct()
    mine = lambda how: entities.join(touched, F.col("graph_id").eqNullSafe(F.col("g")), how).select(*ENTITIES.names)
    return mine("left_anti").unionByName(_resolved(clean, keep(mine("left_semi")), vectors, keep)[0].select(*ENTITIES.names))


def merge(
    clean: DataFrame,
    entities: DataFrame,
    facts: DataFrame,
    vectors: dict[str, list[float]] | None = None,
    duplicate: float = DUPLICATE,
    correction: float = CORRECTION,
    keep: Keep | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts, failed): every graph after its new facts, in order; failed are corrections without effect.

    ``vectors`` is the word table that texts are embedded with; it travels with
    the function, so it must be of a vocabulary's size. Graphs that get no new
    facts pass through without Python, and so do names and subjects that nothing
    new is said of, and facts that have ended. The largest groups are the names
    that match each other and the running facts of one subject. ``keep`` writes a
    frame and reads it again; without one the shared folder serves.
    """
    keep = keep or keeper(clean.sparkSession)
    clean = keep(_timed(clean))
    touched = clean.select(F.col("graph_id").alias("g")).distinct()
    mine = lambda df, how: df.join(touched, F.col("graph_id").eqNullSafe(F.col("g")), how)
    people, new = _resolved(clean, keep(mine(entities, "left_semi").select(*ENTITIES.names)), vectors, keep)
    new = keep(new)
    own = keep(mine(facts, "left_semi").select(*FACTS.names))
    subjects = new.select(F.col("graph_id").alias("g"), "subject_id").distinct()
    of = lambda df, how: df.join(subjects, df["graph_id"].eqNullSafe(subjects["g"]) & (df["subject_id"] == subjects["subject_id"]), how)
    running = own.where("invalid_at is null")
    none = F.lit(None).cast(f"struct<{_fields(FACTS)}>")
    old = of(running, "left_semi").select("graph_id", "subject_id", F.lit(None).cast("string").alias("object_id"), F.lit(None).cast("timestamp").alias("t"), F.col("seq").alias("s"), F.lit(-1).alias("p"), F.struct(*FACTS.names).alias("old"), F.lit(None).cast(new.schema["fact"].dataType).alias("fact"))
    rows = old.unionByName(new.select("graph_id", "subject_id", "object_id", "t", "s", "p", none.alias("old"), "fact"))

    rows = rows.withColumn("new", F.col("p") >= 0).repartition("graph_id", "subject_id").sortWithinPartitions("graph_id", "subject_id", "new", "t", "s", "p")
    names = {"graph_id": "graph_id", "t": "t", "s": "s", "p": "p", "what": "subject_id", "fact": "old", "subjectName": "subject_id", "factText": "subject_id"}

    def fold_subjects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = word_embedder(vectors or {})

        def finished(told: Told) -> list[dict]:
            rows = []
            for f in told.facts:
                made = f.pop("made")
                rows.append({"graph_id": f["graph_id"], **(made or {"t": None, "s": 0, "p": 0}), "what": "new" if made else "old", "fact": f})
            return rows

        out: list[dict] = []
        subject, told = None, None
        for kinds, r in _in_turn(batches):
            if told is None or subject != (r["graph_id"], r["subject_id"]):
                out += finished(told) if told else []
                subject, told = (r["graph_id"], r["subject_id"]), Told(duplicate, correction)
            if r["new"]:
                f, made = r["fact"], {n: r[n] for n in ("t", "s", "p")}
                one = {"graph_id": r["graph_id"], "id": "", "subject_id": r["subject_id"], "object_id": r["object_id"], "predicate": f["predicate"], "fact_text": f["factText"]}
                one |= {"embedding": embed(f["factText"]), "valid_at": r["t"], "invalid_at": None, "seq": 0, "made": made}
                if not told.merge(one, f["isCorrection"]):
                    out.append({"graph_id": r["graph_id"], **made, "what": "failed", "subjectName": f["subjectName"], "factText": f["factText"]})
            else:
                told.add({**r["old"], "embedding": _list(r["old"]["embedding"]), "made": None})
            if len(out) >= ROWS:
                yield _batch(out, kinds, names)
        if told:
            out += finished(told)
            yield _batch(out, kinds, names)

    schema = f"graph_id string, t timestamp, s long, p int, what string, fact struct<{_fields(FACTS)}>, subjectName string, factText string"
    done = keep(rows.mapInArrow(fold_subjects, schema))
    counts = own.groupBy(F.col("graph_id").alias("g")).agg((F.max("seq") + 1).alias("next"))
    made = numbered_within(done.where("what = 'new'"), "graph_id", ["t", "s", "p"], "nth", keep)
    made = made.join(counts, F.col("graph_id").eqNullSafe(F.col("g")), "left").withColumn("seq", F.col("nth") + F.coalesce("next", F.lit(0)))
    number = natural_id(F.col("graph_id"), F.lit("fact"), F.col("seq"), F.col("fact.fact_text"))
    made = made.select(*[number.alias("id") if n == "id" else F.col("seq") if n == "seq" else F.col(n) if n == "graph_id" else F.col(f"fact.{n}").alias(n) for n in FACTS.names])
    passed = own.where("invalid_at is not null").unionByName(of(running, "left_anti").select(*FACTS.names))
    return (
        mine(entities, "left_anti").select(*ENTITIES.names).unionByName(people.select(*ENTITIES.names)),
        mine(facts, "left_anti").select(*FACTS.names).unionByName(passed).unionByName(done.where("what = 'old'").select("fact.*")).unionByName(keep(made)),
        done.where("what = 'failed'").select("graph_id", F.col("s").alias("episode_seq"), F.col("p").alias("pos"), "subjectName", "factText"),
    )


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Schema, dict]]:
    """(schema, row) of sorted rows, one after the other; what is held is a batch and the state of one part."""
    for batch in batches:
        for row in batch.to_pylist():
            yield batch.schema, row


def _batch(rows: list[dict], kinds: pa.Schema, like: dict[str, str]) -> pa.RecordBatch:
    """Rows as a batch, whose columns have the types of some that were read; ``rows`` is emptied."""
    out = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.field(of).type) for n, of in like.items()], list(like))
    rows.clear()
    return out


def _list(x: object) -> list:
    return [] if x is None else list(x)


__all__ = ["STOPWORDS", "People", "clean_facts", "episodes", "fold", "make_id", "merge", "merge_people", "name_parts", "similarity", "word_embedder"]
