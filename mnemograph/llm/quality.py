"""Quality by co-training: a content view and a page view teach each other.

The content view sees the words of a text; the page view its metadata and its
form: kinds of characters, lines, length. Each has a logistic classifier of its
own, and both start from a bounded sample of labelled rows. In each round both
score all documents without a label, and of those that a view is surest of, a
bounded number for each class goes into the training set of the *other* view. At
the end both are calibrated on labelled rows that neither has trained on, a
small combiner over the calibrated log odds is fitted there as well, and every
document is scored.

Only features of the labelled sample and of what was picked come to the driver:
a fixed number of floats for each row, whatever the length of its text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, col, fresh

#: Most labelled rows that are fitted on.
LABELLED = 6_000
#: Every HELD_OUT-th labelled row is kept for calibration.
HELD_OUT = 4
#: Rounds; documents that a view passes on in a round, shared out by the classes' sizes; the least
#: probability to pass one on. Each round reads all documents once.
ROUNDS, PER_ROUND, SURE = 2, 1_000, 0.9
#: Hashed words and hashed metadata values.
WORDS, FACTS = 1024, 128
_WORD_CACHE = 200_000

# -- the two views -------------------------------------------------------------

_KINDS = np.zeros((256, 9))
for _code in range(256):
    _c = chr(_code)
    _KINDS[_code] = [
        _code < 128 and _c.isupper(), _code < 128 and _c.islower(), _code < 128 and _c.isdigit(), _c == " ", _c == "\n",
        33 <= _code < 127 and not _c.isalnum(), _c in "!?", _c in "|<>{}[]=/\\_", _code >= 128,
    ]
#: Figures of a text's words, and of its form.
STYLE, LAYOUT = 5, _KINDS.shape[1] + 4


def text_features(text: str | None, buckets: dict[str, int]) -> np.ndarray:
    """Figures of the words of a whole text and its hashed words, of fixed size."""
    out = np.zeros(STYLE + WORDS, np.float32)
    words = (text or "").lower().split()
    if not words:
        return out
    n, counts = len(words), Counter(words)
    out[:STYLE] = (
        math.log1p(n) / 10,
        sum(map(len, words)) / n / 10,
        len(counts) / n,
        max(counts.values()) / n,
        sum(len(w) > 20 for w in counts) / len(counts),
    )
    if len(buckets) > _WORD_CACHE:
        buckets.clear()
    at, values = [], []
    for w, c in counts.items():
        k = buckets.get(w)
        if k is None:
            k = buckets[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORDS
        at.append(k)
        values.append(c)
    hashed = np.bincount(at, weights=np.log1p(values), minlength=WORDS)
    out[STYLE:] = hashed / np.linalg.norm(hashed)
    return out


def page_features(text: str | None, facts: dict[str, object]) -> np.ndarray:
    """Hashed metadata values, numbers by their order of magnitude (half powers of two), and the form of a whole text."""
    out = np.zeros(FACTS + LAYOUT, np.float32)
    for name, v in facts.items():
        if isinstance(v, int | float) and not isinstance(v, bool):
            v = "none" if v != v else f"{round(2 * math.log2(abs(v) + 1)) if abs(v) < float('inf') else 'inf'}"
        out[zlib.crc32(f"{name}={v}".encode("utf-8", "replace")) % FACTS] += 1
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if lines:
        kinds = _KINDS.shape[1]
        out[FACTS : FACTS + kinds] = np.bincount(raw, minlength=256) @ _KINDS / len(raw)
        out[FACTS + kinds :] = (math.log1p(len(raw)) / 10, math.log1p(len(lines)) / 5, math.log1p(len(raw) / len(lines)) / 10, len(set(lines)) / len(lines))
    return out


# -- fitting -------------------------------------------------------------------


@dataclass
class Logistic:
    """A logistic classifier on scaled features, with Platt calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds."""
        raw = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return np.clip(self.slope * raw + self.shift, -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 250, rate: float = 0.05) -> Logistic:
    """Full-batch gradient descent with moment estimates; no randomness."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))]).astype(np.float32)
    w = np.zeros(z.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = z.T @ (sigmoid(z @ w).astype(np.float32) - y.astype(np.float32)) / len(z)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Logistic(mean, scale, w[:-1].astype(np.float64), float(w[-1]))


def calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> Logistic:
    """Platt scaling on rows that were not trained on, with smoothed targets."""
    raw = Logistic(model.mean, model.scale, model.weights, model.bias).odds(x)
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    line = fit(raw[:, None], np.where(y > 0, high, low), l2=1e-4, steps=400)
    slope = float(line.weights[0] / line.scale[0])
    # A view that tells nothing may come out reversed by chance; then it only tells the base rate.
    slope = max(slope, 0.0)
    shift = line.bias - slope * float(line.mean[0])
    return Logistic(model.mean, model.scale, model.weights, model.bias, slope, shift)


@dataclass
class CoTrained:
    """Both calibrated views and their combiner."""

    text: Logistic
    facts: Logistic
    mix: tuple[float, float, float]

    def scores(self, x: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability by text, by metadata, combined)."""
        a, b = self.text.odds(x), self.facts.odds(f)
        return sigmoid(a), sigmoid(b), sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


#: (pupil, its features of the rows, label) of rows that one view passes on to the other.
Lesson = tuple[int, np.ndarray, float]
#: What gives the lessons of a round, by both views and the share of class 1. No row is passed on to a view twice.
Pool = Callable[[list[Logistic], float], list[Lesson]]


def shares(base: float) -> dict[float, int]:
    """How many rows of each class a view passes on in a round."""
    return {1.0: max(1, round(PER_ROUND * base)), 0.0: max(1, round(PER_ROUND * (1 - base)))}


def pool_of(x: np.ndarray, f: np.ndarray) -> Pool:
    """Rows in memory as a pool."""
    left = np.ones((len(x), 2), bool)

    def lessons(models: list[Logistic], base: float) -> list[Lesson]:
        out = []
        for pupil, (teacher, seen) in ((1, (models[0], x)), (0, (models[1], f))):
            p = sigmoid(teacher.odds(seen))
            for label, share in shares(base).items():
                sure = p if label else 1 - p
                ready = np.flatnonzero(left[:, pupil] & (sure >= SURE))
                best = ready[np.argsort(-sure[ready], kind="stable")[:share]]
                out.append((pupil, best, label))
        for pupil, best, _ in out:
            left[best, pupil] = False
        return [(pupil, (x, f)[pupil][best], label) for pupil, best, label in out]

    return lessons


def co_train(x: np.ndarray, f: np.ndarray, y: np.ndarray, pool: Pool | None, rounds: int = ROUNDS) -> CoTrained:
    """Fit both views; rows are (content features, page features, label 0/1), the pool has rows without labels."""
    held = np.arange(len(y)) % HELD_OUT == HELD_OUT - 1
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)  # too few rows to keep any apart
    check = held if held.any() else ~held
    views = (x, f)
    trained = [(v[~held], y[~held]) for v in views]

    def now(k: int) -> Logistic:
        return calibrate(fit(*trained[k]), views[k][check], y[check])

    models = [now(0), now(1)]
    for _ in range(rounds if pool else 0):
        lessons = [x for x in pool(models, float(y.mean())) if len(x[1])]
        if not lessons:
            break
        for pupil, rows, label in lessons:
            old_x, old_y = trained[pupil]
            trained[pupil] = np.concatenate([old_x, rows]), np.concatenate([old_y, np.full(len(rows), label)])
        models = [now(0), now(1)]
    both = np.column_stack([models[0].odds(x[check]), models[1].odds(f[check])])
    line = fit(both, y[check], l2=1e-4, steps=400)
    mix = np.maximum(line.weights / line.scale, 0.0)
    return CoTrained(models[0], models[1], (float(mix[0]), float(mix[1]), line.bias - float(mix @ line.mean)))


# -- on Spark ------------------------------------------------------------------


def _facts_of(batch: pa.RecordBatch, names: list[str]) -> list[dict]:
    columns = [batch[n].to_pylist() for n in names]
    return [dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True)]


def _features(docs: DataFrame, key: Column, text: str, facts: list[str], label: Column) -> DataFrame:
    """(key, label, x, f) of rows, features as packed floats."""
    names = [f"m{i}" for i in range(len(facts))]
    source = docs.select(key.alias("key"), label.cast("double").alias("label"), col(text).alias("text"), *[_fact(docs, c).alias(n) for c, n in zip(facts, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[str, int] = {}
        for batch in batches:
            x = [text_features(t.as_py(), buckets).tobytes() for t in batch["text"]]
            facts_ = _facts_of(batch, names) if names else [{}] * len(x)
            f = [page_features(t.as_py(), r).tobytes() for t, r in zip(batch["text"], facts_, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], pa.array(x, pa.binary()), pa.array(f, pa.binary())], ["key", "label", "x", "f"])

    return source.mapInArrow(run, "key string, label double, x binary, f binary")


def _fact(docs: DataFrame, name: str) -> Column:
    """Numbers as double, all else as string."""
    number = dict(docs.dtypes)[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or dict(docs.dtypes)[name].startswith("decimal")
    return col(name).cast("double" if number else "string")


def _matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    raw = b"".join(table[name].to_pylist())
    return np.frombuffer(raw, np.float32).reshape(-1, width)


def _rows_of(docs: DataFrame, picked: DataFrame, key: str, text: str, facts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content features, page features, label) of a bounded number of picked rows (key, label), one for each key."""
    here, mark = fresh(docs, "sample_key", "sample_label")
    chosen = docs.join(F.broadcast(picked.select(F.col("key").alias(here), F.col("label").alias(mark))), col(key).cast("string") == F.col(here))
    rows = _features(chosen, F.col(here), text, facts, F.col(mark)).dropDuplicates(["key"]).orderBy(F.xxhash64("key"), "key").toArrow()
    return _matrix(rows, "x", STYLE + WORDS), _matrix(rows, "f", FACTS + LAYOUT), np.array(rows["label"].to_pylist(), np.float64)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, facts: list[str], label: str) -> CoTrained | None:
    """Co-train on at most ``LABELLED`` labelled documents, drawn by the hash of their key, and on all the others.

    None if the labels have fewer than two classes among the documents. Keys
    that are labelled both ways, and null keys and labels, are not used.
    """
    ws = Workspace(docs.sparkSession)
    known = labels.where(col(key).isNotNull() & col(label).isin(0, 1)).groupBy(col(key).cast("string").alias("key"))
    known = known.agg(F.min(col(label)).cast("double").alias("label"), F.max(col(label)).cast("double").alias("top"))
    known = ws.put(known, "labels")
    order = [F.xxhash64(F.lit("sample"), "key"), F.col("key")]
    ids = docs.where(col(key).isNotNull()).select(col(key).cast("string").alias("key")).distinct()
    sample = ws.put(ids.join(known.where("label = top").drop("top"), "key").orderBy(*order).limit(LABELLED), "sample")
    x, f, y = _rows_of(docs, sample, key, text, facts)
    if len(set(y)) < 2:
        return None
    taught: list[list[DataFrame]] = [[], []]  # by pupil

    def lessons(models: list[Logistic], base: float) -> list[Lesson]:
        both = CoTrained(models[0], models[1], (0.0, 0.0, 0.0))
        source = docs.where(col(key).isNotNull()).withColumn("\0key", col(key).cast("string"))
        scored = _scored(source, both, text, facts, ["\0key"], ["all", "p0", "p1"]).withColumnRenamed("\0key", "key").drop("all")
        # Repeated keys give repeated rows; any of them stands for the key.
        scored = scored.groupBy("key").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1")).join(known.select("key"), "key", "left_anti")
        scored = ws.put(scored, "scored")
        picks = []
        for pupil in (1, 0):
            open_ = scored
            for t in taught[pupil]:
                open_ = open_.join(F.broadcast(t.select("key")), "key", "left_anti")  # at most PER_ROUND + 1 rows
            for value, share in shares(base).items():
                p = F.col(f"p{1 - pupil}")
                sure = p if value else 1 - p
                best = open_.where(sure >= SURE).orderBy(sure.desc(), *order).limit(share)
                picks.append(best.select("key", F.lit(float(value)).alias("label"), F.lit(pupil).alias("pupil")))
        picked = ws.put(reduce(DataFrame.unionByName, picks), "picked")
        ws.drop(scored)
        out = []
        for pupil in (1, 0):
            own = picked.where(F.col("pupil") == pupil)
            taught[pupil].append(own)
            px, pf, py = _rows_of(docs, own, key, text, facts)
            out += [(pupil, (px, pf)[pupil][py == value], value) for value in (1.0, 0.0)]
        return out

    return co_train(x, f, y, lessons)


def score(docs: DataFrame, model: CoTrained | None, text: str, facts: list[str], out: str = "quality_score") -> DataFrame:
    """``docs`` without change, with three doubles: ``out``, ``out``_text and ``out``_facts.

    Without a model every score is 1: nothing is known against any document.
    ``docs`` must not have columns of these names.
    """
    return _scored(docs, model, text, facts, docs.columns, [out, f"{out}_text", f"{out}_facts"])


def _scored(docs: DataFrame, model: CoTrained | None, text: str, facts: list[str], kept: list[str], out: list[str]) -> DataFrame:
    """The columns ``kept`` and three scores."""
    names = [f"m{i}" for i in range(len(facts))]
    columns = [*[col(c) for c in kept], *[_fact(docs, c).alias(f"\0{n}") for c, n in zip(facts, names, strict=True)]]
    # A text that passes through anyway is not sent twice.
    at = kept.index(text) if text in kept else len(columns)
    source = docs.select(*columns, *([] if text in kept else [col(text).alias("\0text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[str, int] = {}
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                p = (np.ones(n),) * 3
            else:
                parts = []
                texts = batch.column(at)
                meta = pa.RecordBatch.from_arrays(batch.columns[len(kept) : len(kept) + len(names)], names) if names else None
                rows = _facts_of(meta, names) if names else [{}] * n
                for a in range(0, n, 512):
                    some = [t.as_py() for t in texts[a : a + 512]]
                    x = np.stack([text_features(t, buckets) for t in some])
                    f = np.stack([page_features(t, r) for t, r in zip(some, rows[a : a + 512], strict=True)])
                    parts.append(model.scores(x, f))
                p = [np.concatenate(column) for column in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(p[2]), pa.array(p[0]), pa.array(p[1])], [*kept, *out])

    schema = docs.select(*[col(c) for c in kept]).schema
    for name in out:
        schema = schema.add(name, "double")
    return source.mapInArrow(run, schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    facts: tuple[str, ...] = ("lang", "source", "n_chars"),
    label: str = "quality",
    out: str = "quality_score",
) -> DataFrame:
    """``docs`` with ``out``: the probability that a document is of class 1, by both views; and that of each view.

    Defined cases: a null, empty or blank text has zero text features and is
    scored by what they and its metadata say; nulls in metadata are values like
    any other; metadata columns that ``docs`` lacks are left out, other columns
    pass through, and columns named like a score raise ``ValueError``; repeated rows
    get equal scores; texts are read whole; empty labels, or labels of one
    class, score everything 1; an empty table gives an empty table.
    """
    if {out, f"{out}_text", f"{out}_facts"} & set(docs.columns):
        raise ValueError(f"docs already has a column {out}, {out}_text or {out}_facts")
    present = [c for c in facts if c in docs.columns]
    return score(docs, train(docs, labels, key, text, present, label), text, present, out)
