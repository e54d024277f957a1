"""The nearest rows of many queries, by blocked products: what a task holds is a block of queries and their best so far."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Queries and similarities that are worked on at once.
QUERIES, PRODUCTS = 1024, 1 << 20
_LAST, _MOST = np.iinfo(np.int64).max, np.finfo(np.float64).max


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """As SQL rounds: halves away from zero, never -0.0; what is too large to have such digits stays as it is."""
    scale = 10.0**digits
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.abs(x) * scale
        whole = np.floor(size)
        near = np.copysign(whole + (size - whole >= 0.5), x) / scale
    return np.where(size < 1 << 50, near, x) + 0.0


def matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one size in double precision, and which of them hold a null."""
    flat = vectors.flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1) if flat.null_count else np.zeros(len(vectors), bool)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size), holes


class Queries:
    """Ids and vectors of a bounded set of queries, by size and in blocks."""

    def __init__(self, ids: pa.Array, vectors: pa.Array):
        sizes = vectors.value_lengths().fill_null(0).to_numpy()
        self.ids, self.blocks = ids, []
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            for at in range(0, len(own), QUERIES):
                which = own[at : at + QUERIES]
                self.blocks.append((int(size), which, *matrix(vectors.take(pa.array(which)), int(size))) if size else (0, which, None, None))

    def top(self, batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
        """(query_id, id, similarity): of batches (id, embedding) in the order of ids, the ``limit`` best of each query."""
        best = [Best(len(b[1]), limit) for b in self.blocks]
        kind = None
        step = max(1, PRODUCTS // QUERIES)
        for batch in batches:
            kind = batch.schema.field("id").type
            for at in range(0, batch.num_rows, step):
                own = batch.slice(at, step)
                sizes = own["embedding"].value_lengths().fill_null(0).to_numpy()
                groups = {}
                for (size, _, q, q_holes), state in zip(self.blocks, best, strict=True):
                    if size not in groups:
                        there = np.flatnonzero(sizes == size)
                        groups[size] = (there, *matrix(own["embedding"].take(pa.array(there)), size)) if size and len(there) else (there, None, None)
                    there, x, holes = groups[size]
                    scores, nulls = np.zeros((state.n, own.num_rows)), None
                    if x is not None:
                        with np.errstate(over="ignore", invalid="ignore"):
                            scores[:, there] = q @ x.T
                        if holes.any() or q_holes.any():
                            nulls = np.zeros(scores.shape, bool)
                            nulls[:, there] = holes | q_holes[:, None]
                    state.add(own["id"], scores, nulls)
        if kind is None:
            return
        for (_, which, _, _), state in zip(self.blocks, best, strict=True):
            q, ids, sims = state.rows()
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(which[q])), pa.array(ids, kind), sims], ["query_id", "id", "similarity"])


class Best:
    """The best rows of a block of queries so far. Rows come in the order of ids, so of equal ones the earlier is better.

    A key orders similarities as SQL does, descending: NaN, numbers, null.
    """

    def __init__(self, n: int, limit: int):
        self.n, self.limit, self.seen = n, limit, 0
        self.keys = np.full((n, limit), -np.inf)
        self.places = np.full((n, limit), _LAST)
        self.ids = np.full((n, limit), None, object)

    def add(self, ids: pa.Array, scores: np.ndarray, nulls: np.ndarray | None) -> None:
        """``scores`` (a row for each query) of the next rows; ``nulls`` are those that are null."""
        start, self.seen = self.seen, self.seen + len(ids)
        plain = nulls is None and bool(np.isfinite(scores).all())
        full = bool((self.places[:, -1] < _LAST).all())
        if plain and full:
            # Six digits are asked for of the few that may be better.
            q, d = np.nonzero(scores > self.keys[:, -1:] - 1e-6 - 1e-12 * np.abs(self.keys[:, -1:]))
            keys = rounded(scores[q, d])
            better = keys > self.keys[q, -1]
            q, d, keys = q[better], d[better], keys[better]
            if len(q) > 4 * self.keys.size:
                q = None
        else:
            q = None
        if q is None:
            every = rounded(scores)
            if not plain:
                every = np.where(np.isnan(every), np.inf, np.clip(every, -_MOST, _MOST))
                every = every if nulls is None else np.where(nulls, -np.inf, every)
            wanted = (every > self.keys[:, -1:]) | (self.places[:, -1:] == _LAST)
            if every.shape[1] > self.limit:
                least = np.partition(every, -self.limit, axis=1)[:, -self.limit, None]
                equal = every == least
                wanted &= (every > least) | (equal & (np.cumsum(equal, axis=1) <= self.limit))
            q, d = np.nonzero(wanted)
            keys = every[q, d]
        if not len(q):
            return
        who = np.concatenate([np.repeat(np.arange(self.n), self.limit), q])
        keys, places = np.concatenate([self.keys.ravel(), keys]), np.concatenate([self.places.ravel(), d + start])
        own, at = np.unique(d, return_inverse=True)
        names = np.empty(len(own), object)
        names[:] = ids.take(pa.array(own)).to_pylist()
        named = np.concatenate([self.ids.ravel(), names[at]])
        order = np.lexsort((places, -keys, who))
        top = order[np.searchsorted(who[order], np.arange(self.n))[:, None] + np.arange(self.limit)]
        self.keys, self.places, self.ids = keys[top], places[top], named[top]

    def rows(self) -> tuple[np.ndarray, list, pa.Array]:
        """(queries, ids, similarities) of what there is."""
        q, k = np.nonzero(self.places < _LAST)
        keys = self.keys[q, k]
        sims = np.where(keys == np.inf, np.nan, np.where(np.abs(keys) == _MOST, np.copysign(np.inf, keys), keys))
        return q, list(self.ids[q, k]), pa.array(sims, pa.float64(), mask=keys == -np.inf)
