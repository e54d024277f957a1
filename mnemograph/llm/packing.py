"""Packing token pieces into as few fixed-size sequences as possible.

The lengths of all pieces are a histogram of at most ``capacity`` counts, which
is all that comes to the driver. The configuration linear program over it (one
variable for each pattern of lengths that fits a sequence) is a game: one side
mixes patterns, the other weighs lengths. Both play multiplicative weights: a
pattern gains with the weight that it covers, a length loses with how well it is
covered. An unbounded-knapsack dynamic program prices the best pattern for the
weights of the lengths; it joins the mix, and its value gives a bound that no
packing is below. That goes on until mix and bound are within ``GAP``. The
fractional solution is rounded down and what is left is packed best-fit.

The result is a plan of runs: "the pieces of length L with ranks r to r+n have
the offset o in the sequences s to s+n". Its size depends on the capacity and
the rounds, not on the number of pieces. Pieces get their ranks by counted
blocks, so no length, however common, is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, block_bits, col, fresh, gapless_rank

#: The program is solved until its value is within this share of its lower bound, or for so many
#: rounds; steps of both sides in a round; the exponent of a step for a coverage of one.
GAP, ROUNDS, STEPS, RATE = 0.005, 600, 40, 0.3
#: How much more than in proportion to its length a piece weighs at first, as long ones are harder to place.
START = 1.0
#: Lengths up to which the knapsack goes length by length, and beyond which room by room.
FEW_LENGTHS = 64
#: Pieces of one length that are ranked in one task, about.
RANKED_PER_BLOCK = 1 << 14


def best_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length in the most valuable pattern: unbounded knapsack by dynamic programming.

    ``lengths`` ascend. O(capacity * lengths) in min(capacity, lengths) vector steps or so.
    """
    best = np.zeros(capacity + 1)
    if len(lengths) <= FEW_LENGTHS:
        for n, v in zip(lengths.tolist(), values.tolist(), strict=True):
            # Rooms that differ by multiples of n are a column; more copies only ever add to a smaller room.
            rows = -(-(capacity + 1) // n)
            grid = np.append(best, np.full(rows * n - capacity - 1, -np.inf)).reshape(rows, n)
            paid = np.arange(rows)[:, None] * v
            best = (np.maximum.accumulate(grid - paid, axis=0) + paid).ravel()[: capacity + 1]
    else:
        for room in range(int(lengths[0]), capacity + 1):
            n = int(np.searchsorted(lengths, room, "right"))
            best[room] = max(best[room - 1], float((best[room - lengths[:n]] + values[:n]).max()))
    copies, room, close = np.zeros(len(lengths), np.int64), capacity, 1e-9 * float(best[capacity])
    while room >= lengths[0] and best[room] > close:
        n = int(np.searchsorted(lengths, room, "right"))
        gain = best[room - lengths[:n]] + values[:n]
        k = int(np.argmax(gain))
        if gain[k] < best[room] - close:
            room -= 1  # what is best here is best with less room
        else:
            copies[k] += 1
            room -= int(lengths[k])
    return copies


def best_fit(items: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Best-fit decreasing: each item goes into the fullest bin that has room for it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for item in sorted(items, reverse=True):
        room = next((r for r in range(item, capacity + 1) if by_room[r]), None)
        if room is None:
            bins.append([])
            b, room = len(bins) - 1, capacity
        else:
            b = by_room[room].pop()
        bins[b].append(item)
        by_room[room - item].append(b)
    return [tuple(b) for b in bins]


def fill(counts: dict[int, int], capacity: int) -> Counter[tuple[int, ...]]:
    """Best-fit decreasing on a histogram: whole runs of equal bins at once.

    The longest length left opens a bin, which then takes the longest length
    that still fits, again and again; as many bins of that pattern are made as
    the counts allow. This ends after few patterns, whatever the counts are.
    """
    left = {n: c for n, c in counts.items() if c}
    out: Counter[tuple[int, ...]] = Counter()
    while left:
        order = sorted(left, reverse=True)
        pattern: Counter[int] = Counter()
        room = capacity
        for n in order:
            take = min(room // n, left[n])
            if take:
                pattern[n] += take
                room -= take * n
        times = min(left[n] // k for n, k in pattern.items())
        out[tuple(sorted(pattern.elements(), reverse=True))] += times
        for n, k in pattern.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


@dataclass
class Program:
    """A fractional packing: rows of ``patterns`` (copies of each of ``lengths``) and how often each is used.

    ``value`` is the sum of ``uses``; no packing has fewer sequences than ``bound``.
    """

    lengths: np.ndarray
    patterns: np.ndarray
    uses: np.ndarray
    value: float
    bound: float


def _first(lengths: np.ndarray, need: np.ndarray, capacity: int, start: float) -> dict[bytes, float]:
    """A fractional packing to start from: the best pattern for fixed weights, until one of its lengths is used up; again."""
    weights = lengths * (lengths / capacity) ** start
    done, used = np.zeros(len(lengths)), {}
    while len(open_ := np.flatnonzero(done < 1 - 1e-9)):
        pattern = np.zeros(len(lengths), np.int64)
        pattern[open_] = best_pattern(weights[open_], lengths[open_], capacity)
        have = np.flatnonzero(pattern)
        times = float((need[have] * (1 - done[have]) / pattern[have]).min())
        used[pattern.tobytes()] = used.get(pattern.tobytes(), 0.0) + times
        done[have] += times * pattern[have] / need[have]
    return used


def program(counts: dict[int, int], capacity: int, start: float = START) -> Program:
    """The configuration linear program of a histogram, by multiplicative weights of patterns and of lengths.

    Steps are optimistic: each side answers twice the newest gain less the one
    before, which lets both converge instead of circling. Averages start anew
    after 1, 2, 4, ... rounds.
    """
    lengths = np.array(sorted(n for n, c in counts.items() if c), np.int64)
    need = np.array([counts[int(n)] for n in lengths], float)
    used = _first(lengths, need, capacity, start)
    patterns = np.array([np.frombuffer(k, np.int64) for k in used], float)
    uses = np.array(list(used.values()))
    value, bound = float(uses.sum()), float(lengths @ need) / capacity
    mix, weights = np.log(uses / value), np.log(lengths * need / float(lengths @ need))
    mix_before, weights_before = np.zeros(len(mix)), np.zeros(len(weights))
    mix_sum, weights_sum, renew = np.zeros(len(mix)), np.zeros(len(weights)), 1

    def shares(logs: np.ndarray) -> np.ndarray:
        x = np.exp(logs - logs.max())
        return x / x.sum()

    for t in range(1, ROUNDS + 1):
        if value <= max(bound * (1 + GAP), np.ceil(bound - 1e-6)):
            break
        covers = patterns / need * value  # what a pattern covers of each length; one on average
        for _ in range(STEPS):
            x, y = shares(mix), shares(weights)
            mix_now, weights_now = covers @ y, x @ covers
            mix = np.maximum(mix + RATE * (2 * mix_now - mix_before), mix.max() - 700)
            weights = np.maximum(weights - RATE * (2 * weights_now - weights_before), weights.max() - 700)
            mix_before, weights_before = mix_now, weights_now
            mix_sum += x
            weights_sum += y
        for x in (shares(mix), mix_sum / mix_sum.sum()):
            least = float((x @ patterns / need).min())
            if least > 0 and 1 / least < value:
                value, uses = 1 / least, x / least
        for y in (shares(weights), weights_sum / weights_sum.sum()):
            price = y / need
            pattern = best_pattern(price, lengths, capacity)
            bound = max(bound, 1 / float(pattern @ price))
            if pattern @ price > (patterns @ price).max() * (1 + 1e-9):
                patterns = np.vstack([patterns, pattern])
                mix = np.append(mix, mix.max() - 3)
                mix_before = np.append(mix_before, pattern / need @ y * value)
                mix_sum, uses = np.append(mix_sum, 0.0), np.append(uses, 0.0)
        if t == renew:
            mix_sum, weights_sum, renew = np.zeros(len(mix)), np.zeros(len(weights)), 2 * renew
    return Program(lengths, patterns.astype(np.int64), uses, value, bound)


def solve(counts: dict[int, int], capacity: int, start: float = START) -> Counter[tuple[int, ...]]:
    """Patterns with how often each is used; every piece is covered exactly once."""
    counts = {int(n): int(c) for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("every length must be between 1 and the capacity")
    if not counts:
        return Counter()
    found = program(counts, capacity, start)
    left, whole = dict(counts), Counter()
    for k in np.argsort(-found.uses, kind="stable"):
        have = np.flatnonzero(found.patterns[k])
        each = {int(found.lengths[i]): int(found.patterns[k, i]) for i in have}
        times = min([int(found.uses[k] + 1e-9), *(left[n] // c for n, c in each.items())])
        if times > 0:
            whole[tuple(n for n in sorted(each, reverse=True) for _ in range(each[n]))] += times
            for n, c in each.items():
                left[n] -= times * c
    whole.update(finish(left, capacity))
    return whole


def finish(left: dict[int, int], capacity: int) -> Counter[tuple[int, ...]]:
    """What rounding has left: item by item while that is few, else in runs of equal bins first."""
    few = 20_000
    out: Counter[tuple[int, ...]] = Counter()
    if sum(left.values()) > few:
        out = fill(left, capacity)
        # The thin patterns at the end are where runs lose most; they are packed again item by item.
        again = Counter()
        for pattern, times in list(out.items()):
            if times <= 2 and sum(again.values()) < few:
                again.update({n: times * k for n, k in Counter(pattern).items()})
                del out[pattern]
        left = dict(again)
    out.update(best_fit([n for n, c in left.items() for _ in range(c)], capacity))
    return out


def plan_runs(patterns: Counter[tuple[int, ...]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): the places of all ranks of each length."""
    runs, rank, sequence = [], Counter(), 0
    for pattern, times in sorted(patterns.items(), reverse=True):
        at = 0
        for n in pattern:
            runs.append((n, rank[n], times, sequence, at))
            rank[n] += times
            at += n
        sequence += times
    return sorted(runs)


def cut(lengths: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole capacities, the first piece may be shorter."""
    if lengths <= capacity:
        return [(0, lengths)]
    first = lengths % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, lengths, capacity)]


def token_pieces(docs: DataFrame, key: str, text: str, tokenizer: str, ranks: str | None, end: int, capacity: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document's ids, cut to the capacity.

    ``tokenizer`` is a file of the tokenizers library and defines the ids.
    ``ranks`` may name a file of the same vocabulary as ranks: then those ids
    are computed from it, which is several times faster.
    """
    source = docs.select(col(key).alias("key"), col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks)
        for batch in batches:
            rows, n, start, length, crc = [], [], [], [], []
            texts = batch["text"].to_pylist()
            for k, t in enumerate(texts):
                ids = np.append(encode(t or ""), np.uint32(end)).astype("<u4")
                for i, (s, m) in enumerate(cut(len(ids), capacity)):
                    rows.append(k)
                    n.append(i)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(ids[s : s + m].tobytes()))
            columns = [batch["key"].take(pa.array(rows, pa.int64())), pa.array(n, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long")


@lru_cache(1)
def _encoder(tokenizer: str, ranks: str | None):
    """text -> ids as an array of uint32; strings of special tokens are ordinary text.

    A Python worker keeps it for its next tasks.
    """
    if ranks is None:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)
    import base64

    import tiktoken

    #: Fixed value: how the byte-level vocabulary splits text before merging.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return lambda text: np.array(encoding.encode_ordinary(text), np.uint32)


def place(pieces: DataFrame, capacity: int, ws: Workspace) -> DataFrame:
    """``pieces`` (a written table with a column ``length``) with ``sequence_id`` and ``offset``."""
    rows = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    runs = plan_runs(solve({r[0]: r[1] for r in rows}, capacity))
    row, mix, rank = fresh(pieces, "row", "mix", "rank")
    numbered = pieces.withColumn(row, F.monotonically_increasing_id())
    numbered = ws.put(numbered.withColumn(mix, F.xxhash64(F.lit(6), F.col(row))), "numbered")
    bits = block_bits(sum(r[1] for r in rows), RANKED_PER_BLOCK)
    ranked = gapless_rank(numbered, ["length"], mix, row, bits, rank).drop(mix, row)
    plan = np.array(runs, np.int64).reshape(-1, 5)
    shift = max([1, *(r[1] for r in rows)]) + 1
    starts = plan[:, 0] * shift + plan[:, 1]
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index(rank)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at_length, at_rank))
            k = np.searchsorted(starts, length * shift + r, "right") - 1
            kept = [i for i in range(batch.num_columns) if i != at_rank]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(plan[k, 3] + r - plan[k, 1]), pa.array(plan[k, 4])],
                [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"],
            )

    return ranked.mapInArrow(put, ranked.drop(rank).schema.add("sequence_id", "long").add("offset", "long"))


def pack(
    docs: DataFrame,
    key: str,
    text: str,
    tokenizer: str,
    ranks: str | None = None,
    end: int = 2,
    capacity: int = 1024,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the id ``end``. Only longer ones than ``capacity``
    are cut. Sequence numbers and, in each sequence, offsets have no gaps.

    Defined cases: a null or empty text is the one id ``end``; repeated rows and
    null keys are documents like any other; texts of any length are read whole;
    other columns are not read; an empty table gives an empty table.
    """
    ws = Workspace(docs.sparkSession)
    pieces = ws.put(token_pieces(docs, key, text, tokenizer, ranks, end, capacity), "pieces")
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place(pieces, capacity, ws).select(F.col("key").alias(key), *columns)
