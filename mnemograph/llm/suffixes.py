"""Repeated byte strings, found with suffix arrays and longest-previous-factor arrays.

A window of ``width`` bytes is a repeat if it also starts anywhere else. All
windows that are equal have the same smallest 64-byte hash in the same place, so
texts are cut into stretches of consecutive windows that share that anchor, and
only stretches with equal anchors can hold equal windows:

1. Equal texts are one class. Each distinct text is cut into stretches; of a
   stretch only the hashes of its anchor and of its bytes travel.
2. Stretches are counted by (anchor, bytes). One that occurs twice repeats
   whole. An anchor with one distinct stretch needs no more work.
3. Where an anchor has several distinct stretches, one copy of each is read
   from the texts, and a suffix array over the copies of many anchors is built
   by prefix doubling. In suffix order the previous and next smaller positions
   give each suffix its longest match that starts earlier (the longest previous
   factor), and the larger positions the longest that starts later.
4. What repeats in a stretch holds for all its copies; spans go back to texts.

Two results come of the same arrays: every copy of a repeated string goes, or
later copies go and the first stays. For the second, stretches stand in an array
in the order of their first place, so a longest previous factor of a window's
length says that the window has been before.

An anchor with very many distinct stretches is not gathered in one task: its
windows are then counted by their 128-bit hashes, which combine before the
shuffle. Both ways give the same windows.

Passages are the same by words: a run of so many words that also stands in another
text, however it is spaced. Its stretches share the smallest hash of ``GRAM`` words,
and the windows of those that differ are compared by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, col, fresh, numbered, small

#: Bytes that an anchor's hash covers.
ANCHOR = 64
#: Bytes that are scanned at once; longer texts are scanned in parts that overlap by a window.
SCAN = 1 << 18
#: Distinct stretches of one anchor that a suffix array takes, at most about 3 MB; beyond that windows are counted by hash.
CROWD = 4096
#: Bytes in one suffix array, about.
ARRAY_BYTES = 1 << 19
#: Suffixes that are scanned with a stack at once, about.
STACK = 1 << 16
#: Words that the anchor of a passage covers, a power of two, and windows of words that are scanned at once.
GRAM, SCAN_WORDS = 16, 1 << 15

_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each 64 bytes of ``data``, by doubling the covered length six times."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    length = 1
    for m in _MULTIPLIERS:
        h = (h[:-length] * m) ^ (h[:-length] >> np.uint64(29)) ^ h[length:]
        length *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each ``width`` consecutive values is; of equal ones the first."""
    n = len(h)
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = packed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def stretches(data: bytes, width: int) -> Iterator[tuple[int, int, int]]:
    """(anchor hash, first window, windows) of the stretches of a text, in order.

    A stretch that the end of a scanned part cuts is two stretches.
    """
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(raw) - width + 1), SCAN):
        part = raw[at : at + SCAN + width - 1]
        h = _hashes(part)
        # The order of hashes must not depend on the part: the same bits are compared everywhere.
        order = h >> np.uint64(24)
        anchor = _sliding_argmin(order << np.uint64(24), width - ANCHOR + 1)
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate([[0], cuts])
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        yield from zip(h[anchor[first]].view(np.int64).tolist(), (first + at).tolist(), count.tolist(), strict=True)


# -- suffix order --------------------------------------------------------------


def suffix_array(symbols: np.ndarray, depth: int, keep: set[int] | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(suffixes in order of their first ``depth`` symbols or more; ranks by 1, 2, 4, ... symbols, or those in ``keep``).

    Doubling ends early where no two suffixes share as many symbols.
    """
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
    length, n = 1, len(symbols)
    ranks = {1: rank} if keep is None or 1 in keep else {}
    while True:
        key = rank * np.int64(n + 2)
        if length < n:
            key[: n - length] += rank[length:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(n, np.int32)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        rank = np.empty(n, np.int32)
        rank[order] = new
        length *= 2
        if keep is None or length in keep:
            ranks[length] = rank
        if length >= depth or not n or new[-1] == n - 1:
            return order, ranks


def common_prefix(ranks: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes i and j; needs the ranks of every power up to some largest."""
    n, levels = len(ranks[1]), sorted(ranks, reverse=True)
    length = np.zeros(len(i), np.int64)

    def advance(at: np.ndarray, level: int) -> np.ndarray:
        """Of the pairs ``at``, those that agree on ``level`` more symbols, which are added."""
        a, b = i[at] + length[at], j[at] + length[at]
        inside = (a < n) & (b < n)
        same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        length[at[same]] += level
        return at[same]

    more = np.arange(len(i))
    while len(more):
        more = advance(more, levels[0])
    for level in levels[1:]:
        advance(np.arange(len(i)), level)
    return np.minimum(length, n - np.maximum(i, j))


def powers(width: int) -> list[int]:
    """The powers of two that add up to ``width``, the largest first."""
    return [1 << b for b in range(width.bit_length() - 1, -1, -1) if width >> b & 1]


def share(ranks: dict[int, np.ndarray], width: int, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Whether suffixes i and j share ``width`` symbols; needs the ranks of :func:`powers`."""
    out = (i + width <= n) & (j + width <= n)
    at = 0
    for level in powers(width):
        if level not in ranks:  # doubling has ended before: no two suffixes share as many
            return np.zeros(len(i), bool)
        rank = ranks[level]
        out &= rank[np.minimum(i + at, n - 1)] == rank[np.minimum(j + at, n - 1)]
        at += level
    return out


def _nearest_smaller(places: list[int], bounds: list[int], sign: int) -> list[int]:
    """For each suffix in order: its longest match among those before it that start earlier (sign 1) or later (-1).

    ``bounds[k]`` is the common prefix of suffixes k - 1 and k. A stack keeps the
    suffixes that are still the nearest smaller (larger) position of someone.
    """
    out, stack = [0] * len(places), []  # of (place, least bound since)
    for k, place in enumerate(places):
        least = bounds[k]
        while stack and sign * stack[-1][0] > sign * place:
            least = min(least, stack.pop()[1])
        if stack:
            out[k] = least
        stack.append((place, least))
    return out


def longest_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest later factor) at each suffix of ``order``.

    ``lcp[k]`` belongs to suffixes k - 1 and k of the order. In suffix order, the
    best earlier match of a suffix is the nearest one before or after it with a
    smaller position; the best later match the nearest one with a larger position.
    """
    places, bounds = order.tolist(), lcp.tolist()
    back = places[::-1], [0, *bounds[:0:-1]] if bounds else []
    found = []
    for sign in (1, -1):
        before = np.array(_nearest_smaller(places, bounds, sign), np.int64)
        after = np.array(_nearest_smaller(*back, sign), np.int64)[::-1]
        found.append(np.maximum(before, after))
    return found[0], found[1]


def factors(parts: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place of each part: lengths of its longest earlier and later match, 0 where shorter than ``width``.

    Earlier is in the order of the parts. Matches never leave a part.
    """
    if not parts:
        return []
    # Every part ends in a symbol of its own, so no match leaves a part.
    symbols = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int32), np.int32(256 + k)) for k, p in enumerate(parts)])
    n = len(symbols)
    # The order goes to the ends of the parts: with ties, the best match of a suffix could stand elsewhere.
    order, ranks = suffix_array(symbols, max(map(len, parts)) + 1, {1 << b for b in range(width.bit_length())})
    long_ = np.zeros(n, bool)
    long_[1:] = share(ranks, width, order[:-1], order[1:], n)
    # A suffix whose neighbours in order both share less than a window has no match of one.
    near = long_.copy()
    near[:-1] |= long_[1:]
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(long_)
    lcp[at] = common_prefix(ranks, order[at - 1], order[at])
    del ranks
    own, bounds = order[near], lcp[near]
    # Matches do not reach across a bound of 0, so stretches of the order are solved one after another.
    starts = np.flatnonzero(bounds == 0)
    wanted = np.arange(STACK, len(own), STACK)
    wanted = wanted[wanted <= starts[-1]] if len(starts) else wanted[:0]
    cuts = [0, *np.unique(starts[np.searchsorted(starts, wanted)]).tolist(), len(own)]
    found = np.zeros((2, n), np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            found[:, own[a:b]] = longest_factors(own[a:b], bounds[a:b])
    out, at = [], 0
    for p in parts:
        out.append((found[0, at : at + len(p)], found[1, at : at + len(p)]))
        at += len(p) + 1
    return out


def repeated_windows(parts: list[bytes], width: int, keep_first: bool = False) -> list[np.ndarray]:
    """For each part: whether each of its windows also starts elsewhere in the parts.

    With ``keep_first`` a window is a repeat only if the other one starts earlier.
    """
    out = []
    for p, (earlier, later) in zip(parts, factors(parts, width), strict=True):
        hit = (earlier >= width) if keep_first else (earlier >= width) | (later >= width)
        out.append(hit[: max(0, len(p) - width + 1)])
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


# -- on Spark ------------------------------------------------------------------


def repeats(df: DataFrame, key: str, text: str, width: int = 400, passage: int | None = None) -> DataFrame:
    """One row per row of ``df``: key, n_bytes, spans, kept, later, kept_first, n_passages, n_passage_words.

    ``spans`` are the maximal runs of bytes covered by a ``width``-byte string
    that also starts anywhere else, in the same text included, and ``kept`` the
    bytes outside them: all copies go. ``later`` and ``kept_first`` are the same
    for strings that also start earlier, so of each string the first copy
    stays: that of the smallest key (null comes last), then the order of the rows
    in their files, then position. Texts are judged as they came in, as UTF-8
    bytes; matches never cross texts.

    ``n_passages`` are the maximal runs of words covered by ``passage`` words that
    also stand in a row, one after another, in another row's text, and ``n_passage_words``
    the words in them; both are null without ``passage``. Words are what is between
    blanks (0x20 and 0x09 to 0x0D). Nothing is removed for them.

    Defined cases: a null text counts as empty; texts shorter than ``width`` keep
    everything; repeated rows of at least that length lose everything, but for
    the first of them in ``kept_first``; null keys pass through; other columns
    are not read; an empty table gives an empty table.
    """
    if width < ANCHOR + 1:
        raise ValueError(f"width must be over {ANCHOR}")
    if passage is not None and passage < GRAM:
        raise ValueError(f"passage must be at least {GRAM}")
    ws = Workspace(df.sparkSession)
    raw = F.coalesce(col(text).cast("binary"), F.lit(b""))
    where = fresh(df, "file", "nr")
    place = F.struct(col(key).isNull().alias("none"), col(key).alias("key"), *[F.col(c) for c in where])
    rows = numbered(ws, df, where).select(col(key).alias("key"), raw.alias("raw"), F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("t"), place.alias("o"))
    twice = (F.col("copies") > 1) & (F.col("size") >= width)
    texts = rows.groupBy("t").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("raw")).alias("size"), F.min("o").alias("o"))
    texts = ws.put(texts.select("t", "o", "copies", twice.alias("all")), "texts")
    cut = ws.put(_cut(rows.select("t", "raw"), width), "stretches")

    # Anchors that occur in one place only are done. Copies of a text are one place.
    spot = F.xxhash64("t", "first")
    anchors = cut.groupBy("anchor").agg(F.min(spot).alias("p"), F.max(spot).alias("q")).where("p != q").select("anchor")
    anchors = ws.put(anchors, "anchors")
    seen = cut.join(small(anchors), "anchor", "left_semi").dropDuplicates(["t", "first"])
    seen = ws.put(seen.join(texts.select("t", "o"), "t"), "seen")
    ws.drop(cut)
    # Equal stretches are one kind, with its first place.
    at = F.min(F.struct("o", "first", "t", "windows")).alias("at")
    kinds = ws.put(seen.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), at).select("anchor", "h1", "h2", "n", "at.*"), "kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    copies = ws.put(_read(rows, ws.put(kinds.join(several, "anchor"), "doubtful"), width), "copies")

    few = copies.where(F.col("kinds") <= CROWD).drop("t")
    by_array = few.repartition("anchor").sortWithinPartitions("anchor", "o", "first").select("anchor", "h1", "h2", "kinds", "piece").mapInArrow(_by_array(width), _FOUND)
    found = ws.put(by_array.unionByName(_by_hash(copies.where(F.col("kinds") > CROWD), width)), "found")
    marks = kinds.select("h1", "h2", "n", F.struct("o", "first").alias("at")).join(found, ["h1", "h2"], "left").where("n > 1 or runs is not null")

    # Windows become the bytes that they cover. Of a kind that occurs twice, all repeats; only its first place may have no earlier one.
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("windows").alias("e")))
    runs = F.when(F.col("n") > 1, whole).otherwise(F.col("runs"))
    later = F.when(F.struct("o", "first") != F.col("at"), whole).otherwise(F.coalesce("later", none))

    def bytes_of(windows: Column) -> Column:
        return F.transform(windows, lambda r: F.struct((F.col("first") + r["s"]).alias("s"), (F.col("first") + r["e"] + width - 1).alias("e")))

    spans = seen.join(marks, ["h1", "h2"]).select("t", bytes_of(runs).alias("runs"), bytes_of(later).alias("later"))
    spans = spans.groupBy("t").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("later")).alias("later"))
    spans = ws.put(spans, "spans")

    # Only the first row of a text needs its spans: any other is a copy of a whole text.
    hit = texts.join(spans.select("t", F.lit(True).alias("some")), "t", "left")
    said = [F.lit(None).cast("long").alias(c) for c in _SAID]
    if passage is None:
        hit = hit.where("all or some")
    else:
        hit = hit.join(passages(ws, rows, texts, where, passage), "t", "left").where("all or some or n_passages is not null or copies > 1")
        said = ["n_passages", "n_passage_words"]
        # All words of a copied text stand in another row.
        words = F.when(F.col("copies") > 1, F.regexp_count(F.col("raw").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    hit = hit.select("t", "all", F.coalesce("some", F.lit(False)).alias("some"), F.col("o").alias("first"), "copies", *said)
    hit = ws.put(hit, "hit")
    marked = rows.join(small(hit), "t", "left").withColumn("again", F.coalesce(F.col("o") != F.col("first"), F.lit(False)))
    marked = marked.withColumns({"all": F.coalesce("all", F.lit(False)), "some": F.coalesce(F.col("some") & ~F.col("again"), F.lit(False))})
    if passage is not None:
        whole = words >= passage
        zero = F.lit(0).cast("long")
        n, in_them = F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_passages", zero)), F.when(whole, words).otherwise(F.coalesce("n_passage_words", zero))
        marked = marked.withColumns({"n_passages": n, "n_passage_words": in_them})
    n_bytes = F.octet_length("raw").cast("long")
    full = F.array(F.struct(F.lit(0).cast("long").alias("s"), n_bytes.alias("e")))
    copy = F.col("all") & F.col("again")
    native = marked.where("not some").select(
        "key",
        n_bytes.alias("n_bytes"),
        F.when(F.col("all"), full).otherwise(none).alias("spans"),
        F.when(F.col("all"), F.lit(b"")).otherwise(F.col("raw")).alias("kept"),
        F.when(copy, full).otherwise(none).alias("later"),
        F.when(copy, F.lit(b"")).otherwise(F.col("raw")).alias("kept_first"),
        *_SAID,
    )
    partly = marked.where("some").select("t", "key", "raw", "all", *_SAID).join(spans, "t").select("key", "raw", "all", "runs", "later", *_SAID)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, spans {_SPANS}, kept binary, later {_SPANS}, kept_first binary, n_passages long, n_passage_words long"
    return native.unionByName(partly.mapInArrow(_apply, schema)).withColumnRenamed("key", key)


#: What is said of passages.
_SAID = ("n_passages", "n_passage_words")
_SPANS = "array<struct<s:long,e:long>>"
_FOUND = f"h1 long, h2 long, runs {_SPANS}, later {_SPANS}"
_ARROW_RUNS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _split(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _cut(texts: DataFrame, width: int) -> DataFrame:
    """Stretches of each text: hash of the anchor, hash of the bytes, text, first window, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "h1", "h2", "t", "first", "windows"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            held: list[list] = [[] for _ in names]
            for t, data in zip(batch["t"], batch["raw"], strict=True):
                name, data = t.as_py(), data.as_py()
                for anchor, first, windows in stretches(data, width):
                    h1, h2 = _split(xxhash.xxh3_128_digest(data[first : first + windows + width - 1]))
                    for column, v in zip(held, (anchor, h1, h2, name, first, windows), strict=True):
                        column.append(v)
                if len(held[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names)
                    held = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names)

    return texts.mapInArrow(run, "anchor long, h1 long, h2 long, t binary, first long, windows long")


def _read(rows: DataFrame, doubtful: DataFrame, width: int) -> DataFrame:
    """``doubtful`` with ``piece``, the bytes of each stretch."""
    wanted = doubtful.groupBy("t").agg(F.collect_list(F.struct(*[c for c in doubtful.columns if c != "t"])).alias("w"))
    texts = rows.select("t", "raw").join(small(doubtful.select("t").distinct()), "t", "left_semi").dropDuplicates(["t"])
    piece = F.expr(f"substring(raw, int(x.first + 1), int(x.windows + {width} - 1))")
    pieces = texts.join(wanted, "t").select("t", "raw", F.explode("w").alias("x"))
    return pieces.select("t", "x.*", piece.alias("piece"))


def _by_array(width: int):
    """Stretches sorted by anchor and first place -> what repeats in each, by suffix arrays over whole anchors.

    A large anchor gets an array of its own: how many stretches it has is known
    before they are read.
    """

    def solve(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows = []
        for (h1, h2, data), (earlier, later) in zip(held, factors([x[2] for x in held], width), strict=True):
            n = len(data) - width + 1
            before, after = earlier[:n] >= width, later[:n] >= width
            if before.any() or after.any():
                rows.append((h1, h2, _named(_runs(before | after)), _named(_runs(before))))
        h1, h2, runs, first = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(runs, _ARROW_RUNS), pa.array(first, _ARROW_RUNS)], ["h1", "h2", "runs", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            columns = [batch[n].to_pylist() for n in ("anchor", "h1", "h2", "kinds")]
            for anchor, h1, h2, kinds, piece in zip(*columns, batch["piece"], strict=True):
                if anchor != last and held and size + kinds * 2 * width >= ARRAY_BYTES:
                    yield solve(held)
                    held, size = [], 0
                last = anchor
                held.append((h1, h2, piece.as_py()))
                size += len(held[-1][2])
        if held:
            yield solve(held)

    return run


def _named(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"s": s, "e": e} for s, e in runs]


def _by_hash(copies: DataFrame, width: int) -> DataFrame:
    """The same for crowded anchors: windows are told apart by 128-bit hash, and each hash has a first place."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "w", "x1", "x2"]
        for batch in batches:
            held: list[list[int]] = [[] for _ in names]
            columns = [batch[n].to_pylist() for n in ("h1", "h2")]
            for h1, h2, piece in zip(*columns, batch["piece"], strict=True):
                data = piece.as_py()
                for w in range(len(data) - width + 1):
                    x1, x2 = _split(xxhash.xxh3_128_digest(data[w : w + width]))
                    for column, v in zip(held, (h1, h2, w, x1, x2), strict=True):
                        column.append(v)
                if len(held[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names)
                    held = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names)

    each = copies.select("h1", "h2", "piece").mapInArrow(windows, "h1 long, h2 long, w long, x1 long, x2 long")
    each = each.join(copies.select("h1", "h2", F.struct("o", "first").alias("place")), ["h1", "h2"])
    twice = each.groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("seen"), F.min("place").alias("least")).where("seen > 1").drop("seen")
    hits = each.join(twice, ["x1", "x2"])

    def gathered(w: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(w)), lambda w: F.struct(w.alias("s"), (w + 1).alias("e")))

    return hits.groupBy("h1", "h2").agg(gathered(F.col("w")).alias("runs"), gathered(F.when(F.col("place") != F.col("least"), F.col("w"))).alias("later"))


# -- passages of words ---------------------------------------------------------


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_stretches(hashes: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(anchor hash, first window, windows) of the stretches of texts that stand one after another.

    ``hashes`` are those of their words, ``ends`` where each text ends. No window
    crosses an end.
    """
    h, n = hashes, 1
    for m in _MULTIPLIERS[: GRAM.bit_length() - 1]:
        h = (h[:-n] * m) ^ (h[:-n] >> np.uint64(29)) ^ h[n:]
        n *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    # The order of hashes must not depend on what is scanned together: the same bits are compared everywhere.
    anchor = _sliding_argmin((h >> np.uint64(24)) << np.uint64(24), length - GRAM + 1)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = np.flatnonzero(text[: len(text) - length + 1] == text[length - 1 :])
    cuts = np.flatnonzero((np.diff(anchor[at]) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], cuts])
    count = np.diff(np.concatenate([first, [len(at)]]))
    yield from zip(h[anchor[at[first]]].view(np.int64).tolist(), at[first].tolist(), count.tolist(), strict=True)


def _cut_words(texts: DataFrame, length: int) -> DataFrame:
    """Stretches of each text by words: hash of the anchor, hash of the words, text, first window, windows."""
    names = ["anchor", "h1", "h2", "t", "first", "windows"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def solve(held: list[tuple[bytes, int, np.ndarray]]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        hashes, ends = np.concatenate([x[2] for x in held]), np.cumsum([len(x[2]) for x in held])
        raw, begins, of, k = hashes.tobytes(), [0, *ends.tolist()], [x[:2] for x in held], 0
        for anchor, at, windows in word_stretches(hashes, ends, length):
            while at >= begins[k + 1]:
                k += 1
            h1, h2 = _split(xxhash.xxh3_128_digest(raw[8 * at : 8 * (at + windows + length - 1)]))
            for column, v in zip(out, (anchor, h1, h2, of[k][0], of[k][1] + at - begins[k], windows), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for t, data in zip(batch["t"], batch["raw"], strict=True):
                words = data.as_py().split()
                for at in range(0, len(words) - length + 1, SCAN_WORDS):
                    held.append((t.as_py(), at, _word_hashes(words[at : at + SCAN_WORDS + length - 1])))
                    size += len(held[-1][2])
                    if size >= SCAN_WORDS:
                        yield solve(held)
                        held, size = [], 0
        if held:
            yield solve(held)

    return texts.mapInArrow(run, "anchor long, h1 long, h2 long, t binary, first long, windows long")


def _word_windows(texts: DataFrame, length: int) -> DataFrame:
    """The stretches ``w`` of each text with ``xs``, the hashes of their windows."""
    names = ["anchor", "h1", "h2", "kinds", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, xs = [[] for _ in names], []
            for data, wanted in zip(batch["raw"], batch["w"], strict=True):
                raw = _word_hashes(data.as_py().split()).tobytes()
                for x in wanted.as_py():
                    places = range(8 * x["first"], 8 * (x["first"] + x["windows"]), 8)
                    found = np.fromiter((xxhash.xxh3_64_intdigest(raw[at : at + 8 * length]) for at in places), np.uint64, len(places))
                    xs.append(found.view(np.int64))
                    for column, name in zip(held, names, strict=True):
                        column.append(x[name])
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in held], pa.array(xs, pa.list_(pa.int64()))], [*names, "xs"])

    return texts.select("raw", "w").mapInArrow(run, "anchor long, h1 long, h2 long, kinds long, p long, q long, xs array<long>")


def passages(ws: Workspace, rows: DataFrame, texts: DataFrame, where: list[str], length: int) -> DataFrame:
    """(t, n_passages, n_passage_words) of the texts that share ``length`` words in a row with a different text.

    ``p`` and ``q`` are the least and the largest hash of the texts that hold
    something: it stands in two texts if they differ. Equal windows have equal
    anchors, so a window is told by two hashes. What has few kinds meets by anchor,
    one row for each stretch; the windows of a crowded one are counted everywhere.
    """
    cut = ws.put(_cut_words(rows.select("t", "raw"), length), "word-stretches")
    spot = F.xxhash64("t")
    anchors = ws.put(cut.groupBy("anchor").agg(F.min(spot).alias("p"), F.max(spot).alias("q")).where("p != q").select("anchor"), "word-anchors")
    seen = ws.put(cut.join(small(anchors), "anchor", "left_semi"), "word-seen")
    ws.drop(cut)
    # Equal stretches are one kind, of which any copy serves.
    kinds = seen.groupBy("anchor", "h1", "h2").agg(F.min(spot).alias("p"), F.max(spot).alias("q"), F.min(F.struct("t", "first", "windows")).alias("at"))
    kinds = ws.put(kinds.select("anchor", "h1", "h2", "p", "q", "at.*"), "word-kinds")
    # A kind in two texts repeats whole; where it is the only one of its anchor nothing else can.
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.expr("p = q")).alias("open")).where("kinds > 1 and open")
    place = [F.col(f"o.{c}").alias(c) for c in where]
    wanted = kinds.join(several, "anchor").groupBy("t").agg(F.collect_list(F.struct("anchor", "h1", "h2", "kinds", "first", "windows", "p", "q")).alias("w"))
    wanted = ws.put(wanted.join(texts.select("t", *place), "t").drop("t"), "word-doubtful")
    # One row of each text is read. Which ones is often small enough to be sent where what is wanted of them is not.
    held = rows.select("raw", *place).join(small(wanted.select(*where)), where, "left_semi").join(small(wanted), where)
    each = ws.put(_word_windows(held, length), "word-windows")

    def windows(of: DataFrame) -> DataFrame:
        return of.select("anchor", "h1", "h2", "p", "q", F.posexplode("xs").alias("w", "x"))

    same = Window.partitionBy("anchor", "x")
    few = windows(each.where(F.col("kinds") <= CROWD).repartition("anchor")).withColumns({"least": F.min("p").over(same), "most": F.max("q").over(same)})
    few = few.where("p = q and least != most").select("h1", "h2", "w")
    many = windows(each.where(F.col("kinds") > CROWD))
    twice = many.groupBy("anchor", "x").agg(F.min("p").alias("least"), F.max("q").alias("most")).where("least != most").select("anchor", "x")
    many = many.where("p = q").join(twice, ["anchor", "x"]).select("h1", "h2", "w")
    found = few.unionByName(many).groupBy("h1", "h2").agg(F.collect_list("w").alias("hits"))
    marks = kinds.select("h1", "h2", (F.col("p") != F.col("q")).alias("whole")).join(found, ["h1", "h2"], "left").where("whole or hits is not null")

    span = lambda s, e: F.struct((F.col("first") + s).alias("s"), (F.col("first") + e + length - 1).alias("e"))
    runs = F.when(F.col("whole"), F.array(span(F.lit(0), F.col("windows")))).otherwise(F.transform("hits", lambda w: span(w, w + 1)))
    # A text with copies is a passage as a whole; here each of its stretches would come once for every copy.
    alone = seen.join(small(ws.put(texts.where("copies > 1").select("t"), "word-copied")), "t", "left_anti")
    by_text = alone.join(marks, ["h1", "h2"]).groupBy("t").agg(F.array_sort(F.flatten(F.collect_list(runs))).alias("runs"))
    # Ascending spans that overlap or touch are one passage.
    none = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in (("n", 0), ("words", 0), ("end", -1))])

    def add(total: Column, r: Column) -> Column:
        return F.struct(
            (total["n"] + (r["s"] > total["end"]).cast("long")).alias("n"),
            (total["words"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], total["end"]))).alias("words"),
            F.greatest(r["e"], total["end"]).alias("end"),
        )

    by_text = by_text.select("t", F.aggregate("runs", none, add).alias("x"))
    return ws.put(by_text.select("t", F.col("x.n").alias("n_passages"), F.col("x.words").alias("n_passage_words")), "passages")


#: Rows that are rewritten at once.
SLICE = 256


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside ascending spans."""
    parts, at = [], 0
    for s, e in spans:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their runs -> spans and the bytes left, for all copies and for later ones."""
    for whole in batches:
        for first in range(0, whole.num_rows, SLICE):
            batch = whole.slice(first, SLICE)
            lengths, out = [], [[], [], [], []]
            for data, all_, runs, later in zip(batch["raw"], batch["all"], batch["runs"], batch["later"], strict=True):
                data = data.as_py()
                own = [(0, len(data))] if all_.as_py() else merged([(r["s"], r["e"]) for r in runs.as_py()])
                late = merged([(r["s"], r["e"]) for r in later.as_py()])
                lengths.append(len(data))
                for column, v in zip(out, (_named(own), _without(data, own), _named(late), _without(data, late)), strict=True):
                    column.append(v)
            columns = [batch["key"], pa.array(lengths, pa.int64())]
            columns += [pa.array(c, k) for c, k in zip(out, (_ARROW_RUNS, pa.binary()) * 2, strict=True)]
            columns += [batch[c] for c in _SAID]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "spans", "kept", "later", "kept_first", *_SAID])


def keep_first(texts: list[bytes], width: int) -> list[bytes]:
    """A list in memory: later copies of repeated windows go, the first stays; the same as ``kept_first`` of :func:`repeats`."""
    hits = repeated_windows(texts, width, keep_first=True)
    return [_without(data, merged([(s, e + width - 1) for s, e in _runs(hit)])) for data, hit in zip(texts, hits, strict=True)]
