"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one occurrence per group.

Lines are normalised (lower case, white space collapsed) and equal ones are one
class. A line's fingerprint is the 64-bit SimHash of its set of words. Classes meet
in ten buckets, one for each pair of five blocks of the fingerprint: all within three
bits meet, and of those further apart the ones whose bits fall into three blocks.
What meets and differs in at most eight bits is verified by edit similarity. Of each
connected group the first occurrence stays. Many similar lines do not meet (recall 0.40
of pairs at scale 0.01): README has the figures of wider schemes.

All of it is DataFrame expressions. The bit counts of a SimHash are sums over
exploded words with three 21-bit counters in a long, one combinable aggregate.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, col, connected_components, fresh, numbered, small

#: Most differing bits of two fingerprints that share two blocks, and least edit similarity of two lines. Similar
#: lines are mostly four to eight bits apart, and fewer than one in 4,000 of those that meet by chance are so near.
MAX_BITS, SIMILARITY = 8, 0.8
#: Blocks of the fingerprint: (first bit, bits).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Counters in a long and their width: up to 1,048,575 words in a line are counted so. A line of more
#: words has at least ``VAST`` bytes; those have a counter for each bit.
LANES, WIDTH, VAST = 3, 21, 1 << 21
#: Edit distances that are sought first: near lines differ in few characters, however long they are.
NARROW = (32, 256)


#: What counts as white space within a line.
BLANKS = " \t\r\f\x0b"


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank; newlines stay. The ends are not trimmed."""
    # Most texts have none of it, and looking for fixed strings is far cheaper than the pattern. It is looked
    # for in the text as it is: a lower-cased one would be computed again for each of these tests.
    low, odd = F.lower(text), F.contains(text, F.lit("  "))
    for c in BLANKS[1:]:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(low, r"[ \t\r\f\x0b]+", " ")).otherwise(low)


#: Each packed counter c0, ..., c20 holds the bits i, i + 21 and i + 42; c21 holds bit 63.
COUNTERS = WIDTH + 1
#: One bit at the foot of each lane.
FEET = sum(1 << (WIDTH * k) for k in range(LANES))


def _spread(h: Column, i: int) -> Column:
    """The bits that counter i holds, each at the foot of its lane."""
    return F.shiftrightunsigned(h, 63) if i == WIDTH else F.shiftrightunsigned(h, i).bitwiseAND(F.lit(FEET))


def _majority(total: Column) -> Column:
    """The fingerprint: bits that are set in over half the words.

    What is missing to the top bit of a lane is added to all lanes at once, so
    that the top bit of a lane says whether its count is over half the total.
    """
    top = WIDTH - 1
    missing = F.lit((1 << top) - 1).cast("long") - F.least(F.floor(total / 2), F.lit((1 << top) - 1))
    out = F.shiftleft(F.shiftrightunsigned(F.col(f"c{WIDTH}") + missing, top).bitwiseAND(F.lit(1).cast("long")), 63)
    for i in range(WIDTH):
        over = F.shiftrightunsigned(F.col(f"c{i}") + missing * F.lit(FEET), top).bitwiseAND(F.lit(FEET))
        out = out.bitwiseOR(F.shiftleft(over, i))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_simhash(lines: DataFrame, norm: str, out: str, vast: bool = False) -> DataFrame:
    """``lines`` with ``norm`` replaced by ``out``, the SimHash of its set of blank-separated words.

    The other columns must tell the lines apart. A word counts once: else one
    that fills half a line, such as the bar of a table, decides all bits, and
    thousands of different lines share a fingerprint. ``vast`` is for lines of
    any number of words; the result is the same.
    """
    keys = [c for c in lines.columns if c != norm]
    hashed = lines.select(*keys, F.explode(F.array_distinct(F.split(norm, " "))).alias("word")).select(*keys, F.xxhash64("word").alias("h"))
    if vast:
        sums = [F.sum(F.getbit("h", F.lit(i))).alias(f"c{i}") for i in range(64)]
        bits = [F.when(F.col(f"c{i}") * 2 > F.col("words"), F.lit(_signed(1 << i))).otherwise(F.lit(0)).cast("long") for i in range(64)]
        counted = hashed.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("words"))
        return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias(out))
    sums = [F.sum(_spread(F.col("h"), i)).alias(f"c{i}") for i in range(COUNTERS)]
    counted = hashed.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("words"))
    # floor() of a quotient of longs is exact here: counts stay far below 2 ** 53.
    return counted.select(*keys, _majority(F.col("words")).alias(out))


def _block_keys(f: Column) -> Column:
    """What a fingerprint holds in each pair of blocks. Equal keys of two pairs of blocks only cost a comparison."""
    masks = [((1 << n) - 1) << a | ((1 << m) - 1) << b for (a, n), (b, m) in combinations(BLOCKS, 2)]
    return F.array(*[f.bitwiseAND(F.lit(_signed(mask))) for mask in masks])


def _near(f: Column, g: Column) -> Column:
    return F.bit_count(f.bitwiseXOR(g)) <= MAX_BITS


def _within(a: Column, b: Column, most: Column) -> Column:
    """Whether the edit distance is at most ``most``, small bounds first."""
    out = F.call_function("levenshtein", a, b, most) >= 0
    for bound in reversed(NARROW):
        out = F.when(most <= bound, F.call_function("levenshtein", a, b, most) >= 0).when(F.call_function("levenshtein", a, b, F.lit(bound)) >= 0, True).otherwise(out)
    return out


def _replaced(p: Column, q: Column) -> Column:
    """At least the edit distance of two lists of words: what it costs to replace each word by the one in its place."""

    def size(w: Column) -> Column:
        return F.coalesce(F.char_length(w), F.lit(0))

    costs = F.zip_with(p, q, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(F.greatest(size(x), size(y)) + 1))
    return F.aggregate(costs, F.lit(0), lambda total, c: total + c)


def alike(pairs: DataFrame, x: str, y: str, similarity: float) -> DataFrame:
    """The rows whose texts ``x`` and ``y``, which go, are similar: 1 - edit distance / longer length, in characters,
    reaches ``similarity``. Nothing is computed twice.

    A condition is copied into the join below it, where each use of a list of
    words splits the text again. Words that both begin with, and those that both
    end with, change no distance: it is sought between them.
    """
    w, s, m = fresh(pairs, "w", "s", "m")
    keep = [c for c in pairs.columns if c not in (x, y)]
    most = F.floor(F.greatest(F.char_length(x), F.char_length(y)) * (1 - similarity) + 1e-9).cast("int")
    one = pairs.select(*keep, x, y, _once(F.struct(F.split(x, " ").alias("p"), F.split(y, " ").alias("q"), most.alias("most"))).alias(w))
    p, q, most = F.col(f"{w}.p"), F.col(f"{w}.q"), F.col(f"{w}.most")

    def same(p: Column, q: Column) -> Column:
        """How many words both begin with."""
        unlike = F.zip_with(p, q, lambda u, v: ~u.eqNullSafe(v))
        return F.array_position(F.concat(unlike, F.array(F.lit(True))), True).cast("int") - 1

    def chars(words: Column, n: Column) -> Column:
        return F.char_length(F.array_join(F.slice(words, F.lit(1), n), " "))

    # What is null is similar already.
    ends = F.struct(same(p, q).alias("front"), same(F.reverse(p), F.reverse(q)).alias("back"))
    one = one.select(*keep, x, y, w, _once(F.when(_replaced(p, q) > most, ends)).alias(s))
    front, back = F.col(f"{s}.front"), F.col(f"{s}.back")
    back = F.least(back, F.least(F.size(p), F.size(q)) - front)
    ends = F.struct(chars(p, front).alias("front"), chars(F.reverse(p), back).alias("back"), most.alias("most"))
    one = one.select(*keep, x, y, _once(F.when(F.col(s).isNotNull(), ends)).alias(s))
    front, back = F.col(f"{s}.front"), F.col(f"{s}.back")
    between = [F.substring(F.col(t), front + 1, F.char_length(t) - front - back).alias(c) for t, c in ((x, "x"), (y, "y"))]
    one = one.select(*keep, _once(F.when(F.col(s).isNotNull(), F.struct(*between, F.col(f"{s}.most").alias("most")))).alias(m))
    a, b, most = F.col(f"{m}.x"), F.col(f"{m}.y"), F.col(f"{m}.most")
    short = F.greatest(F.char_length(a), F.char_length(b)) <= most
    return one.where(F.when(F.col(m).isNull() | short, True).otherwise(_within(a, b, most))).select(*keep)


def _verified(ws: Workspace, docs: DataFrame, where: list[str], pairs: DataFrame, places: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of line ids whose lines are similar. Only documents that hold such a line are split."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = ws.put(places.join(ids, "id").groupBy(*where).agg(F.collect_list(F.struct("id", "pos")).alias("w")), "wanted")
    held = docs.select(*where, "t").join(small(wanted), where)
    one = held.select("w", _once(F.split("t", "\n", -1)).alias("lines"))
    one = one.select(F.explode(F.transform("w", lambda x: F.struct(x["id"].alias("id"), F.get("lines", x["pos"]).alias("line")))).alias("x"))
    texts = ws.put(one.select("x.id", F.trim(normalised(F.col("x.line"))).alias("norm")), "texts")
    ta = texts.select(F.col("id").alias("a"), F.col("norm").alias("x"))
    tb = texts.select(F.col("id").alias("b"), F.col("norm").alias("y"))
    return ws.put(alike(pairs.join(ta, "a").join(tb, "b"), "x", "y", similarity).select("a", "b"), "similar")


def _once(value: Column) -> Column:
    """A value that is computed once for a row, however often it is used: a generator is never copied into its uses."""
    return F.explode(F.array(value))


def line_classes(docs: DataFrame, where: list[str]) -> DataFrame:
    """(at, f, size, n): distinct normalised lines with their first place, fingerprint, length and number.

    ``docs`` is (where, o, t). The whole text is normalised before it is split,
    so that nothing is computed again for each use of a line.
    """

    def keyed(source: DataFrame) -> DataFrame:
        split = source.select(*where, "o", F.posexplode(F.split(normalised(F.col("t")), "\n", -1)).alias("pos", "line"))
        lines = split.select(*where, "o", "pos", F.trim("line").alias("norm")).where("norm != ''")
        return lines.select(*where, "o", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), F.char_length("norm").alias("size"), "norm")

    # Lower case may take more bytes than upper case, at most three times as many.
    longest = docs.agg(F.max(F.octet_length("t"))).first()[0] or 0
    prints = keyed(docs)
    if longest * 3 < VAST:
        prints = with_simhash(prints, "norm", "f")
    else:
        vast = F.octet_length("norm") >= VAST
        prints = with_simhash(prints.where(~vast), "norm", "f").unionByName(with_simhash(prints.where(vast), "norm", "f", vast=True))
    at = F.struct(F.col("o").isNull().alias("none"), "o", *where, "pos")
    return (
        prints.groupBy("h1", "h2")
        .agg(F.min(at).alias("at"), F.first("f").alias("f"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
        .select("at", "f", "size", "n")
    )


def linked(ws: Workspace, classes: DataFrame, docs: DataFrame, where: list[str], similarity: float) -> DataFrame:
    """(node, component) of the classes, by id, that links connect.

    Classes meet in the buckets of :func:`_block_keys`. First each meets the
    most frequent class of its bucket. What that joins is one group, and only
    pairs of different groups are left to compare: those with an end outside the
    group of the bucket's most frequent class. No link is lost, and a dense
    bucket does not give all its pairs.
    """
    close = F.least("sa", "sb") >= F.greatest("sa", "sb") * similarity - 1e-6
    keyed = classes.select("id", "f", "size", "n", F.explode(_block_keys(F.col("f"))).alias("k"))
    # Two classes that meet by chance are told by the bits in which they differ, before anything is joined.
    differ = F.bit_count(F.bit_or("f").bitwiseXOR(F.bit_and("f")))
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m"), differ.alias("d")).where(f"m > 2 or (m = 2 and d <= {MAX_BITS})").select("k")
    seats = ws.put(keyed.join(small(ws.put(shared, "buckets")), "k"), "seats")
    places = classes.select("id", *[F.col(f"at.{c}").alias(c) for c in where], F.col("at.pos").alias("pos"))

    top = seats.groupBy("k").agg(F.max(F.struct("n", (-F.col("id")).alias("i"), "f", "size")).alias("top"))
    top = ws.put(top.select("k", (-F.col("top.i")).alias("b"), F.col("top.f").alias("fb"), F.col("top.size").alias("sb")), "top")
    met = seats.select("k", F.col("id").alias("a"), F.col("f").alias("fa"), F.col("size").alias("sa")).join(top, "k")
    met = met.where((F.col("a") != F.col("b")) & _near(F.col("fa"), F.col("fb")) & close)
    met = ws.put(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    first = _verified(ws, docs, where, met, places, similarity)
    groups = ws.put(connected_components(ws, first, "a", "b"), "groups").withColumnRenamed("node", "id")

    grouped = seats.join(groups, "id", "left").select("k", "id", "f", "size", F.coalesce("component", "id").alias("g"))
    grouped = ws.put(grouped, "grouped")
    tops = top.join(groups.select(F.col("id").alias("b"), "component"), "b", "left").select("k", F.coalesce("component", "b").alias("gt"))
    apart = grouped.join(tops, "k").where("g != gt").select("k", F.col("id").alias("a"), F.col("f").alias("fa"), F.col("size").alias("sa"), F.col("g").alias("ga"))
    rest = grouped.select("k", F.col("id").alias("b"), F.col("f").alias("fb"), F.col("size").alias("sb"), F.col("g").alias("gb"))
    left = apart.join(rest, (apart["k"] == rest["k"]) & (F.col("ga") != F.col("gb")) & _near(F.col("fa"), F.col("fb")) & close)
    left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    left = ws.put(left, "left")
    ws.drop(seats, grouped)
    if not left.count():
        return groups.withColumnRenamed("id", "node")
    second = _verified(ws, docs, where, left, places, similarity)
    # What these join are groups: one edge for each pair of them, and then each group's name.
    whole = _in_groups(second.select(F.col("a").alias("id"), "b"), groups, "x").select("x", F.col("b").alias("id"))
    whole = _in_groups(whole, groups, "y").select("x", "y").distinct()
    names = ws.put(connected_components(ws, whole, "x", "y"), "names").select(F.col("node").alias("g"), F.col("component").alias("name"))
    old = groups.join(names, F.col("component") == F.col("g"), "left").select(F.col("id").alias("node"), F.coalesce("name", "component").alias("component"))
    new = names.join(groups.select("id"), F.col("g") == F.col("id"), "left_anti").select(F.col("g").alias("node"), F.col("name").alias("component"))
    return old.unionByName(new)


def _in_groups(ids: DataFrame, groups: DataFrame, out: str) -> DataFrame:
    """Adds ``out``, the group of ``id``, which is its own where it has none."""
    return ids.join(groups, "id", "left").withColumn(out, F.coalesce("component", "id")).drop("component", "id")


def kept_lines(ws: Workspace, docs: DataFrame, where: list[str], similarity: float = SIMILARITY) -> DataFrame:
    """(where, kept): of each row that keeps any, the positions of the lines that are first in their group.

    ``docs`` is (where, o, t): columns that tell rows apart, an order and a text.
    The first occurrence is that of the smallest order (null comes last), then
    ``where``, then position. Blank lines are in no group.
    """
    classes = ws.put(line_classes(docs, where).withColumn("id", F.monotonically_increasing_id()), "classes")
    joined = linked(ws, classes, docs, where, similarity).withColumnRenamed("node", "id")
    member = classes.select("id", "at").join(joined, "id", "left")
    stay = member.groupBy(F.coalesce("component", "id").alias("group")).agg(F.min("at").alias("at"))
    stay = stay.select(*[F.col(f"at.{c}").alias(c) for c in where], F.col("at.pos").alias("pos"))
    return stay.groupBy(*where).agg(F.collect_list("pos").alias("kept"))


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, n_lines, n_kept, kept) for each row: which lines :func:`dedup_lines` keeps, without moving any text.

    ``kept`` are the ascending positions, from 0, of lines that are the first of
    their group; blank lines, which stay as well, are not among them. A null
    text has no lines.
    """
    ws = Workspace(docs.sparkSession)
    where = fresh(docs, "file", "nr")
    rows = numbered(ws, docs, where)
    plain = rows.select(*[F.col(c) for c in where], col(key).alias("o"), col(text).alias("t"))
    stay = kept_lines(ws, plain, where, similarity)
    breaks = F.octet_length("t") - F.octet_length(F.replace(F.col("t"), F.lit("\n"), F.lit("")))
    out = plain.select(*where, "o", F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines")).join(stay, where, "left")
    kept = F.array_sort(F.coalesce("kept", F.array().cast("array<int>")))
    return out.select(F.col("o").alias(key), "n_lines", F.size(kept).cast("long").alias("n_kept"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with duplicate lines gone from ``text``, and two longs: n_lines before and n_kept.

    Two lines link if their fingerprints agree in two of five blocks, which all
    within three bits do, and differ in at most eight bits, and their edit
    similarity in characters, at any length, reaches ``similarity``; equal
    normalised lines always do. Of each connected group the first occurrence
    stays: that of the smallest key (null comes last), then the order of the
    rows in their files.

    Defined cases: a null text stays null and has no lines; blank lines stay and
    are compared with nothing; a text whose lines all go becomes empty; repeated
    rows are separate rows, of which the first keeps its lines; lines are read
    whole. An empty table gives an empty table. Columns named n_lines or n_kept
    raise ``ValueError``; helper columns avoid every clash.
    """
    if {"n_lines", "n_kept"} & {c.lower() for c in docs.columns}:
        raise ValueError("docs already has a column n_lines or n_kept")
    ws = Workspace(docs.sparkSession)
    where = fresh(docs, "file", "nr")
    lines, kept = fresh(docs, "lines", "kept")
    rows = numbered(ws, docs, where)
    plain = rows.select(*[F.col(c) for c in where], col(key).alias("o"), col(text).alias("t"))
    stay = kept_lines(ws, plain, where, similarity).withColumnRenamed("kept", kept)
    whole = rows.select(*[col(c) for c in docs.columns], *where).join(ws.put(stay, "stay"), where, "left")
    out = whole.select(*[col(c) for c in docs.columns if c != text], F.col(kept), _once(F.split(col(text), "\n", -1)).alias(lines))
    none = F.array().cast("array<int>")
    there = F.col(lines).isNotNull()
    blank = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda p: F.btrim(F.get(F.col(lines), p), F.lit(BLANKS)) == "")
    out = out.withColumn(kept, F.when(there, F.array_sort(F.concat(F.coalesce(F.col(kept), none), blank))))
    left = F.array_join(F.transform(F.col(kept), lambda p: F.get(F.col(lines), p)), "\n")
    return out.select(
        *[left.alias(text) if c == text else col(c) for c in docs.columns],
        F.when(there, F.size(lines)).otherwise(0).cast("long").alias("n_lines"),
        F.when(there, F.size(kept)).otherwise(0).cast("long").alias("n_kept"),
    )
