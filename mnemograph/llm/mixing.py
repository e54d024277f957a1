"""A mix of sources with given weights, by thresholds on a hash that histograms find.

Every document has a hash. What a source gives beyond whole repeats are the
documents whose hash is below the source's threshold. Sizes are summed by source
and by the first digit of the hash; running sums tell the one bucket that the
budget ends in, and only documents of that bucket are read for the next digit.
So nothing is sorted, and a larger budget of the same source always takes what a
smaller one takes.

Everything is a DataFrame expression; to the driver come two sums at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, col, fresh, large, numbered, small

#: Weights of sources in their order, again and again; the most that a source gives, in multiples of its size.
WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of a digit, and digits of each of the two hashes: of the key, and of the row for rows of one key.
BITS, DIGITS = 10, 6
WIDTH = BITS * DIGITS


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_hash(key: Column, seed: int) -> Column:
    """The first ``WIDTH`` bits of the MD5 of ``seed:key``; null keys are written as nothing."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.left(F.md5(name.cast("binary")), F.lit(WIDTH // 4)), 16, 10).cast("long")


def _ranked(ws: Workspace, sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0, by code point, null last.

    Sources may be many: ranges of them are numbered where they are, and only
    the sizes of the ranges meet.
    """
    by = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    ranged = ws.put(ranged, "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("part").orderBy(*by)
    placed = ranged.join(small(offsets.select("part", "before")), "part").withColumn("place", F.col("before") + F.row_number().over(within) - 1)
    return placed.drop("part", "before")


def targets(ws: Workspace, sources: DataFrame, weights: tuple[int, ...], shares: tuple[float, ...], most: int) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``share`` (its number) and ``target``, a row for each share.

    A share of all sizes is dealt by weight. A source whose part would be above
    ``most`` times its size gets that, and the rest is dealt among the others
    again, until none is above.
    """
    cycle = F.array(*map(F.lit, weights))
    weighed = ws.put(_ranked(ws, sources).withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))).drop("place"), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * most
    out = []
    for i, share in enumerate(shares):
        budget, capped, seen = total if share == 1 else total * share, F.lit(False), -1
        while True:
            # Sums over the sources that are capped so far; each round caps more of them, or is the last.
            sums = weighed.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
            left, weight, n = budget - (sums[0] or 0), sums[1] or 0, sums[2]
            if n == seen or not weight:
                break
            seen, each = n, float(left) / float(weight)
            capped = capped | (F.lit(each) * F.col("weight") > cap)
        dealt = F.lit(float(left) / float(weight) if weight else 0.0) * F.col("weight")
        out.append(weighed.select("source", "code", "source_size", F.lit(i).alias("share"), F.when(capped, cap.cast("double")).otherwise(dealt).alias("target")))
    frame = out[0]
    for more in out[1:]:
        frame = frame.unionByName(more)
    return frame


def _digit(hashes: list[Column], level: int) -> Column:
    """Digit ``level`` of the two hashes, the first ones first."""
    return F.shiftright(hashes[level // DIGITS], WIDTH - BITS * (level % DIGITS + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def _thresholds(ws: Workspace, rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(code, share, t1, t2): documents of a source whose (h1, h2) is below (t1, t2) are taken once more.

    ``rows`` is (code, size, h1, h2), ``budgets`` (code, share, rest). A
    document is taken if its middle, in the running sum by hash, is within the
    rest: the sum then ends as near to it as whole documents allow.
    """
    pending = budgets.where(F.col("rest") > 0).select("code", "share", "rest", F.lit(0).cast("long").alias("before"), *[F.lit(0).cast("long").alias(t) for t in ("t1", "t2")])
    pending = ws.put(pending, "pending")
    found = [budgets.where(F.col("rest") <= 0).select("code", "share", *[F.lit(0).cast("long").alias(t) for t in ("t1", "t2")])]
    # Documents without words change no sum.
    own = rows.where(F.col("size") > 0)
    for level in range(2 * DIGITS):
        digit = _digit([F.col("h1"), F.col("h2")], level)
        here = F.col("t1") if level < DIGITS else F.col("t2")
        # At the first level all budgets of a source share one histogram; after it each has its own bucket.
        by = ["code"] if level == 0 else ["code", "share"]
        running = Window.partitionBy("code", "share").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        sums = own.groupBy(*by, digit.alias("digit")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"))
        steps = sums.join(small(pending), by).withColumn("before", F.col("before") + F.coalesce(F.sum("sum").over(running), F.lit(0)))
        # The one bucket of each budget that the rest ends in.
        edge = ws.put(steps.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("sum"))), "edge")
        last = level == 2 * DIGITS - 1
        done = F.lit(True) if last else F.col("n") == 1
        inside = (2 * F.col("before") + F.col("sum") <= 2 * F.col("rest")).cast("long")
        shift = WIDTH - BITS * (level % DIGITS + 1)
        end = here + F.shiftleft(F.col("digit") + F.when(done, inside).otherwise(0), shift)
        moved = edge.withColumn("t1" if level < DIGITS else "t2", end)
        found.append(moved.where(done).select("code", "share", "t1", "t2"))
        if last:
            break
        pending = ws.put(moved.where(~done).select("code", "share", "rest", "before", "t1", "t2", "digit"), "pending")
        if pending.isEmpty():
            break
        inner = pending.select("code", "share", "digit")
        own = large(own.withColumn("digit", digit)).join(small(inner), [*by, "digit"])
        own = ws.put(own.select("code", "share", "size", "h1", "h2"), "boundary")
        pending = pending.drop("digit")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    shares: tuple[float, ...] = (1.0,),
    most: int = MOST,
    seed: int = 42,
) -> DataFrame:
    """key, source, size, source_size, targets and takes (one element for each of ``shares``), a row for each row of ``df``.

    A size is a number of words. ``takes`` is how many words of a document a mix
    takes: a whole number of times its size, at most ``most``. All documents of
    a source are taken the same number of times, or once more if their hash is
    below a threshold; so a mix of a smaller share is within that of a larger
    one, and the sum of a source misses its target by half a document at most.

    Defined cases: a null or empty text has no words and nothing is taken of it;
    texts are read whole; a null source is one source, the last, and not the
    empty one; rows of one key are told apart by their place in the files, so a
    key may hold any number of them, and all of one place and key go together;
    an empty table gives an empty table; if no text has words all targets are 0.
    Other columns are not read.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    if not shares or min(shares) < 0 or max(shares) > most:
        raise ValueError("shares must be between 0 and most")
    ws = Workspace(df.sparkSession)
    file, nr = fresh(df, "file", "nr")
    told = numbered(ws, df, [file, nr])
    name = col(source).cast("string")
    rows = told.select(
        col(key).alias("key"),
        name.alias("source"),
        F.when(name.isNull(), "n").otherwise(F.concat(F.lit("s"), name)).alias("code"),
        words(col(text)).alias("size"),
        key_hash(col(key), seed).alias("h1"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), col(file), col(nr)), 64 - WIDTH).alias("h2"),
    )
    rows = ws.put(rows, "rows")
    sources = rows.groupBy("code").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    aims = ws.put(targets(ws, ws.put(sources, "sources"), weights, shares, most), "targets")
    full = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    aims = aims.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    edges = _thresholds(ws, rows.select("code", "size", "h1", "h2"), aims.select("code", "share", "rest"))
    plan = aims.join(edges, ["code", "share"], "left").select("code", "source_size", F.struct("share", "target", "full", "t1", "t2").alias("b"))
    plan = ws.put(plan.groupBy("code").agg(F.first("source_size").alias("source_size"), F.sort_array(F.collect_list("b")).alias("b")), "plan")
    below = lambda b: (F.col("h1") < b["t1"]) | ((F.col("h1") == b["t1"]) & (F.col("h2") < b["t2"]))
    taken = F.transform("b", lambda b: F.col("size") * (b["full"] + F.coalesce(below(b), F.lit(False)).cast("long")))
    out = large(rows).join(small(plan), "code")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", F.transform("b", lambda b: b["target"]).alias("targets"), taken.alias("takes"))
