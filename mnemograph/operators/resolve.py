"""Resolving names to entities: exactly, by alias, by fuzzy match, by external reference.

Every way is an equi-join. A fuzzy match is containment of token sets, or a single
token that equals the other's initials. A set is looked for at its rarest token
only, which each set that holds it must have, so a frequent token is a key of no
name that has a rarer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.functions.text import initials, name_tokens, tokens_match


def name_keys(entities: DataFrame) -> DataFrame:
    """(id, seq, key): every name and alias of an entity, in lower case."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("id", "seq", F.explode(names).alias("n")).where("n is not null").select("id", "seq", F.lower("n").alias("key")).distinct()


def _first(matches: DataFrame, by: str) -> DataFrame:
    return matches.groupBy(by).agg(F.min(F.struct("seq", "id")).alias("m")).select(by, F.col("m.id").alias("id"))


def exact(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """(name, id): the first entity whose name or alias is equal, whatever case; diacritics count."""
    own = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    return _first(own.join(name_keys(entities), F.lower("name") == F.col("key")), "name")


def by_reference(refs: DataFrame, entities: DataFrame, ref: str = "external_ref") -> DataFrame:
    """(external_ref, id): the first entity of an external reference."""
    own = refs.select(F.col(ref).alias("external_ref")).where("external_ref is not null").distinct()
    return _first(own.join(entities.select("id", "seq", "external_ref"), "external_ref"), "external_ref")


def _profiles(names: DataFrame, prefix: str) -> DataFrame:
    """Distinct names with their token sets and initials; names without tokens match none."""
    own = names.select("name").distinct().select("name", name_tokens(F.col("name")).alias("t"), initials(F.col("name")).alias("i"))
    return own.where(F.size("t") > 0).select(*[F.col(c).alias(prefix + c) for c in own.columns])


def _holders(small: DataFrame, s: str, large: DataFrame, b: str) -> DataFrame:
    """Pairs of a name of ``small`` and each of ``large`` that has its rarest token; sets with a token that none has meet nothing."""
    holds = large.select(*large.columns, F.explode(f"{b}t").alias("key"))
    often = holds.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counted = small.select(*small.columns, F.explode(f"{s}t").alias("key")).join(often, "key")
    rarest = counted.groupBy(f"{s}name").agg(F.min(F.struct("n", "key")).alias("m"), F.count(F.lit(1)).alias("found"), F.first(f"{s}t").alias(f"{s}t"), F.first(f"{s}i").alias(f"{s}i"))
    return rarest.where(F.col("found") == F.size(f"{s}t")).select(*small.columns, F.col("m.key").alias("key")).join(holds, "key").drop("key")


def fuzzy_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_name, l_t, l_i, r_name, r_t, r_i): what :func:`fuzzy_pairs` compares; a pair may come more than once.

    Each name of one side meets the names of the other that hold its rarest
    token, and the other way round; single tokens meet equal initials.
    """
    a, b = _profiles(left, "l_"), _profiles(right, "r_")
    cols = [*a.columns, *b.columns]
    within = _holders(a, "l_", b, "r_").select(cols)
    around = _holders(b, "r_", a, "l_").select(cols)
    short = a.where(F.size("l_t") == 1).join(b.where("r_i <> ''"), F.element_at("l_t", 1) == F.col("r_i")).select(cols)
    long_ = b.where(F.size("r_t") == 1).join(a.where("l_i <> ''"), F.element_at("r_t", 1) == F.col("l_i")).select(cols)
    return within.unionByName(around).unionByName(short).unionByName(long_)


def fuzzy_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_name, r_name): pairs of names, each frame with a column ``name``, that match; each once."""
    match = tokens_match(F.col("l_t"), F.col("l_i"), F.col("r_t"), F.col("r_i"))
    return fuzzy_candidates(left, right).where(match).select("l_name", "r_name").distinct()


def fuzzy(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """(name, id): the first entity of which a name or alias matches."""
    known = entities.select("id", "seq", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    pairs = fuzzy_pairs(names.select(F.col(name).alias("name")), known.select("name"))
    return _first(pairs.join(known.withColumnRenamed("name", "r_name"), "r_name").withColumnRenamed("l_name", "name"), "name")


def resolve(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """(name, id, how): exact first, fuzzy for the rest; names that match nothing have a null id."""
    own = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    hit = exact(own, entities).withColumn("how", F.lit("exact"))
    rest = own.join(hit.select("name"), "name", "left_anti")
    both = hit.unionByName(fuzzy(rest, entities).withColumn("how", F.lit("fuzzy")))
    return own.join(both, "name", "left")
