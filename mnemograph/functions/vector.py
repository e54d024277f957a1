"""Vector similarity and mean-of-word-vectors embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.functions.text import STOPWORDS, tokens

#: Below this share of known content words a query's vector is not trusted.
COVERAGE = 0.5


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 for empty vectors or unequal lengths. Unit vectors make it the cosine."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    odd = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b))
    return F.when(odd, F.lit(0.0)).otherwise(F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def coverage(text: Column, known: Column) -> Column:
    """Share of content words, repeats counted, that are in the array ``known``; 1 for a text of stopwords only, 0 without words."""
    words = tokens(text)
    content = F.filter(words, lambda t: ~t.isin(STOPWORDS))
    share = F.size(F.filter(content, lambda t: F.array_contains(known, t))) / F.size(content)
    return F.when(F.size(words) == 0, 0.0).when(F.size(content) == 0, 1.0).otherwise(share)


def embed(texts: DataFrame, word_vectors: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, embedding, coverage): unit mean of the vectors of a text's known words, repeats and stopwords included.

    ``word_vectors`` is (word, vec); a word that it lacks is unknown. No known
    word gives an empty vector, no words coverage 0 as well. Words join their
    vectors, and one aggregate takes the counts and a sum in double precision for
    each component; how many there are is read from ``word_vectors`` at once.
    """
    words = texts.select(F.col(key).alias("k"), F.explode(tokens(F.col(text))).alias("word"))
    words = words.withColumn("content", ~F.col("word").isin(STOPWORDS))
    hit = words.join(word_vectors.select("word", "vec"), "word", "left")
    size = word_vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    sums = F.array(*[F.sum(F.get("vec", F.lit(i)).cast("double")) for i in range(max(size, 0))]).cast("array<double>")
    own = hit.groupBy("k").agg(
        F.count("vec").alias("resolved"),
        F.count_if("content").alias("content"),
        F.count_if(F.col("content") & F.col("vec").isNotNull()).alias("known"),
        F.filter(sums, lambda x: x.isNotNull()).alias("s"),
    )
    out = texts.select(F.col(key).alias("k")).join(own, "k", "left")
    mean = F.transform("s", lambda x: x / F.col("resolved"))
    out = out.withColumn("m", mean).withColumn("norm", F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x)))
    unit = F.when(F.col("norm") > 0, F.transform("m", lambda x: (x / F.col("norm")).cast("float"))).otherwise(F.transform("m", lambda x: x.cast("float")))
    share = F.when(F.col("content").isNull(), 0.0).when(F.col("content") == 0, 1.0).otherwise(F.col("known") / F.col("content"))
    return out.select(F.col("k").alias(key), F.coalesce(unit, F.array().cast("array<float>")).alias("embedding"), share.alias("coverage"))
