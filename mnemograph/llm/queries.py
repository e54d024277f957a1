"""The registered queries of this subpackage, each over its whole table.

Every query is thin: it reads the table, applies its operator with production
parameters and derives the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_SHARDS = 24


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    from mnemograph.llm.packing import pack

    docs = _read(spark, sf_dir, "documents")
    return pack(docs, "doc_id", "text", vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), end=2, capacity=1024)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings of 400 or more that repeat anywhere in all documents, removed; with the first copies kept; and passages of over 50 words."""
    from mnemograph.llm.suffixes import repeats

    left = repeats(_read(spark, sf_dir, "documents"), "doc_id", "text", width=400, passage=51)
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("repeats"),
        (F.col("n_bytes") - F.octet_length("kept_first")).cast("long").alias("n_removed_later"),
        F.size("later").cast("long").alias("n_spans_later"),
        F.sha2("kept_first", 256).alias("kept_first_sha256"),
        "n_passages",
        "n_passage_words",
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their duplicate lines."""
    from mnemograph.llm.lines import dedup_lines

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, "doc_id", "text").select("doc_id", "n_lines", "n_kept", "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, by text and by metadata."""
    from mnemograph.llm.quality import classify

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = classify(docs, labels, "doc_id", "text", ("lang", "source", "n_chars"), "quality")
    return scored.select("doc_id", "quality_score", "quality_score_text", "quality_score_facts", (F.col("quality_score") >= 0.5).alias("kept"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards, law ``rows``."""
    from mnemograph.llm.sharding import uniform_shards

    docs = _read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return uniform_shards(docs, N_SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the public 32k piece model, and the digest of the text decoded from them."""
    from mnemograph.llm import pieces

    docs = _read(spark, sf_dir, "documents")
    model = vocabulary("piece_bpe_32k.model")
    return pieces.encode(docs, "doc_id", "text", model, with_text=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from mnemograph.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, max_distance=3)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of all embeddings, within labels."""
    from mnemograph.llm.embeddings import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", threshold=0.93)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, plain and disguised, in all documents."""
    from mnemograph.llm.pii import scan

    return scan(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as Ogg and read back."""
    from mnemograph.llm.media import read_media, to_media

    return read_media(to_media(_read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole vectors in 40 clusters by five rounds of plain Lloyd."""
    from mnemograph.llm.centroids import cluster

    out = cluster(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", size=64, k=40, rounds=5, seed=2)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors, with some labels made wrong first."""
    from mnemograph.llm.negatives import mine

    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").withColumn("label", wrong)
    return mine(rows, F.col("vec_id") % 100 == 0, "vec_id", "embedding", "label")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source, as much as there is; and the half of that as a nested mix."""
    from mnemograph.llm.mixing import mix

    out = mix(_read(spark, sf_dir, "documents"), "doc_id", "text", "source", shares=(1.0, 0.5))
    return out.select("doc_id", "size", "source_size", F.get("targets", F.lit(0)).alias("target"), F.get("takes", F.lit(0)).alias("taken"), F.get("takes", F.lit(1)).alias("taken_half"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash": op2_simhash,
    "op3_embeddings": op3_embeddings,
    "op4_pii": op4_pii,
    "op5_ogg": op5_ogg,
    "op6_packing": op6_packing,
    "op7_suffixes": op7_suffixes,
    "op8_lines": op8_lines,
    "op10_quality": op10_quality,
    "op9_sharding": op9_sharding,
    "op11_centroids": op11_centroids,
    "op12_negatives": op12_negatives,
    "op13_mixing": op13_mixing,
}



def _lloyd_sql(rounds: int) -> str:
    """The rounds as one CTE each: nearest centroids, and floors of their means."""
    near = "SELECT w.id, c.n, list_sum(list_transform(list_zip(w.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM w, {c} c"
    parts = [
        """w AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM w ORDER BY h LIMIT 40))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT id, n, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, n) AS k FROM ({near.format(c=f'c{i}')})) WHERE k = 1)")
        if i < rounds:
            parts.append(
                f"""s{i} AS (SELECT n, list(m ORDER BY p) AS v FROM (SELECT n, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
                FROM (SELECT n, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i} JOIN w USING (id)) GROUP BY n, p) GROUP BY n),
                c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(s.v, c.v) AS v FROM c{i} c LEFT JOIN s{i} s ON s.n = c.n)"""
            )
    return "WITH " + ",\n".join(parts) + (
        f"""
    SELECT vec_id, CAST(a.n AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN w USING (id) JOIN c{rounds} c ON c.n = a.n"""
    )


#: Only what SQL can say on whole tables: the others need hashes, models, media or draws that SQL does not have.
ORACLE_SQL: dict[str, str] = {
    "op3_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
    reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.c),
    own AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
    number AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = id AS kept FROM own LEFT JOIN number ON a = id""",
    "op11_centroids": _lloyd_sql(5),
    "op12_negatives": """WITH r AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
    p AS (SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score, k FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.row, p.k ORDER BY s.score DESC, s.vec_id) AS nth
        FROM p JOIN s ON s.row = p.row AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
    SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE nth <= 5""",
    "op13_mixing": """WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source),
    share AS (SELECT unnest([1.0::DOUBLE, 0.5::DOUBLE]) AS share), total AS (SELECT share, sum(source_size) * share AS total FROM s, share GROUP BY share),
    -- A round: what the capped leave, for each unit of weight.
    round(share, n, each) AS (SELECT share, 0, total::DOUBLE / (SELECT sum(weight) FROM s)::DOUBLE FROM total
        UNION SELECT r.share, r.n + 1, (SELECT (any_value(t.total) - coalesce(sum(CASE WHEN r.each * weight > 3 * source_size THEN 3 * source_size END), 0))::DOUBLE
            / sum(CASE WHEN r.each * weight > 3 * source_size THEN NULL ELSE weight END)::DOUBLE FROM s, total t WHERE t.share = r.share) FROM round r WHERE r.n < 12),
    aims AS (SELECT s.*, r.share, CASE WHEN each * weight > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE each * weight END AS target FROM s, round r WHERE r.n = 12),
    budget AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3, floor(target / source_size)) AS BIGINT) ELSE 0 END AS whole FROM aims),
    run AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) ROWS UNBOUNDED PRECEDING) - size AS before FROM d),
    got AS (SELECT r.*, b.share, b.source_size, b.target, size * (whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS taken
        FROM run r JOIN budget b ON b.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, size, any_value(source_size) AS source_size, max(CASE WHEN share = 1 THEN target END) AS target, CAST(max(CASE WHEN share = 1 THEN taken END) AS BIGINT) AS taken,
    CAST(max(CASE WHEN share < 1 THEN taken END) AS BIGINT) AS taken_half FROM got GROUP BY doc_id, size""",
}
