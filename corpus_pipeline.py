"""From raw documents to packed sequences: five stages over all documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the ``docs`` of the next. All but the last return
the columns that they were given. Personal data is masked after near-duplicates,
so texts that differ in nothing else stay as they are.

Defined cases of every stage: null and empty texts are documents like any other;
texts are read whole; repeated rows are separate rows; an empty table gives an
empty table; further columns pass through up to packing, which returns its own.
What more there is to say stands at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.llm.common import Workspace, swept
from mnemograph.llm.lines import dedup_lines
from mnemograph.llm.packing import pack
from mnemograph.llm.pii import mask
from mnemograph.llm.quality import classify
from mnemograph.llm.queries import vocabulary
from mnemograph.llm.shingles import keep_one

#: A document stays if its probability of good quality is at least this.
QUALITY = 0.5
#: Words of a shingle, and the least share of common shingles of two near copies.
SHINGLE, SIMILARITY = 5, 0.8


def _as_before(docs: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with the columns of ``docs``, the length column following the text."""
    if "n_chars" in docs.columns:
        after = after.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return after.select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Without labels of both classes none does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, "doc_id", "text").where(F.col("quality_score") >= QUALITY).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or similar lines the first occurrence stays; a null text stays null, one without lines empty."""
    return _as_before(docs, dedup_lines(docs, "doc_id", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents that of the smallest id stays. Texts without words are copies of each other."""
    return keep_one(docs, "doc_id", "text", SHINGLE, SIMILARITY).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, is replaced by its kind; a null text stays null."""
    return _as_before(docs, mask(docs, "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens; a null or empty text is one token, its end."""
    tokenizer, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    return pack(docs, "doc_id", "text", tokenizer, ranks, end=2, capacity=1024)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Most stages are beyond SQL (models, shingle components, transducers, a linear program).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again. What a stage has read or written for itself is deleted after it."""
    ws, before = Workspace(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with swept():
            docs = ws.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
