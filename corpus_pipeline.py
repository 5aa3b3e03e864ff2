"""From raw documents to token ids: the training-data operators as one pipeline of stages.

Each stage gets all rows its predecessor kept, written as Parquet in the shared folder, and all but the
last return the columns they got. A stage that loses executors is computed again from its input; no
stage reads another's lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact_dedup, mixing, ngram_join, quality
from plumbline.llm.common import shared_path, word_count


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the folder's labels, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for the case of A-Z: the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, in its order; a document that the mix repeats comes once per copy."""
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        "doc_id",
        "source",
        word_count(F.col("text")).alias("words"),
    )
    return mixing.in_mix_order(mixing.mix_sources(sized, size="words"), ["document"]).select("document.*")


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every row of the mix."""
    tokens = bpe.encode(spark, docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary_path())
    return tokens.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"
    )


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed_to_weights),
    ("BPE encoding", as_tokens),
]

# Training the classifier cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the folder's documents."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name.lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
