"""From raw documents to a tokenised, mixed training corpus: five stages, each read from the files of the one before.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``docs``; the last returns what ``op4`` returns, one row per
reading of a document in the mix.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_cnn, cotraining, mixing, shingle_copies, speculative_bpe
from plumbline.llm.common import table
from plumbline.session import shared_dir

# A document goes if its language is unknown or less sure than this.
LEAST_LANGUAGE_SCORE = 0.5
# A document goes if it is less likely good than this.
LEAST_QUALITY = 0.5
VOCABULARY = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language."""
    # The row travels as one column, so that its columns may have any names.
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    found = byte_cnn.with_language(rows, byte_cnn.train(docs), ["doc"])
    known = (F.col("lang_pred") != byte_cnn.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(known).select("doc.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views together take for good."""
    read = ["text", "lang", "source", "n_chars"]
    model = cotraining.train(docs.select("doc_id", *read), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *read)
    return cotraining.with_quality(rows, model, ["doc"]).filter(F.col("quality_score") >= LEAST_QUALITY).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the least id, nulls last.

    Candidates come from op8's SimHash index and from MinHash bands; a link is five-word shingles of Jaccard similarity 0.8 or more.
    """
    return shingle_copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per reading of a document, in training order; documents that the mix does not take go.

    A reading that ends inside a document keeps its whole text.
    """
    return mixing.mixed_readings(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every reading."""
    return speculative_bpe.token_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

# Trained models and XXH64 are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    out = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
