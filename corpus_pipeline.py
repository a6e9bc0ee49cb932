"""A pass over a corpus: toxic documents out, one of each group of near duplicates, secrets out of the texts, sources
mixed to their weights, tokens. Each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, minhash, mixing, secrets, toxicity
from tracewell.llm.catalog import bpe_digest, vocabulary
from tracewell.llm.shared import crc_remainder, settled


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labelled ones outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train(docs, labels, crc_remainder(F.col("doc_id")) != 1))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group whose texts share 0.8 or more of their five-word shingles, over links."""
    return minhash.kept(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redacted(docs, secrets.train(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    docs = mixing.keyed(docs)
    return mixing.mixed(docs, settled(spark, lambda: mixing.pareto_mix(docs).select(mixing.KEY, "copies"), "mix-copies"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of the decoded text."""
    path = vocabulary("word_bpe_49k.json")
    return bpe_digest(bpe.encode_decode(docs, path, bpe.build_lexicon(docs, path)), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mix", mixed_sources),
    ("tokens", encoded),
]

#: SQL can express neither the trained models nor the sampling; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
    return docs
