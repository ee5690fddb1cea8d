"""A corpus pipeline of five stages: quality, near duplicates, secrets, mixing, SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import jaccard_join, mixing, quality, secret_scan, sentencepiece_codec
from gaugeworks.llm.queries import THRESHOLD, tokenizer
from gaugeworks.llm.shared import read_table, saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored like any other."""
    weights = quality.train(docs, read_table(spark, sf_dir, "labels"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, weights, keep=True, name=name).where(F.col(name) >= THRESHOLD).drop(name)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes their words; documents without words go."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of the mix: doc_id, n_tokens and the digests of ids and decoded text."""
    return sentencepiece_codec.digests(sentencepiece_codec.encode_texts(docs, tokenizer("piece_bpe_32k.model")))


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("secrets", mask_secrets), ("mixing", mix_sources), ("sentencepiece", encode)]

#: No stage but the secrets' patterns can be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
