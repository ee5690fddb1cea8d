"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import fill_middle, id_store, jaccard_join, license_scan, mixing, nearest, quality, secret_scan, sentencepiece_codec, source_divergence, token_count, toxicity, transport_stream
from gaugeworks.llm.shared import read_table, saved

#: A text counts as good from this score on, and as toxic from this expected severity on.
THRESHOLD, FLAGGED = 0.3, 0.2
#: The id that ends a document in the store of ids.
END = 2


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode_texts(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"), license_scan.known_licenses(spark), runs=license_scan.known_runs(spark))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read_table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    weights = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).select("doc_id", F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = toxicity.severity(docs, *toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "expected_severity", "grade", (F.col("expected_severity") >= FLAGGED).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(read_table(spark, sf_dir, "documents")))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = saved(transport_stream.to_media(read_table(spark, sf_dir, "documents")), "media")
    return transport_stream.summary(transport_stream.from_media(stored))


def op11_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return id_store.look_up(id_store.write_store(docs, tokenizer("word_bpe_49k.json"), END), docs, with_ids=False)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.summary(fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_license_scan, op3_token_count, op4_mixing, op5_quality, op6_jaccard_join, op7_nearest, op8_toxicity, op9_secret_scan, op10_transport_stream, op11_id_store, op12_fill_middle, op13_source_divergence)}

ORACLES: dict[str, str] = {"op2_license_scan": license_scan.sql(), "op6_jaccard_join": jaccard_join.sql(), "op12_fill_middle": fill_middle.sql(), "op13_source_divergence": source_divergence.sql()}
