"""The training-data queries, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import oracles


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import nn_descent

    return nn_descent.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import jaccard_join

    return jaccard_join.join(documents(spark, sf_dir))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import url_filter

    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import mpeg_audio

    return mpeg_audio.digests(mpeg_audio.store_texts(documents(spark, sf_dir)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import pii

    docs = documents(spark, sf_dir)
    return pii.digests(pii.find(docs, pii.fit(docs)))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import kneser_ney

    return kneser_ney.held_out_scores(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import token_counts

    return token_counts.token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from flowloom.llm import toxicity
    from flowloom.llm.common import crc_fold

    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import packing

    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import bpe

    return bpe.round_trip_digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import simhash

    return simhash.near_copies(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import vector_codes

    return vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import conversations

    return conversations.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_nn_descent, op2_ngram_jaccard, op3_url_filters, op4_mpeg_audio, op5_pii, op6_kneser_ney, op7_token_counts, op8_toxicity, op9_best_fit_packing, op10_bpe, op11_simhash, op12_vector_codes, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op12_vector_codes": oracles.VECTOR_CODES, "op13_conversation_repair": oracles.CONVERSATION_REPAIR}
