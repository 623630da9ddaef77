"""Queries of the operators over the tables of a folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quant, bpe_codec, filter_audit, jaccard_join, jpeg_media, language_id, mixing, quality_crf, secret_scan, token_counts, token_output, url_filter, vector_code
from ._shared import crc_of_id


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_output(spark: SparkSession, folder: str) -> DataFrame:
    files = token_output.write_tokens(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.summaries(spark, files)


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality_crf.score(docs, quality_crf.fit(docs, _table(spark, folder, "labels")))


def op5_jpeg_media(spark: SparkSession, folder: str) -> DataFrame:
    return jpeg_media.describe(jpeg_media.to_jpeg(_table(spark, folder, "documents")))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    words = secret_scan.frequent_words(docs)
    return secret_scan.findings(docs, secret_scan.train(secret_scan.labelled_findings(spark, words=words), words), words=words)


def op7_additive_quantisation(spark: SparkSession, folder: str) -> DataFrame:
    return additive_quant.search(_table(spark, folder, "embeddings"), lambda i: i % 20 == 0)


def op8_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_codec.digests(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.judge(pages, rules, url_filter.site_urls(pages))


def op12_vector_code(spark: SparkSession, folder: str) -> DataFrame:
    return vector_code.compress(_table(spark, folder, "embeddings"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_mix_sources, op3_token_counts, op4_quality_crf, op5_jpeg_media, op6_secret_scan, op7_additive_quantisation, op8_bpe_codec, op9_jaccard_join, op10_language_id, op11_url_filter, op12_vector_code, op13_filter_audit)}
ORACLE: dict[str, str] = {"op2_mix_sources": mixing.ORACLE, "op11_url_filter": url_filter.ORACLE, "op12_vector_code": vector_code.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
