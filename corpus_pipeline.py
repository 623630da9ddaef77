"""Corpus pipeline: the stages that turn raw documents into encoded training text.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the encoded rows.
A stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe_codec, jaccard_join, language_id, mixing, secret_scan
from tallyspark.llm._shared import crc_of_id, dropped, saved

#: A document stays if its language is known and at least so likely.
LEAST_LANGUAGE = 0.5
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Rows of the encoding stage's Arrow batches; paths of its tables that are still there.
ENCODED_ROWS = 250
_encoded: list[str] = []
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or letters and those whose language the model can't tell; a language that isn't given is the predicted one.

    Null, empty and blank texts go. Repeated rows stay or go together; columns beyond those of documents are left
    out, whatever their names. An empty table stays empty.
    """
    model = language_id.fit(docs, F.pmod(crc_of_id(), F.lit(4)) != 2)
    found = language_id.predict(docs.select(*COLUMNS), model).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the least doc_id.

    Null and blank texts and rows without a doc_id stay; of rows that share a doc_id the one with the least text
    does. Columns beyond those of documents are left out. An empty table stays empty.
    """
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; a changed text has its characters counted again.

    Null, empty and clean texts stay as they are, and so do all rows; repeated rows are treated alike. Columns
    beyond those of documents are left out. An empty table stays empty.
    """
    words = secret_scan.frequent_words(docs)
    forest = secret_scan.train(secret_scan.labelled_findings(spark, words=words), words)
    clean = secret_scan.redact(docs.select(*COLUMNS, F.length("text").alias("length_before")), forest, words=words)
    changed = F.length("text") != F.col("length_before")
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their target weights.

    A document comes as often as the mix takes it, rounded: up to twice, or not at all if less than half of it
    is taken. Rows that agree in doc_id, source and size come as often as the least taken of them. Null and blank
    texts have no words and go; null is a source of its own. Columns beyond those of documents are left out. An
    empty table stays empty.
    """
    taken = mixing.taken_words(docs)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    often = taken.where("size > 0").withColumn("copies", copies).groupBy("doc_id", "source", "size").agg(F.min("copies").alias("copies")).where("copies > 0")
    often = often.select(F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source"), F.col("size").alias("mixed_size"), "copies")
    size = F.regexp_count("text", F.lit(mixing.WORD)).cast("long")
    rows = docs.select(*COLUMNS).join(often, F.col("doc_id").eqNullSafe(F.col("mixed_id")) & F.col("source").eqNullSafe(F.col("mixed_source")) & (size == F.col("mixed_size")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes the ids again; a row whose ids don't give its text back fails the job.

    Null and empty texts have no ids; repeated rows are encoded alike. Columns beyond those of documents are left
    out. An empty table stays empty. The result is a table in the shared folder, written with small Arrow batches, as an
    executor's two tokenizers leave little room beside them.
    """
    found = bpe_codec.encode(docs.select(*COLUMNS), public_tokenizers.path(VOCABULARY), check=True, keep_text=False)
    return saved(found.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_tokens"), "ids"), "encoded", _encoded, ENCODED_ROWS)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: Naive Bayes, the forest and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages. Each stage's table is deleted once the next one's is written; the last one stays, as the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        made: list[str] = []
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", made)
        dropped(spark, before + _encoded)
        _encoded.clear()
        before = made
    return docs
