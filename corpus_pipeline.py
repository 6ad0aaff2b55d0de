"""The corpus pipeline: five stages over whole tables, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import language_id, line_dedup, packing, secret_scan, simhash_links
from veldt.llm.common import forget, scratch

#: Rows that go to a Python worker at once: documents are long, and each worker and its executor hold a batch.
BATCH_ROWS = 2000
#: Documents whose language holds a smaller share of their letters are rejected.
LEAST_SHARE = 0.5


def _small_batches(spark: SparkSession) -> None:
    """The pipeline's session moves documents in small batches; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects documents without a letter and those no language holds half of; others stay unchanged.

    Null and empty texts are rejected. The model is learned from the rows of ``docs`` that aren't held out.
    """
    _small_batches(spark)
    labelled = language_id.identify(docs, language_id.train(docs))
    kept = labelled.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: boilerplate lines of each source leave the texts; n_chars follows the text. No document goes."""
    _small_batches(spark)
    done = line_dedup.drop_boilerplate(docs)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of linked documents the one with the smallest doc_id stays, unchanged."""
    _small_batches(spark)
    return simhash_links.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every found secret becomes a mask; n_chars follows the text. No document goes."""
    _small_batches(spark)
    done = secret_scan.redact(docs, secret_scan.train(docs))
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: all documents in sequences of at most 4096 tokens; one row per piece."""
    _small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_site_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Language scores, fingerprints, tagging and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is Parquet in the shared folder and read again as the next input, then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{scratch(spark)}/veldt-pipeline-{uuid.uuid4().hex}"
    paths = [f"{home}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            forget(spark, paths[k - 1])
    return docs
