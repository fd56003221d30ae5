"""The jobs as registered queries: run twice into one new folder, then read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import EvaluationConfig
from gleaner.operators.metrics import metric_names
from gleaner.plans.oracles import EVALUATED, MARKDOWN, chunks_of, squeezed
from gleaner.session import work_path
from jobs import corpus_build, retrieval_evaluation
from jobs.common import read_config

NAMES = metric_names(EvaluationConfig())


def job1_corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's latest state, and its chunks if it was accepted."""
    folder = work_path(spark, "job1")
    for _ in range(2):  # the second run finds nothing new
        corpus_build.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/corpus", f"{folder}/checkpoint")
    documents, chunks = corpus_build.current(spark, f"{folder}/corpus")
    pieces = chunks.select("document_id", "chunk_id", "chunk_index", "char_start", "char_end", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
    return documents.select("document_id", "source_id", "language", "status", "character_count", "content_sha256", "error").join(pieces, "document_id", "left")


def job2_retrieval_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All details and the summary of all modes; a summary's row has no query_id, and no language if it is of all."""
    folder = work_path(spark, "job2")
    for _ in range(2):
        retrieval_evaluation.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder, read_config(retrieval_evaluation.DEFAULT_CONFIG))
    details = spark.read.parquet(f"{folder}/details")
    summary = spark.read.parquet(f"{folder}/summary")
    rounded = [F.round(n, 9).alias(n) for n in NAMES]
    ids = lambda c: F.array_join(c, ",").alias(c)
    one = details.select("mode", "language", F.col("query_id").cast("string").alias("query_id"), F.lit(1).cast("long").alias("query_count"), ids("relevant_chunk_ids"), ids("retrieved_chunk_ids"), "first_result_source_id", *rounded)
    none = [F.lit(None).cast("string").alias(c) for c in ("query_id", "relevant_chunk_ids", "retrieved_chunk_ids", "first_result_source_id")]
    return one.unionByName(summary.select("mode", "language", "query_count", *none, *rounded))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_corpus_build, job2_retrieval_evaluation)}


JOB1 = rf"""
WITH RECURSIVE {chunks_of(squeezed(MARKDOWN))},
d AS (SELECT 'doc_' || substr(sha1(source || '::' || doc_id), 1, 20) AS document_id, doc_id, source AS source_id, lang AS language, sha256(text) AS content_sha256, length({squeezed(MARKDOWN)}) AS n FROM documents),
c AS (SELECT document_id AS doc_id, chunk_index, char_start, char_end, text FROM pieces)
SELECT d.document_id, source_id, language, CASE WHEN n >= 40 THEN 'accepted' ELSE 'rejected' END AS status, CAST(n AS INTEGER) AS character_count, content_sha256,
  CASE WHEN n < 40 THEN 'text too short: ' || n || ' characters' END AS error,
  'chk_' || substr(sha1(d.document_id || chr(31) || char_start || chr(31) || char_end || chr(31) || text), 1, 20) AS chunk_id,
  CAST(chunk_index AS INTEGER) AS chunk_index, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, sha256(text) AS text_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id AND n >= 40
"""


def oracle_sql() -> dict[str, str]:
    return {"job1_corpus_build": JOB1, "job2_retrieval_evaluation": EVALUATED}
