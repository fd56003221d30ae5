"""Bind questions to the chunks that answer them, rank all chunks for all questions, and score the rankings.

    python -m jobs.retrieval_evaluation --corpus TABLE --questions TABLE --output FOLDER [--config FILE]

Under the output folder:

* ``questions`` (status): each question with the chunks that hold its text (four at most, the shortest first); ``unbound`` ones have none;
* ``details`` (mode, language): one row for each bound question and mode: metrics, ranked and relevant chunk ids, the first result's source.
  A question's language is that of its primary chunk;
* ``summary`` (mode): means of the metrics of a mode, and of each language in it.

A run replaces these tables, so it can be repeated after any failure with the same result. Times go to the log, not to the
tables. Questions without a text or an id are left out and counted; a repeated chunk or question id is an error.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleaner.config import EvaluationConfig
from gleaner.operators import binding, metrics
from gleaner.operators.fusion import rerank
from gleaner.operators.lexical import bm25_search, build_index
from gleaner.plans.retrieval import details, validated
from gleaner.session import cut, ship
from jobs.common import HERE, logger, read_config

DEFAULT_CONFIG = HERE / "retrieval_evaluation.toml"
MODES = ("bm25", "rerank")
QUESTION = "query_id string, query string, language string, relevant_chunk_ids array<string>, primary_chunk_id string, status string"
log = logger("retrieval_evaluation")


def corpus_of(rows: DataFrame, c: dict) -> DataFrame:
    """The corpus as chunks: ids as text, one chunk a row."""
    none = F.lit(None).cast("int")
    named = [F.col(f"`{c[n]}`").cast("string").alias(n) for n in ("chunk_id", "document_id", "source_id", "title", "language", "text")]
    return rows.select(*named, none.alias("page_start"), none.alias("page_end"), F.array().cast("array<string>").alias("section_path"), F.lit(0).alias("chunk_index"), F.length(F.col(f"`{c['text']}`")).alias("character_count"))


def bound_questions(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of QUESTION: every question with the chunks that hold it, whatever their source."""
    anywhere = chunks.withColumn("source_id", F.lit(""))
    bound = binding.bind(questions.select(F.col("query_id").alias("id"), F.array("query").alias("evidence_terms")), anywhere)
    spoken = chunks.select(F.col("chunk_id").alias("primary_chunk_id"), "language")
    found = questions.join(bound.select("query_id", "relevant_chunk_ids", "primary_chunk_id"), "query_id", "left").join(spoken, "primary_chunk_id", "left")
    return found.select("query_id", "query", "language", "relevant_chunk_ids", "primary_chunk_id", F.when(F.col("primary_chunk_id").isNull(), "unbound").otherwise("bound").alias("status"))


def ranked(chunks: DataFrame, questions: DataFrame, modes: list[str], depth: int, candidates: int) -> DataFrame:
    """mode, query_id, chunk_id, rank: the best ``depth`` chunks of each question in each mode."""
    index = build_index(chunks)
    first = cut(bm25_search(index, questions, max(depth, candidates)), "evaluation-ranking")
    found = []
    for mode in modes:
        began = time.perf_counter()
        rows = first if mode == "bm25" else rerank(first.filter(F.col("rank") <= candidates), questions, chunks, depth)
        rows = cut(rows.filter(F.col("rank") <= depth).select(F.lit(mode).alias("mode"), "query_id", "chunk_id", F.col("rank").cast("int").alias("rank")), "evaluation-ranking")
        log.info("mode %s: %.1f s", mode, time.perf_counter() - began)
        found.append(rows)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def run(spark: SparkSession, corpus: str, questions: str, output: str, config: dict | None = None) -> dict:
    """Evaluate, and return the counts that are logged."""
    config = config or read_config(DEFAULT_CONFIG)
    e = config["evaluation"]
    if unknown := set(e["modes"]) - set(MODES):
        raise ValueError(f"unknown modes {sorted(unknown)}")
    ship(spark)
    log.info("reading %s and %s, writing %s", corpus, questions, output)
    chunks = validated(corpus_of(spark.read.parquet(corpus), config["corpus"]).filter("chunk_id IS NOT NULL"))
    q, seen = config["questions"], Observation()
    asked = spark.read.parquet(questions).select(F.col(f"`{q['query_id']}`").cast("string").alias("query_id"), F.col(f"`{q['query']}`").cast("string").alias("query"))
    usable = F.col("query_id").isNotNull() & (F.length(F.trim(F.coalesce("query", F.lit("")))) > 0)
    asked = cut(asked.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(usable).alias("usable")).filter(usable), "evaluation-questions")
    if repeated := asked.groupBy("query_id").count().filter("count > 1").first():
        raise ValueError(f"duplicate query id {repeated.query_id}")
    to = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{output}/{name}")
    to(bound_questions(asked, chunks), "questions", "status")
    everyone = spark.read.schema(QUESTION).parquet(f"{output}/questions")
    bound = everyone.filter("status = 'bound'")
    settings = EvaluationConfig(tuple(e["recall_k"]), e["mrr_k"], e["ndcg_k"])
    ranking = ranked(chunks, bound.select("query_id", "query"), e["modes"], settings.deepest, e["candidates"])
    rows, counted = details(ranking, bound, chunks, settings), Observation()
    to(rows.observe(counted, F.count(F.lit(1)).alias("rows")), "details", "mode", "language")
    done = spark.read.schema(rows.schema).parquet(f"{output}/details")
    to(metrics.summarize_levels(done, metrics.metric_names(settings)), "summary", "mode")
    counts = {"questions": seen.get["read"], "unusable": seen.get["read"] - seen.get["usable"], "bound": bound.count(), "details": counted.get["rows"]}
    log.info("read %(questions)d questions (%(unusable)d unusable), bound %(bound)d, wrote %(details)d details", counts)
    return counts


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Evaluate retrieval on a corpus and a table of questions.")
    p.add_argument("--corpus", required=True)
    p.add_argument("--questions", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config", default=DEFAULT_CONFIG)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("retrieval evaluation").getOrCreate()
    try:
        run(spark, args.corpus, args.questions, args.output, read_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
