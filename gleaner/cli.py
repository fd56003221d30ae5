"""Command line: index, search, evaluate, ask, doctor. Exit codes: 0 well, 1 something missing (doctor), 2 an error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import Config
from gleaner.operators.answer import answer_one
from gleaner.operators.topk import compact
from gleaner.plans.retrieval import MODES, Retriever, evaluate, validated
from gleaner.session import local_session
from gleaner.sinks.writers import write_json_lines, write_report
from gleaner.sources.files import checked_json_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner", description="Search a chunk corpus.")
    p.add_argument("--config", help="YAML file of settings; without one the defaults hold")
    p.add_argument("--chunks", default="data/chunks", help="chunks: a Parquet folder, or JSON lines (.jsonl)")
    p.add_argument("--cores", default="*")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index", help="build and count the indexes")
    for name in ("search", "ask"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--mode", choices=MODES, default="hybrid")
        s.add_argument("--top-k", type=int, default=0)
    sub.choices["ask"].add_argument("--llm", choices=("auto", "never", "required"), default="auto")
    e = sub.add_parser("evaluate")
    e.add_argument("--queries", required=True, help="query_id, query, language, relevant_chunk_ids: Parquet, or JSON lines (.jsonl)")
    e.add_argument("--modes", nargs="+", choices=MODES, default=list(MODES))
    e.add_argument("--output", required=True, help="the report, JSON")
    e.add_argument("--details", help="a folder for a row of each question and mode, JSON lines")
    sub.add_parser("doctor", help="check that the corpus is there")
    return p


CHUNK = "chunk_id string, document_id string, source_id string, title string, text string, page_start int, page_end int, section_path array<string>, source_page string, language string, content_sha256 string"
QUESTION = "query_id string, query string, language string, source_id string, relevant_chunk_ids array<string>"


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return checked_json_lines(spark, path, schema) if path.endswith(".jsonl") else spark.read.parquet(path)


def run(args: argparse.Namespace) -> int:
    if args.command == "doctor":
        there = os.path.exists(args.chunks)
        print(json.dumps({"chunks": args.chunks, "found": there}))
        return 0 if there else 1
    spark = local_session(args.cores)
    chunks = validated(table(spark, args.chunks, CHUNK))
    config = Config.read(args.config) if args.config else Config()
    retriever = Retriever(chunks, config)
    if args.command == "index":
        print(json.dumps({k: v for k, v in retriever.lexical.stats.first().asDict().items()} | {"embeddings": retriever.embeddings.count()}))
    elif args.command == "search":
        found = retriever.search(spark.createDataFrame([(0, args.query)], "query_id int, query string"), args.mode, args.top_k)
        shown = found.orderBy("rank").select("rank", F.round("score", 6).alias("score"), "chunk_id", "title", compact(F.col("text")).alias("preview"))
        print(json.dumps([r.asDict() for r in shown.collect()], ensure_ascii=False, indent=2))  # top_k rows at most
    elif args.command == "ask":
        found = retriever.search(spark.createDataFrame([(0, args.query)], "query_id int, query string"), args.mode, args.top_k)
        print(json.dumps(answer_one(args.query, found, mode=args.llm), ensure_ascii=False, indent=2, default=str))
    else:
        queries = table(spark, args.queries, QUESTION)
        report, rows = evaluate(retriever, queries, queries.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id")), tuple(args.modes))
        write_report(args.output, report)
        if args.details:
            write_json_lines(rows, args.details)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (ValueError, OSError, RuntimeError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
