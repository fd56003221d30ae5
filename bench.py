"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is timed as a whole, indexes included. Searching an index that is there, as the baseline does, is timed apart: for the questions of
the benchmark table and, since a batch has a fixed cost, for all turns of users too.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from gleaner.config import Config  # noqa: E402
from gleaner.operators.fusion import fuse, rerank  # noqa: E402
from gleaner.operators.lexical import bm25_search, build_index  # noqa: E402
from gleaner.plans import catalog  # noqa: E402
from gleaner.session import cut, local_session  # noqa: E402

HEADLINE = ("bm25_topk", "dense_topk", "hybrid_topk", "rerank_topk", "chunk_documents", "tokenize_documents", "bind_questions", "extractive_answers", "ir_metrics_per_query", "page_blocks")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, 8, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    # the session and its Python workers are up before the clock starts
    spark.range(1000).repartition(int(cores)).mapInArrow(lambda batches: batches, "id long").groupBy().sum().collect()
    queries, seconds = catalog.queries(), {}

    def timed(name, df):
        began = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: queries[name](spark, folder))
    whole = round(sum(seconds.values()), 3)

    r, chunks, asked = Config().retrieval, catalog._chunks(spark, folder), catalog._questions(spark, folder)
    turns = spark.read.parquet(f"{folder}/conversations.parquet").filter("role = 'user'").select(F.xxhash64("conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    began = time.perf_counter()
    index = build_index(chunks)
    seconds["bm25_index"] = round(time.perf_counter() - began, 3)
    timed("bm25_search", lambda: bm25_search(index, asked, r.final_top_k))
    timed("bm25_search_turns", lambda: bm25_search(index, turns, r.final_top_k))
    fused = lambda: fuse([bm25_search(index, asked, r.candidate_k), catalog._dense(spark, folder, r.candidate_k)], r.hybrid_top_k, r.rrf_k)
    timed("hybrid_search", fused)
    ready = cut(fused(), "bench-fused")
    timed("rerank_search", lambda: rerank(ready.filter(F.col("rank") <= r.rerank_candidates), asked, chunks, r.final_top_k))
    n, m = max(asked.count(), 1), max(turns.count(), 1)
    ms = {"bm25": seconds["bm25_search"] / n, "bm25_turns": seconds["bm25_search_turns"] / m, "dense": seconds["dense_topk"] / n, "hybrid": seconds["hybrid_search"] / n, "rerank": (seconds["hybrid_search"] + seconds["rerank_search"]) / n}
    per_query = {f"{k}_ms_per_query": round(1000 * v, 2) for k, v in ms.items()}
    print(json.dumps({"metric": "headline_total", "value": whole, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "questions": n, "turns": m, **per_query}))
    spark.stop()


if __name__ == "__main__":
    main()
