"""Reciprocal-rank fusion and reranking of rankings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.excerpt import excerpt, excerpt_weight, terms_of
from gleaner.operators.topk import top_k
from gleaner.session import ship


def fuse(rankings: list[DataFrame], k: int = 50, rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank, stage, component_ranks: each chunk has the sum of 1 / (rrf_k + rank) over the rankings that hold it.

    Rankings have query_id, chunk_id, rank and stage; one is free of repeated ids.
    """
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "chunk_id", "rank", "stage") for r in rankings])
    summed = rows.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "rank")))).alias("component_ranks")
    )
    return top_k(summed, k).withColumn("stage", F.lit("hybrid"))


class PairScorer(Protocol):
    name: str

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, scorer: PairScorer | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank, stage, pre_rerank_rank: the ``k`` best of the candidates by a pair scorer.

    The scorer sees the query and the title with the excerpt nearest to the query. Without one, the excerpt's lexical
    weight stands in (stage rerank, model ``lexical-standin``).
    """
    pairs = candidates.select("query_id", "chunk_id", F.col("rank").alias("pre_rerank_rank")).join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "title", "text"), "chunk_id")
    terms = terms_of(F.col("query"))
    if scorer is None:
        scored = pairs.withColumn("score", excerpt_weight(terms, F.col("text")).cast("double"))
    else:
        ship(candidates.sparkSession)
        scored = _scored(pairs.withColumn("passage", F.concat_ws("\n", "title", excerpt(terms, F.col("text")))), scorer)
    return top_k(scored.select("query_id", "chunk_id", "score", "pre_rerank_rank"), k).withColumn("stage", F.lit("rerank"))


def _scored(pairs: DataFrame, scorer: PairScorer) -> DataFrame:
    kept = pairs.select("query_id", "chunk_id", "pre_rerank_rank", "query", "passage")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer.score(list(zip(batch.column("query").to_pylist(), batch.column("passage").to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "chunk_id", "pre_rerank_rank")), pa.array(scores, "float64")], ["query_id", "chunk_id", "pre_rerank_rank", "score"])

    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes[:3])
    return kept.mapInArrow(work, f"{schema}, score double")
