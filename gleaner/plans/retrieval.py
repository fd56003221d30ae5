"""Retrieval modes as plans over tables of queries, and their evaluation."""

from __future__ import annotations

import platform
import time
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import Config, EvaluationConfig
from gleaner.operators import metrics
from gleaner.operators.dense import Encoder, HashingEncoder, dense_search, encode, passage
from gleaner.operators.fusion import PairScorer, fuse, rerank
from gleaner.operators.lexical import Bm25Index, bm25_search, build_index
from gleaner.operators.topk import with_payload
from gleaner.session import cut, union_all

MODES = ("bm25", "dense", "hybrid", "rerank")


def validated(chunks: DataFrame) -> DataFrame:
    """The chunks, or an error if there are none or an id is repeated."""
    if chunks.isEmpty():
        raise ValueError("chunk corpus is empty")
    if repeated := repeated_ids(chunks).first():
        raise ValueError(f"duplicate chunk id {repeated.chunk_id}")
    return chunks


def repeated_ids(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


class Retriever:
    """The lexical index is written when first used, embeddings are a plan until ``prepare`` keeps them."""

    def __init__(self, chunks: DataFrame, config: Config = Config(), encoder: Encoder | None = None, scorer: PairScorer | None = None, embeddings: DataFrame | None = None):
        self.chunks, self.config, self.encoder, self.scorer, self._given = chunks, config, encoder or HashingEncoder(), scorer, embeddings

    @cached_property
    def lexical(self) -> Bm25Index:
        return build_index(self.chunks, config=self.config.bm25)

    @cached_property
    def embeddings(self) -> DataFrame:
        return self._given if self._given is not None else encode(passage(self.chunks), self.encoder, "chunk_id", "passage", self.encoder.passage_prefix)

    def prepare(self, mode: str) -> float:
        """Make what a mode needs; seconds taken. What an earlier mode made is there already."""
        began = time.perf_counter()
        if mode != "dense":
            _ = self.lexical
        if mode != "bm25" and self._given is None:
            self._given = cut(self.embeddings, "dense-index")
            self.__dict__.pop("embeddings", None)
        return time.perf_counter() - began

    def rank(self, queries: DataFrame, mode: str = "hybrid", k: int | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank, stage (hybrid: component_ranks; rerank: pre_rerank_rank) for all queries (query_id, query)."""
        if mode not in MODES:
            raise ValueError(f"unknown retrieval mode {mode!r}")
        r = self.config.retrieval
        k = k or r.final_top_k
        if mode == "bm25":
            return bm25_search(self.lexical, queries, k)
        asked = encode(queries, self.encoder, "query_id", "query", self.encoder.query_prefix) if mode != "bm25" else None
        if mode == "dense":
            return dense_search(self.embeddings, asked, k)
        fused = fuse([bm25_search(self.lexical, queries, r.candidate_k), dense_search(self.embeddings, asked, r.candidate_k)], r.hybrid_top_k, r.rrf_k)
        if mode == "hybrid":
            return fused.filter(F.col("rank") <= k)
        return rerank(fused.filter(F.col("rank") <= r.rerank_candidates), queries, self.chunks, k, self.scorer)

    def timed(self, queries: DataFrame, mode: str, k: int) -> tuple[DataFrame, dict[str, float]]:
        """``rank``, written stage by stage, and the seconds that each stage took for all queries together."""
        r, seconds = self.config.retrieval, {}

        def done(stage: str, rows: DataFrame) -> DataFrame:
            began = time.perf_counter()
            rows = cut(rows, f"evaluation-{stage}")
            seconds[stage] = time.perf_counter() - began
            return rows

        wide = mode in ("hybrid", "rerank")
        parts = []
        if mode != "dense":
            parts.append(done("bm25", bm25_search(self.lexical, queries, r.candidate_k if wide else k)))
        if mode != "bm25":
            asked = encode(queries, self.encoder, "query_id", "query", self.encoder.query_prefix)
            parts.append(done("dense", dense_search(self.embeddings, asked, r.candidate_k if wide else k)))
        found = parts[0]
        if wide:
            found = done("fusion", fuse(parts, r.hybrid_top_k, r.rrf_k))
        if mode == "rerank":
            found = done("rerank", rerank(found.filter(F.col("rank") <= r.rerank_candidates), queries, self.chunks, k, self.scorer))
        return found.filter(F.col("rank") <= k), seconds

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int | None = None) -> DataFrame:
        """``rank`` with the chunks' columns."""
        return with_payload(self.rank(queries, mode, k), self.chunks)


def details(ranking: DataFrame, questions: DataFrame, chunks: DataFrame, config: EvaluationConfig) -> DataFrame:
    """mode, query_id, language, the metrics, relevant and retrieved chunk ids, and the source of the first result.

    ``ranking``: mode, query_id, chunk_id, rank; ``questions``: query_id, language, relevant_chunk_ids.
    """
    relevant = questions.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    measured = metrics.per_query(ranking, relevant, config, ("mode",))
    lists = ranking.groupBy("mode", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"]).alias("retrieved_chunk_ids"))  # as deep as a ranking is
    first = ranking.filter("rank = 1").join(chunks.select("chunk_id", F.col("source_id").alias("first_result_source_id")), "chunk_id").drop("rank", "chunk_id")
    rows = measured.join(lists, ["mode", "query_id"]).join(first, ["mode", "query_id"], "left")
    return rows.join(questions.select("query_id", "language", "relevant_chunk_ids"), "query_id")


def evaluate(retriever: Retriever, queries: DataFrame, relevant: DataFrame, modes: tuple[str, ...] = MODES) -> tuple[dict, DataFrame]:
    """(report, details of every query and mode). A mode is a batch over all queries, stage by stage; a stage's seconds are divided by their number.

    ``queries``: query_id, query, language; ``relevant``: query_id, chunk_id.
    """
    config = retriever.config.evaluation
    names = metrics.metric_names(config)
    lists = relevant.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant_chunk_ids"))
    asked = queries.select("query_id", "query", "language").join(lists, "query_id", "left").withColumn("relevant_chunk_ids", F.coalesce("relevant_chunk_ids", F.array().cast(f"array<{dict(relevant.dtypes)['chunk_id']}>")))
    spoken = {r.language: r.n for r in queries.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(spoken.values())
    corpus = retriever.chunks.agg(F.count(F.lit(1)), F.countDistinct("source_id")).first()
    report = {
        "generated_at": datetime.now(UTC).isoformat(),
        "corpus": {"chunk_count": corpus[0], "source_count": corpus[1]},
        "evaluation_set": {"query_count": n, "languages": spoken},
        "models": {"embedding": retriever.encoder.name, "reranker": getattr(retriever.scorer, "name", "lexical-standin")},
        "environment": {"python": platform.python_version(), "platform": platform.platform(), "spark": queries.sparkSession.version},
        "modes": {},
        "notes": ["A mode is timed as one batch over all queries; latencies are seconds of a stage divided by the number of queries, index and embeddings not included."],
    }
    found = []
    for mode in modes:
        setup = retriever.prepare(mode)
        ranking, seconds = retriever.timed(queries.select("query_id", "query"), mode, config.deepest)
        found.append(ranking.select(F.lit(mode).alias("mode"), "query_id", "chunk_id", "rank"))
        per_query = {stage: 1000 * s / max(n, 1) for stage, s in seconds.items()}
        report["modes"][mode] = {"setup_seconds": setup, "seconds": sum(seconds.values()), "latency_ms": sum(per_query.values()), "stage_latency_ms": per_query}
    rows = cut(details(union_all(found), asked, retriever.chunks, config), "evaluation-details")
    for r in metrics.summarize_levels(rows, names).collect():  # a row for each mode and language, and one more a mode
        own = report["modes"][r["mode"]]
        if r["level"] == 1:
            own["metrics"] = {c: r[c] for c in names}
        else:
            own.setdefault("by_language", {})[r["language"]] = {c: r[c] for c in names}
    return report, rows
