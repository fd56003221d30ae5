"""Rankings: the k best per query, and what a ranked row shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = ("chunk_id", "document_id", "source_id", "title", "text", "page_start", "page_end", "section_path", "source_page", "repository_policy", "license")


def top_k(scores: DataFrame, k: int, query: str = "query_id", score: str = "score", tie: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """The ``k`` rows of highest score of each query, ranked from 1, ties to the smaller id.

    The filter on the rank lets Spark keep k rows per query and task before it shuffles.
    """
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return scores.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def with_payload(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with the chunks' columns; until here only ids and scores travel."""
    there = [c for c in RESULT if c in chunks.columns]
    shown = chunks.select(*there)
    if "section_path" in there:
        shown = shown.withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>")))
    return ranking.join(shown, "chunk_id")


def compact(text: Column, size: int = 240) -> Column:
    """A one-line preview."""
    return F.translate(F.substring(text, 1, size), "\n", " ")
