"""Ranking metrics, per query and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.config import EvaluationConfig


def metric_names(config: EvaluationConfig) -> list[str]:
    return [*(f"recall_at_{k}" for k in config.recall_k), *(f"hit_at_{k}" for k in config.recall_k), f"mrr_at_{config.mrr_k}", f"ndcg_at_{config.ndcg_k}"]


def _ideal(n: Column, k: int) -> Column:
    """The gain of min(n, k) relevant rows at the top."""
    gains = F.array(*[F.lit(0.0)], *[F.lit(1.0) / F.log2(F.lit(float(i + 1))) for i in range(1, k + 1)])
    return F.aggregate(F.slice(gains, F.lit(1), F.least(n, F.lit(k)).cast("int") + 1), F.lit(0.0), lambda s, g: s + g)


def per_query(ranking: DataFrame, relevant: DataFrame, config: EvaluationConfig = EvaluationConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """query_id (and ``keys``, columns of the ranking such as the mode) with one column for each metric.

    ``ranking``: query_id, chunk_id, rank; ``relevant``: query_id, chunk_id. Queries without relevant chunks score 0.
    """
    wanted = relevant.select("query_id", "chunk_id").distinct()
    count = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = ranking.select("query_id", *keys, "chunk_id", "rank").join(wanted.withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "left").join(count, "query_id", "left")
    hit, rank, n = F.coalesce("hit", F.lit(False)), F.col("rank"), F.coalesce("n", F.lit(0))

    def within(k: int) -> Column:
        return hit & (rank <= k)

    gain = F.sum(F.when(within(config.ndcg_k), 1.0 / F.log2(rank + 1)).otherwise(0.0))
    grouped = rows.groupBy("query_id", *keys).agg(
        F.max(n).alias("n"), *[F.countDistinct(F.when(within(k), F.col("chunk_id"))).alias(f"found_{k}") for k in config.recall_k],
        F.min(F.when(within(config.mrr_k), rank)).alias("first"), gain.alias("gain"),
    )
    return grouped.select(
        "query_id", *keys,
        *[F.when(F.col("n") > 0, F.col(f"found_{k}") / F.col("n")).otherwise(0.0).alias(f"recall_at_{k}") for k in config.recall_k],
        *[F.when(F.col(f"found_{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in config.recall_k],
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias(f"mrr_at_{config.mrr_k}"),
        F.when(F.col("n") > 0, F.col("gain") / _ideal(F.col("n"), config.ndcg_k)).otherwise(0.0).alias(f"ndcg_at_{config.ndcg_k}"),
    )


def summarize(metrics: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Means of the metrics for each combination of ``by``."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("query_count"), *means)


def summarize_levels(metrics: DataFrame, names: list[str], mode: str = "mode", language: str = "language") -> DataFrame:
    """Means per mode and per mode and language in one pass; the language of the overall rows is null."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names]
    return metrics.groupingSets([[F.col(mode)], [F.col(mode), F.col(language)]], F.col(mode), F.col(language)).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("query_count"), *means)


def latency_summary(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean, exact median and 95th percentile (linear between ranks), maximum."""
    return rows.groupBy(*by).agg(F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.95)).alias("p95"), F.max(column).alias("max"))
