"""Dense retrieval: embeddings of chunks, exact search by dot product, a keyed cache.

The encoder is a plug-in. ``HashingEncoder`` stands in where no model is at hand: signed hashes of
tokens, L2-normalized; it is named as a stand-in in its results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.operators.topk import top_k
from gleaner.session import cut, ship


class Encoder(Protocol):
    name: str
    query_prefix: str
    passage_prefix: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    name, query_prefix, passage_prefix = "hashing-standin", "query: ", "passage: "

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, text in enumerate(texts):
            for word in text.casefold().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def encode(texts: DataFrame, encoder: Encoder, id_col: str, text_col: str, prefix: str = "") -> DataFrame:
    """(id, embedding) of each row; a worker encodes Arrow batches."""
    ship(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encoder.encode([prefix + (t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], [id_col, "embedding"])

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, embedding array<float>")


def passage(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.concat_ws("\n", "title", "text").alias("passage"))


def cache_key(chunks: DataFrame, encoder: Encoder, revision: str = "main") -> str:
    """Of the model and the chunks' ids and contents, whatever their order in storage."""
    row = F.sha2(F.concat_ws("\x1f", F.col("chunk_id").cast("string"), "content_sha256"), 256)
    parts = chunks.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring("h", i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 9, 17, 25, 33, 41, 49, 57)]).first()
    return hashlib.sha256("\x1f".join([encoder.name, revision, *map(str, parts)]).encode()).hexdigest()[:20]


def cached_embeddings(chunks: DataFrame, encoder: Encoder, folder: str, revision: str = "main") -> DataFrame:
    """Embeddings of ``chunks`` from ``folder`` if they are those of exactly these chunks, else made and written there."""
    spark, path = chunks.sparkSession, f"{folder}/{cache_key(chunks, encoder, revision)}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        found = spark.read.parquet(path)
        ids = chunks.select("chunk_id").withColumn("a", F.lit(1)).join(found.select("chunk_id").withColumn("b", F.lit(1)), "chunk_id", "full")
        if ids.filter("a IS NULL OR b IS NULL").isEmpty():
            return found
    encode(passage(chunks), encoder, "chunk_id", "passage", encoder.passage_prefix).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


KEPT = "chunk_id {kind}, content_sha256 string, model string, embedding array<float>, bucket int"


def refreshed_embeddings(chunks: DataFrame, encoder: Encoder, folder: str, revision: str = "main", buckets: int = 64) -> tuple[DataFrame, int]:
    """(embeddings of ``chunks``: chunk_id, embedding; how many were encoded now). ``chunks``: chunk_id, title, text, content_sha256.

    ``folder`` holds a table in folders by the hash of chunk_id. Only chunks whose id, content and model it doesn't hold are encoded, and only folders that gain
    or lose a chunk are written again (dynamic partition overwrite), so a run that breaks off is finished by the next one.
    """
    spark, kind = chunks.sparkSession, dict(chunks.dtypes)["chunk_id"]
    model, same = f"{encoder.name}@{revision}", ["chunk_id", "content_sha256"]
    path = f"{folder}/embeddings"
    try:
        there = spark.read.schema(KEPT.format(kind=kind)).parquet(path).filter(F.col("model") == model)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = spark.createDataFrame([], KEPT.format(kind=kind))
    wanted = chunks.select(*same, F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int").alias("bucket"))
    new = chunks.join(there.select(*same), same, "left_anti")
    fresh, seen = encode(passage(new), encoder, "chunk_id", "passage", encoder.passage_prefix), Observation()
    fresh = cut(fresh.observe(seen, F.count(F.lit(1)).alias("n")).join(wanted, "chunk_id").withColumn("model", F.lit(model)), "fresh-embeddings")
    gone = there.join(wanted, same, "left_anti").select("bucket")
    touched = [r.bucket for r in fresh.select("bucket").union(gone).distinct().collect()]  # ``buckets`` at most
    if touched:
        stays = there.filter(F.col("bucket").isin(touched)).join(wanted.select(*same), same, "left_semi")
        columns = [*same, "model", "embedding", "bucket"]
        rows = cut(stays.select(*columns).unionByName(fresh.select(*columns)), "embeddings")  # what is read from the folders is not what is overwritten there
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    found = spark.read.schema(KEPT.format(kind=kind)).parquet(path).filter(F.col("model") == model)
    return found.join(wanted.select(*same), same, "left_semi").select("chunk_id", "embedding"), seen.get["n"]


def dense_search(embeddings: DataFrame, queries: DataFrame, k: int, most_queries: int = 16_384) -> DataFrame:
    """query_id, chunk_id, score, rank, stage of the ``k`` largest dot products of each query.

    ``embeddings``: chunk_id, embedding; ``queries``: query_id, embedding. Queries are broadcast in blocks of
    ``most_queries`` (counted first); each task sends on its k best per query.
    """
    ship(queries.sparkSession)
    kinds = dict(embeddings.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    blocks = max(1, -(-queries.count() // most_queries))
    found = None
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").toArrow()
        sent = queries.sparkSession.sparkContext.broadcast((rows.column("query_id").to_pylist(), np.array(rows.column("embedding").to_pylist(), np.float64)))
        part = embeddings.select("chunk_id", "embedding").mapInArrow(_best(sent, k, kinds), f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k).select("query_id", "chunk_id", "score", "rank", F.lit("dense").alias("stage"))


def _best(sent, k: int, kinds: tuple[str, str]):
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = sent.value
        best: list[list[tuple[float, object]]] = [[] for _ in asked]
        for batch in batches:
            if not batch.num_rows or not asked:
                continue
            ids = batch.column("chunk_id").to_pylist()
            x = np.array(batch.column("embedding").to_pylist(), np.float64)
            for at in range(0, len(asked), 256):
                # summed in the order of the components, so that a score is the same in any batch
                scores = np.zeros((min(256, len(asked) - at), len(ids)))
                for d in range(x.shape[1]):
                    scores += q[at : at + 256, d : d + 1] * x[:, d]
                for i, row in enumerate(scores, at):
                    edge = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    near = [(-row[j], ids[j]) for j in np.flatnonzero(row >= edge).tolist()]
                    best[i] = sorted(best[i] + near)[:k]
        rows = [(asked[i], c, float(-s)) for i, own in enumerate(best) for s, c in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow[kinds[1]]), pa.array([r[1] for r in rows], arrow[kinds[0]]), pa.array([r[2] for r in rows], "float64")], ["query_id", "chunk_id", "score"])

    return work
