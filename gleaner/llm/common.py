"""What the operators of this folder share: column handling and Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.session import ship

#: State that Python workers keep between tasks, by the key of what it was made from.
WORKER: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs; others, however named, can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_batches(df: DataFrame, schema: str | StructType, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    ship(df.sparkSession)
    owner = work.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if WORKER.get("owner") != owner:  # a worker serves one operator after the other; it keeps the state of one
            WORKER.clear()
            WORKER["owner"] = owner
            give_back()
        yield from work(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except AttributeError:  # another C library
        return
    trim(0)


def per_worker(key: str, make: Callable[[], object]) -> object:
    if key not in WORKER:
        WORKER[key] = make()
    return WORKER[key]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most_bytes`` at most (one row at least)."""
    start, total = 0, 0
    sizes = [0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()]
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)
