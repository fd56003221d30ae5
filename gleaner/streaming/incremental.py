"""Incremental ingestion: documents that arrive in a folder are chunked as a stream.

Chunking is a map over documents, so the stream needs no state; a sink that appends chunks per batch
makes the chunk table grow with the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gleaner.config import ChunkConfig
from gleaner.operators.chunking import chunk_offsets


def arriving_documents(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def chunk_stream(documents: DataFrame, target: str, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Append the chunks of arriving documents (document_id, text) to ``target``; ends when all that is there is done."""
    chunks = chunk_offsets(documents, config)
    return chunks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
