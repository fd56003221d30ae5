"""Build a chunk corpus from a growing table of texts, batch by batch.

    python -m jobs.corpus_build --input TABLE --output FOLDER --checkpoint FOLDER [--config FILE]

A file stream takes the files that came since the last run (``availableNow``; the checkpoint is the mark), and the run ends when all are
done. Each batch writes its own partitions of three tables under the output folder:

* ``documents`` (batch, status): every row that is new, accepted or rejected with the reason;
* ``chunks`` (language, batch): the chunks of the accepted documents;
* ``report`` (batch): rows, accepted, rejected, characters and errors by source and file type.

A row whose document and content an earlier batch has already taken is passed over, so a file that is delivered twice adds
nothing; a document with new content is taken again, and ``current`` shows each document's latest state. If a run breaks off,
the next one repeats the unfinished batch, whose partitions it overwrites: the result is the same. Of several texts of one
document in one batch, that with the largest digest counts.

Rows without an id are rejected and taken once a delivery. Nulls, empty texts and extra columns are fine; an
empty table leaves no output. Executors need nothing but the shared folders.
"""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from gleaner.config import ChunkConfig
from gleaner.operators.chunking import chunk_documents
from gleaner.plans import build
from gleaner.session import ship
from jobs.common import HERE, logger, read_config, written

DEFAULT_CONFIG = HERE / "corpus_build.toml"
DOCUMENTS, CHUNKS = build.DOCUMENT + ", batch long", build.CHUNK + ", batch long"
log = logger("corpus_build")


def _raw(rows: DataFrame, c: dict) -> DataFrame:
    col = lambda name: F.col(f"`{c[name]}`")
    return rows.select(*build.raw_document(col("source"), col("key"), col("body").cast("string"), F.lit(c["file_type"]), col("title"), col("language")))


def _fresh(raw: DataFrame, earlier: DataFrame) -> DataFrame:
    """One row a document, without those that earlier batches hold with the same content."""
    alone = F.when(F.col("document_id").isNull(), F.monotonically_increasing_id())  # rows without an id are a group each
    one = raw.groupBy("document_id", alone.alias("alone")).agg(F.max_by(F.struct(*[c for c in raw.columns if c != "document_id"]), F.coalesce("content_sha256", F.lit(""))).alias("r")).select("document_id", "r.*")
    known = earlier.filter("document_id IS NOT NULL").select(F.col("document_id").alias("known_id"), F.col("content_sha256").alias("known_sha"))
    return one.join(known, (F.col("document_id") == F.col("known_id")) & F.col("content_sha256").eqNullSafe(F.col("known_sha")), "left_anti")


def take_batch(rows: DataFrame, batch: int, output: str, config: dict) -> None:
    """Write one batch's partitions; a repeated call with the same rows writes the same."""
    spark = rows.sparkSession
    earlier = written(spark, f"{output}/documents", DOCUMENTS).filter(F.col("batch") < batch).select("document_id", "content_sha256")
    to = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")
    fresh = _fresh(_raw(rows, config["input"]), earlier).persist(StorageLevel.DISK_ONLY)  # read by each parser; made again from the source where it is lost
    try:
        documents = build.judged_documents(fresh, config["documents"]["least_characters"])
        documents, seen = build.counted(documents.withColumn("batch", F.lit(batch).cast("long")))
        to(documents, "documents", "batch", "status")
    finally:
        fresh.unpersist()
    counts = seen.get
    own = written(spark, f"{output}/documents", DOCUMENTS).filter(F.col("batch") == batch)
    accepted = own.filter("status = 'accepted'").select("document_id", "text", "spans", *build.INHERITED, "batch")
    chunks, cut_up = chunk_documents(accepted, ChunkConfig(**config["chunks"])), Observation()
    to(chunks.observe(cut_up, F.count(F.lit(1)).alias("chunks")), "chunks", "language", "batch")
    to(build.build_report(own).withColumn("batch", F.lit(batch).cast("long")), "report", "batch")
    log.info("batch %d: %d new rows, %d accepted, %d rejected, %d characters; %d chunks written", batch, counts["rows"], counts["accepted"], counts["rejected"], counts["characters"], cut_up.get["chunks"])


def one_file(spark: SparkSession, source: str) -> str | None:
    """The name of the file that ``source`` is; None if it is a folder. A file stream wants folders."""
    name = source.rstrip("/").rpartition("/")[2]
    files = spark.read.parquet(source).inputFiles()
    return name if len(files) == 1 and files[0].endswith(f"/{name}") else None


def arriving(spark: SparkSession, source: str) -> DataStreamReader:
    return spark.readStream.schema(spark.read.parquet(source).schema)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> int:
    """Take what is new in the Parquet table ``source``; returns the number of input rows read."""
    config = config or read_config(DEFAULT_CONFIG)
    ship(spark)
    log.info("reading %s, writing %s, mark in %s", source, output, checkpoint)
    stream = arriving(spark, source).option("maxFilesPerTrigger", config["input"]["files_per_batch"])
    stream = stream.parquet(source) if not (alone := one_file(spark, source)) else stream.option("pathGlobFilter", alone).parquet(source.rpartition("/")[0])
    wanted = sorted({config["input"][c] for c in ("key", "source", "title", "language", "body")})
    query = (
        stream.select(*[F.col(f"`{c}`") for c in wanted])
        .writeStream.foreachBatch(lambda rows, batch: take_batch(rows, batch, output, config))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    read = sum(p.numInputRows for p in query.recentProgress)
    log.info("read %d rows in %d batches", read, sum(p.numInputRows > 0 for p in query.recentProgress))
    return read


def current(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """(the latest row of every document, the chunks of those that are accepted)."""
    documents = build.newest(written(spark, f"{output}/documents", DOCUMENTS))
    live = documents.filter("status = 'accepted'").select("document_id", "batch")
    return documents, written(spark, f"{output}/chunks", CHUNKS).join(live, ["document_id", "batch"], "left_semi")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Build a chunk corpus from a growing table of texts.")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", default=DEFAULT_CONFIG)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpus build").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint, read_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
