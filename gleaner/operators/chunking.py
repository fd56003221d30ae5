"""Documents from blocks, and chunks from documents.

Where a chunk ends decides where the next one starts, so cutting is a scan within one document: an
Arrow function that reads whole documents and returns their chunks. Everything around it (spans,
pages, section paths, ids) is column expressions, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import ChunkConfig
from gleaner.functions.text import clean_block, stable_id
from gleaner.session import ship, sliced, spread

#: After these a chunk may end (fixed values of the chunk format).
STOPS = ("\n\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ")
SPAN = "array<struct<start:int,end:int,kind:string,page:int,section_path:array<string>>>"


def assemble(blocks: DataFrame, exact: bool = True) -> DataFrame:
    """document_id, text, spans from rows (document_id, pos, kind, page, section_path, text).

    Blocks are cleaned, empty ones dropped, the others joined by an empty line.
    """
    rows = blocks.withColumn("text", clean_block(F.col("text"), exact)).filter(F.length("text") > 0)
    before = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int"))
    span = F.struct("start", (F.col("start") + F.length("text")).alias("end"), "kind", F.col("page").cast("int").alias("page"), "section_path")
    together = placed.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"), F.array_sort(F.collect_list(span)).alias("spans"))
    return together.select("document_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"), "spans")


def substantial(documents: DataFrame, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """(documents with a text of ``least`` characters or more, the others)."""
    ok = F.coalesce(F.length("text") >= least, F.lit(False))
    return documents.filter(ok), documents.filter(~ok)


def _last_stop(text: str, low: int, high: int) -> int:
    """The end of the latest stop that lies within [low, high), or -1."""
    return max(at + len(s) if (at := text.rfind(s, low, high)) >= 0 else -1 for s in STOPS)


def cuts(text: str, config: ChunkConfig) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk, white space at its ends left out."""
    size, start = len(text), 0
    while start < size:
        end = start + config.size
        if end < size:
            stop = _last_stop(text, min(end, start + max(config.least, int(config.size * 0.6))), end)
            end = stop if stop >= 0 else end
        else:
            end = size
        piece = text[start:end]
        if body := piece.strip():
            first = start + len(piece) - len(piece.lstrip())
            yield first, first + len(body)
            if end == size:
                return
            aim = max(start + 1, end - config.overlap)
            stop = _last_stop(text, max(start + 1, aim - config.overlap // 2), end)
            aim = stop if stop >= 0 else aim
            if size - aim < config.least:  # no short rest: the last chunk reaches back
                aim = max(start + 1, size - config.least)
            start = aim if aim > start else end
        else:
            start = end


def chunk_offsets(documents: DataFrame, config: ChunkConfig = ChunkConfig(), id_col: str = "document_id") -> DataFrame:
    """(id, chunk_index, char_start, char_end, text) of every chunk of ``documents`` (id, text)."""
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            for row, text in enumerate(batch.column("text").to_pylist()):
                found = list(cuts(text or "", config))
                if found:
                    own = batch.column(id_col).slice(row, 1).take(pa.array([0] * len(found)))
                    cols = [own, pa.array(range(len(found)), "int32"), *(pa.array([f[i] for f in found], "int32") for i in (0, 1)), pa.array([text[a:z] for a, z in found], "string")]
                    yield pa.RecordBatch.from_arrays(cols, [id_col, "chunk_index", "char_start", "char_end", "text"])

    return spread(documents.select(id_col, "text")).mapInArrow(work, f"{id_col} {kind}, chunk_index int, char_start int, char_end int, text string")


def overlapping(spans: Column, start: Column, end: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def chunk_documents(documents: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of documents (document_id, text, spans and further columns, which chunks inherit), with pages and section paths."""
    pieces = chunk_offsets(documents, config).withColumnRenamed("text", "chunk_text")
    met = documents.join(pieces, "document_id").withColumn("met", overlapping(F.col("spans"), F.col("char_start"), F.col("char_end")))
    pages = F.filter(F.transform("met", lambda s: s["page"]), lambda p: p.isNotNull())
    paths = F.array_distinct(F.filter(F.transform("met", lambda s: s["section_path"]), lambda p: F.size(p) > 0))
    rest = [c for c in documents.columns if c not in ("document_id", "text", "spans")]
    return met.select(
        stable_id("chk", F.col("document_id"), F.col("char_start"), F.col("char_end"), F.col("chunk_text")).alias("chunk_id"),
        "document_id", "chunk_index", F.col("chunk_text").alias("text"), F.length("chunk_text").alias("character_count"), "char_start", "char_end",
        F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"),
        F.coalesce(F.get(paths, F.lit(0)), F.array().cast("array<string>")).alias("section_path"), paths.alias("section_paths"), *rest,
    )


def processing_report(documents: DataFrame, by: str) -> DataFrame:
    """Documents, characters and warnings for each value of a column."""
    has = "warnings" in documents.columns
    warnings = F.sum(F.size("warnings")) if has else F.lit(0)
    scans = F.count_if(F.exists("warnings", lambda w: w.startswith("ocr_recommended"))) if has else F.lit(0)
    return documents.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"), warnings.cast("long").alias("warnings"), scans.cast("long").alias("ocr_recommended"))
