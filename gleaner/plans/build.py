"""Building a corpus: every input row becomes an accepted or a rejected document, and accepted ones become chunks.

One pass parses, assembles and judges; a row that can't become a document stays, with the reason, as a rejected one, so
that accepted and rejected rows add up to the input. Counts are gathered by ``DataFrame.observe`` while the rows are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.functions.text import stable_id
from gleaner.operators.chunking import SPAN, assemble
from gleaner.sources import html, markdown

#: Goes into every document: raise it when parsing changes, and documents of older versions can be told apart.
PROCESSOR_VERSION = "3"
LEAST_CHARACTERS = 40
#: Which parser reads a file type.
PARSERS = {"html": "html", "htm": "html", "md": "markdown", "txt": "markdown"}
DOCUMENT = (
    "document_id string, source_id string, title string, language string, file_type string, content_sha256 string, parser string, processor_version string, "
    f"text string, spans {SPAN}, character_count int, block_count int, warnings array<string>, error string, status string"
)
CHUNK = (
    "chunk_id string, document_id string, chunk_index int, text string, character_count int, char_start int, char_end int, page_start int, page_end int, "
    "section_path array<string>, section_paths array<array<string>>, source_id string, title string, language string, content_sha256 string"
)
#: A document's columns that its chunks inherit.
INHERITED = ("source_id", "title", "language", "content_sha256")


def parser_of(file_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in PARSERS.items() for x in pair])[F.lower(file_type)]


def raw_document(source_id: Column, key: Column, body: Column, file_type: Column, title: Column, language: Column) -> list[Column]:
    """The columns of an input row of ``judged_documents``: its id is made of source and key, null if either is."""
    return [
        F.when(source_id.isNotNull() & key.isNotNull(), stable_id("doc", F.concat_ws("::", source_id, key))).alias("document_id"),
        source_id.cast("string").alias("source_id"),
        title.cast("string").alias("title"),
        language.cast("string").alias("language"),
        file_type.cast("string").alias("file_type"),
        F.sha2(F.encode(body, "UTF-8"), 256).alias("content_sha256"),
        body.cast("string").alias("body"),
    ]


def judged_documents(raw: DataFrame, least: int = LEAST_CHARACTERS) -> DataFrame:
    """Rows of DOCUMENT, one for each of ``raw`` (see ``raw_document``; document_id names one row at most, unless it is null).

    Rejected, with the reason in ``error`` and no text: rows without an id or a body, of an unknown file type, or with fewer
    than ``least`` characters of text.
    """
    known = parser_of(F.col("file_type"))
    reason = F.when(F.col("document_id").isNull(), "no id").when(F.col("body").isNull(), "no content").when(known.isNull(), F.concat(F.lit("unknown file type "), F.coalesce("file_type", F.lit("null"))))
    rows = raw.select("*", known.alias("parser"), reason.alias("error"))
    readable = rows.filter("error IS NULL")
    of_pages = html.page_blocks(readable.filter("parser = 'html'").select("document_id", "body"), "document_id", "body")
    of_texts = markdown.text_blocks(readable.filter("parser = 'markdown'").select("document_id", "body"), "document_id", "body")
    made = assemble(of_pages.unionByName(of_texts)).withColumnRenamed("document_id", "made_id")
    joined = rows.drop("body").join(made, F.col("document_id") == F.col("made_id"), "left").drop("made_id")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = F.when(size < least, F.concat(F.lit("text too short: "), size.cast("string"), F.lit(" characters")))
    error = F.coalesce("error", short)
    accepted = error.isNull()
    return joined.select(
        "document_id", "source_id", "title", "language", "file_type", "content_sha256", "parser", F.lit(PROCESSOR_VERSION).alias("processor_version"),
        F.when(accepted, F.col("text")).alias("text"), F.when(accepted, F.col("spans")).alias("spans"), size.alias("character_count"),
        F.coalesce(F.size("spans"), F.lit(0)).alias("block_count"), F.array().cast("array<string>").alias("warnings"), error.alias("error"),
        F.when(accepted, "accepted").otherwise("rejected").alias("status"),
    )


def counted(documents: DataFrame) -> tuple[DataFrame, Observation]:
    """The documents, and the counts that are there once they have been written: rows, accepted, rejected, characters, warnings."""
    seen = Observation()
    ok = F.col("status") == "accepted"
    sums = [F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.coalesce(F.sum(F.when(ok, F.col("character_count"))), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings")]
    return documents.observe(seen, *sums), seen


def build_report(documents: DataFrame, by: tuple[str, ...] = ("source_id", "file_type")) -> DataFrame:
    """Of each source and file type: input rows, accepted and rejected ones, characters, warnings, and how often each error came up."""
    ok = F.col("status") == "accepted"
    kind = F.regexp_replace("error", " [0-9]+ characters$", "")  # one entry for all short texts
    one = documents.groupBy(*by, kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("accepted"), F.sum(F.when(ok, F.col("character_count")).otherwise(0)).cast("long").alias("characters"), F.sum(F.size("warnings")).cast("long").alias("warnings")
    )
    errors = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.concat("kind", F.lit(" x "), F.col("rows").cast("string")))))
    total = one.groupBy(*by).agg(F.sum("rows").alias("documents"), F.sum("accepted").alias("accepted"), F.sum("characters").alias("characters"), F.sum("warnings").alias("warnings"), errors.alias("errors"))
    return total.withColumn("rejected", F.col("documents") - F.col("accepted"))


def newest(documents: DataFrame, batch: str = "batch") -> DataFrame:
    """Of each document_id the row of the latest batch; rows without an id all stay."""
    last = documents.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.max(batch).alias(batch))
    return documents.join(last, ["document_id", batch], "left_semi").unionByName(documents.filter("document_id IS NULL"))
