"""From raw files to chunks."""

from __future__ import annotations

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.config import ChunkConfig
from gleaner.functions.text import stable_id
from gleaner.operators.chunking import assemble, chunk_documents, substantial
from gleaner.session import arrow_udf, cut, union_all
from gleaner.sources import html, markdown, pages
from gleaner.sources.charset import CharsetModel
from gleaner.sources.files import zip_members


def logical_files(files: DataFrame) -> DataFrame:
    """Raw files with archives replaced by their members: source_id, title, raw_path, member_path, suffix, content, document_id."""
    plain = files.filter("suffix <> 'zip'").select("source_id", "title", F.col("path").alias("raw_path"), F.lit(None).cast("string").alias("member_path"), "suffix", "content")
    archives = files.filter("suffix = 'zip'")
    members = zip_members(archives).join(archives.select("path", "source_id", "title"), "path")
    inner = members.select("source_id", F.concat_ws(" - ", "title", F.substring_index("member", "/", -1)).alias("title"), F.col("path").alias("raw_path"), F.col("member").alias("member_path"), F.lower(F.substring_index("member", ".", -1)).alias("suffix"), "content")
    rows = plain.unionByName(inner)
    logical = F.concat_ws("::", "source_id", F.concat_ws("!/", "raw_path", "member_path"))
    return rows.withColumn("document_id", stable_id("doc", logical)).withColumn("content_sha256", F.sha2("content", 256))


def documents_of(files: DataFrame, reader: pages.PageReader | None = None, charsets: CharsetModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with text, spans and warnings, the other files with their error).

    HTML, Markdown and plain text are read here (in the character set that they name, in UTF-8, or as ``charsets`` finds), PDF by ``reader``. A file without a reader for it, one that the reader fails on and one whose
    text is too short are errors by name; pages with little text are a warning (``ocr_recommended``).
    """
    from_html = files.filter(F.col("suffix").isin("html", "htm")).select("document_id", html_text("content", charsets).alias("html"))
    from_text = files.filter(F.col("suffix").isin("md", "txt")).select("document_id", html_text("content", charsets).alias("text"))
    blocks = [html.page_blocks(from_html, "document_id", "html"), markdown.text_blocks(from_text)]
    paged = files.filter("suffix = 'pdf'").select("document_id", "content")
    if reader is None:
        failed = paged.select("document_id", F.lit("no page reader for pdf").alias("failure"))
        warned = paged.select("document_id", F.lit(None).cast("array<string>").alias("warnings")).limit(0)
    else:
        read = cut(pages.read_pages(paged, reader), "read-pages")
        lines = pages.lines_of(read)
        blocks.append(pages.line_blocks(lines))
        failed = read.filter("error IS NOT NULL").select("document_id", F.col("error").alias("failure"))
        sizes = pages.page_statistics(pages.page_sizes(lines))
        warned = sizes.filter("ocr_recommended").select("document_id", F.array(F.concat(F.lit("ocr_recommended: "), "sparse_pages", F.lit(" of "), "pages", F.lit(" pages with little text"))).alias("warnings"))
    texts = files.drop("content").join(assemble(union_all(blocks)), "document_id", "left")
    made = texts.join(failed, "document_id", "left").join(warned, "document_id", "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    good, short = substantial(made)
    return good.drop("failure"), short.withColumn("error", F.coalesce("failure", F.concat(F.lit("text too short: "), F.length("text"), F.lit(" characters")))).drop("failure", "text", "spans")


def html_text(body: str, charsets: CharsetModel | None = None) -> Column:
    detect = None if charsets is None else charsets.detect

    def decoded(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: html.decode(bytes(b), detect), na_action="ignore")

    return arrow_udf(decoded, StringType())(body)


def build(files: DataFrame, config: ChunkConfig = ChunkConfig(), reader: pages.PageReader | None = None, charsets: CharsetModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, the files that gave none, with their error)."""
    documents, rejected = documents_of(logical_files(files), reader, charsets)
    return chunk_documents(documents, config), rejected
