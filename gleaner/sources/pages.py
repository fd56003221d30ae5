"""Documents of pages and lines (from PDF or OCR): repeated edges, page statistics, blocks.

Reading the pages of a file is a plug-in (``PageReader``); all from lines on is here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleaner.functions import pytext
from gleaner.functions.text import clean_block, heading_level, is_heading, is_page_number
from gleaner.session import ship


class PageReader(Protocol):
    def pages(self, body: bytes) -> list[list[str]]: ...


def edge_lines(lines: Column, depth: int = 3) -> Column:
    """The first and the last ``depth`` lines; on a short page a line may be both."""
    last = F.when(F.size(lines) < depth, lines).otherwise(F.slice(lines, -depth, depth))
    return F.concat(F.slice(lines, 1, depth), last)


def repeated_edge_lines(pages: DataFrame) -> DataFrame:
    """(document_id, line, times): edge lines on so many pages that they are headers or footers.

    ``pages``: document_id, page, lines (cleaned, none empty).
    """
    bound = pages.groupBy("document_id").agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) * 0.4 + 0.999)).alias("bound"))
    lines = pages.select("document_id", F.explode(edge_lines(F.col("lines"))).alias("line")).filter(F.length("line").between(2, 100) & ~is_page_number(F.col("line")))
    times = lines.groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("times"))
    return times.join(bound, "document_id").filter("times >= bound").select("document_id", "line", "times")


def page_statistics(pages: DataFrame) -> DataFrame:
    """(document_id, pages, sparse_pages, mean_chars, ocr_recommended) from rows (document_id, page, chars)."""
    grouped = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("chars") < 30).alias("sparse_pages"), F.avg("chars").alias("mean_chars"))
    return grouped.withColumn("ocr_recommended", (F.col("sparse_pages") / F.col("pages") >= 0.4) | (F.col("mean_chars") < 80))


FULL, ENDS = 240, "。！？.!?；;：:"  # a paragraph of so many characters ends with the line that closes a sentence (fixed values)


def _numbered(key: list[str]):
    """Each line with the number of its block on its page, in lines that come page by page: headings stand alone, full paragraphs end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, number, size, ended = None, 0, 0, True
        for batch in batches:
            numbers = []
            for *at, line, alone in zip(*(batch.column(c).to_pylist() for c in (*key, "line", "alone")), strict=True):
                if at != page:
                    page, number, size, ended = at, 0, 0, True
                if ended or alone:
                    number, size = number + 1, 0
                size += len(line) + 1  # with the blank that joins it to the next
                ended = alone or (size > FULL and line[-1] in ENDS)
                numbers.append(number)
            yield batch.append_column("block", pa.array(numbers, "int32"))

    return work


def _text_lines(lines: DataFrame) -> DataFrame:
    """Cleaned lines that say something: none empty, no page numbers, no headers or footers that pages repeat."""
    own = lines.select("document_id", "page", "no", clean_block(F.col("line")).alias("line")).filter(F.length("line") > 0)
    pages = own.groupBy("document_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]).alias("lines"))
    edges = repeated_edge_lines(pages).select("document_id", "line")
    return own.filter(~is_page_number(F.col("line"))).join(edges, ["document_id", "line"], "left_anti")


def line_blocks(lines: DataFrame) -> DataFrame:
    """(document_id, pos, kind, page, section_path, text) from rows (document_id, page, no, line): one raw line a row.

    Paragraphs end with their page; the section path goes on over pages. Lines of a page are numbered in passing, page by page, so no document is
    gathered in one place; a null page or an empty line is no line. (document_id, page, no) names a line.
    """
    ship(lines.sparkSession)
    said = _text_lines(lines.filter("page IS NOT NULL AND line IS NOT NULL")).withColumn("alone", is_heading(F.col("line")))
    ordered = said.select("document_id", "page", "no", "line", "alone").repartition("document_id", "page").sortWithinPartitions("document_id", "page", "no")
    numbered = ordered.mapInArrow(_numbered(["document_id", "page"]), StructType([*ordered.schema.fields, StructField("block", IntegerType())]))
    parts = numbered.groupBy("document_id", "page", "block").agg(F.sort_array(F.collect_list(F.struct("no", "line"))).alias("own"), F.first("alone").alias("alone"))
    text = F.when(F.col("alone"), F.col("own")[0]["line"]).otherwise(clean_block(F.array_join(F.transform("own", lambda x: x["line"]), " ")))
    blocks = parts.select("document_id", "page", "block", "alone", text.alias("text"), F.when(F.col("alone"), heading_level(text)).alias("level"))
    return _with_paths(blocks)


def _with_paths(blocks: DataFrame) -> DataFrame:
    """Section paths of headings of two levels, carried along a document by running last values.

    The first entry is the last heading of level one or, before there is any, the first of level two; the second is the
    last heading of level two behind that.
    """
    whole = Window.partitionBy("document_id").orderBy("page", "block")
    upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.withColumn("pos", F.row_number().over(whole) - 1)
    head = F.struct("pos", "text")
    known = placed.withColumns({
        "one": F.last(F.when(F.col("level") == 1, head), True).over(upto), "two": F.last(F.when(F.col("level") == 2, head), True).over(upto),
        "first_two": F.first(F.when(F.col("level") == 2, head), True).over(upto),
    })
    top = F.coalesce("one", "first_two")
    path = F.when(top.isNull(), F.array().cast("array<string>")).when(F.coalesce(F.col("two.pos") > top["pos"], F.lit(False)), F.array(top["text"], F.col("two.text"))).otherwise(F.array(top["text"]))
    return known.select("document_id", "pos", F.when(F.col("alone"), "heading").otherwise("paragraph").alias("kind"), F.col("page").cast("int").alias("page"), path.alias("section_path"), "text")


def read_pages(files: DataFrame, reader: PageReader, id_col: str = "document_id") -> DataFrame:
    """(id, pages, error) of files (id, content): the reader's lines of every page, cleaned, or why there are none."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[list[str]] | None] = []
            errors: list[str | None] = []
            for body in batch.column("content").to_pylist():
                try:
                    found.append([[pytext.clean_block(line) for line in page] for page in reader.pages(body or b"")])
                    errors.append(None)
                except Exception as e:  # whatever a plug-in raises is that file's error
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found, pa.list_(pa.list_(pa.string()))), pa.array(errors, "string")], [id_col, "pages", "error"])

    return files.select(id_col, "content").mapInArrow(work, f"{id_col} {kind}, pages array<array<string>>, error string")


def lines_of(read: DataFrame, id_col: str = "document_id") -> DataFrame:
    """One row for each line of rows (id, pages): document_id, page (from 1), no, line."""
    pages = read.select(F.col(id_col).alias("document_id"), F.posexplode("pages").alias("at", "lines"))
    return pages.select("document_id", (F.col("at") + 1).alias("page"), F.posexplode("lines").alias("no", "line"))


def page_sizes(lines: DataFrame) -> DataFrame:
    """(document_id, page, chars) of rows (document_id, page, no, line)."""
    return lines.groupBy("document_id", "page").agg(F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("chars"))
