"""Raw files and JSON lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.functions.urls import member_allowed
from gleaner.session import ship

SUFFIXES = ("pdf", "html", "htm", "zip", "md", "txt")
MOST_MEMBERS, MOST_MEMBER_BYTES = 100, 30 << 20


def _parsed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """value, file, start (of the split in its file), row, r: every line that is not blank with what it parses to; ``r._broken`` is null if it parses."""
    full = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).add("_broken", "string")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return lines.withColumn("r", F.when(F.length(F.trim("value")) > 0, F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})))


def _is_broken() -> Column:
    return (F.length(F.trim("value")) > 0) & (F.col("r").isNull() | F.col("r._broken").isNotNull())


def broken_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line, value) of every line that is no JSON of the schema; lines are numbered from 1 in their file.

    A file is read in splits by many tasks: a line's number is its place in its split and the lines of all splits before it,
    whose counts are one row a split.
    """
    lines = _parsed(spark, path, schema)
    splits = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bad = lines.filter(_is_broken()).select("file", "start", "row", "value")
    return bad.join(placed, ["file", "start"]).select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a given schema; empty lines are skipped, a broken one is an error that shows it when the rows are read."""
    rows = _parsed(spark, path, schema).filter(F.length(F.trim("value")) > 0)
    ok = F.when(_is_broken(), F.raise_error(F.concat(F.lit("invalid JSON in "), "file", F.lit(": "), "value"))).otherwise(F.lit("ok")).cast("string")
    return rows.filter(ok == "ok").select("r.*").drop("_broken")


def checked_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """``read_json_lines``, checked now: a broken line is a ValueError that begins with file:line of the first one."""
    first = broken_lines(spark, path, schema).orderBy("file", "line").first()
    if first:
        raise ValueError(f"{first.file}:{first.line}: invalid JSON: {first.value[:200]}")
    return read_json_lines(spark, path, schema)


def raw_files(spark: SparkSession, root: str, sources: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(group, source_id, path, name, suffix, content): supported files below root/group/source of manifest sources.

    Names with a leading dot or underscore are left out by Spark's own listing or by the filter.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.regexp_extract("path", r"/(open|restricted)/([^/]+)/(?:.*/)?([^/]+)$", 0)
    rows = found.select(
        F.regexp_extract("path", r"/(open|restricted)/([^/]+)/", 1).alias("group"), F.regexp_extract("path", r"/(open|restricted)/([^/]+)/", 2).alias("source_id"),
        "path", F.substring_index("path", "/", -1).alias("name"), F.lower(F.substring_index("path", ".", -1)).alias("suffix"), "content",
    ).filter((parts != "") & ~F.col("name").rlike("^[._]") & F.col("suffix").isin(*SUFFIXES))
    if only:
        rows = rows.filter(F.col("source_id").isin(only))
    return rows.join(sources.select(F.col("id").alias("source_id"), *[c for c in ("title", "include_members") if c in sources.columns]), "source_id")


def zip_members(archives: DataFrame) -> DataFrame:
    """(path, member, content) of the allowed members of archives (path, content, include_members).

    More than MOST_MEMBERS members, one of more than MOST_MEMBER_BYTES, or none at all is an error.
    """
    ship(archives.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(infos)), pa.array([i.filename for i in infos], "string"), pa.array([i.file_size for i in infos], "int64")], ["path", "member", "size"])

    listed = archives.select("path", "content").mapInArrow(work, "path string, member string, size long").join(archives.select("path", "include_members"), "path")
    chosen = listed.filter(member_allowed(F.col("member"), F.coalesce("include_members", F.array().cast("array<string>"))))
    kept = chosen.groupBy("path").agg(F.collect_list("member").alias("members"), F.max("size").alias("most"))
    judged = archives.select("path", "content").join(kept, "path", "left").withColumn(
        "members",
        F.when(F.coalesce(F.size("members"), F.lit(0)) < 1, F.raise_error(F.concat(F.lit("no member to read in "), "path")))
        .when(F.size("members") > MOST_MEMBERS, F.raise_error(F.concat(F.lit("too many members in "), "path")))
        .when(F.col("most") > MOST_MEMBER_BYTES, F.raise_error(F.concat(F.lit("too large a member in "), "path")))
        .otherwise(F.col("members")),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body, members in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "members")), strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for m in members:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([m]), pa.array([z.read(m)], "binary")], ["path", "member", "content"])

    return judged.select("path", "content", "members").mapInArrow(read, "path string, member string, content binary")
