"""Fetching planned addresses: the transport is injected, checks and receipts are columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.urls import magic_ok, safe_filename, url_allowed
from gleaner.session import cut, ship, union_all
from gleaner.sources.html import page_links
from gleaner.sources.manifest import fetch_plan, group

#: (url, timeout, most bytes) -> (body, final url, content type)
Transport = Callable[[str, float, int], tuple[bytes, str, str]]


def fetch(plan: DataFrame, transport: Transport, retries: int = 3, timeout: float = 60.0, most_bytes: int = 100 << 20, https_only: bool = True, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """plan (id, url, filename, allowed_hosts) with body, final_url, content_type and error (null if all went well).

    Only allowed addresses are asked for; the final address, the size and the first bytes are checked after.
    """
    ship(plan.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (url, ok) in enumerate(zip(batch.column("url").to_pylist(), batch.column("ok").to_pylist(), strict=True)):
                body, final, kind, error = None, None, None, None if ok else "address isn't allowed"
                for attempt in range(retries if ok else 0):
                    try:
                        body, final, kind = transport(url, timeout, most_bytes)
                        error = None if len(body) <= most_bytes else "too large"
                        break
                    except OSError as e:
                        error = str(e)
                        if attempt + 1 < retries:
                            wait(min(2**attempt, 8))
                row = batch.slice(i, 1).select(["id", "url", "filename", "allowed_hosts"])
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([body if error is None else None], "binary"), pa.array([final], "string"), pa.array([kind], "string"), pa.array([error], "string")], [*row.schema.names, "body", "final_url", "content_type", "error"])

    asked = plan.select("id", "url", "filename", "allowed_hosts", url_allowed(F.col("url"), F.col("allowed_hosts"), https_only).alias("ok"))
    got = asked.mapInArrow(work, "id string, url string, filename string, allowed_hosts array<string>, body binary, final_url string, content_type string, error string")
    moved = F.when(F.col("body").isNotNull() & ~url_allowed(F.col("final_url"), F.col("allowed_hosts"), https_only), "final address isn't allowed")
    wrong = F.when(F.col("body").isNotNull() & ~magic_ok(F.col("body"), F.col("filename")), "content isn't what the name says")
    return got.withColumn("error", F.coalesce("error", moved, wrong)).withColumn("body", F.when(F.col("error").isNull(), F.col("body")))


def to_fetch(plan: DataFrame, there: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what is to be fetched, what is there already) by (id, filename)."""
    if force:
        return plan, plan.limit(0)
    keys = ["id", "filename"]
    return plan.join(there.select(*keys), keys, "left_anti"), plan.join(there.select(*keys), keys, "left_semi")


def receipts(fetched: DataFrame) -> DataFrame:
    return fetched.filter("error IS NULL").select("id", "url", "final_url", "filename", "content_type", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"), F.current_timestamp().alias("fetched_at"))


def chosen_links(links: DataFrame, pattern: str, most: int) -> DataFrame:
    """The first ``most`` distinct addresses of links (pos, href, text) that fit a pattern, in order of first sight."""
    first = links.filter(F.col("href").rlike(pattern)).groupBy("href").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
    return first.orderBy("pos").limit(most)


#: How a listing's links to reports read (fixed values of the collection's site).
REPORT_TITLE = "^(?:report |bulletin |safety digest )"
REPORT_PATH = "^/raib-reports/|/government/news/report-|/government/publications/"


def report_pages(links: DataFrame, most: DataFrame) -> DataFrame:
    """(id, place, href) of the first ``most`` (id, most) distinct report pages that a listing's links (id, pos, href, text) name."""
    host, path = F.lower(F.try_parse_url("href", F.lit("HOST"))), F.coalesce(F.try_parse_url("href", F.lit("PATH")), F.lit(""))
    fits = F.lower("text").rlike(REPORT_TITLE) & (host == "www.gov.uk") & path.rlike(REPORT_PATH)
    first = links.filter(fits).groupBy("id", "href").agg(F.min("pos").alias("pos"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    return placed.join(most, "id").filter("place <= most").select("id", "place", "href")


def collections(rows: DataFrame, transport: Transport, most: int | None = None, **options) -> DataFrame:
    """Fetch the reports of every source of kind govuk_raib_collection.

    id, url, filename, body, final_url, content_type, error, report_page, status: "pdf" for a report page's first PDF,
    "page_only" where it has none, "failed" with its error, "listing" for a listing (failed, or without any report), and
    "warning" where fewer reports came than the source asks for (10 if it doesn't say).
    """
    sources = rows.filter("fetch.kind = 'govuk_raib_collection'").select("id", "fetch.url", F.lit("_listing.html").alias("filename"), "fetch.allowed_hosts", F.coalesce(F.lit(most).cast("int"), "fetch.max_items", F.lit(10)).alias("most"))
    wanted = sources.select("id", "most")
    listings = cut(fetch(sources, transport, **options), "collection-listings")
    links = page_links(listings.filter("error IS NULL").withColumn("html", F.decode("body", "UTF-8")), "id")
    place = F.lpad(F.col("place").cast("string"), 2, "0")
    name = F.concat(F.when(F.col("place") < 100, place).otherwise(F.col("place").cast("string")), F.lit("_"), safe_filename(F.substring_index(F.try_parse_url("href", F.lit("PATH")), "/", -1)))
    chosen = cut(report_pages(links, wanted).join(sources.select("id", "allowed_hosts"), "id").select("id", F.col("href").alias("url"), F.concat(name, F.lit(".html")).alias("filename"), "allowed_hosts"), "collection-chosen")
    pages = cut(fetch(chosen, transport, **options).withColumn("page", F.concat_ws("\n", "id", "filename")), "collection-pages")
    inside = page_links(pages.filter("error IS NULL").withColumn("html", F.decode("body", "UTF-8")), "page").join(pages.select("page", "id", "filename", "allowed_hosts", F.col("url").alias("report_page")), "page")
    is_pdf = F.lower(F.try_parse_url("href", F.lit("PATH"))).endswith(".pdf") & F.array_contains("allowed_hosts", F.lower(F.try_parse_url("href", F.lit("HOST"))))
    pdfs = inside.filter(is_pdf).groupBy("page", "id", "filename", "allowed_hosts", "report_page").agg(F.min_by("href", "pos").alias("url")).withColumn("filename", F.regexp_replace("filename", r"\.html$", ".pdf"))
    pdfs = cut(pdfs, "collection-pdfs")
    got = cut(fetch(pdfs, transport, **options), "collection-reports").join(pdfs.select("id", "filename", "report_page"), ["id", "filename"])
    shown = ["id", "url", "filename", "body", "final_url", "content_type", "error", "report_page"]
    plain = pages.join(pdfs.select("page"), "page", "left_anti").withColumn("report_page", F.col("url")).select(*shown, F.when(F.col("error").isNull(), "page_only").otherwise("failed").alias("status"))
    reports = got.select(*shown, F.when(F.col("error").isNull(), "pdf").otherwise("failed").alias("status")).unionByName(plain)
    came = reports.filter("status <> 'failed'").groupBy("id").agg(F.count(F.lit(1)).alias("came"))
    bare = listings.join(chosen.select("id").distinct().withColumn("any", F.lit(True)), "id", "left").filter("any IS NULL")
    bare = bare.withColumn("error", F.coalesce("error", F.lit("no report is listed; the page may have changed"))).withColumn("report_page", F.lit(None).cast("string")).select(*shown, F.lit("listing").alias("status"))
    few = listings.join(wanted, "id").join(came, "id", "left").withColumn("came", F.coalesce("came", F.lit(0))).filter("came < most")
    few = few.withColumns({"error": F.format_string("%d of %d reports", "came", "most"), "report_page": F.lit(None).cast("string"), "body": F.lit(None).cast("binary"), "filename": F.lit(None).cast("string")}).select(*shown, F.lit("warning").alias("status"))
    return reports.unionByName(bare).unionByName(few)


FETCHED = "id string, url string, filename string, body binary, final_url string, content_type string, error string, report_page string, status string"
LOG = "id string, url string, final_url string, filename string, content_type string, bytes long, sha256 string, fetched_at timestamp, status string, error string"


def fetch_all(rows: DataFrame, transport: Transport, there: DataFrame | None = None, force: bool = False, **options) -> DataFrame:
    """FETCHED rows of sources of any kind: files, pages and bundles by their plan, collections by their listings.

    ``there`` (id, filename) is passed over, with status "cached". A failure is a row with its error.
    """
    spark = rows.sparkSession
    plan = fetch_plan(rows.filter("fetch.kind <> 'govuk_raib_collection'")).withColumn("filename", F.coalesce("filename", safe_filename(F.substring_index("url", "/", -1))))
    todo, cached = to_fetch(plan, there if there is not None else spark.createDataFrame([], "id string, filename string"), force)
    none = F.lit(None).cast("string")
    got = fetch(todo, transport, **options).withColumns({"report_page": none, "status": F.when(F.col("error").isNull(), "downloaded").otherwise("failed")})
    kept = cached.select("id", "url", "filename", none.cast("binary").alias("body"), none.alias("final_url"), none.alias("content_type"), none.alias("error"), none.alias("report_page"), F.lit("cached").alias("status"))
    shown = [c.split(" ")[0] for c in FETCHED.split(", ")]
    parts = [got.select(*shown), kept.select(*shown)]
    if not rows.filter("fetch.kind = 'govuk_raib_collection'").isEmpty():
        parts.append(collections(rows, transport, **options).select(*shown))
    return union_all(parts)


def run(rows: DataFrame, transport: Transport, folder: str, force: bool = False, **options) -> dict[str, int]:
    """Fetch what ``folder`` doesn't hold yet; returns how many rows came to which status.

    Bodies go to ``files`` (source and name as columns, a folder a source), a line for every success and failure to ``log`` (JSON lines, appended).
    A run that breaks off has logged nothing, so the next one fetches the same again; the latest body of a name counts.
    """
    spark = rows.sparkSession
    there = logged(spark, folder).filter("status NOT IN ('failed', 'listing', 'warning')").select("id", "filename").distinct()
    got = cut(fetch_all(rows, transport, there, force, **options), "fetched")
    new = got.filter("status <> 'cached'")
    names = rows.select("id", group(F.col("repository_policy")).alias("group"), "title", "include_members")
    bodies = new.filter("body IS NOT NULL").join(names, "id").withColumn("fetched_at", F.current_timestamp())
    bodies.select("id", "group", "title", "include_members", "filename", "body", "fetched_at").write.mode("append").partitionBy("group").parquet(f"{folder}/files")
    made = receipts(new).drop("fetched_at").select("id", "filename", "bytes", "sha256")
    log = new.drop("body", "report_page").join(made, ["id", "filename"], "left").withColumn("fetched_at", F.current_timestamp())
    log.select(*[c.split(" ")[0] for c in LOG.split(", ")]).write.mode("append").option("ignoreNullFields", "false").json(f"{folder}/log")
    return {r.status: r.n for r in got.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}


def logged(spark: SparkSession, folder: str) -> DataFrame:
    """The log of all runs; empty if there was none."""
    try:
        return spark.read.schema(LOG).json(f"{folder}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def fetched_files(spark: SparkSession, folder: str) -> DataFrame:
    """The latest body of every name, as ``ingest.logical_files`` wants files: group, source_id, title, include_members, path, name, suffix, content."""
    rows = spark.read.parquet(f"{folder}/files")
    last = rows.groupBy("id", "filename").agg(F.max("fetched_at").alias("fetched_at"))
    path = F.concat_ws("/", "group", "id", "filename")
    shown = rows.join(last, ["id", "filename", "fetched_at"], "left_semi").dropDuplicates(["id", "filename"])
    return shown.select("group", F.col("id").alias("source_id"), "title", "include_members", path.alias("path"), F.col("filename").alias("name"), F.lower(F.substring_index("filename", ".", -1)).alias("suffix"), F.col("body").alias("content"))
