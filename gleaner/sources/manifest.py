"""The source manifest: reading, rules, selection, effective settings."""

from __future__ import annotations

from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.urls import OPEN_POLICIES, POLICIES

KINDS = ("file", "webpage", "webpage_bundle", "govuk_raib_collection")
SOURCE = (
    "pos int, id string, title string, language string, jurisdiction string, category string, version string, publication_date string, source_page string, "
    "repository_policy string, license struct<status:string,name:string,url:string,attribution:string>, "
    "fetch struct<enabled:boolean,kind:string,url:string,urls:array<string>,filename:string,filenames:array<string>,expected_content_type:string,allowed_hosts:array<string>,max_items:int,max_file_size_mb:double>, "
    "include_members array<string>"
)


class ManifestError(ValueError):
    pass


def load_yaml(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ManifestError(f"YAML root must be a mapping: {path}")
    return found


def sources(spark: SparkSession, manifest: dict) -> DataFrame:
    """The manifest's sources as rows; a manifest is a small file, read on the driver."""
    if manifest.get("manifest_version") != 1 or not isinstance(manifest.get("defaults"), dict):
        raise ManifestError("a manifest needs manifest_version 1 and defaults")
    found = manifest.get("sources")
    if not isinstance(found, list) or not found or not all(isinstance(s, dict) for s in found):
        raise ManifestError("a manifest needs sources")
    rows = [{**s, "pos": i, "publication_date": None if (d := s.get("publication_date")) is None else str(d), "include_members": (s.get("process") or {}).get("include_members") or []} for i, s in enumerate(found)]
    return spark.createDataFrame(rows, SOURCE)


def violations(rows: DataFrame) -> DataFrame:
    """(pos, id, rule) of every broken rule."""
    urls = F.when(F.col("fetch.kind") == "webpage_bundle", F.col("fetch.urls")).otherwise(F.array("fetch.url"))
    rules: dict[str, Column] = {
        "id": ~F.coalesce(F.col("id").rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False)),
        "policy": ~F.coalesce(F.col("repository_policy").isin(*POLICIES), F.lit(False)),
        "kind": ~F.coalesce(F.col("fetch.kind").isin(*KINDS), F.lit(False)),
        "urls": urls.isNull() | (F.coalesce(F.size(urls), F.lit(0)) <= 0) | F.coalesce(F.exists(urls, lambda u: u.isNull()), F.lit(False)),
        "hosts": F.coalesce(F.size("fetch.allowed_hosts"), F.lit(0)) <= 0,
    }
    broken = [rows.filter(test).select("pos", "id", F.lit(rule).alias("rule")) for rule, test in rules.items()]
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("pos")).alias("at")).filter("n > 1").select(F.explode(F.slice("at", F.lit(2), F.size("at"))).alias("pos"), "id", F.lit("repeated").alias("rule"))
    return reduce(DataFrame.unionByName, broken).unionByName(repeated)


def check(rows: DataFrame) -> DataFrame:
    """The rows themselves, or an error that names the first broken rule."""
    first = violations(rows).orderBy("pos", "rule").first()
    if first:
        raise ManifestError(f"source {first.pos} ({first.id!r}) breaks rule {first.rule}")
    return rows


def select(rows: DataFrame, only: list[str] | None = None, open_only: bool = False, include_disabled: bool = False) -> DataFrame:
    if only:
        unknown = rows.sparkSession.createDataFrame([(i,) for i in only], "id string").join(rows, "id", "left_anti").first()
        if unknown:
            raise ManifestError(f"unknown source id {unknown.id!r}")
        rows = rows.filter(F.col("id").isin(only))
    if open_only:
        rows = rows.filter(F.col("repository_policy").isin(*OPEN_POLICIES))
    return rows if include_disabled else rows.filter(F.coalesce("fetch.enabled", F.lit(False)))


def group(policy: Column) -> Column:
    return F.when(policy.isin(*OPEN_POLICIES), "open").otherwise("restricted")


def effective(rows: DataFrame, defaults: dict) -> DataFrame:
    """(id, max_file_size_bytes, timeout_seconds, retries, request_delay_seconds, require_https)."""
    most = F.coalesce("fetch.max_file_size_mb", F.lit(float(defaults.get("max_file_size_mb", 100))))
    return rows.select(
        "id", (most * 1024 * 1024).cast("long").alias("max_file_size_bytes"), F.lit(float(defaults.get("timeout_seconds", 60))).alias("timeout_seconds"), F.lit(int(defaults.get("retries", 3))).alias("retries"),
        F.lit(float(defaults.get("request_delay_seconds", 0.5))).alias("request_delay_seconds"), F.lit(bool(defaults.get("require_https", True))).alias("require_https"),
    )


def fetch_plan(rows: DataFrame) -> DataFrame:
    """(id, kind, url, filename, allowed_hosts): one row per address; a bundle's addresses and names must pair up.

    A collection's addresses are known once its listing is read: ``fetch.collections`` takes those sources, this refuses them.
    """
    bundle = F.col("fetch.kind") == "webpage_bundle"
    paired = F.size("fetch.urls") == F.size("fetch.filenames")
    pairs = F.when(bundle, F.when(paired, F.arrays_zip(F.col("fetch.urls").alias("url"), F.col("fetch.filenames").alias("filename"))).otherwise(F.raise_error("urls and filenames of a bundle must have equal lengths"))).otherwise(F.array(F.struct(F.col("fetch.url").alias("url"), F.col("fetch.filename").alias("filename"))))
    pairs = F.when(F.col("fetch.kind") == "govuk_raib_collection", F.raise_error("a collection is fetched by fetch.collections")).otherwise(pairs)
    return rows.select("id", F.col("fetch.kind").alias("kind"), F.explode(pairs).alias("p"), F.col("fetch.allowed_hosts").alias("allowed_hosts")).select("id", "kind", "p.url", "p.filename", "allowed_hosts")
