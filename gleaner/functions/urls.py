"""URLs, file names and policies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Policies under which raw files may be kept openly (fixed values of the manifest format).
OPEN_POLICIES = ("raw_allowed_with_attribution", "raw_allowed_noncommercial_sharealike", "raw_allowed_with_third_party_exclusions")
POLICIES = (*OPEN_POLICIES, "manifest_only")


def safe_filename(value: Column) -> Column:
    """Percent-decoded, other characters as one hyphen, 180 characters at most, never empty."""
    decoded = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    cleaned = F.substring(F.btrim(F.regexp_replace(decoded, "[^A-Za-z0-9._-]+", "-"), F.lit("-._")), 1, 180)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("download"))


def url_allowed(url: Column, hosts: Column, https_only: bool = True) -> Column:
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    schemes = ("https",) if https_only else ("http", "https")
    return F.coalesce(scheme.isin(*schemes) & F.array_contains(F.transform(hosts, F.lower), host), F.lit(False))


def glob_pattern(glob: Column) -> Column:
    """A file pattern (*, ?) as a regular expression."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\\\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def member_allowed(name: Column, globs: Column, suffixes: tuple[str, ...] = ("pdf", "html", "htm", "md", "txt")) -> Column:
    """An archive member with a relative path, no way up, a known suffix and (if there are any) a matching pattern."""
    safe = ~name.startswith("/") & ~F.array_contains(F.split(name, "/"), "..")
    known = F.lower(F.substring_index(name, ".", -1)).isin(*suffixes) & F.substring_index(name, "/", -1).rlike(r"^.+\.[^.]+$")
    return safe & known & ((F.size(globs) == 0) | F.exists(globs, lambda g: F.regexp_like(name, glob_pattern(g))))


def magic_ok(content: Column, name: Column) -> Column:
    """A .pdf begins like one, and so does a .zip."""
    suffix = F.lower(F.substring_index(name, ".", -1))
    head = F.decode(F.substring(content, 1, 5), "ISO-8859-1")
    return F.when(suffix == "pdf", head == "%PDF-").when(suffix == "zip", head.startswith("PK")).otherwise(True)
