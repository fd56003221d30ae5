"""What goes into a release archive, and the archive itself."""

from __future__ import annotations

import hashlib
import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the release format.
ROOT_FILES = (".gitignore", "README.md", "requirements.txt", "source_manifest.yaml")
ROOT_FOLDERS = ("configs", "docs", "evaluation", "scripts", "src", "tests")
LEFT_OUT_NAMES = (".DS_Store", "__pycache__")
LEFT_OUT_SUFFIXES = (".pyc", ".part")
FORBIDDEN = ("data/raw/", "data/processed/", "data/cache/", ".venv/", "artifacts/")


def allowed(path: Column) -> Column:
    """A relative path (with /) that a release may hold."""
    parts = F.split(path, "/")
    left_out = F.arrays_overlap(parts, F.array(*map(F.lit, LEFT_OUT_NAMES)))
    for suffix in LEFT_OUT_SUFFIXES:
        left_out = left_out | path.endswith(suffix)
    return ~left_out & F.when(F.size(parts) == 1, path.isin(*ROOT_FILES)).otherwise(parts[0].isin(*ROOT_FOLDERS))


def forbidden(path: Column) -> Column:
    hit = F.lit(False)
    for marker in FORBIDDEN:
        hit = hit | F.contains(path, F.lit(marker))
    return hit


def demo_sample(chunks: DataFrame, source_id: str, count: int = 12) -> DataFrame:
    """The first chunks of one source, in the order of the corpus."""
    return chunks.filter(F.col("source_id") == source_id).orderBy("document_id", "chunk_index").limit(count)


def build_archive(spark, root: str, target: str, most_mb: int = 50) -> dict:
    """Zip the allowed files below ``root``; forbidden paths and too large an archive are errors."""
    names = [os.path.relpath(os.path.join(d, f), root).replace(os.sep, "/") for d, _, files in os.walk(root) for f in files]
    listing = spark.createDataFrame([(n,) for n in names], "path string").filter(allowed(F.col("path")))
    bad = listing.filter(forbidden(F.col("path"))).first()
    if bad:
        raise ValueError(f"forbidden path {bad.path}")
    chosen = [r.path for r in listing.orderBy("path").toLocalIterator()]
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name in chosen:
            z.write(os.path.join(root, name), name)
    size = os.path.getsize(target)
    if size > most_mb << 20:
        os.remove(target)
        raise ValueError(f"archive of {size} bytes is over {most_mb} MB")
    return {"files": len(chosen), "bytes": size, "sha256": hashlib.sha256(Path(target).read_bytes()).hexdigest()}
