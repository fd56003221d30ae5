"""Writing results: tables by Spark's committer, small reports atomically on the driver."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line; the committer makes the files visible together."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet; chunks partitioned by source_id let readers skip other sources."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_report(path: str | Path, value: dict) -> None:
    """A small JSON file, complete or not there: written beside its place and moved onto it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(suffix=".part", dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
