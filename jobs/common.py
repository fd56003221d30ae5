"""What both jobs share: configuration, logging and tables that may not be there yet."""

from __future__ import annotations

import logging
import sys
import tomllib
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent


def read_config(path: str | Path) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def logger(name: str) -> logging.Logger:
    log = logging.getLogger(f"jobs.{name}")
    if not logging.getLogger("jobs").handlers:
        out = logging.StreamHandler(sys.stderr)
        out.setFormatter(logging.Formatter("%(asctime)s %(name)s %(message)s"))
        logging.getLogger("jobs").addHandler(out)
        logging.getLogger("jobs").setLevel(logging.INFO)
    return log


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
