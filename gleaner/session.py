"""Session helpers shared by the operators: the shared work folder and code shipping."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

_shipped: set[str] = set()
#: Bytes of texts that an Arrow function turns into Python objects together.
SLICE = 1 << 20


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleaner")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only a local master, where every task runs on this machine,
    may do without: there a temporary folder is made once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a file that outlives executors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it comes from fewer files than there are cores.

    Few files are few row groups, often one, and a row group is read by one task; many files fill the cores by themselves and stay as they are,
    and so does a stream.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    It acts when the driver's JVM collects garbage, which a driver with little to do seldom does by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def done_with(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and the shuffles of their making."""
    spark = tables[0].sparkSession
    for path in {p.rsplit("/", 1)[0] for t in tables for p in t.inputFiles()}:
        drop_path(spark, path)
    free(spark)


def cuts_of(texts: pa.Array, most_bytes: int = SLICE) -> list[tuple[int, int]]:
    """(start, length) of stretches of texts that hold about ``most_bytes`` at most (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    found, start = [], 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        found.append((start, end - start))
        start = end
    return found


def sliced(batches: Iterator[pa.RecordBatch], column: int | str, most_bytes: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts hold about ``most_bytes`` at most: what a worker makes of one does not grow with a partition's rows."""
    for batch in batches:
        for start, length in cuts_of(batch.column(column), most_bytes):
            yield batch.slice(start, length)


def text_udf(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of one text as a column function, a stretch of the texts at a time; a null stays null."""

    def work(texts: pa.Array) -> pa.Array:
        parts = [pa.array([None if t is None else f(t) for t in texts.slice(*at).to_pylist()], "string") for at in cuts_of(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], "string")

    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return F.arrow_udf(work, StringType())


def arrow_udf(f: Callable, kind: DataType) -> Callable[..., Column]:
    """A pandas function of this package as a column function; the package goes to the executors with it."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return F.pandas_udf(f, kind)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="gleaner-code-")  # the driver serves the file as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    clean = Path(folder, "src")
    shutil.copytree(root, clean / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(Path(folder, f"{root.name}-code")), "zip", clean))
    _shipped.add(app)
