"""Line dedup on levelled sorted runs of line hashes, with DataFrame operations only.

A store of *runs* holds every line key once: rows (h1, h2, n_docs, max_doc), bucketed and sorted by hash, in tables of one
file a bucket under the shared folder. A batch of documents is reduced to one row per line key, in the same buckets and order.
The merge-anti-join with the runs, bucket by bucket without an exchange, decides what is new: those rows are the batch's own
run, of level 0. What the anti-join turns away is known already and goes to the *tallies*, which say how many documents more
hold a key and which is the largest. When a level holds ``fanout`` runs they are merged into one run of the next level;
their keys are disjoint, so nothing is added up, and a store of n batches has about fanout * log(n) runs.
A batch has about ``most_lines`` lines, so that their number and not their size grows with the corpus; beyond the least number of batches their
rows are dealt to folders first, so that each is read once.

The main path is native: ``split``, ``xxhash64``, joins and aggregates, no Python on executors.
A line key is held as two 64-bit hashes with different seeds. A line that a third of all documents
hold is one row per batch after the map-side aggregate; the join back to the documents is a sort-merge
join that can split a hot key, on rows of two hashes and a position.

Defined cases: a null or empty text is one empty line and stays; a null doc_id counts as one
document below all others; repeated rows with one doc_id count as one document and lose the same
lines; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import cut, drop_path, work_path

#: The white space that is stripped from a line's ends (fixed values of the line key).
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, n_docs long, max_doc long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, version, pos, key: every line with its key; version tells rows of one doc_id apart."""
    version = F.xxhash64("text")
    return docs.select("doc_id", version.alias("version"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")).select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))


def hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, version, pos, h1, h2 of the lines whose key has ``least_chars`` code points or more."""
    long = lines_of(docs).filter(F.length("key") >= least_chars)
    return long.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), F.col("key")).alias("h2"))


class LineRuns:
    """A levelled store of sorted runs. ``levels[i]`` names level i's tables; no key is in two of them."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.tallies: list[str] = []
        self.paths: dict[str, str] = {}

    def write(self, rows: DataFrame, deal: bool = False) -> str:
        """A table of ``rows`` in buckets, one sorted file each.

        ``deal`` brings the rows of a bucket together first; what an aggregate by key or a join of buckets made lies together already.
        """
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = work_path(self.spark, "line-run")
        rows = rows.select(*KEY, "n_docs", "max_doc")
        if deal:
            rows = rows.repartition(self.buckets, F.pmod(F.hash(*KEY), F.lit(self.buckets)))
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name]).option("compression", "zstd").saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, self.paths.pop(name))

    def rows(self) -> DataFrame:
        """All runs' rows."""
        parts = [self.spark.table(run) for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], RUN)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose key no run holds: merge-anti-joins in the order of the hashes."""
        for run in (run for level in self.levels for run in level):
            batch = batch.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Take a batch of rows (h1, h2, doc_id) of documents that no earlier batch held."""
        own = self.write(batch.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc")))
        if not any(self.levels):
            self.levels[0].append(own)
            return
        with in_order(self.spark):
            new = self.write(self.fresh(self.spark.table(own)))
            known = self.spark.table(own).join(self.spark.table(new).select(*KEY).hint("merge"), KEY, "left_anti")
            self.tallies.append(self.write(known))
        self.levels[0].append(new)
        self.drop(own)
        self._compact()

    def totals(self, least_docs: int = 1) -> DataFrame:
        """(h1, h2, n_docs, max_doc) of the keys that ``least_docs`` documents or more hold: every run's rows meet the tallies in their buckets."""
        if not self.tallies:
            return self.rows().filter(F.col("n_docs") >= least_docs)
        more = reduce(DataFrame.unionByName, [self.spark.table(t) for t in self.tallies]).groupBy(*KEY).agg(F.sum("n_docs").alias("more"), F.max("max_doc").alias("later"))
        n, top = (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "later").alias("max_doc")
        parts = [self.spark.table(run).join(more.hint("merge"), KEY, "left").select(*KEY, n, top).filter(F.col("n_docs") >= least_docs) for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, parts)

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.write(reduce(DataFrame.unionByName, [self.spark.table(run) for run in runs]), deal=True))
            self.levels[level] = []
            self.drop(*runs)
            level += 1

    def close(self) -> None:
        self.drop(*list(self.paths))


@contextmanager
def in_order(spark: SparkSession) -> Iterator[None]:
    """Plans made inside rely on the order of bucketed files (there is one a bucket), and on their buckets."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt(lines: DataFrame, batches: int, path: str) -> DataFrame:
    """The hashes in a folder for each batch, so that however many batches there are, each is read once; a batch lies in several files."""
    spark = lines.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), batches)
    lines.repartition(tasks, "batch", F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(-(-tasks // batches)))).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def repeated_lines(docs: DataFrame, least_chars: int, least_docs: int, least_batches: int = 3, most_lines: int = 100_000_000, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """(the hashed lines, the repeated keys with the doc_id that keeps them)."""
    lines = cut(hashed_lines(docs, least_chars), "line-hashes")
    batches = max(least_batches, -(-lines.count() // most_lines))
    runs = LineRuns(docs.sparkSession, fanout)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    parted = lines.withColumn("batch", batch)
    if batches > least_batches:
        path = work_path(docs.sparkSession, "line-batches")
        parted = dealt(parted, batches, path)
    for i in range(batches):
        runs.add(parted.filter(F.col("batch") == i))
    # written, so that the join with the lines reads two plain shuffles, of which Spark can split a hot line
    repeated = cut(runs.totals(least_docs).select(*KEY, "max_doc"), "line-repeated")
    runs.close()
    if batches > least_batches:
        drop_path(docs.sparkSession, path)
    return lines, repeated


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, least_batches: int = 3, most_lines: int = 100_000_000, fanout: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, ``kept_text`` (each text without its repeated lines) and ``rest``, a struct of all columns.

    A key of at least ``least_chars`` code points in at least ``least_docs`` documents loses its
    lines everywhere but in the largest doc_id that holds it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    lines, repeated = repeated_lines(docs, least_chars, least_docs, least_batches, most_lines, fanout)
    drops = (
        lines.join(repeated, KEY)
        .filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("version").alias("drop_version"))
        .agg(F.collect_set("pos").alias("drop"))
    )
    joined = docs.withColumn("version", F.xxhash64("text")).join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("version") == F.col("drop_version")), "left")
    parts = joined.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    n = F.size("lines")
    keep = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n"))
    return parts.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"), "rest")


def without_repeated_lines(docs: DataFrame, **parameters: int) -> DataFrame:
    """``docs`` with the repeated lines gone from its texts, n_chars (if there) following."""
    kept = line_dedup(docs, **parameters)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def line_digests(docs: DataFrame, **parameters: int) -> DataFrame:
    return line_dedup(docs, **parameters).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
