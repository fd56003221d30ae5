"""Approximate nearest neighbours by multi-index hashing (Norouzi et al., 2014) on learned codes.

Codes: unit vectors are centred, rotated by PCA and then by rotations learned with ITQ (Gong and
Lazebnik, 2011; from several random beginnings) on a bounded sample (``most_sample`` rows, those with the least hash of vec_id), and
the signs are the bits. The first rotation's code is split into substrings of 16 bits, and every block of rows
keeps one table per substring; all rotations together make a long code that tells distances more finely.

Search: by the pigeonhole principle a code within Hamming radius s * (a + 1) - 1 of the query has at
least one of its s substrings within a of the query's. Probing the tables with a = 0, 1, 2, ... hence
retrieves every code within that radius; the search stops at the first radius that holds ``share`` of the block's codes. Of
those the ``enough`` nearest by long code, and all that are as near as the last, are reranked by cosine in double
precision on the original vectors.

Distribution: every row is indexed, in the block where it is read; queries are broadcast in blocks
of ``most_queries`` rows (their number is counted first), each block of queries in its own pass.
A task keeps the k best per query of all its blocks, so what is shuffled is k rows per query and
task. No vector is shuffled.

Defined cases: vectors that are null, empty, zero, of another dimension than most, or hold null or non-finite components take
no part; a row with the query's vec_id is the query's own; repeated rows of one vec_id are one query
and one candidate; ties go to the smaller vec_id; with fewer than k candidates all are returned; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import map_batches

SUB = 16
FOUND = "query_id long, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Codes:
    """The learned maps from vectors to codes: of the first rotation as 16-bit substrings, of all as 64-bit words."""

    def __init__(self, sample: np.ndarray, rounds: int = 40, seed: int = 3, rotations: int = 4):
        x = unit(sample)
        d = x.shape[1]
        self.mean = x.mean(0)
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1]
        rng, v, self.axes = np.random.default_rng(seed), x @ axes, []
        for _ in range(rotations):
            r, _ = np.linalg.qr(rng.normal(size=(d, d)))
            for _ in range(rounds):  # the rotation that brings the projections closest to their signs
                left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (left @ right).T
            self.axes.append(axes @ r)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = unit(x) - self.mean
        bits = [x @ a >= 0 for a in self.axes]
        return _packed(bits[0], SUB).view(np.uint16), _packed(np.concatenate(bits, 1), 64).view(np.uint64)


def _packed(on: np.ndarray, unit_: int) -> np.ndarray:
    """Rows of bits as bytes, filled up to whole units."""
    wide = np.zeros((len(on), -(-on.shape[1] // unit_) * unit_), bool)
    wide[:, : on.shape[1]] = on
    return np.packbits(wide, 1)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


class Block:
    """The index of a block of rows: per substring, the rows in order of its value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes):
        self.ids, self.x = ids, x.astype(np.float64)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.code, self.long = codes.encode(x)
        self.tables = []
        for j in range(self.code.shape[1]):
            order = np.argsort(self.code[:, j], kind="stable")
            values, start = np.unique(self.code[order, j], return_index=True)
            self.tables.append((order, values, start, np.append(start[1:], len(order))))

    def within(self, code: np.ndarray, enough: int, skip: int) -> np.ndarray:
        """Rows whose code lies within the first probed radius that holds ``enough`` rows (or all rows)."""
        s = len(self.tables)
        away = [np.bitwise_count(values ^ code[j]) for j, (_, values, _, _) in enumerate(self.tables)]
        seen = np.zeros(len(self.ids), bool)
        far = np.zeros(len(self.ids), np.int64)
        for a in range(SUB + 1):
            for j, (order, _, start, end) in enumerate(self.tables):
                hit = np.flatnonzero(away[j] == a)  # nearer ones came in earlier turns
                rows = order[_ranges(start[hit], end[hit])]
                rows = rows[~seen[rows]]
                seen[rows] = True
                far[rows] = np.bitwise_count(self.code[rows] ^ code).sum(1)
            near = np.flatnonzero(seen & (far <= s * (a + 1) - 1))
            if len(near) >= enough + skip:
                return near
        return np.flatnonzero(seen)

    def search(self, query_id: int, q: np.ndarray, code: np.ndarray, long: np.ndarray, k: int, share: float, enough: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.within(code, max(enough, int(share * len(self.ids))), 1)
        rows = rows[self.ids[rows] != query_id]
        if len(rows) > enough:
            far = np.bitwise_count(self.long[rows] ^ long).sum(1, dtype=np.int64)
            rows = rows[far <= np.partition(far, enough - 1)[enough - 1]]
        score = self.x[rows] @ q / (self.norm[rows] * np.sqrt(q @ q))
        edge = np.partition(score, -k)[-k] - 1e-9 if len(rows) > k else -np.inf
        rows = rows[score >= edge]
        score = (self.x[rows] * q).sum(1) / (self.norm[rows] * np.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, share: float = 0.1, enough: int = 400, most_sample: int = 8192, most_queries: int = 16_384, block: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest of every row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL").filter(usable(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if usual is None:
        return none
    rows = rows.filter(F.size("v") == usual.d)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_sample).toArrow()
    codes = Codes(_matrix(sample.column("v")))
    asked = rows.filter(F.col("vec_id") % every == 0)
    count = asked.count()
    if not count:
        return none
    parts = -(-count // most_queries)
    found = None
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toArrow()
        if not own.num_rows:
            continue
        ids, first = np.unique(np.asarray(own.column("vec_id")), return_index=True)
        got = map_batches(rows, FOUND, _searcher(spark, ids, _matrix(own.column("v"))[first], codes, k, share, enough, block))
        found = got if found is None else found.unionByName(got)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(spark, ids: np.ndarray, queries: np.ndarray, codes: Codes, k: int, share: float, enough: int, block: int):
    sent = spark.sparkContext.broadcast((ids, queries, codes, codes.encode(queries)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, codes, (asked, asked_long) = sent.value
        best_id, best = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)

        def take(index: Block) -> None:
            for i in range(len(ids)):
                near, score = index.search(int(ids[i]), queries[i], asked[i], asked_long[i], k, share, enough)
                near, score = np.concatenate([best_id[i], near]), np.concatenate([best[i], score])
                order = np.lexsort((near, -score))
                _, once = np.unique(near[order], return_index=True)  # repeated rows of one vec_id count once
                order = order[np.sort(once)][:k]
                best_id[i, : len(order)], best[i, : len(order)] = near[order], score[order]

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((np.asarray(batch.column("vec_id")), _matrix(batch.column("v"))))
            if sum(len(h[0]) for h in held) >= block:
                take(Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), codes))
                held.clear()
        if held and sum(len(h[0]) for h in held):
            take(Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), codes))
        ok = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[ok.ravel()]), pa.array(best_id[ok]), pa.array(best[ok])], ["query_id", "vec_id", "score"])

    return work


def brute_force(ids: np.ndarray, x: np.ndarray, k: int = 5, every: int = 50) -> dict[int, list[tuple[int, float]]]:
    """Every query's k nearest by comparing it with all rows (for tests and for measuring recall)."""
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(1) / (norm * np.sqrt((x[i] * x[i]).sum()))
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out
