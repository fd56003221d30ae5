"""BM25 over chunks, for whole tables of queries, on an inverted index of written tables.

The index is made in one pass over the texts: chunks are ranged by id, and each task turns stretches of them (*shards*, of counted size)
into postings, one row for each (shard, token), and a row that lists the shard's chunks and their lengths. Rows lie in folders by the
hash of the token, the vocabulary (token, df, idf) likewise, so that a search opens its own tokens' folders only and its cost does not
grow with the other tokens. Postings hold, for every block of them, the largest term frequency and the least length: a bound on the
score that any of the block can add.

A search brings the postings of its tokens together by shard and, in each shard, adds up a query's tokens from the weightiest
to the least (MaxScore). Once the k-th best sum so far exceeds what the tokens to come can add to a chunk that has none yet, only
chunks that may still reach it are looked up in the rest, and the blocks' bounds drop most of these first. No result depends on
what is skipped. A shard sends on k rows a query.

idf is ln(N - df + 0.5) - ln(df + 0.5); a negative one is replaced by epsilon times the mean idf. Every chunk is ranked,
those without a query token with score 0, ties to the smaller chunk id. Where weights are negative (in tiny
collections) nothing is skipped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.config import Bm25Config
from gleaner.functions import pytext
from gleaner.operators.topk import top_k
from gleaner.session import cut, ship, sliced, spread, work_path

#: How a run of CJK characters becomes tokens; a segmenter with a dictionary can take the place of the default.
Segmenter = Callable[[str], list[str]]
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: A shard ends at so many chunks or postings; a block is so many postings.
SHARD_CHUNKS, SHARD_POSTINGS, BLOCK = 1 << 14, 1 << 21, 128
#: The folder of the rows that list the shards' chunks.
LISTS = -1


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame  # bucket, shard, token, places, tfs, block_tf, block_dl; in bucket LISTS: shard, ids, tfs (the chunks' lengths)
    vocabulary: DataFrame  # token, df, idf, bucket
    n: int
    avgdl: float
    avg_idf: float
    n_terms: int
    buckets: int
    config: Bm25Config
    segment: Segmenter

    @property
    def stats(self) -> DataFrame:
        return self.postings.sparkSession.createDataFrame([(self.n, self.avgdl, self.avg_idf, self.n_terms)], "n long, avgdl double, avg_idf double, n_terms long")


def titled(chunks: DataFrame) -> Column:
    return F.concat_ws(" ", "title", "text")


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def counted_tokens(texts: DataFrame, id_col: str, text: Column, segment: Segmenter) -> DataFrame:
    """(id, dl, tokens, tfs) of each row's text: how many tokens, the distinct ones, and how often each occurs."""
    ship(texts.sparkSession)
    kind = dict(texts.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = [Counter(pytext.tokens(t or "", segment)) for t in batch.column(1).to_pylist()]
            at = pa.array(np.cumsum([0, *map(len, found)]), "int32")
            tokens = pa.ListArray.from_arrays(at, pa.array([t for c in found for t in c], "string"))
            tfs = pa.ListArray.from_arrays(at, pa.array([n for c in found for n in c.values()], "int32"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.total() for c in found], "int64"), tokens, tfs], [id_col, "dl", "tokens", "tfs"])

    return texts.select(id_col, text.alias("text")).mapInArrow(work, f"{id_col} {kind}, dl long, tokens array<string>, tfs array<int>")


def _lists(at: np.ndarray, values: np.ndarray, kind: str = "int32") -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, "int32"), pa.array(values, kind))


def _numbered(own: Counter[str], names: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' numbers in ``names``, which gets those it lacks, and how often each occurs."""
    return np.fromiter((names.setdefault(t, len(names)) for t in own), np.int32, len(own)), np.fromiter(own.values(), np.int32, len(own))


def _shard(shard: int, ids: list, counts: list[Counter[str]] | list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType, names: dict[str, int] | None = None) -> pa.RecordBatch:
    """The rows of one shard: its list of chunks, then its postings by token. ``counts``: of each chunk how often each token occurs, by numbers if there are ``names``."""
    if names is None:
        names = {}
        counts = [_numbered(own, names) for own in counts]
    sizes = [len(tfs) for _, tfs in counts]
    lengths = np.array([tfs.sum() for _, tfs in counts], np.int32)
    words, code, tf = pa.array(list(names), "string"), np.concatenate([c for c, _ in counts]), np.concatenate([tfs for _, tfs in counts])
    place = np.repeat(np.arange(len(counts), dtype=np.int32), sizes)
    rank = np.empty(len(words), np.int64)
    by_token = np.asarray(pc.sort_indices(words))
    rank[by_token] = np.arange(len(words))
    order = np.argsort(rank[code], kind="stable") if len(code) else np.zeros(0, np.int64)
    place, tf = place[order], tf[order]
    start = np.searchsorted(rank[code][order], np.arange(len(words) + 1)) if len(code) else np.zeros(1, np.int64)
    blocks = -(-np.diff(start) // BLOCK)
    block_at = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    first = np.repeat(start[:-1], blocks) + (np.arange(block_at[-1]) - np.repeat(block_at[:-1], blocks)) * BLOCK
    most_tf = np.maximum.reduceat(tf, first) if len(first) else tf
    least_dl = np.minimum.reduceat(lengths[place], first) if len(first) else tf
    n = len(words) + 1
    nothing = np.zeros(1, np.int64)
    with_list = lambda at: np.concatenate([nothing, at])  # noqa: E731  the first row is the list of chunks
    columns = [
        pa.array(np.full(n, shard), "int64"),
        pa.concat_arrays([pa.array([""]), words.take(pa.array(by_token))]),
        pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * n, "int32"), pa.array(ids, kind)),
        _lists(with_list(start), place),
        _lists(np.concatenate([nothing, start + len(ids)]), np.concatenate([lengths, tf])),
        _lists(with_list(block_at), most_tf),
        _lists(with_list(block_at), least_dl),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "token", "ids", "places", "tfs", "block_tf", "block_dl"])


def _shards(segment: Segmenter, kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, counts, postings, shard = [], {}, [], 0, None
        for batch in sliced(batches, "text"):
            for row, name, text in zip(*(batch.column(c).to_pylist() for c in ("row", "chunk_id", "text")), strict=True):
                shard = row if shard is None else shard
                ids.append(name)
                own = Counter(pytext.tokens(text or "", segment))
                counts.append(_numbered(own, names))
                postings += len(own)
                if len(ids) >= SHARD_CHUNKS or postings >= SHARD_POSTINGS:
                    yield _shard(shard, ids, counts, kind, names)
                    ids, names, counts, postings, shard = [], {}, [], 0, None
        if ids:
            yield _shard(shard, ids, counts, kind, names)

    return work


def build_index(chunks: DataFrame, text: Column | None = None, config: Bm25Config = Bm25Config(), segment: Segmenter = pytext.pairs, buckets: int | None = None) -> Bm25Index:
    """Index the ``chunk_id`` and text of ``chunks`` (by default title and text); texts are read and shuffled once."""
    spark = chunks.sparkSession
    ship(spark)
    kind = dict(chunks.dtypes)["chunk_id"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = chunks.select("chunk_id", (titled(chunks) if text is None else text).alias("text")).repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id")
    made = ranged.select(F.monotonically_increasing_id().alias("row"), "chunk_id", "text").mapInArrow(_shards(segment, ARROW[kind]), f"shard long, token string, ids array<{kind}>, places array<int>, tfs array<int>, block_tf array<int>, block_dl array<int>")
    rows = made.withColumn("bucket", F.when(F.col("token") == "", LISTS).otherwise(bucket_of(F.col("token"), buckets)))
    path = work_path(spark, "lexical-index")
    rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "token", "shard").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    postings = spark.read.schema(rows.schema).parquet(path)
    lists = postings.filter(F.col("bucket") == LISTS)
    n, total = lists.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    avgdl = total / n if n else None
    df = cut(postings.filter(F.col("bucket") != LISTS).groupBy("token").agg(F.sum(F.size("places")).alias("df")), "lexical-df")
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    avg_idf, n_terms = df.agg(F.avg(raw), F.count(F.lit(1))).first()
    idf = F.when(raw < 0, F.lit(config.epsilon * (avg_idf or 0.0))).otherwise(raw)
    words = df.select("token", "df", idf.alias("idf"), bucket_of(F.col("token"), buckets).alias("bucket"))
    path = work_path(spark, "lexical-vocabulary")
    words.repartition(parts, "bucket").write.partitionBy("bucket").parquet(path)
    return Bm25Index(postings, spark.read.schema(words.schema).parquet(path), n, avgdl, avg_idf, n_terms, buckets, config, segment)


def bm25_search(index: Bm25Index, queries: DataFrame, k: int, most_weights: int = 1_000_000, most_queries: int = 4096) -> DataFrame:
    """query_id, chunk_id, score, rank, stage of the ``k`` best chunks of each query (query_id, query).

    Queries are dealt to blocks of about ``most_weights`` (query, token) pairs and ``most_queries`` queries (counted first),
    and a block's weights are broadcast.
    """
    spark = queries.sparkSession
    asked = counted_tokens(spread(queries), "query_id", F.col("query"), index.segment)
    pairs = asked.select("query_id", F.explode_outer(F.arrays_zip("tokens", "tfs")).alias("t")).groupBy("query_id", F.col("t.tokens").alias("token")).agg(F.sum("t.tfs").alias("qtf"))
    pairs = cut(pairs.withColumn("bucket", bucket_of(F.col("token"), index.buckets)), "lexical-queries")
    n_pairs, n_queries, opened = pairs.agg(F.count(F.lit(1)), F.approx_count_distinct("query_id"), F.collect_set("bucket")).first()  # buckets are few
    blocks = max(1, -(-n_pairs // most_weights), -(-n_queries // most_queries))
    words = index.vocabulary.filter(F.col("bucket").isin(opened)).select("token", "idf")
    weights = pairs.join(words, "token", "left").select("query_id", "token", "bucket", (F.col("qtf") * F.col("idf")).alias("weight"))
    kinds = dict(index.postings.dtypes)["ids"][6:-1], dict(queries.dtypes)["query_id"]
    found = None
    for block in range(blocks):
        own = weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        sent = spark.sparkContext.broadcast(_weighted(own, index.config))
        part = _tokens_of(index, pairs.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block), opened).groupBy("shard").applyInArrow(_best(sent, index, k, kinds), f"query_id {kinds[1]}, chunk_id {kinds[0]}, score float")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k).select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), "rank", F.lit("bm25").alias("stage"))


def _tokens_of(index: Bm25Index, pairs: DataFrame, opened: list[int]) -> DataFrame:
    """The lists of chunks, and the postings of the tokens in ``pairs`` (of counted size) from the folders that may hold them."""
    tokens = F.broadcast(pairs.filter("token IS NOT NULL").select("token").distinct())
    columns = ["shard", "token", "ids", "places", "tfs", "block_tf", "block_dl"]
    lists = index.postings.filter(F.col("bucket") == LISTS).select(*columns)
    return lists.unionByName(index.postings.filter(F.col("bucket").isin(opened)).join(tokens, "token", "left_semi").select(*columns))


def _weighted(own: pa.Table, config: Bm25Config) -> tuple[list, list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """(query ids, known tokens, of each query its tokens' places and weights, the weightiest first)."""
    ids = own.column("query_id").unique()
    known = own.filter(pc.is_valid(own.column("weight")))
    tokens = known.column("token").unique()
    token, query = (np.asarray(pc.index_in(known.column(c), v)).astype(np.int64) for c, v in (("token", tokens), ("query_id", ids)))
    weight = np.asarray(known.column("weight"), np.float64) * (config.k1 + 1)
    names = np.asarray(known.column("token").to_pylist(), dtype=object)
    order = sorted(range(len(query)), key=lambda i: (query[i], -weight[i], names[i]))  # the same in every shard, so equal chunks have equal sums
    token, weight = token[order], weight[order]
    at = np.searchsorted(query[order], np.arange(len(ids) + 1))
    return ids.to_pylist(), tokens.to_pylist(), [(token[a:z], weight[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]


class Shard:
    """A shard's postings for the tokens asked, and the search in it."""

    def __init__(self, table: pa.Table, c: Bm25Config, avgdl: float):
        table = table.combine_chunks()
        names = table.column("token").to_pylist()
        head = names.index("")
        self.ids = table.column("ids")[head].values
        self.n = len(self.ids)
        norm = lambda dl: c.k1 * (1 - c.b + c.b * dl / avgdl)
        self.norm = norm(np.asarray(table.column("tfs")[head].values, np.float64))
        self.postings: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for i, name in enumerate(names):
            if name:
                places, tfs, tops, lows = (np.asarray(table.column(col)[i].values) for col in ("places", "tfs", "block_tf", "block_dl"))
                self.postings[name] = places, tfs / (tfs + self.norm[places]), tops / (tops + norm(lows.astype(np.float64)))
        self.sums = np.zeros(self.n)
        self.skipped = 0

    def best(self, tokens: list[str], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores of single precision) of the ``k`` best, ties to the smaller place."""
        own = [(w, *self.postings[t]) for t, w in zip(tokens, weights.tolist(), strict=True) if t in self.postings]
        may = np.array([w * bounds.max() for w, _, _, bounds in own])
        rest = np.append(np.cumsum(may[::-1])[::-1], 0.0)  # what the tokens from here on can add
        self.sums[:] = 0
        few, look = None, rest[0] / 2 if not len(may) or may.min() >= 0 else -np.inf
        for i, (w, places, parts, bounds) in enumerate(own):
            if few is None and self.n > 4 * k and rest[i] <= look:
                edge = self._edge(k)
                if rest[i] < edge:
                    few = np.flatnonzero(self.sums + rest[i] >= edge)
                look = rest[i] / 2
            if few is None or len(few) * 8 > len(places):
                self.sums[places] += w * parts
                continue
            at = np.searchsorted(places, few)
            block = np.minimum(at, len(places) - 1) // BLOCK
            few_may = self.sums[few] + w * bounds[block] + rest[i + 1] >= edge
            self.skipped += len(few) - int(few_may.sum())
            few, at = few[few_may], at[few_may]
            at = np.minimum(at, len(places) - 1)
            hit = places[at] == few
            self.sums[few[hit]] += w * parts[at[hit]]
        places = np.arange(self.n) if few is None else few
        scores = self.sums[places].astype(np.float32)
        if len(scores) > k:
            edge = np.partition(scores, -k)[-k]
            above = np.flatnonzero(scores > edge)
            near = np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])
            places, scores = places[near], scores[near]
        return places, scores

    def _edge(self, k: int) -> float:
        """A little below the k-th best sum so far, by more than single precision can blur."""
        edge = np.partition(self.sums, -k)[-k]
        return edge - 1e-6 * abs(edge)


def _best(sent: Broadcast, index: Bm25Index, k: int, kinds: tuple[str, str]):
    c, avgdl = index.config, index.avgdl or 1.0

    def work(table: pa.Table) -> pa.Table:
        ids, tokens, asked = sent.value
        shard = Shard(table, c, avgdl)
        rows, scores, names = [], [], []
        for q, (own, weights) in enumerate(asked):
            places, found = shard.best([tokens[t] for t in own.tolist()], weights, k)
            rows.append(np.full(len(places), q))
            names.append(places)
            scores.append(found)
        rows, names, scores = (np.concatenate(x) if x else np.zeros(0) for x in (rows, names, scores))
        query = pa.array(ids, ARROW[kinds[1]]).take(pa.array(rows.astype(np.int64)))
        return pa.table({"query_id": query, "chunk_id": shard.ids.take(pa.array(names.astype(np.int64))).cast(ARROW[kinds[0]]), "score": pa.array(scores.astype(np.float32))})

    return work
