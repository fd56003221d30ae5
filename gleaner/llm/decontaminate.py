"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of the benchmark items. The alphabet is words, a block is two
consecutive words, and patterns of one length form a class with its own tables:

* ``shift``: block -> how far the search may move when the text's current block is this one. A
  block in no pattern lets it skip the whole window but one word.
* ``bucket``: hash of a pattern's last block -> the patterns that end in it, with their first words,
  tried when the shift is 0.
* a candidate is confirmed by comparing its words with the text's directly.

Items shorter than the window are patterns of their own length, with a block of one word if they
have only one. Documents are read once and nothing of them is shuffled.

The benchmark is broadcast in shards of at most ``most_bytes`` of item text (its size is measured
first); with more than one shard, each document's hits from all shards are merged by key.

Defined cases: a null text or one without words has no words and isn't contaminated; an item that
is null or without words has no window; items with equal texts all count; an item with a null id marks words as hit but isn't
listed; repeated rows are judged each by itself; empty tables work; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import WORKER, id_text, map_batches, sha256_hex, slices

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Bytes of texts that a task works on at once.
SLICE = 4_000_000
#: Bytes that belong to words keep themselves (A-Z in lower case); others part words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class WuManber:
    """Patterns of one length, each a tuple of words with the numbers of its items."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[int, list[tuple[bytes, tuple[bytes, ...], set[int]]]] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                b = b" ".join(words[end - self.block : end])
                self.shift[b] = min(self.shift.get(b, self.far), length - end)
            self.bucket[hash(b)].append((words[0], words, items))

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of each occurrence, in order."""
        shift, far, m, n = self.shift.get, self.far, self.length, len(text)
        two, at = self.block == 2, m - 1
        while at < n:
            b = text[at - 1] + b" " + text[at] if two else text[at]
            move = shift(b, far)
            if move:
                at += move
                continue
            start = at - m + 1
            for first, words, items in self.bucket.get(hash(b), ()):
                if text[start] == first and tuple(text[start : at + 1]) == words:
                    yield start, items
            at += 1


def automata(items: list[tuple[int, list[bytes]]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for number, words in items:
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            by_length[k][tuple(words[i : i + k])].add(number)
    return [WuManber(k, p) for k, p in sorted(by_length.items())]


def search(tables: list[WuManber], text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged runs [start, end) of hit words, and the numbers of the items that occur."""
    found, items = [], set()
    for t in tables:
        for start, own in t.occurrences(text):
            found.append((start, start + t.length))
            items |= own
    runs: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    return runs, items


def _shards(items: DataFrame, most_bytes: int) -> int:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // most_bytes))


def _key(texts: list[str], window: int) -> str:
    """Under which a worker keeps the automata of these texts between its tasks."""
    return f"decontaminate:{window}:{sha256_hex(chr(0).join(texts).encode())}"


def _held(key: str, make: Callable[[], list[WuManber]]) -> list[WuManber]:
    """The automata that the worker holds; it holds those of one shard at a time."""
    if WORKER.get("automata", (None,))[0] != key:
        WORKER.pop("automata", None)
        WORKER["automata"] = key, make()
    return WORKER["automata"][1]


def _hits(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """doc_id, version, n_words, runs, items of each document against one shard."""
    rows = [(i, t) for i, t in items.select("item_id", "text").toLocalIterator() if t]
    sent = docs.sparkSession.sparkContext.broadcast(([i for i, _ in rows], [t for _, t in rows]))
    key = _key([t for _, t in rows], window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts = sent.value
        tables = _held(key, lambda: automata([(k, words_of(t)) for k, t in enumerate(texts)], window))
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            n, runs, own = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found, numbers = search(tables, words)
                n.append(len(words))
                runs.append([{"s": s, "e": e} for s, e in found])
                own.append([str(i) for k in numbers if (i := names[k]) is not None])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast("int64"), batch.column("version"), pa.array(n, "int64"), pa.array(runs, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(own, pa.list_(pa.string()))],
                ["doc_id", "version", "n_words", "runs", "items"],
            )

    return map_batches(docs.withColumn("version", F.xxhash64("text")), "doc_id long, version long, n_words long, runs array<struct<s:int,e:int>>, items array<string>", work)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, most_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, runs (hit spans of words) and items (ids as text, each once) per document."""
    docs, items = id_text(docs), id_text(benchmark, "item_id").withColumnRenamed("doc_id", "item_id")
    shards = _shards(items, most_bytes)
    if shards == 1:
        found = _hits(docs, items, window)
    else:  # equal rows have equal hits, so merging by doc_id and version keeps each right
        parts = [_hits(docs, items.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == i), window) for i in range(shards)]
        key = ["doc_id", "version"]
        merged = None
        for part in parts:
            part = part.select(*key, "n_words", "runs", "items").dropDuplicates(key)  # one row for each shard is gathered, however often a row is repeated
            merged = part if merged is None else merged.unionByName(part)
        merged = merged.groupBy(*key).agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
        base = docs.select("doc_id", F.xxhash64("text").alias("version"))
        m = merged.withColumnsRenamed({k: f"m_{k}" for k in key})
        found = base.join(m, F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("version") == F.col("m_version"))).select(*key, "n_words", "runs", "items")
    joined = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["upto"], r["s"]))).alias("n"), F.greatest(a["upto"], r["e"]).alias("upto")),
    )
    return found.select("doc_id", "version", "n_words", joined["n"].cast("long").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "runs")


def judge_rows(found: DataFrame, share: int) -> DataFrame:
    return found.filter((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def judge(found: DataFrame, share: int = 20) -> DataFrame:
    """The contract's digest columns: contaminated from 1/``share`` of the words on."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, most_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated; one pass over them for each shard of the benchmark.

    A document that only several shards together contaminate is found by merging their hits, so with more than
    one shard the verdicts are joined to the rows.
    """
    items = id_text(benchmark, "item_id").withColumnRenamed("doc_id", "item_id")
    if _shards(items, most_bytes) > 1:
        rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("version"))
        bad = judge_rows(contamination(docs, benchmark, window, most_bytes), share).select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")).distinct()
        return rows.join(bad, rows["id"].eqNullSafe(bad["bad_id"]) & (rows["version"] == bad["bad_version"]), "left_anti").select("row.*")
    texts = [t for (t,) in items.select("text").toLocalIterator() if t]
    sent = docs.sparkSession.sparkContext.broadcast(texts)
    key = _key(texts, window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _held(key, lambda: automata([(k, words_of(t)) for k, t in enumerate(sent.value)], window))
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            clean = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                hit = sum(e - s for s, e in search(tables, words)[0])
                clean.append(not hit or share * hit < len(words))
            yield batch.filter(pa.array(clean, "bool"))

    return map_batches(docs, docs.schema, work)


def brute_force(texts: list[str | None], items: list[tuple[int, str | None]], window: int = 13) -> list[tuple[int, int, int, str, bool]]:
    """What ``judge`` returns for each text but doc_id, by comparing every position (for tests)."""
    out = []
    for text in texts:
        w, hit, own = words_of(text), set(), set()
        for i, t in items:
            v = words_of(t)
            k = min(window, len(v))
            for a in range(len(v) - k + 1 if k else 0):
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == v[a : a + k]:
                        hit.update(range(s, s + k))
                        own.add(str(i))
        out.append((len(w), len(hit), len(own), sha256_hex(",".join(sorted(own)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out
