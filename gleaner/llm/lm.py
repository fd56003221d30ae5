"""LM scoring: every text's log10 probability under a gated recurrent model and under smoothed counts.

1. Token counts over all training documents: each task counts its own words, counts are summed by
   word. They grow with the corpus and stay distributed; to the driver go totals, per rare class and overall, and
   the words above a count that at most ``most_frequent`` words exceed (a histogram of at most some hundred bins finds it).
2. The network (``recurrent.py``) is fitted by truncated backpropagation on all training documents, each once, in rounds
   that take a sixteenth, a quarter and all of them (by hash) less what came before. In a round every task carries the weights of the
   last one on over its texts, long ones from window to window with the state kept, and the tasks' weights are averaged by their
   tokens. Rounds of few tokens have few tasks (``least_tokens`` for each, if there are as many), as an average of hardly begun
   networks says little. Weights are of fixed size and are summed by block on executors.
3. One pass scores whole documents, the state being carried from window to window. Words above the
   count are looked up in the broadcast table; the others leave as (document, word, n), meet their counts in
   a join, and come back summed by document.

Base score: sum over tokens of log10((c + 1) / (N + V + 1)), as (c + 1) / (N + 1 * (V + 1)). In the
model, a word without an output vector has (c + 1) / (N_k + V_k + 1) of its class k.

Defined cases: a null or empty text is its end token alone; a null doc_id isn't held out; repeated
rows are counted and scored each by itself; without training documents all counts are 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import id_text, map_batches, slices
from gleaner.llm.quality import held_out
from gleaner.llm.recurrent import RARE, Adam, Gru, rare_class
from gleaner.llm.shingles import UPPER
from gleaner.session import cut, done_with

END = b"\n"  # no word holds a line feed
ROUNDS = (4, 16, 64)  # how many of 64 parts of the documents are learned from after each round
BLOCK = 8192  # weights that are summed together
INSIDE = bytes(not bytes([i]).isspace() for i in range(256))  # which bytes are a word's
LONGEST = 64  # bytes of a word in the broadcast table
TOGETHER = 1 << 21  # tokens of documents that the network scores together
NAMES = ["doc_id", "rid", "held_out", "n_tokens", "n_known", "logs", "plain", "word", "n"]
SCORED = "doc_id long, rid long, held_out boolean, n_tokens long, n_known long, logs double, plain double, word binary, n long"


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the tokens of all texts, how many each text has), by the letters of all texts at once."""
    texts = pc.binary_join_element_wise(texts, "", END.decode(), null_handling="replace", null_replacement="")  # each with its end
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    letters = memoryview(texts.buffers()[2])[ends[0] : ends[-1]].tobytes().translate(UPPER)
    ends = ends[1:] - ends[0] - 1
    inside = np.frombuffer(letters.translate(INSIDE), np.bool_)
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # words begin and stop in turn, as the last letter is an end
    n = np.searchsorted(edges[::2], ends)  # words before each end
    size = np.insert(edges[1::2] - edges[::2], n, 1)
    kept = inside.copy()
    kept[ends] = True
    at = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=at[1:])
    own = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.frombuffer(letters, np.uint8)[kept])])
    return own, np.diff(n, prepend=0) + 1


#: The class of a word by its last two bytes, or by its only one.
CLASS_OF_TWO = np.array([rare_class(bytes(divmod(i, 256))) for i in range(1 << 16)], np.int32)
CLASS_OF_ONE = np.array([rare_class(bytes([i])) for i in range(1 << 8)], np.int32)


def rare_classes(words: pa.Array) -> np.ndarray:
    """``rare_class`` of each word (none is empty)."""
    if not len(words):
        return np.zeros(0, np.int32)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(words.buffers()[2], np.uint8)
    last, before = letters[at[1:] - 1].astype(np.int64), letters[np.maximum(at[1:] - 2, 0)].astype(np.int64)
    return np.where(np.diff(at) > 1, CLASS_OF_TWO[before * 256 + last], CLASS_OF_ONE[last])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 16_000_000):
            if part.num_rows:
                found = parted(part.column("text"))[0].value_counts()
                words = found.field("values")
                yield pa.RecordBatch.from_arrays([words, pa.array(rare_classes(words), "int32"), found.field("counts")], ["word", "class", "c"])


def word_counts(training: DataFrame) -> DataFrame:
    """(word, class, c) over all tokens of the documents."""
    parts = map_batches(training.select("text"), "word binary, class int, c long", _count)
    return parts.groupBy("word", "class").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """All words above the least count that at most ``most`` words exceed, by falling count."""
    short = counts.filter(F.length("word") <= LONGEST)
    edge = F.floor(F.log2("c") * 32)
    bins = sorted(((r.bin, r.n) for r in short.groupBy(edge.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    lowest, total = None, 0
    for b, n in bins:
        if total + n > most:
            break
        lowest, total = b, total + n
    if lowest is None:
        return []
    rows = short.filter(edge >= lowest).select("word", "c").toArrow()
    return sorted(zip(rows.column("word").to_pylist(), rows.column("c").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))


class Table:
    """The broadcast tier: place, count and model id of frequent words, totals of all classes, the network."""

    def __init__(self, frequent: list[tuple[bytes, int]], classes: dict[int, tuple[int, int]], n_words: int, hidden: int, total: int, distinct: int):
        end = [r for r in frequent if r[0] == END] or [(END, 0)]
        frequent = [r for r in frequent if r[0] != END]
        frequent.insert(min(n_words - 1, sum(c >= end[0][1] for _, c in frequent)), end[0])  # the end token always has an output vector
        self.words = [w for w, _ in frequent]
        self.dictionary = pa.array(self.words, "binary")
        self.count = np.array([c for _, c in frequent], np.int64)
        self.total, self.distinct = total, distinct
        self.n_words = min(n_words, len(frequent))
        self.size = np.zeros(RARE)  # N_k + V_k of the words without output vector
        for k, (tokens, types) in classes.items():
            self.size[k] = tokens + types
        for w, c in frequent[: self.n_words]:
            if c:
                self.size[rare_class(w)] -= c + 1
        self.id = np.array([i if i < self.n_words else self.n_words + rare_class(w) for i, w in enumerate(self.words)], np.int64)
        self.end = self.words.index(END)
        self.model = Gru(self.n_words, hidden)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word is in the table; -1 less its class if it isn't there."""
        found = pc.fill_null(pc.index_in(words, value_set=self.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missed = np.flatnonzero(found < 0)
        found[missed] = -1 - rare_classes(words.take(pa.array(missed)))
        return found

    def ids(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.id[np.maximum(places, 0)], self.n_words - 1 - places)


def fit_language_model(docs: DataFrame, counts: DataFrame, n_words: int, most_frequent: int, hidden: int, least_tokens: int) -> Table:
    """``docs``: the training documents (doc_id, text)."""
    totals = {r["class"]: (r.n, r.v) for r in counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    table = Table(frequent_words(counts, most_frequent), totals, n_words, hidden, sum(n for n, _ in totals.values()), sum(v for _, v in totals.values()))
    place, done = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS[-1])), 0
    for upto in ROUNDS:
        tasks = -(-table.total * (upto - done) // (ROUNDS[-1] * least_tokens))
        fit_further(docs.filter((place >= done) & (place < upto)), table, max(1, tasks))
        done = upto
    return table


def fit_further(docs: DataFrame, table: Table, most_tasks: int) -> None:
    """Carry the network on over all of ``docs``: each task by itself from the weights at hand, then the mean by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        model = own.model.copy()
        adam, total = Adam(model), 0
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                if part.num_rows:
                    words, size = parted(part.column("text"))
                    model.learn(np.split(own.ids(own.places(words)), np.cumsum(size)[:-1]), own.end, adam)
                    total += len(words)
        if total:
            blocks = np.split(model.flat().astype(np.float64) * total, range(BLOCK, model.flat().size, BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), "int32"), pa.array([total] * len(blocks), "int64"), pa.array([b.tobytes() for b in blocks], "binary")], ["block", "n", "w"])

    def add(parts: pa.Table) -> pa.Table:
        w = sum(np.frombuffer(b.as_py(), np.float64) for b in parts.column("w"))
        n = sum(parts.column("n").to_pylist())
        return pa.table({"block": pa.array([parts.column("block")[0].as_py()], "int32"), "w": pa.array([(w / n).tobytes()], "binary")})

    # written first: what reads a task's weights again must not train it again
    parts = cut(map_batches(docs.select("text").coalesce(most_tasks), "block int, n long, w binary", learn), "lm-weights")
    found = parts.groupBy("block").applyInArrow(add, "block int, w binary").collect()  # of fixed size
    if found:
        table.model.fill(np.concatenate([np.frombuffer(r.w, np.float64) for r in sorted(found, key=lambda r: r.block)]))
    sent.destroy()
    done_with(parts)


def _score(table: Table, parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part; the network reads the documents of several parts together, ``TOGETHER`` tokens or one part more."""
    waiting, tokens = [], 0
    for part in parts:
        own, ids, rare = _look_up(table, part)
        if rare.num_rows:
            yield rare
        waiting.append((own, ids))
        tokens += sum(map(len, ids))
        if tokens >= TOGETHER:
            yield from _read(table, waiting)
            waiting, tokens = [], 0
    yield from _read(table, waiting)


def _look_up(table: Table, part: pa.RecordBatch) -> tuple[pa.RecordBatch, list[np.ndarray], pa.RecordBatch]:
    """(a row for each document, its ``plain`` without the network's share; the ids of its tokens; a row for each of its words beyond the table)."""
    n_rows = part.num_rows
    words, n = parted(part.column("text"))
    first = np.cumsum(n) - n  # every text has its end token
    own = table.places(words)
    seen, held, ids = own >= 0, np.maximum(own, 0), table.ids(own).astype(np.int32)
    log_count = np.where(seen, np.log10(table.count + 1.0)[held], 0.0)
    known, logs = np.add.reduceat((seen & (table.count[held] > 0)).astype(np.int64), first), np.add.reduceat(log_count, first)
    without = ids >= table.n_words  # words without an output vector: their share within the class
    share = np.where(without, log_count - np.log10(table.size + 1.0)[np.maximum(ids - table.n_words, 0)], 0.0)
    plain = np.add.reduceat(share, first)
    missed = np.flatnonzero(~seen)
    rare = pa.table({"row": np.repeat(np.arange(n_rows), n)[missed], "word": words.take(pa.array(missed))}).group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
    rid = np.frombuffer(secrets.token_bytes(8 * n_rows), np.int64)
    doc_id, held_out_ = part.column("doc_id").cast("int64"), part.column("held_out")
    row, word, times = (rare.column(c).combine_chunks() for c in ("row", "word", "count_all"))
    nulls = (pa.nulls(rare.num_rows, t) for t in ("bool", "int64", "int64", "float64", "float64"))
    return (
        pa.RecordBatch.from_arrays([doc_id, pa.array(rid), held_out_, *map(pa.array, (n, known, logs, plain)), pa.nulls(n_rows, "binary"), pa.nulls(n_rows, "int64")], NAMES),
        np.split(ids, first[1:]),
        pa.RecordBatch.from_arrays([doc_id.take(row), pa.array(rid).take(row), *nulls, word, times], NAMES),
    )


def _read(table: Table, waiting: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """The documents' rows, with the network's share."""
    logs = table.model.score([d for _, docs in waiting for d in docs], table.end) / np.log(10)
    for batch, docs in waiting:
        own, logs = logs[: len(docs)], logs[len(docs) :]
        yield batch.set_column(NAMES.index("plain"), "plain", pa.array(batch.column("plain").to_numpy() + own))


def language_scores(docs: DataFrame, folds: int = 7, remainder: int = 2, n_words: int = 2048, most_frequent: int = 200_000, hidden: int = 16, least_tokens: int = 250_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    docs = id_text(docs).withColumn("held_out", held_out(folds, remainder))
    training = docs.filter(~F.col("held_out"))
    counts = cut(word_counts(training), "lm-counts")
    return score_documents(docs, counts, fit_language_model(training, counts, n_words, most_frequent, hidden, least_tokens))


def score_documents(docs: DataFrame, counts: DataFrame, table: Table) -> DataFrame:
    """``docs``: doc_id, text, held_out."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(sent.value, (part for batch in batches for part in slices(batch, "text", 8_000_000) if part.num_rows))

    # row ids are drawn at random, so this must be written before it is read twice
    scored = cut(map_batches(docs, SCORED, work), "lm-scored")
    missed = scored.filter("word IS NOT NULL").select("doc_id", "rid", "word", "n").join(counts.select("word", "c"), "word", "left")
    met = missed.groupBy("doc_id", "rid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"))
    base = scored.filter("word IS NULL").select("doc_id", "rid", "held_out", "n_tokens", "n_known", "logs", "plain")
    both = base.unionByName(met.select("doc_id", "rid", F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens"), "n_known", "logs", F.col("logs").alias("plain")))
    summed = both.groupBy("doc_id", "rid").agg(F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("logs").alias("logs"), F.sum("plain").alias("score"))
    whole = float(np.log10(table.total + table.distinct + 1))
    return summed.select(
        "doc_id", "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(table.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * whole).alias("base_score"), "score",
    )
