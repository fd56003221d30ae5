"""Quality classifier: attention-based multiple-instance learning (Ilse et al., 2018) in numpy.

A document is a bag of passages of ``WORDS`` words. Every passage of the whole text is encoded
(surface features, one tanh layer), a gated attention weighs the passages, and a logistic unit
scores the weighted sum. All weights are learned together from document labels by Adam.

Fitting takes a bounded sample of labelled rows: at most ``most_docs`` of them, those with the least hash of doc_id, and of these, in that
order, the documents whose passages together number ``most_passages`` at most. A document takes part with every passage
or not at all. Scoring reads every passage of every document, in one pass without a shuffle.

Held out is what ``crc32(doc_id as text) % folds == 0`` names; such rows never reach the fit. Labels, lang,
source and doc_id are no inputs of a score.

Defined cases: a null or empty text is one empty passage and gets a score; null labels and labels
of unknown documents teach nothing; repeated labels of a document count once (the larger), of a doc_id with several texts one (of least
hash) teaches; a score equal to the threshold is good; without
any label the score is 0.5; a null doc_id isn't held out; repeated rows are scored each by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import id_text, map_batches, slices
from gleaner.llm.shingles import BLANK, mix, word_hashes
from gleaner.session import cut, done_with

WORDS = 64
BINS = 32
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.zeros(256, np.int64)
for _chars, _number in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:'\"()-", 3), (b"!?", 4), (b"*#%&$@^~_=+", 5), (b"|<>[]{}\\/`", 6), (b"\n", 7), (bytes(range(128, 256)), 8)):
    _CLASS[list(_chars)] = _number
FEATURES = 9 + 8 + BINS


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, bag number of each); an empty text has one passage of zeros."""
    raws = [(t or "").encode() for t in texts]
    size = np.array([len(r) + 1 for r in raws])
    at = np.concatenate([[0], np.cumsum(size)])
    buffer = b"\n".join(raws) + b"\n"
    hashes, start = word_hashes(buffer)
    b = np.frombuffer(buffer, np.uint8)
    bounds = np.searchsorted(start, at)
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), n_words)
    nth = np.arange(len(hashes)) - bounds[:-1][doc]
    n_bags = np.maximum(1, -(-n_words // WORDS))
    bag_at = np.concatenate([[0], np.cumsum(n_bags)])
    bag = bag_at[doc] + nth // WORDS
    total = int(bag_at[-1])
    owner = np.repeat(np.arange(len(texts)), n_bags)
    x = np.zeros((total, FEATURES), np.float32)
    if not len(hashes):
        return x, owner
    count = np.bincount(bag, minlength=total)
    some = np.maximum(count, 1)
    # bytes belong to the passage of the last word that began before them
    begun = np.zeros(len(b), np.int64)
    begun[start] = 1
    piece = np.concatenate([[0], bag])[np.cumsum(begun)]
    piece = np.maximum(piece, np.repeat(bag_at[:-1], size))  # before a text's first word: its first passage
    long = np.maximum(np.bincount(piece, minlength=total), 1)
    x[:, :9] = np.bincount(piece * 9 + _CLASS[b], minlength=total * 9).reshape(total, 9) / long[:, None]
    x[:, 9] = np.log1p(count)
    x[:, 10] = (count / long) * 5

    def distinct(keys: np.ndarray) -> np.ndarray:
        keys = mix(keys ^ (bag.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        k, g = keys[order], bag[order]
        fresh = np.concatenate([[True], k[1:] != k[:-1]])
        runs = np.diff(np.append(np.flatnonzero(fresh), len(k)))
        top = np.zeros(total)
        np.maximum.at(top, g[fresh], runs)
        return np.stack([np.bincount(g[fresh], minlength=total) / some, top / some])

    x[:, 11:13] = distinct(hashes).T
    follower = np.roll(hashes, -1)
    follower[bounds[1:][n_words > 0] - 1] = 0  # a text's last word has none, whatever text comes next
    pair = mix(hashes ^ follower * np.uint64(3))
    x[:, 13:15] = distinct(pair).T
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (bag[1:] == bag[:-1])
    x[:, 15] = np.bincount(bag, same, minlength=total) / some
    keys = mix(hashes ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    fresh = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    x[:, 16] = (np.bincount(doc[order[fresh]], minlength=len(texts)) / np.maximum(n_words, 1))[owner]
    follow = ((b[:-1].astype(np.uint64) * np.uint64(257) + b[1:]) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(BINS)
    solid = ~BLANK[b[:-1]] & ~BLANK[b[1:]]
    x[:, 17:] = np.bincount(piece[:-1][solid] * BINS + follow[solid].astype(np.int64), minlength=total * BINS).reshape(total, BINS) / long[:, None] * 4
    x[count == 0] = 0
    return x, owner


class Model:
    """Weights: encoder (w1, b1), gated attention (v, u, a), output (w2, b2); features are standardized."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {
            "w1": r.normal(0, FEATURES**-0.5, (FEATURES, hidden)), "b1": np.zeros(hidden), "v": r.normal(0, hidden**-0.5, (hidden, gate)),
            "u": r.normal(0, hidden**-0.5, (hidden, gate)), "a": r.normal(0, gate**-0.5, gate), "w2": np.zeros(hidden), "b2": np.zeros(1),
        }

    def forward(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of bags 0.., whose rows follow each other."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        alpha = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(h * alpha[:, None], first)
        return 1 / (1 + np.exp(-np.clip(z @ p["w2"] + p["b2"], -30, 30))), (x, h, t, s, alpha, z, first)

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, (score, (x, h, t, s, alpha, z, first)) = self.p, self.forward(x, bag)
        d = (score - y) / len(y)
        g = {"w2": z.T @ d, "b2": np.array([d.sum()])}
        dz = d[:, None] * p["w2"]
        dalpha = (h * dz[bag]).sum(1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[bag])
        g["a"] = (t * s).T @ de
        dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dh = (dz[bag] * alpha[:, None] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        g["w1"], g["b1"] = x.T @ dh, dh.sum(0)
        return {k: v + decay * p[k] * (k in ("w1", "v", "u")) for k, v in g.items()}

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 30, size: int = 250, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        at, rng = np.searchsorted(bag, np.arange(len(y) + 1)), np.random.default_rng(seed)
        batches = [part for _ in range(epochs) for part in np.array_split(rng.permutation(len(y)), -(-len(y) // size))]
        for i, part in enumerate(batches, 1):
            n, steps = at[part + 1] - at[part], len(batches)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[part], n)
            for k, g in self.gradients(x[rows], np.repeat(np.arange(len(part)), n), y[part], decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * min(1.0, 2 - 2 * i / steps) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)


def held_out(folds: int, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == remainder, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2_000_000):
            x, owner = passages(part.column("text").to_pylist())
            at = np.searchsorted(owner, np.arange(part.num_rows + 1))
            out = [x[a:z].astype(np.float32).tobytes() for a, z in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast("int64"), part.column("version"), pa.array(np.diff(at), "int64"), pa.array(out, "binary")], ["doc_id", "version", "n", "bag"])


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, most_docs: int = 4000, most_passages: int = 200_000) -> Model | None:
    docs = id_text(docs)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(folds))
    sample = marked.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    quality = {r.doc_id: r.quality for r in sample.toLocalIterator()}  # most_docs rows at most, in the order of their hashes
    if not quality:
        return None
    chosen = docs.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in quality], "doc_id long")), "doc_id")
    rows = map_batches(chosen.select("doc_id", "text").withColumn("version", F.xxhash64("text")), "doc_id long, version long, n long, bag binary", _bags)
    one = cut(rows.groupBy("doc_id").agg(F.min_by(F.struct("n", "bag"), "version").alias("b")).select("doc_id", "b.n", "b.bag"), "quality-bags")
    size, own, total = {r.doc_id: r.n for r in one.select("doc_id", "n").toLocalIterator()}, [], 0
    for doc in quality:  # whole documents, as long as they fit
        if 0 < size.get(doc, 0) <= most_passages - total:
            own.append(doc)
            total += size[doc]
    if not own:
        return None
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in own], "doc_id long"))
    bags = sorted((r.doc_id, bytes(r.bag)) for r in one.join(wanted, "doc_id").select("doc_id", "bag").toLocalIterator())
    done_with(one)
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, b in bags]
    model = Model()
    model.fit(np.concatenate(x).astype(np.float64), np.repeat(np.arange(len(x)), [len(v) for v in x]), np.array([float(quality[i] > 0) for i, _ in bags]))
    return model


def quality_scores(docs: DataFrame, model: Model | None, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    docs = id_text(docs).withColumn("held_out", held_out(folds))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                if not part.num_rows:
                    continue
                x, owner = passages(part.column("text").to_pylist())
                score = np.full(part.num_rows, 0.5) if sent.value is None else sent.value.forward(x.astype(np.float64), owner)[0]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast("int64"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs, SCHEMA, work)


def quality_classifier(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, most_docs: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    return quality_scores(docs, fit_quality(docs, labels, folds, most_docs), folds, threshold)


def good_documents(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                if part.num_rows and sent.value is not None:
                    x, owner = passages(part.column("text").to_pylist())
                    part = part.filter(pa.array(sent.value.forward(x.astype(np.float64), owner)[0] >= threshold))
                yield part

    return map_batches(docs, docs.schema, work)
