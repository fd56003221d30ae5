"""Token counts by a map-side two-tier lookup.

The lengths (in tokens) of frequent pre-tokens form a compact table, words in one buffer and lengths in an array, that is
broadcast; a pre-token that isn't in it is encoded by the library once per worker and kept in that worker's bounded cache
of two generations. Pre-tokens never leave the task that reads them, so the only cost beyond the scan is the lookup itself.

Frequent pre-tokens are counted on a sample of ``most_docs`` documents, those with the least hash of doc_id: each of a few tasks
sends its ``most_frequent`` most frequent ones to the driver, which keeps as many in all. The sample decides what is
looked up where and nothing else; neither tier changes a count.

White space parts pre-tokens, so a text's count is the sum over its pieces between ASCII white space. A piece that holds a
special string, or characters for which versions of Unicode may differ, is one unit for both tiers; the others
are split into pre-tokens by the vocabulary's pattern.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null doc_id and repeated rows are counted each by
itself; an empty table gives an empty result; other columns are ignored. Very long texts are taken by themselves.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import id_text, map_batches, per_worker, sha256_hex, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
SLICE = 2_000_000
#: The pre-token pattern that the vocabulary file states (a fixed value of its format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose normal form, lower case and class don't depend on a Unicode version: up to Latin Extended-B, Cyrillic, dashes and
#: quotation marks, kana, unified ideographs, Hangul syllables.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f\u0400-\u045f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
BETWEEN = re.compile("[^\t\n\x0b\x0c\r\x20]+")


def tokenizer_of(blob: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(blob)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Splitter:
    """Texts as units whose tokens add up."""

    def __init__(self, tok):
        special = "|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values())
        self.odd = re.compile(f"{ODD.pattern}|{special}" if special else ODD.pattern).search
        self.find = regex.compile(PRE_TOKEN).findall

    def __call__(self, text: str) -> list[str]:
        if not self.odd(text):
            return self.find(text.lower())
        odd, plain = [], []
        for piece in BETWEEN.findall(text):
            (odd if self.odd(piece) else plain).append(piece)
        return self.find(" ".join(plain).lower()) + odd


class Frequent:
    """The broadcast tier: words in one buffer, and their lengths."""

    def __init__(self, lengths: dict[str, int]):
        self.words, self.n = " ".join(lengths).encode(), np.array(list(lengths.values()), np.uint32)  # no unit holds a blank

    def table(self) -> dict[str, int]:
        return dict(zip(self.words.decode().split(" "), self.n.tolist(), strict=True)) if len(self.n) else {}


def _held(units: Collection[str]) -> int:
    """About how many bytes units take in a table and a set: their characters, and what a string and two entries need besides."""
    return 240 * len(units) + 2 * sum(map(len, units))


class Counts:
    """Counts tokens of texts; lengths of about ``most_cached`` units are kept beside the frequent ones, and about ``most_bytes`` of units."""

    def __init__(self, blob: bytes, frequent: Frequent, most_cached: int, most_bytes: int = 32 << 20):
        self.tok, self.frequent = tokenizer_of(blob), frequent.table()
        self.split, self.most = Splitter(self.tok), most_cached
        self.n, self.used, self.most_bytes, self.size = dict(self.frequent), set(), most_bytes, 0

    def _turn(self) -> None:
        """The units used since the last turn stay (none, if that is nearly all)."""
        few = 4 * len(self.used) <= 3 * self.most and 4 * _held(self.used) <= 3 * self.most_bytes
        stay = {u: self.n[u] for u in self.used} if few else {}
        self.n, self.used, self.size = self.frequent | stay, set(), _held(stay)

    def __call__(self, texts: list[str]) -> np.ndarray:
        units = [self.split(t) for t in texts]
        every = list(chain.from_iterable(units))
        rare = set(every).difference(self.frequent)
        if len(self.n) - len(self.frequent) + len(rare) > self.most or self.size + _held(rare.difference(self.n)) > self.most_bytes:
            self._turn()
        self.used |= rare
        new = list(rare.difference(self.n))
        self.size += _held(new)
        self.n.update(zip(new, (len(e) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(self.n.__getitem__, every), np.int64, len(every)))])
        return np.diff(upto[np.cumsum([0, *map(len, units)])])


def frequent_lengths(docs: DataFrame, blob: bytes, most_docs: int, most_frequent: int, tasks: int = 8) -> Frequent:
    """Lengths of the units that are most frequent in the sample, by falling count."""
    chosen = [r.doc_id for r in docs.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).toLocalIterator()]
    if not chosen:
        return Frequent({})
    sample = docs.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id").select("text").coalesce(tasks)
    sent = docs.sparkSession.sparkContext.broadcast(blob)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = Splitter(tokenizer_of(sent.value)), Counter()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for text in part.column("text").to_pylist():
                    found.update(split(text or ""))
                if len(found) > 8 * most_frequent:  # bounded memory: those seen least go
                    found = Counter(dict(found.most_common(4 * most_frequent)))
        top = found.most_common(most_frequent)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], "string"), pa.array([n for _, n in top], "int64")], ["unit", "n"])

    total: Counter[str] = Counter()
    for r in map_batches(sample, "unit string, n long", work).toLocalIterator():  # tasks * most_frequent rows at most
        total[r.unit] += r.n
    units = [u for u, _ in sorted(total.items(), key=lambda r: (-r[1], r[0]))[:most_frequent]]
    return Frequent(dict(zip(units, (len(e) for e in tokenizer_of(blob).encode_batch_fast(units, add_special_tokens=False)), strict=True)))


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 2048, most_cached: int = 400_000, most_docs: int = 4096, most_frequent: int = 65_536) -> DataFrame:
    """One row per document: bytes, tokens, and whether the tokens exceed ``limit``.

    ``vocab_path`` is read on the driver; executors get its bytes by broadcast.
    """
    with open(vocab_path, "rb") as f:
        blob = f.read()
    docs = id_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    frequent = frequent_lengths(docs, blob, most_docs, most_frequent)
    sent = docs.sparkSession.sparkContext.broadcast((blob, frequent))
    key = f"token_counts:{sha256_hex(blob + frequent.words)}:{most_cached}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = per_worker(key, lambda: Counts(*sent.value, most_cached))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = count([t or "" for t in part.column("text").to_pylist()])
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast("int64")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs, SCHEMA, work)
