"""Which character set bytes are in: rules of validity first, then how likely their pairs of bytes are in each set.

A mark at the beginning, zeros in every second byte, and valid UTF-8 decide by themselves. What is left is read in the set, of those that can hold
it, in which its distinct pairs of bytes with a high one are likeliest (each once: a word said a hundred times tells no more than said once);
how likely they are is counted from texts of the corpus, written in every set.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from gleaner.session import arrow_udf, ship

CHARSETS = ("cp1252", "cp850", "mac_roman", "cp1251", "koi8_r", "gb18030", "big5", "shift_jis", "euc_kr")
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
PAIRS = 1 << 16


def high_pairs(body: bytes) -> np.ndarray:
    """The pairs of neighbours of which one at least is a high byte."""
    b = np.frombuffer(body, np.uint8).astype(np.int64)
    return (b[:-1] * 256 + b[1:])[(b[:-1] > 127) | (b[1:] > 127)] if len(b) > 1 else np.zeros(0, np.int64)


def _holds(body: bytes, name: str) -> bool:
    with suppress(UnicodeDecodeError, LookupError):
        body.decode(name)
        return True
    return False


@dataclass(frozen=True)
class CharsetModel:
    """Of each set the logarithms of how likely each pair of bytes is."""

    likely: dict[str, np.ndarray]

    def detect(self, body: bytes) -> str:
        for mark, name in MARKS:
            if body.startswith(mark):
                return name
        head = np.frombuffer(body[:4096], np.uint8)
        if len(head) > 3:
            zeros = (head[: len(head) // 2 * 2].reshape(-1, 2) == 0).mean(0)
            if zeros.max() > 0.3 and zeros.min() < 0.1:
                return "utf-16-le" if zeros[1] > zeros[0] else "utf-16-be"
        if _holds(body, "utf-8"):
            return "utf-8"
        pairs = np.unique(high_pairs(body))
        score = {name: float(table[pairs].mean()) for name, table in self.likely.items() if len(pairs) and _holds(body, name)}
        return max(score, key=lambda n: (score[n], n), default="latin-1")

    def decode(self, body: bytes) -> str:
        return body.decode(self.detect(body), "replace")


def learn_charsets(texts: DataFrame, text: str = "text", charsets: tuple[str, ...] = CHARSETS) -> CharsetModel:
    """Count pairs of bytes of all texts in every set that can write them; a table of 65,536 numbers a set is all that comes to the driver."""
    ship(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {name: np.zeros(PAIRS, np.int64) for name in charsets}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for name in charsets if t and not t.isascii() else ():
                    with suppress(UnicodeEncodeError):
                        counts[name] += np.bincount(high_pairs(t.encode(name)), minlength=PAIRS)
        for name, n in counts.items():
            pairs = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(pairs), "string"), pa.array(pairs, "int32"), pa.array(n[pairs], "int64")], ["charset", "pair", "n"])

    rows = texts.select(text).mapInArrow(work, "charset string, pair int, n long").groupBy("charset", "pair").agg(F.sum("n").alias("n")).toArrow()
    likely = {}
    for name in charsets:
        own = rows.filter(pc.equal(rows.column("charset"), name))
        n = np.full(PAIRS, 0.01)
        n[np.asarray(own.column("pair"))] += np.asarray(own.column("n"))
        if len(own):  # a set in which no text can be written is never chosen
            likely[name] = np.log(n / n.sum()).astype(np.float32)
    return CharsetModel(likely)


def detected(bodies: DataFrame, model: CharsetModel, id_col: str, body: str) -> DataFrame:
    """(id, charset, text) of bytes; a null body stays null."""
    spark = bodies.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = dict(bodies.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if b is None else sent.value.detect(b) for b in batch.column(1).to_pylist()]
            texts = [None if b is None else b.decode(name, "replace") for b, name in zip(batch.column(1).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, "string"), pa.array(texts, "string")], [id_col, "charset", "text"])

    return bodies.select(id_col, body).mapInArrow(work, f"{id_col} {kind}, charset string, text string")


def _written(texts: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode(n, "xmlcharrefreplace") for t, n in zip(texts, names, strict=True)])


def _read_as(bodies: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else bytes(b).decode(n, "replace") for b, n in zip(bodies, names, strict=True)])


def written(text: Column, name: Column) -> Column:
    """A text's bytes in a character set; what that lacks becomes character references."""
    return arrow_udf(_written, BinaryType())(text, name)


def read_as(body: Column, name: Column) -> Column:
    return arrow_udf(_read_as, StringType())(body, name)
