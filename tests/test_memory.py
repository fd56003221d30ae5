"""What a worker holds at once, and over how many tasks texts are dealt, does not follow from how a table is cut up."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from conftest import SF
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner.functions import pytext
from gleaner.functions.segment import segmented
from gleaner.operators.lexical import _shards
from gleaner.plans import catalog
from gleaner.session import sliced, text_udf
from gleaner.sources.blocks import exploded

ROWS, SIZE = 4000, 2000  # of one partition: 8 MB of texts


def long_texts(spark):
    return spark.range(0, ROWS, 1, 1).select("id", F.repeat(F.lit("x"), SIZE).alias("text"))


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "é" * 3, "c" * 200])], ["t"])
    parts = list(sliced(iter([batch, batch.slice(0, 0)]), "t", 40))
    assert [p.column(0).to_pylist() for p in parts] == [["a" * 10, None], ["b" * 50], ["", "é" * 3], ["c" * 200]]


def test_runs_are_segmented_a_slice_at_a_time(spark):
    """all runs of an Arrow batch were parted together."""

    class Told:
        def segment(self, runs):
            return [[str(len(runs))] for _ in runs]

    class Sent:
        def __reduce__(self):
            return cloudpickle.loads, (told,)

    told = cloudpickle.dumps(Told())
    got = segmented(long_texts(spark), Sent(), "id", "text").select(F.col("words")[0].cast("int").alias("n")).agg(F.count("n"), F.max("n")).first()
    assert got[0] == ROWS and got[1] * SIZE <= 1 << 20


def test_blocks_are_made_a_slice_at_a_time(spark):
    """the blocks of all rows of an Arrow batch were Python objects together."""

    class Row(dict):
        live = 0

        def __init__(self, **own):
            super().__init__(**own)
            Row.live += 1

        def __del__(self):
            Row.live -= 1

    made = exploded(long_texts(spark), "id", ["text"], lambda t: [Row(pos=0, kind="p", page=None, section_path=[], text=str(Row.live))])
    got = made.agg(F.count("text"), F.max(F.col("text").cast("int"))).first()
    assert got[0] == ROWS and got[1] * SIZE <= 2 << 20


def test_texts_are_changed_a_slice_at_a_time(spark):
    """F5, F8: normal forms of all rows of an Arrow batch were made together."""

    class Live(str):
        live = 0

        def __new__(cls, text):
            Live.live += 1
            return super().__new__(cls, text)

        def __del__(self):
            Live.live -= 1

    change = text_udf(lambda t: Live(Live.live))
    got = long_texts(spark).withColumn("text", F.when(F.col("id") != 7, F.col("text"))).select(change(F.col("text")).cast("int").alias("n")).agg(F.count("n"), F.max("n")).first()
    assert got[0] == ROWS - 1 and got[1] * SIZE <= 2 << 20


def test_a_shard_is_kept_as_numbers():
    """F8, F11, F12, F13: a shard's postings were strings in dictionaries until it was whole."""
    texts = [" ".join(f"w{(i * 7 + j * 13) % 5000}" for j in range(300)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array(texts)], ["row", "chunk_id", "text"])
    tracemalloc.start()
    (made,) = _shards(pytext.pairs, pa.int64())(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
    tokens = made.column("token").to_pylist()
    assert tokens == ["", *sorted(set(" ".join(texts).split()))]
    at = tokens.index("w26")
    assert made.column("places")[at].as_py() == [i for i, t in enumerate(texts) if "w26" in t.split()]
    assert made.column("tfs")[0].as_py() == [300] * 2000 and made.column("ids")[0].as_py() == list(range(2000))


def test_lines_of_one_file_are_read_by_all_cores(spark):
    """a table of one file was read by one task."""
    assert catalog._lines(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_plain_lines_are_cleaned_as_others_are(spark):
    odd = ["", " ", "a", "\ta \x0b b\f\r\n c ", "a\x1cb", "é\x85b", "\xa0x\xa0", "a\n\n\tb", "ü  ß\r", "中 文", "\xadx", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    from gleaner.functions import text as tx

    slow = F.regexp_replace(tx.squeezed(tx.clean_inline(F.col("t"))), tx.BETWEEN, "")
    assert rows.filter(~tx.clean_block(F.col("t")).eqNullSafe(slow)).collect() == []
