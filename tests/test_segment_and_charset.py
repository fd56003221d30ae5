"""Dictionary segmentation against all segmentations, and character sets against what texts were written in."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import pytext
from gleaner.functions.segment import Dictionary, counted_dictionary, segmented, segmenter
from gleaner.operators.lexical import bm25_search, build_index
from gleaner.plans import catalog
from gleaner.sources import charset

COUNTS = {"a": 5, "ab": 9, "abc": 2, "b": 1, "ca": 7, "bca": 3, "轨道": 8, "轨": 1, "道岔": 6, "检修": 4, "😀b": 2}


def ways(run):
    if not run:
        yield []
    for n in range(1, len(run) + 1):
        for rest in ways(run[n:]):
            yield [run[:n], *rest]


def cost(words, d):
    total = sum(COUNTS.values())
    return sum(-math.log(COUNTS[w] / total) if w in COUNTS else d.unknown if len(w) == 1 else math.inf for w in words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc轨道岔检修😀x", max_size=9), max_size=6))
def test_the_cheapest_of_all_segmentations(runs):
    d = Dictionary.of(COUNTS)
    for run, words in zip(runs, d.segment(runs), strict=True):
        assert "".join(words) == run
        assert cost(words, d) == pytest.approx(min(cost(w, d) for w in ways(run)))


def test_batches_do_not_matter():
    rnd = random.Random(3)
    runs = ["".join(rnd.choice("abc轨道岔") for _ in range(rnd.choice([0, 1, 5, 30, 700]))) for _ in range(120)]
    d = Dictionary.of(COUNTS)
    assert d.segment(runs) == [d.segment([r])[0] for r in runs]
    assert Dictionary.of({}).segment(["ab", ""]) == [["a", "b"], []]


def test_a_dictionary_from_a_corpus_parts_it_again(spark):
    words = spark.createDataFrame([(w,) for w in ["轨道", "检修", "规程", "道岔"] * 3 + ["once"]], "w string")
    d = counted_dictionary(words)
    assert d.segment(["轨道检修规程道岔"]) == [["轨道", "检修", "规程", "道岔"]]
    rows = spark.createDataFrame([(1, "道岔检修"), (2, None), (3, "")], "i int, t string")
    assert {r.i: r.words for r in segmented(rows, d, "i", "t").collect()} == {1: ["道岔", "检修"], 2: [], 3: []}
    chunks = spark.createDataFrame([(1, "道岔检修规程"), (2, "岔检修程")], "chunk_id long, text string")
    found = bm25_search(build_index(chunks, F.col("text"), segment=segmenter(d)), spark.createDataFrame([(1, "道岔")], "query_id int, query string"), 1).first()
    assert found.chunk_id == 1
    got = catalog.queries()["segmented_documents"](spark, SF).agg(F.sum("n_words")).first()[0]
    real = spark.read.parquet(f"{SF}/documents.parquet").select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert 0.7 * real < got < 1.5 * real


def test_character_sets(spark):
    model = charset.learn_charsets(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model.detect(b"plain") == "utf-8" and model.detect(b"") == "utf-8" and model.detect("é".encode()) == "utf-8"
    assert model.detect("﻿x".encode("utf-16")) == "utf-16" and model.detect("abcdef".encode("utf-16-le")) == "utf-16-le" and model.detect(b"\xef\xbb\xbfx") == "utf-8-sig"
    assert charset.learn_charsets(spark.createDataFrame([], "text string")).detect(b"\xe9") == "latin-1"
    chinese = spark.createDataFrame([("轨道电路故障处理办法，列车限速运行。" * 20,), ("Über die Straße gehen öfter Männer. " * 30,)], "text string")
    both = charset.learn_charsets(chinese)
    assert both.detect("列车限速".encode("gb18030")) == "gb18030" and both.detect("Männer gehen öfter".encode("cp1252")) == "cp1252"
    right = [r.right for r in catalog.queries()["decoded_pages"](spark, "/root/testdata/sf0.01").collect()]
    assert sum(right) >= 0.99 * len(right)
    odd = spark.createDataFrame([(1, None), (2, b"\xff\xfe"), (3, b"\xe9")], "i int, b binary")
    assert [r.text for r in charset.detected(odd, model, "i", "b").orderBy("i").collect()] == [None, "", "é"]


def test_a_repeated_letter_does_not_outweigh_the_rest(spark):
    """a page that says one rare word over and over was read in the set in which its byte is a frequent letter."""
    texts = ["Der ö Fluss, die ö Brücke, öfter über für Männer. " * 40, "Ü ist ein Wort, ç é è ê sind Zeichen: ça, été, père, fête. " * 4]
    model = charset.learn_charsets(spark.createDataFrame([(t,) for t in texts], "text string"))
    text = "Ü " * 200 + "ça été père fête über"
    for name in ("cp1252", "cp850", "mac_roman"):
        assert text.encode(name).decode(model.detect(text.encode(name))) == text


def made_up(rnd, n):
    """Words of syllables, and how often each occurs: many run into one another, and many are equally frequent."""
    words = ["".join(rnd.choice(["ta", "ka", "no", "mi", "t", "a", "ren", "so"]) for _ in range(rnd.randrange(1, 6))) for _ in range(n)]
    return {w: rnd.choice([2, 2, 2, 3, 4, 6, 40]) for w in words}


def plainly(counts, unknown, run):
    """Place by place, costs added up from the beginning; of equal ways the longest last word."""
    total, longest = sum(counts.values()), max(map(len, counts))
    costs = {w: float(-np.log(n / total)) for w, n in counts.items()}
    best, step = [0.0], [0]
    for j in range(1, len(run) + 1):
        ways = [(best[j - n] + min(costs.get(run[j - n : j], math.inf), unknown if n == 1 else math.inf), -n) for n in range(1, min(longest, j) + 1)]
        least, n = min(ways)
        best.append(least)
        step.append(-n)
    words, j = [], len(run)
    while j:
        words.append(run[j - step[j] : j])
        j -= step[j]
    return words[::-1]


@pytest.mark.parametrize("seed", range(6))
def test_pieces_add_up_as_whole_runs_do(seed):
    """Also where two ways cost the same but for rounding, which depends on all that stands before."""
    rnd = random.Random(seed)
    counts = made_up(rnd, 300) | ({"道岔": 6, "岔检": 6, "检": 3} if seed % 2 else {})
    d = Dictionary.of(counts)
    letters = [*counts, "x", "-"] + ["道", "检", "😀", "é"] * (seed % 2)
    runs = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 40, 400]))) for _ in range(60)] + ["ta" * 900]
    assert d.segment(runs) == [plainly(counts, d.unknown, r) for r in runs]


def test_parting_takes_little_more_than_finding_words():
    """each place was looked up with every length of word: 61 times what finding the words between blanks takes, now 11 times (measured here)."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("bcdfglmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 12)))[: rnd.randrange(2, 25)] for _ in range(30_000)]
    d = Dictionary.of({w: 1 + 30_000 // (i + 1) for i, w in enumerate(words)})
    texts = [" ".join(words[min(29_999, int(rnd.paretovariate(0.5)))] for _ in range(300)) for _ in range(150)]
    runs = [t.replace(" ", "") for t in texts]

    def least(f, given):
        took = []
        for _ in range(3):
            began = time.process_time()
            f(given)
            took.append(time.process_time() - began)
        return min(took)

    assert least(d.segment, runs) < 30 * least(lambda given: [pytext.tokens(t) for t in given], texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz09._/+- \n\0éßıİﬁ２轨道😀", max_size=12)), max_size=8))
def test_tokens_of_many_texts_are_those_of_each(texts):
    want = [pytext.tokens(t or "") for t in texts]
    got = pytext.token_lists(pa.array(["q", *texts], "string").slice(1))
    assert got.to_pylist() == want
    assert pytext.joined_tokens(pa.array(texts, "string")) == ["".join(w) for w in want]


def test_a_dictionary_from_counted_words(spark):
    """Rows of one word add up, and the most frequent stay, of equal ones the first."""
    rows = spark.createDataFrame([("b", 1), ("b", 1), ("a", 2), ("c", 1), ("ab", 3), ("x" * 25, 9)], "w string, n long").repartition(3)
    assert counted_dictionary(rows, most=2).unknown == Dictionary.of({"ab": 3, "a": 2}).unknown
    assert counted_dictionary(rows, most=2).segment(["abab", "ba"]) == [["ab", "ab"], ["b", "a"]]
    assert counted_dictionary(rows).unknown == Dictionary.of({"ab": 3, "a": 2, "b": 2}).unknown


def test_the_driver_reads_counts_until_it_has_enough(spark, monkeypatch):
    """it was sent the best of every partition, each as many as it wanted in all."""
    counts = spark.range(0, 40_000, 1, 8).selectExpr("concat('w', id) AS w", "id AS n")

    def none(*_):
        raise AssertionError("all partitions at once")

    monkeypatch.setattr(type(counts), "collect", none)
    d = counted_dictionary(counts, most=50)
    assert d.segment(["w39999w39950"]) == [["w39999", "w39950"]] and len(d.segment(["w39949"])[0]) > 1
