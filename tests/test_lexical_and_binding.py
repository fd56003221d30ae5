"""The inverted index and the q-gram binding against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.config import Bm25Config
from gleaner.functions import pytext
from gleaner.operators import binding, lexical
from test_engine import chunks  # noqa: F401


def plain_bm25(texts, query, k):
    c = Bm25Config()
    docs = [Counter(pytext.tokens(t or "")) for t in texts]
    n, dl = len(docs), [d.total() for d in docs]
    avgdl = sum(dl) / n
    df = Counter(t for d in docs for t in d)
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: c.epsilon * mean if v < 0 else v for t, v in raw.items()}
    asked = Counter(pytext.tokens(query))
    score = [sum(q * idf.get(t, 0) * d[t] * (c.k1 + 1) / (d[t] + c.k1 * (1 - c.b + c.b * size / avgdl)) for t, q in asked.items() if d[t]) for d, size in zip(docs, dl, strict=True)]
    best = sorted(range(n), key=lambda i: (-np.float32(score[i]), i))[:k]
    return [(i, pytest.approx(score[i], rel=1e-5, abs=1e-9)) for i in best]


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)] + ["the"] * 150
    return [None, "", "the"] + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunks_a_shard", [1 << 14, 70])
def test_bm25_is_a_plain_loop(spark, monkeypatch, chunks_a_shard):
    monkeypatch.setattr(lexical, "SHARD_CHUNKS", chunks_a_shard)
    texts = corpus(1, 900)
    texts += texts[10:40]  # ties
    asked = ["the w1 w2 w3 w4 w5 w9 w17", "w2", "unheard", "", "the the the", texts[50], texts[60] + " the " + texts[61]]
    table = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(5)
    index = lexical.build_index(table, F.col("text"))
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    for k in (1, 10):
        got = lexical.bm25_search(index, queries, k).orderBy("query_id", "rank").collect()
        for q, query in enumerate(asked):
            assert [(r.chunk_id, r.score) for r in got if r.query_id == q] == plain_bm25(texts, query, k), query
    small = lexical.bm25_search(index, queries, 10, most_weights=8, most_queries=2).orderBy("query_id", "rank").collect()
    assert small == lexical.bm25_search(index, queries, 10).orderBy("query_id", "rank").collect()


def test_searches_skip_and_still_find_the_best():
    """Of a shard whose rare token decides, most chunks are never looked up; the result is that of adding up everything."""
    rnd = random.Random(2)
    counts = [Counter({"the": rnd.randrange(1, 9), "of": rnd.randrange(1, 5), **({"rare": rnd.randrange(1, 4)} if i % 97 == 0 else {}), "x": rnd.randrange(1, 60)}) for i in range(4000)]
    import pyarrow as pa

    table = pa.Table.from_batches([lexical._shard(0, list(range(4000)), counts, pa.int64())])
    shard = lexical.Shard(table, Bm25Config(), 40.0)
    tokens, weights = ["rare", "of", "the"], np.array([9.0, 0.6, 0.5])
    places, scores = shard.best(tokens, weights, 5)
    whole = np.zeros(4000)
    for t, w in zip(tokens, weights, strict=True):
        at, parts, _ = shard.postings[t]
        whole[at] += w * parts
    order = np.lexsort((np.arange(4000), -whole.astype(np.float32)))[:5]
    assert sorted(places.tolist()) == sorted(order.tolist()) and sorted(scores.tolist()) == sorted(whole[order].astype(np.float32).tolist())
    assert (shard.sums != 0).sum() < 400  # the others were never added up
    for t in tokens:  # no posting adds more than its block's bound
        _, parts, bounds = shard.postings[t]
        assert all(parts[i] <= bounds[i // lexical.BLOCK] + 1e-12 for i in range(len(parts)))


def test_a_search_opens_its_own_tokens_folders(spark):
    table = spark.createDataFrame([(i, f"word{i} shared") for i in range(300)], "chunk_id long, text string")
    index = lexical.build_index(table, F.col("text"), buckets=16)
    pairs = spark.createDataFrame([("word7",)], "token string")
    opened = [r.b for r in pairs.select(lexical.bucket_of(F.col("token"), 16).alias("b")).collect()]
    found = lexical._tokens_of(index, pairs, opened)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 or plan.count("PartitionFilters: [") == 2 and "bucket" in plan
    assert sorted({r.token for r in found.collect()}) == ["", "word7"]
    folders = {f.split("bucket=")[1].split("/")[0] for f in index.postings.filter(F.col("bucket").isin(opened)).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert folders == {str(opened[0])}


def test_empty_index(spark):
    none = spark.createDataFrame([], "chunk_id long, text string")
    index = lexical.build_index(none, F.col("text"))
    assert index.n == 0 and lexical.bm25_search(index, spark.createDataFrame([(1, "a")], "query_id int, query string"), 3).count() == 0


def test_holding_is_a_plain_loop(spark):
    rnd = random.Random(4)
    forms = [None, "", "a", "ab" * 40, "日本語のテスト" * 3, "x" * 5000 + "needle" + "x" * 7] + ["".join(rnd.choice("abcé😀") for _ in range(rnd.randrange(1, 200))) for _ in range(60)]
    terms = {"a", "é😀", "needle", "x" * 31, "ab" * 20, "zz", "本語", "x" * 100} | {f[s : s + n] for f in forms if f for n in (1, 2, 3, 6, 7, 14, 15, 30, 31, 50) for s in [rnd.randrange(max(1, len(f) - n))] if f[s : s + n]}
    chunks = spark.createDataFrame([(i, "s", f) for i, f in enumerate(forms)], "chunk_id long, source_id string, form string").repartition(3)
    got = {(r.chunk_id, r.term) for r in binding.holding(chunks, spark.createDataFrame([(t,) for t in sorted(terms)], "term string")).collect()}
    assert got == {(i, t) for i, f in enumerate(forms) for t in terms if f and t in f}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=80), st.text(alphabet="ab", max_size=20), st.text(alphabet="ab", max_size=20))
def test_every_window_meets_a_piece(term, before, after):
    """What the join relies on, in plain words: in each whole window of a term one of q pieces is a piece of any text around it."""
    text = before + term + after
    q = next(n for n in binding.GRAMS if len(term) >= 2 * n - 1)
    pieces = {(i, text[i : i + q]) for i in range(0, len(text) - q + 1, q)}
    for window in range((len(term) - (2 * q - 1)) // q + 1):
        assert any((len(before) + at, term[at : at + q]) in pieces for at in range(window * q, window * q + q))


def test_questions_of_any_source(spark, chunks):
    asked = spark.createDataFrame([("q", ["限速"]), ("none", [])], "id string, evidence_terms array<string>")
    got = binding.bind(asked, chunks).collect()
    assert got and all(r.query_id == "q" for r in got) and len({r.source_id for r in got}) == len(got)
