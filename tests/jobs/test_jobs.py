"""The jobs on copies of the tables that grow between runs, on odd rows, and against their SQL."""

from __future__ import annotations

import logging

import pytest
from conftest import SF, comparable
from pyspark.sql import functions as F

from gleaner.plans import build
from jobs import corpus_build, queries, retrieval_evaluation
from jobs.common import read_config

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_query(spark, duck, name):
    before = dict(spark.conf.getAll)
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
    assert dict(spark.conf.getAll) == before


def state(spark, output):
    documents, chunks = corpus_build.current(spark, output)
    return documents.drop("batch"), chunks.drop("batch")


def rows_of(df):
    return sorted(map(str, df.collect()))


def batches(spark, output):
    return sorted(r.batch for r in spark.read.parquet(f"{output}/documents").select("batch").distinct().collect())


def test_corpus_build_takes_only_what_is_new(spark, tmp_path, caplog):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.filter("doc_id < 120").coalesce(2).write.parquet(source)
    logging.getLogger("jobs").propagate = True
    with caplog.at_level(logging.INFO, "jobs"):
        assert corpus_build.run(spark, source, out, mark) == 120
    assert any("accepted" in m for m in caplog.messages) and any("read 120 rows" in m for m in caplog.messages)
    first = rows_of(state(spark, out)[1])
    assert corpus_build.run(spark, source, out, mark) == 0  # nothing has come
    assert rows_of(state(spark, out)[1]) == first and batches(spark, out) == [0]
    # the rest, some rows again, and one document with a new text
    new = docs.filter("doc_id >= 100").withColumn("text", F.when(F.col("doc_id") == 101, F.lit("A new text of this document. " * 60)).otherwise(F.col("text")))
    new.coalesce(1).write.mode("append").parquet(source)
    assert corpus_build.run(spark, source, out, mark) == docs.count() - 100
    documents, chunks = state(spark, out)
    assert batches(spark, out) == [0, 1]
    taken = spark.read.parquet(f"{out}/documents").filter("batch = 1").count()
    assert taken == docs.filter("doc_id >= 120").count() + 1  # what was there with the same text is passed over
    whole = str(tmp_path / "whole")
    docs.filter("doc_id <> 101").unionByName(new.filter("doc_id = 101")).write.parquet(whole)
    corpus_build.run(spark, whole, str(tmp_path / "out2"), str(tmp_path / "mark2"))
    again = state(spark, str(tmp_path / "out2"))
    assert rows_of(documents.drop("spans")) == rows_of(again[0].drop("spans")) and rows_of(chunks) == rows_of(again[1])
    report = spark.read.parquet(f"{out}/report")
    sums = report.agg(F.sum("documents"), F.sum(F.col("accepted") + F.col("rejected"))).first()
    assert sums[0] == sums[1] == spark.read.parquet(f"{out}/documents").count()


def test_corpus_build_repeats_an_unfinished_batch(spark, tmp_path):
    """The chunks of a batch are gone and the mark isn't there yet: the next run makes the same."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.read.parquet(f"{SF}/documents.parquet").limit(40).write.parquet(source)
    config = read_config(corpus_build.DEFAULT_CONFIG)
    rows = spark.read.parquet(source)
    corpus_build.take_batch(rows, 0, out, config)
    want = rows_of(state(spark, out)[0]), rows_of(state(spark, out)[1])
    for _ in range(2):
        corpus_build.take_batch(rows, 0, out, config)
        assert (rows_of(state(spark, out)[0]), rows_of(state(spark, out)[1])) == want
    corpus_build.run(spark, source, out, str(tmp_path / "mark"))  # the stream's batch 0 is that batch
    assert (rows_of(state(spark, out)[0]), rows_of(state(spark, out)[1])) == want


def test_corpus_build_of_odd_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    long = "One sentence of a very long text. " * 40_000
    rows = [(1, "a", "en", "short"), (2, "a", "en", None), (None, "a", "en", "x" * 50), (3, None, "en", "y" * 50), (4, "a", None, "z" * 50), (5, "a", "en", ""), (6, "b", "en", long), (7, "b", "en", "w" * 60), (7, "b", "en", "w" * 60), (8, "b", "en", "v1 " * 30), (8, "b", "en", "v2 " * 30)]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, text string, status string, batch int").repartition(3).write.parquet(source)
    assert corpus_build.run(spark, source, out, str(tmp_path / "mark")) == len(rows)
    documents, chunks = corpus_build.current(spark, out)
    assert documents.filter("document_id IS NULL").count() == 2
    assert {(r.error or "").split(":")[0]: r.n for r in documents.groupBy("error").agg(F.count(F.lit(1)).alias("n")).collect()} == {"": 4, "no id": 2, "no content": 1, "text too short": 1} or documents.filter("status = 'rejected'").count() == 5
    assert documents.filter("status = 'accepted'").count() == 4
    assert chunks.filter("character_count > 900").count() == 0 and chunks.filter("source_id = 'b'").count() > 1000
    empty = str(tmp_path / "none")
    spark.read.parquet(source).limit(0).write.parquet(empty)
    assert corpus_build.run(spark, empty, str(tmp_path / "out3"), str(tmp_path / "mark3")) == 0
    assert corpus_build.current(spark, str(tmp_path / "out3"))[1].count() == 0


def test_judged_documents_of_every_kind(spark):
    raw = spark.createDataFrame([("s", "1", "<html><body><h1>Title</h1><p>" + "word " * 20 + "</p></body></html>", "html"), ("s", "2", "# Head\n\n" + "text " * 20, "md"), ("s", "3", "x" * 50, "pdf")], "source string, key string, body string, kind string")
    rows = raw.select(*build.raw_document(F.col("source"), F.col("key"), F.col("body"), F.col("kind"), F.col("source"), F.lit("en")))
    got = {r.file_type: r for r in build.judged_documents(rows).collect()}
    assert got["html"].status == got["md"].status == "accepted" and got["md"].spans[1].section_path == ["Head"]
    assert got["pdf"].error == "unknown file type pdf" and got["pdf"].text is None


def test_retrieval_evaluation(spark, tmp_path):
    corpus, asked, out = (str(tmp_path / n) for n in ("c", "q", "out"))
    texts = ["The brake test is done every seven days by the driver.", "Points are heated in winter.", "The BRAKE test  is done every seven days by the driver. See also the winter rules for points.", None, ""]
    spark.createDataFrame([(i, t, "s", "en" if i < 2 else "fr", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, rank int").write.parquet(corpus)
    spark.createDataFrame([(1, "brake test is done every seven days"), (2, "points are heated"), (3, "nothing like this"), (4, None), (None, "winter")], "item_id long, text string").write.parquet(asked)
    counts = retrieval_evaluation.run(spark, corpus, asked, out)
    assert counts == {"questions": 5, "unusable": 2, "bound": 2, "details": 4}
    details = {(r.mode, r.query_id): r for r in spark.read.parquet(f"{out}/details").collect()}
    assert details["bm25", "1"].relevant_chunk_ids == ["0", "2"] and details["bm25", "1"].recall_at_5 == 1 and details["bm25", "1"].language == "en"
    assert details["rerank", "2"].retrieved_chunk_ids[0] == "1"
    first = rows_of(spark.read.parquet(f"{out}/details")), rows_of(spark.read.parquet(f"{out}/summary"))
    retrieval_evaluation.run(spark, corpus, asked, out)
    assert (rows_of(spark.read.parquet(f"{out}/details")), rows_of(spark.read.parquet(f"{out}/summary"))) == first
    assert spark.read.parquet(f"{out}/questions").filter("status = 'unbound'").count() == 1
    with pytest.raises(ValueError, match="unknown modes"):
        retrieval_evaluation.run(spark, corpus, asked, out, {"evaluation": {"modes": ["x"]}})
    spark.read.parquet(asked).unionByName(spark.read.parquet(asked)).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="duplicate query id"):
        retrieval_evaluation.run(spark, corpus, str(tmp_path / "twice"), out)
