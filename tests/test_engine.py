"""Facts about single operators on small fixtures."""

from __future__ import annotations

import io
import json
import os
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from gleaner import cli
from gleaner.config import AnswerConfig, ChunkConfig
from gleaner.functions import pytext, text as tx
from gleaner.operators import answer, binding, chunking, fusion, metrics
from gleaner.operators.dense import HashingEncoder, cached_embeddings, dense_search, refreshed_embeddings
from gleaner.operators.excerpt import excerpt, terms_of
from gleaner.operators.lexical import bm25_search, build_index
from gleaner.plans import catalog, ingest
from gleaner.plans.ingest import build
from gleaner.plans.retrieval import MODES, Retriever, evaluate, validated
from gleaner.sinks import package, writers
from gleaner.sources import fetch, files, html, manifest, markdown, pages
from gleaner.sources.charset import CharsetModel

CHUNKS = [
    ("c1", "d1", "s1", "线路检修规程", "发现钢轨裂纹时应当立即限速并安排检查。", 3, 3, ["钢轨"]),
    ("c2", "d2", "s2", "应急演练办法", "每半年组织一次综合应急预案的演练，并记录结果。", None, None, ["演练频率"]),
    ("c3", "d3", "s3", "Station rules", "The station staff adjusts entry and exit routes. It follows the passenger flow closely.", 8, 9, []),
]
COLUMNS = "chunk_id string, document_id string, source_id string, title string, text string, page_start int, page_end int, section_path array<string>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = spark.createDataFrame(CHUNKS, COLUMNS)
    return rows.withColumns({"character_count": F.length("text"), "chunk_index": F.lit(0), "source_page": F.lit("https://example.org/p"), "content_sha256": F.sha2(F.encode("text", "UTF-8"), 256)})


def one(spark, column, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"v{i} string" for i in range(len(values)))).select(column.alias("x")).first().x


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_tokens_of_mixed_text(spark):
    found = one(spark, tx.tokens(F.col("v0")), "轨道 Track-Circuit B2-304 straße Ｆｕｌｌ")
    assert found == ["轨道", "track-circuit", "b2-304", "strasse", "full"]


def test_clean_text_agrees_with_python(spark):
    for t in ("  a b​ \n\n c ", "轨 道 x", "ﬁne\tｔｅｘｔ", ""):
        assert one(spark, tx.clean_block(F.col("v0")), t) == pytext.clean_block(t)


@pytest.mark.parametrize(("line", "want"), [("第一章 总则", True), ("CHAPTER 2 Scope", True), ("1、范围", True), ("GENERAL RULES", True), ("第一章 总则。", False), ("plain words", False), ("x" * 101, False)])
def test_headings(spark, line, want):
    assert one(spark, tx.is_heading(F.col("v0")), line) is want
    assert pytext.is_heading(line) is want


def test_bm25_ranks_the_relevant_chunk_first_and_fills_up(spark, chunks):
    rows = bm25_search(build_index(chunks), asked(spark, "综合应急预案多久演练一次", "nothing"), 3).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in rows][0] == "c2" and len(rows) == 6
    assert [(r.chunk_id, r.score) for r in rows][3:] == [("c1", 0.0), ("c2", 0.0), ("c3", 0.0)]


def test_fusion_ties_go_by_id_and_order_of_rankings_is_irrelevant(spark):
    a = spark.createDataFrame([(0, "c1", 1, "bm25"), (0, "c2", 2, "bm25")], "query_id int, chunk_id string, rank int, stage string")
    b = spark.createDataFrame([(0, "c2", 1, "dense"), (0, "c1", 2, "dense")], "query_id int, chunk_id string, rank int, stage string")
    one_, two = (fusion.fuse(x).orderBy("rank").collect() for x in ([a, b], [b, a]))
    assert one_ == two and [r.chunk_id for r in one_] == ["c1", "c2"]
    assert one_[0].component_ranks == {"bm25": 1, "dense": 2}


def test_excerpt_keeps_late_evidence(spark):
    text = "无关说明。" * 100 + "检修记录应保存至设备使用寿命终止。" + "附则。" * 100
    row = spark.createDataFrame([("检修记录保存多久", text)], "q string, t string").withColumn("terms", terms_of(F.col("q")))
    assert "检修记录应保存" in row.select(excerpt(F.col("terms"), F.col("t"), 120).alias("x")).first().x


def test_metrics(spark):
    ranking = spark.createDataFrame([(0, "x", 1), (0, "c1", 2), (0, "c2", 3), (1, "x", 1)], "query_id int, chunk_id string, rank int")
    relevant = spark.createDataFrame([(0, "c1"), (0, "c2")], "query_id int, chunk_id string")
    found = {r.query_id: r for r in metrics.per_query(ranking, relevant).collect()}
    assert found[0].recall_at_5 == 1.0 and found[0].hit_at_5 == 1.0 and found[0].mrr_at_10 == 0.5
    assert found[0].ndcg_at_10 == pytest.approx((1 / np.log2(3) + 1 / np.log2(4)) / (1 + 1 / np.log2(3)))
    assert found[1].recall_at_5 == found[1].ndcg_at_10 == found[1].mrr_at_10 == 0.0


def test_answer_without_a_generator_cites_its_source(spark, chunks):
    ranking = chunks.filter("chunk_id = 'c2'").withColumn("rank", F.lit(1))
    found = answer.answer_one("综合应急预案多久演练一次？", ranking, mode="never")
    assert found["generator"] == "extractive-fallback" and "[S1]" in found["answer"]
    assert found["sources"][0]["locator"] == "演练频率" and "每半年" in found["sources"][0]["evidence"]


def test_answer_by_a_generator_and_without_the_required_one(spark, chunks):
    class Fake:
        name = "fake:model"

        def answer(self, instructions, prompt):
            assert instructions == answer.INSTRUCTIONS and "[S1]" in prompt
            return " said [S1] "

    ranking = chunks.filter("chunk_id = 'c3'").withColumn("rank", F.lit(1))
    assert answer.answer_one("q", ranking, mode="required", generator=Fake())["answer"] == "said [S1]"
    with pytest.raises(RuntimeError):
        answer.answer_one("q", ranking, mode="required")
    assert answer.answer_one("q", ranking.limit(0), mode="never")["answer"] == answer.NOT_FOUND


def test_evidence_keeps_the_budget(spark):
    ranking = spark.createDataFrame([(0, i, "x" * 40) for i in range(1, 9)], "query_id int, rank int, text string")
    rows = answer.evidence(ranking, AnswerConfig(max_evidence_chunks=4, max_evidence_characters=100)).orderBy("rank").collect()
    assert [len(r.text) for r in rows] == [40, 40, 20] and [r.citation for r in rows] == ["S1", "S2", "S3"]


def test_binding_and_its_errors(spark, chunks):
    specs = spark.createDataFrame([("q1", "s1", ["钢轨 裂纹", "限速"], 9)], "id string, source_id string, evidence_terms array<string>, page_hint int")
    row = binding.bind_all(specs, chunks).first()
    assert row.relevant_chunk_ids == ["c1"] and row.source_locator.type == "pdf_page"
    with pytest.raises(ValueError, match="q1"):
        binding.bind_all(specs.withColumn("source_id", F.lit("s3")), chunks)
    with pytest.raises(ValueError, match="duplicate"):
        binding.bind_all(specs.union(specs), chunks)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。.!\n；é", max_size=3000), st.integers(200, 400), st.integers(0, 199), st.integers(1, 200))
def test_cuts_cover_the_text(text, size, overlap, least):
    found = list(chunking.cuts(text, ChunkConfig(size, overlap, least)))
    seen = [False] * len(text)
    for a, z in found:
        assert 0 < z - a <= max(size, least) and text[a:z] == text[a:z].strip()
        seen[a:z] = [True] * (z - a)
    assert all(s or c.isspace() for s, c in zip(seen, text, strict=True))


def test_chunk_config_is_checked():
    for bad in ((100, 10, 10), (300, 300, 10), (300, 10, 301)):
        with pytest.raises(ValueError):
            ChunkConfig(*bad)


def test_html_blocks_links_and_main_node(spark):
    page = f"<html><body><nav><a href='/n'>n</a></nav><div class='content'><h1>Top</h1><p>{'word ' * 60}</p><h3>Sub</h3><table><tr><td>a</td><td>b</td></tr></table><pre>x  y</pre><p>打印</p></div><footer>f</footer></body></html>"
    found = html.page_blocks(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("pos").collect()
    assert [(b["kind"], b["section_path"]) for b in found] == [("heading", ["Top"]), ("paragraph", ["Top"]), ("heading", ["Top", "Sub"]), ("paragraph", ["Top", "Sub"]), ("code", ["Top", "Sub"])]
    assert found[3]["text"] == "a | b"
    assert html.links_of(page, "https://h.example/x/y") == [{"pos": 0, "href": "https://h.example/n", "text": "n"}]


def test_markdown_blocks():
    found = markdown.blocks_of("# One #\n\ntext *b*\nmore [l](u)\n\n```\ncode *x*\n```\n### Deep\nend\n```\nopen")
    assert [(b["kind"], b["text"], b["section_path"]) for b in found] == [
        ("heading", "One", ["One"]), ("paragraph", "text b more l", ["One"]), ("code", "code *x*", ["One"]),
        ("heading", "Deep", ["One", "Deep"]), ("paragraph", "end", ["One", "Deep"]), ("code", "open", ["One", "Deep"]),
    ]


def plain_line_blocks(document):
    """The blocks of a document (a list of pages of lines), line by line."""
    texts = [[t for t in map(pytext.clean_block, page) if t] for page in document]
    edges = Counter(t for page in texts for t in page[:3] + (page[-3:] if len(page) >= 3 else page) if 2 <= len(t) <= 100 and not pytext.is_page_number(t))
    most = max(3, int(0.4 * sum(map(bool, texts)) + 0.999))
    out, path = [], []
    for number, page in enumerate(texts, 1):
        held = []

        def done():
            if held:
                out.append(("paragraph", number, list(path), pytext.clean_block(" ".join(held))))
                held.clear()

        for t in page:
            if edges[t] >= most or pytext.is_page_number(t):
                continue
            if pytext.is_heading(t):
                done()
                path = [*path[: 0 if len(t) <= 35 else 1], t]
                out.append(("heading", number, list(path), t))
                continue
            held.append(t)
            if sum(len(x) + 1 for x in held) > 240 and t[-1] in "。！？.!?；;：:":
                done()
        done()
    return [(i, *b) for i, b in enumerate(out)]


def test_line_blocks_are_a_plain_loop(spark):
    rnd = random.Random(6)
    choice = ["Head", "第一章 总则", "CHAPTER 2 " + "A LONG TITLE " * 3, "- 1 -", "12", "text one", "some words that end here.", "long " * 30, "long words end. " * 9, "", " ", "中文，没有", "Part B", "x"]
    documents = [[[rnd.choice(choice) for _ in range(rnd.randrange(14))] for _ in range(rnd.randrange(7))] for _ in range(40)]
    rows = [(d, p, n, line, "clash") for d, document in enumerate(documents) for p, page in enumerate(document, 1) for n, line in enumerate(page)]
    rows += [(None, 1, 0, "a line without a document", "x"), (3, None, 0, "a line without a page", "x"), (3, 1, 99, None, "x")]
    table = spark.createDataFrame(rows, "document_id int, page int, no int, line string, block string").repartition(5)
    got = {}
    for r in pages.line_blocks(table).orderBy("document_id", "pos").collect():
        got.setdefault(r.document_id, []).append((r.pos, r.kind, r.page, r.section_path, r.text))
    assert got.pop(None) == [(0, "paragraph", 1, [], "a line without a document")]
    assert {d: got.get(d, []) for d in range(40)} == {d: plain_line_blocks(document) for d, document in enumerate(documents)}
    assert pages.line_blocks(table.limit(0)).count() == 0


def test_pdf_goes_through_a_reader_or_is_an_error(spark):
    class Reader:
        def pages(self, body):
            if body == b"bad":
                raise ValueError("broken file")
            return [[line for line in page.split("\n")] for page in body.decode().split("\f")]

    bodies = {"a": b"Part One\n" + b"A sentence of the first page. " * 5 + b"\f" + b"Part Two\n" + b"More words on this page. " * 5, "b": b"bad", "c": b"x\fy"}
    rows = spark.createDataFrame([(k, "s", "t", f"{k}.pdf", None, "pdf", v) for k, v in bodies.items()], "document_id string, source_id string, title string, raw_path string, member_path string, suffix string, content binary")
    good, other = ingest.documents_of(rows, Reader())
    found = good.first()
    assert good.count() == 1 and found.document_id == "a" and [tuple(s.section_path) for s in found.spans] == [("Part One",), ("Part One",), ("Part Two",), ("Part Two",)] and found.spans[2].page == 2
    assert {r.document_id: (r.error, len(r.warnings)) for r in other.collect()} == {"b": ("ValueError: broken file", 0), "c": ("text too short: 4 characters", 1)}
    assert {r.error for r in ingest.documents_of(rows)[1].collect()} == {"no page reader for pdf"}


def test_manifest_rules_selection_and_plan(spark):
    good = {"id": "a", "repository_policy": "manifest_only", "fetch": {"enabled": True, "kind": "webpage_bundle", "urls": ["https://h/x", "https://h/y"], "filenames": ["x.html", "y.html"], "allowed_hosts": ["h"]}}
    rows = manifest.check(manifest.sources(spark, {"manifest_version": 1, "defaults": {}, "sources": [good]}))
    assert manifest.fetch_plan(rows).count() == 2
    with pytest.raises(manifest.ManifestError):
        manifest.check(manifest.sources(spark, {"manifest_version": 1, "defaults": {}, "sources": [good, good]}))
    with pytest.raises(manifest.ManifestError):
        manifest.select(rows, only=["zzz"])
    with pytest.raises(manifest.ManifestError):
        manifest.sources(spark, {"manifest_version": 2})


def test_fetch_checks_before_and_after(spark):
    plan = spark.createDataFrame([("a", "https://h/x.pdf", "x.pdf", ["h"]), ("a", "http://h/y", "y", ["h"]), ("a", "https://h/z.pdf", "z.pdf", ["h"]), ("a", "https://h/moved", "m", ["h"])], "id string, url string, filename string, allowed_hosts array<string>")

    def transport(url, timeout, most):
        if url.endswith("moved"):
            return b"x", "https://elsewhere/x", "text/html"
        return (b"%PDF-1" if "x.pdf" in url else b"no"), url, "application/pdf"

    got = {r.filename: r for r in fetch.fetch(plan, transport).collect()}
    assert got["x.pdf"].error is None and got["x.pdf"].body == b"%PDF-1"
    assert got["y"].error and got["z.pdf"].error and got["m"].error
    there = spark.createDataFrame([("a", "x.pdf")], "id string, filename string")
    todo, cached = fetch.to_fetch(plan, there)
    assert (todo.count(), cached.count()) == (3, 1)


def test_fetch_runs_take_what_is_missing_and_log_failures(spark, tmp_path):
    asked, broken = spark.sparkContext.accumulator(0), str(tmp_path / "up")

    def transport(url, timeout, most):
        asked.add(1)
        if "bad" in url and not os.path.exists(broken):
            raise OSError("no answer")
        return b"<html><body><p>" + url.encode() + b" says caf\xe9 and more words than forty characters.</p></body></html>", url, "text/html"

    one = lambda i, **f: {"pos": i, "id": f"s{i}", "title": f"T{i}", "repository_policy": "manifest_only", "include_members": [], "fetch": {"enabled": True, "allowed_hosts": ["h"], **f}}
    rows = spark.createDataFrame([one(0, kind="webpage", url="https://h/a.html"), one(1, kind="webpage_bundle", urls=["https://h/b", "https://h/bad"], filenames=["b.html", "bad.html"])], manifest.SOURCE)
    folder, quiet = str(tmp_path / "f"), {"wait": lambda s: None, "retries": 2}
    assert fetch.run(rows, transport, folder, **quiet) == {"downloaded": 2, "failed": 1} and asked.value == 4
    assert fetch.run(rows, transport, folder, **quiet) == {"cached": 2, "failed": 1} and asked.value == 6
    open(broken, "w").close()
    assert fetch.run(rows, transport, folder, **quiet) == {"cached": 2, "downloaded": 1} and asked.value == 7
    log = fetch.logged(spark, folder)
    assert log.filter("status = 'failed'").count() == 2 and log.filter("status = 'downloaded' AND sha256 IS NOT NULL AND bytes > 0").count() == 3
    latin = CharsetModel({"cp1252": np.zeros(1 << 16, np.float32)})
    good, other = ingest.documents_of(ingest.logical_files(fetch.fetched_files(spark, folder)), charsets=latin)
    assert good.filter("text LIKE '%café%'").count() == 3 and other.count() == 0


def test_raw_files_to_chunks(spark, tmp_path):
    folder = tmp_path / "raw/open/src"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("# Title\n\n" + "Some sentence here. " * 30)
    (folder / "_skip.md").write_text("x" * 100)
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("in/b.html", "<html><body><p>" + "words in a page " * 20 + "</p></body></html>")
        z.writestr("../evil.md", "no")
    (folder / "c.zip").write_bytes(body.getvalue())
    rows = files.raw_files(spark, str(tmp_path / "raw"), spark.createDataFrame([("src", "T", ["in/*"])], "id string, title string, include_members array<string>"))
    chunks, rejected = build(rows, ChunkConfig(300, 50, 100))
    made = chunks.collect()
    assert rejected.count() == 0
    assert {r.member_path for r in made} == {None, "in/b.html"} and all(r.chunk_id.startswith("chk_") for r in made)
    assert {tuple(r.section_path) for r in made if r.member_path is None} == {("Title",)}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception, match="broken"):
        files.read_json_lines(spark, str(tmp_path / "b.jsonl"), "a int").collect()


def test_broken_lines_are_named_by_file_and_line(spark, tmp_path):
    """Files of several splits; lines of one and of many bytes, empty ones counted."""
    rnd, want = random.Random(1), []
    for name in ("a", "b"):
        lines = ['{"a": %d, "t": "%s"}' % (i, "x" * rnd.randrange(200)) for i in range(3000)]
        for i in rnd.sample(range(3000), 5):
            lines[i] = "{broken %d" % i
            want.append((f"{name}.jsonl", i + 1))
        for i in rnd.sample(range(3000), 50):
            lines[i] = lines[i] if "broken" in lines[i] else rnd.choice(["", "  "])
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        bad = files.broken_lines(spark, str(tmp_path), "a int, t string")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in bad.collect()) == sorted(want)
        with pytest.raises(ValueError, match=rf"a\.jsonl:{min(n for f, n in want if f[0] == 'a')}: invalid JSON"):
            files.checked_json_lines(spark, str(tmp_path), "a int, t string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_embeddings_are_made_for_what_changed(spark, chunks, tmp_path):
    encoder, folder = HashingEncoder(), str(tmp_path / "e")
    rows = lambda df: sorted((r.chunk_id, tuple(r.embedding)) for r in df.collect())
    made, n = refreshed_embeddings(chunks, encoder, folder, buckets=4)
    assert n == 3 and len(rows(made)) == 3
    again, n = refreshed_embeddings(chunks, encoder, folder, buckets=4)
    assert n == 0 and rows(again) == rows(made)
    changed = chunks.withColumn("text", F.when(F.col("chunk_id") == "c2", "A new text.").otherwise(F.col("text"))).withColumn("content_sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    now, n = refreshed_embeddings(changed, encoder, folder, buckets=4)
    old, new = dict(rows(made)), dict(rows(now))
    assert n == 1 and new["c2"] != old["c2"] and (new["c1"], new["c3"]) == (old["c1"], old["c3"])
    left, n = refreshed_embeddings(changed.filter("chunk_id <> 'c1'"), encoder, folder, buckets=4)
    assert n == 0 and [r[0] for r in rows(left)] == ["c2", "c3"]


def test_dense_search_and_cache(spark, chunks, tmp_path):
    encoder = HashingEncoder()
    made = cached_embeddings(chunks, encoder, str(tmp_path))
    again = cached_embeddings(chunks, encoder, str(tmp_path))
    assert made.inputFiles() == again.inputFiles()
    q = spark.createDataFrame([(0, encoder.encode(["Station rules passenger flow"])[0].tolist())], "query_id int, embedding array<float>")
    assert dense_search(made, q, 1).first().chunk_id == "c3"


def test_modes_and_evaluation(spark, chunks):
    retriever = Retriever(validated(chunks))
    queries = asked(spark, "钢轨裂纹", "passenger flow station").withColumn("language", F.when(F.col("query_id") == 0, "zh").otherwise("en"))
    relevant = spark.createDataFrame([(0, "c1"), (1, "c3")], "query_id int, chunk_id string")
    report, rows = evaluate(retriever, queries, relevant)
    assert set(report["modes"]) == set(MODES) and report["modes"]["bm25"]["metrics"]["mrr_at_10"] == 1.0
    assert rows.count() == 2 * len(MODES)
    assert report["evaluation_set"] == {"query_count": 2, "languages": {"zh": 1, "en": 1}} and report["models"]["embedding"] == "hashing-standin"
    assert list(report["modes"]["rerank"]["stage_latency_ms"]) == ["bm25", "dense", "fusion", "rerank"] and set(report["modes"]["bm25"]["by_language"]) == {"zh", "en"}
    first = rows.filter("mode = 'bm25' AND query_id = 1").first()
    assert first.first_result_source_id == "s3" and first.relevant_chunk_ids == ["c3"] and first.retrieved_chunk_ids[0] == "c3"
    assert retriever.search(queries.select("query_id", "query"), "rerank", 2).count() == 4
    with pytest.raises(ValueError):
        retriever.rank(queries, "magic")
    with pytest.raises(ValueError):
        validated(chunks.union(chunks))
    with pytest.raises(ValueError):
        validated(chunks.limit(0))


def test_release_archive(spark, tmp_path):
    for name in ("README.md", "src/a.py", "src/__pycache__/a.pyc", "other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    made = package.build_archive(spark, str(tmp_path), str(tmp_path / "out.zip"))
    assert made["files"] == 2
    (tmp_path / "docs/data/raw").mkdir(parents=True)
    (tmp_path / "docs/data/raw/a.md").write_text("x")
    with pytest.raises(ValueError, match="forbidden"):
        package.build_archive(spark, str(tmp_path), str(tmp_path / "out2.zip"))


def test_cli(spark, chunks, tmp_path, capsys):
    assert cli.main(["--chunks", str(tmp_path / "none"), "doctor"]) == 1
    assert cli.main(["--chunks", str(tmp_path / "none"), "search", "x"]) == 2
    chunks.write.parquet(str(tmp_path / "c"))
    capsys.readouterr()
    assert cli.main(["--chunks", str(tmp_path / "c"), "search", "passenger flow", "--mode", "bm25", "--top-k", "1"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["chunk_id"] == "c3"
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(dict(zip(("chunk_id", "document_id", "source_id", "title", "text", "page_start", "page_end", "section_path"), c, strict=True)), ensure_ascii=False) for c in CHUNKS))
    (tmp_path / "q.jsonl").write_text('{"query_id": "q1", "query": "passenger flow", "language": "en", "relevant_chunk_ids": ["c3"]}\n')
    (tmp_path / "c.yaml").write_text("evaluation:\n  recall_k: [1, 2]\n  mrr_k: 2\nmodels: {}\n")
    own = ["--config", str(tmp_path / "c.yaml"), "--chunks", str(tmp_path / "c.jsonl")]
    assert cli.main([*own, "evaluate", "--queries", str(tmp_path / "q.jsonl"), "--modes", "bm25", "--output", str(tmp_path / "report.json"), "--details", str(tmp_path / "details")]) == 0
    assert json.loads((tmp_path / "report.json").read_text())["modes"]["bm25"]["metrics"] == {"recall_at_1": 1.0, "recall_at_2": 1.0, "hit_at_1": 1.0, "hit_at_2": 1.0, "mrr_at_2": 1.0, "ndcg_at_10": 1.0}
    assert spark.read.json(str(tmp_path / "details")).first().retrieved_chunk_ids[0] == "c3"
    (tmp_path / "c.jsonl").write_text("{}\n{oops\n")
    capsys.readouterr()
    assert cli.main([*own, "search", "x"]) == 2 and "c.jsonl:2: invalid JSON" in capsys.readouterr().err
    writers.write_report(tmp_path / "r.json", {"a": "é"})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": "é"}


def test_stream_of_documents(spark, tmp_path):
    from gleaner.streaming.incremental import arriving_documents, chunk_stream

    spark.createDataFrame([("d", "Sentence one. " * 100)], "document_id string, text string").write.parquet(str(tmp_path / "in"))
    q = chunk_stream(arriving_documents(spark, str(tmp_path / "in"), "document_id string, text string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(list(chunking.cuts("Sentence one. " * 100, ChunkConfig())))


def test_heading_paths_fold_whole_texts(spark, tmp_path):
    heads = ["Chapter 1 One", "Chapter 2 A chapter whose long title is of level two", "Chapter 3 Three", "Chapter 4 Another chapter whose title is of level two"]
    text = "\n".join(f"plain words here, and more of them.\n{h}" for h in heads * 3)
    spark.createDataFrame([(1, text), (2, "no headings here."), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/part.parquet").limit(0).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.doc_id: (r.n_headings, r.path) for r in catalog.queries()["heading_paths"](spark, str(tmp_path)).collect()}
    found, path = [h for h in heads * 3], []
    for h in found:
        path = [*path[: 0 if len(h) <= 35 else 1], h]
    assert got[1] == (12, " > ".join(path)) and got[2] == (0, "")


def test_evidence_comes_from_the_ranking_of_all_documents(spark, tmp_path):
    docs = [(i, f"filler number {i} about nothing at all in particular. " * 3, "en", "s") for i in range(30)] + [(5000, "the quokka sleeps under the old bridge at noon today. " * 3, "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "quokka bridge")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = catalog.queries()
    assert {n for n in run if n.startswith("retrieved_")} <= {f"retrieved_{n}" for n in (*run, "excerpts")}
    first = run["retrieved_evidence_budget"](spark, str(tmp_path)).orderBy("rank").first()
    assert (first.chunk_id, first.citation, first.characters) == (5000, "S1", len(docs[-1][1]))
    assert "quokka" in run["retrieved_extractive_answers"](spark, str(tmp_path)).first().answer
    assert {r.chunk_id: r.excerpt for r in run["retrieved_excerpts"](spark, str(tmp_path)).collect()}[5000].startswith("the quokka")
    assert 5000 in {r.chunk_id for r in run["retrieved_answer_sources"](spark, str(tmp_path)).collect()}
    assert run["retrieved_prompt_context"](spark, str(tmp_path)).count() == 1


def test_collections_are_crawled(spark):
    site = "https://www.gov.uk"
    listing = "".join(f'<a href="{h}">{t}</a>' for h, t in [("/raib-reports/one", "Report 1/2020: One"), ("/raib-reports/one", "Report 1 again"), ("/help", "Report help"), ("/raib-reports/x", "About us"), ("/government/news/report-two", "Bulletin 2"), ("/raib-reports/bad", "Safety digest 3"), ("/raib-reports/four", "Report 4")])
    web = {
        "/list": listing, "/raib-reports/one": '<a href="https://other.org/n.pdf">n</a><a href="/a.PDF">a</a><a href="/b.pdf">b</a>', "/government/news/report-two": "<p>text only</p>",
        "/a.PDF": "%PDF-1", "/raib-reports/four": "<p>past the limit</p>", "/none": "<p>nothing</p>",
    }

    def transport(url, timeout, most):
        if url.removeprefix(site) not in web:
            raise OSError("not found")
        return web[url.removeprefix(site)].encode(), url, "text/html"

    def source(i, name, path):
        return {"pos": i, "id": name, "repository_policy": "manifest_only", "fetch": {"enabled": True, "kind": "govuk_raib_collection", "url": site + path, "allowed_hosts": ["www.gov.uk"], "max_items": 3}}

    rows = spark.createDataFrame([source(0, "full", "/list"), source(1, "empty", "/none")], manifest.SOURCE)
    got = fetch.collections(rows, transport, wait=lambda s: None).collect()
    seen = {(r.id, r.status, r.filename, r.url.removeprefix(site)) for r in got}
    assert seen == {
        ("full", "pdf", "01_one.pdf", "/a.PDF"), ("full", "page_only", "02_report-two.html", "/government/news/report-two"), ("full", "failed", "03_bad.html", "/raib-reports/bad"),
        ("full", "warning", None, "/list"), ("empty", "listing", "_listing.html", "/none"), ("empty", "warning", None, "/none"),
    }
    assert {r.error for r in got if r.status == "warning"} == {"2 of 3 reports", "0 of 3 reports"}
    with pytest.raises(Exception, match="fetch.collections"):
        manifest.fetch_plan(rows).collect()
