"""Answers with evidence: budget, extraction, prompts, sources."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import AnswerConfig
from gleaner.functions.text import stripped, tokens
from gleaner.operators.excerpt import excerpt, terms_of

#: What an answer says without evidence (a fixed value of the answer format).
NOT_FOUND = "未在当前检索证据中找到足以回答该问题的内容。"
#: How a remote model is told to answer, in the language of its prompt.
INSTRUCTIONS = "只根据下面的证据回答。每个事实之后注明证据编号，例如[S1]。证据不够时说明不知道。区分事实与建议，力求简洁。"
SENTENCE_END = r"(?U)(?<=[。！？!?；;.])\s+|\n+"


def locator(page_start: Column, page_end: Column, section: Column) -> Column:
    """Pages if there are any, else the section path, else "web page"."""
    several = F.coalesce((page_end != 0) & (page_end != page_start), F.lit(False))
    pages = F.when(several, F.format_string("pp. %d-%d", page_start, page_end)).otherwise(F.format_string("p. %d", page_start))
    path = F.array_join(F.coalesce(section, F.array().cast("array<string>")), " > ")
    return F.when(page_start.isNotNull(), pages).when(path != "", path).otherwise("web page")


def evidence(ranking: DataFrame, config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """The first rows of each query whose texts fit the budget, the last cut to fit, with citations S1, S2, ...

    ``ranking``: query_id, rank, text and more.
    """
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = ranking.withColumns({"spent": spent, "place": place}).filter((F.col("place") <= config.max_evidence_chunks) & (F.col("spent") < config.max_evidence_characters))
    cut = F.substring(F.col("text"), F.lit(1), (F.lit(config.max_evidence_characters) - F.col("spent")).cast("int"))
    return rows.withColumn("text", cut).withColumn("citation", F.concat(F.lit("S"), F.col("place"))).drop("spent", "place")


def extractive_answers(queries: DataFrame, found: DataFrame, exact: bool = True) -> DataFrame:
    """(query_id, answer): the two sentences of the evidence that share most tokens with the query, cited.

    Of equal shares the earlier place in its chunk comes first, then the greater sentence, then the greater citation.
    """
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query"), exact)).alias("asked"))
    sentences = found.select("query_id", "citation", F.posexplode(F.split("text", SENTENCE_END)).alias("place", "raw")).withColumn("sentence", stripped(F.col("raw"))).filter(F.length("sentence") >= 20)
    scored = sentences.join(asked, "query_id").withColumn("share", F.size(F.array_intersect(F.array_distinct(tokens(F.col("sentence"), exact)), F.col("asked"))))
    order = [F.desc("share"), F.asc("place"), F.desc("sentence"), F.desc("citation")]
    once = scored.withColumn("bare", F.regexp_replace("sentence", r"(?U)\s+", "")).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "bare").orderBy(*order))).filter("nth = 1")
    best = once.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter("n <= 2")
    text = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", F.format_string("%s [%s]", "sentence", "citation").alias("s")))).alias("s"))
    joined = text.select("query_id", F.array_join(F.transform("s", lambda x: x["s"]), " ").alias("answer"))
    return queries.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"))


def prompts(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, prompt) for a remote model: the question and the numbered evidence."""
    place = F.format_string("[%s] %s | %s | %s\n%s", F.col("citation"), F.col("title"), locator(F.col("page_start"), F.col("page_end"), F.col("section_path")), F.coalesce("source_page", F.lit("None")), F.col("text"))
    parts = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", place.alias("part")))).alias("parts"))
    context = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<rank:int,part:string>>")), lambda p: p["part"]), "\n\n")
    return queries.select("query_id", "query").join(parts, "query_id", "left").select("query_id", F.concat(F.lit("问题："), F.col("query"), F.lit("\n\n证据：\n"), context).alias("prompt"))


def sources(queries: DataFrame, found: DataFrame, config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """One row per citation: where it is from, and the excerpt nearest to the query."""
    rows = found.join(queries.select("query_id", terms_of(F.col("query")).alias("terms")), "query_id")
    return rows.select("query_id", "citation", "title", "source_id", "chunk_id", locator(F.col("page_start"), F.col("page_end"), F.col("section_path")).alias("locator"), "page_start", "page_end", "section_path", "source_page", excerpt(F.col("terms"), F.col("text"), config.excerpt_characters).alias("evidence"))


class Generator(Protocol):
    name: str

    def answer(self, instructions: str, prompt: str) -> str: ...


def answer_one(query: str, ranking: DataFrame, config: AnswerConfig = AnswerConfig(), mode: str = "auto", generator: Generator | None = None) -> dict:
    """The answer to one question, by a remote model if one is given (and ``mode`` isn't never), else by extraction."""
    if mode not in ("auto", "never", "required"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "required" and generator is None:
        raise RuntimeError("a generator is required")
    asked = ranking.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    found = evidence(ranking.withColumn("query_id", F.lit(0)), config)
    if generator is not None and mode != "never":
        text, name = generator.answer(INSTRUCTIONS, prompts(asked, found).first().prompt).strip(), generator.name
    else:
        text, name = extractive_answers(asked, found).first().answer, "extractive-fallback"
    cited = sources(asked, found, config).drop("query_id").orderBy(F.substring("citation", 2, 9).cast("int"))
    return {"query": query, "answer": text, "generator": name, "sources": [r.asDict() for r in cited.collect()]}  # max_evidence_chunks rows at most
