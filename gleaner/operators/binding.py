"""Ground truth: questions bound to the chunks that hold all their evidence terms.

Terms are sought by a positional q-gram index, in column expressions. A text is cut into pieces of q characters; wherever a term of
2q - 1 characters or more occurs, one of the q pieces that begin in its first q places (in fact in any window of it) is
such a piece of the text. Of each term the window whose pieces are rarest in the corpus is the key of a join with the pieces of
the texts; how far apart term and text lie gives the place where the term must begin, and only that place is compared. q follows from a
term's length, 16 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import binding_form
from gleaner.session import cut, union_all

#: Piece lengths, for terms of 2q - 1 characters or more.
GRAMS = (16, 8, 4, 2, 1)


def page_distance(page_start: Column, page_end: Column, hint: Column) -> Column:
    end = F.coalesce(F.nullif(page_end, F.lit(0)), page_start)
    apart = F.least(F.abs(page_start - hint), F.abs(end - hint))
    return F.when(hint.isNull() | page_start.isNull() | hint.between(page_start, end), 0).otherwise(apart)


def _asked(questions: DataFrame, exact: bool) -> DataFrame:
    """id, term: every distinct term of every question in its binding form, empty ones left out."""
    rows = questions.select("id", F.explode("evidence_terms").alias("t"))
    return rows.select("id", binding_form(F.col("t"), exact).alias("term")).filter(F.length("term") > 0).distinct()


def term_grams(terms: DataFrame) -> DataFrame:
    """term, size, q, window, at, h: the pieces at every place of every whole window of the terms (term, none empty)."""
    size = F.length("term")
    q = F.lit(1)
    for n in reversed(GRAMS):
        q = F.when(size >= 2 * n - 1, n).otherwise(q)
    sized = terms.select("term", size.alias("size"), q.alias("q")).withColumn("windows", F.expr("(size - (2 * q - 1)) div q + 1"))
    placed = sized.select("term", "size", "q", F.explode(F.sequence(F.lit(0), (F.col("windows") * F.col("q") - 1).cast("int"))).alias("at"))
    return placed.select("term", "size", "q", F.expr("at div q").alias("window"), "at", F.xxhash64("q", F.expr("substring(term, at + 1, q)")).alias("h"))


def text_grams(chunks: DataFrame, q: int) -> DataFrame:
    """chunk_id, at, h: the pieces of q characters that a form (chunk_id, form) is cut into."""
    pieces = F.regexp_extract_all("form", F.lit(f"(?s).{{{q}}}"), F.lit(0))
    if q == 1:  # single characters come again and again, and their places say little
        return chunks.select("chunk_id", F.explode(F.array_distinct(pieces)).alias("piece")).select("chunk_id", F.lit(None).cast("int").alias("at"), F.xxhash64(F.lit(q), "piece").alias("h"))
    return chunks.select("chunk_id", F.posexplode(pieces).alias("i", "piece")).select("chunk_id", (F.col("i") * q).alias("at"), F.xxhash64(F.lit(q), "piece").alias("h"))


def holding(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, source_id, term): which of the terms (term) each chunk's ``form`` holds. chunk_id is a key."""
    grams = cut(term_grams(terms), "binding-terms")
    lengths = [r.q for r in grams.select("q").distinct().collect()]  # five at most
    if not lengths:
        return chunks.select("chunk_id", "source_id", F.lit(None).cast("string").alias("term")).filter(F.lit(False))
    pieces = union_all([text_grams(chunks, q) for q in lengths])
    met = cut(pieces.join(grams.select("h").distinct(), "h", "left_semi"), "binding-pieces")
    often = met.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    windows = grams.join(often, "h", "left").groupBy("term", "window").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = windows.groupBy("term").agg(F.min(F.struct("n", "window")).alias("best")).select("term", F.col("best.window").alias("window"))
    keys = grams.join(rarest, ["term", "window"]).select("h", "term", "size", F.col("at").alias("term_at"))
    begin = F.col("at") - F.col("term_at")
    # written, so that Spark knows how few they are before it brings texts to them
    spots = cut(met.join(keys, "h").withColumn("begin", begin).filter("begin IS NULL OR begin >= 0").select("chunk_id", "term", "size", "begin").distinct(), "binding-spots")
    there = F.when(F.col("begin").isNull(), F.contains("form", "term")).otherwise(F.expr("substring(form, begin + 1, size)") == F.col("term"))
    return chunks.select("chunk_id", "source_id", "form").join(spots, "chunk_id").filter(there).select("chunk_id", "source_id", "term").distinct()


def candidates(questions: DataFrame, chunks: DataFrame, exact: bool = True) -> DataFrame:
    """(id, chunk_id, place, ...) of the chunks of a question's source that hold all its terms, the nearest page first.

    Questions without a column source_id are asked of every source, each for itself. What is joined are the terms that a chunk holds, not
    questions and chunks. A question without terms has every chunk of its source, or
    none if it names no source.
    """
    hints = questions if "page_hint" in questions.columns else questions.withColumn("page_hint", F.lit(None).cast("int"))
    at_home = "source_id" in questions.columns
    asked = _asked(questions, exact)
    wanted = hints.select("id", *["source_id"] * at_home, "page_hint").join(asked.groupBy("id").agg(F.count(F.lit(1)).alias("terms")), "id", "left")
    forms = chunks.select("chunk_id", "source_id", binding_form(F.col("text"), exact).alias("form"))
    met = holding(forms, asked.select("term").distinct()).join(asked, "term").groupBy("id", "chunk_id", "source_id").agg(F.count(F.lit(1)).alias("held"))
    columns = ["id", "source_id", "page_hint", "chunk_id"]
    rows = met.join(wanted.filter("terms > 0"), ["id", *["source_id"] * at_home]).filter("held = terms").select(*columns)
    if at_home:
        rows = rows.unionByName(wanted.filter("terms IS NULL").join(chunks.select("source_id", "chunk_id"), "source_id").select(*columns))
    rows = rows.join(chunks.drop("text"), ["source_id", "chunk_id"])
    order = Window.partitionBy("id", *[] if at_home else ["source_id"]).orderBy(page_distance(F.col("page_start"), F.col("page_end"), F.col("page_hint")), "character_count", "chunk_index", "chunk_id")
    return rows.withColumn("place", F.row_number().over(order)).filter("place <= 4")


def bind(questions: DataFrame, chunks: DataFrame, exact: bool = True) -> DataFrame:
    """query_id (and source_id), relevant_chunk_ids (four at most, best first), primary_chunk_id, relevant_document_ids, source_locator."""
    rows = candidates(questions, chunks, exact)
    grouped = rows.groupBy(F.col("id").alias("query_id"), "source_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "chunk_id"))).alias("best"),
        F.array_sort(F.collect_set("document_id")).alias("relevant_document_ids"),
        F.min_by(F.struct("page_start", "page_end", "section_path"), "place").alias("at"),
    )
    ids = F.transform("best", lambda b: b["chunk_id"])
    paged = F.col("at.page_start").isNotNull()
    place = F.struct(F.when(paged, "pdf_page").otherwise("web_section").alias("type"), F.col("at.page_start").alias("page_start"), F.col("at.page_end").alias("page_end"), F.when(~paged, F.coalesce("at.section_path", F.array().cast("array<string>"))).alias("section_path"))
    return grouped.select("query_id", "source_id", ids.alias("relevant_chunk_ids"), ids[0].alias("primary_chunk_id"), "relevant_document_ids", place.alias("source_locator"))


def bind_all(questions: DataFrame, chunks: DataFrame, exact: bool = True) -> DataFrame:
    """``bind``, or an error that names questions without a chunk or with a repeated id."""
    repeated = questions.groupBy("id").count().filter("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"duplicate query ids: {[r.id for r in repeated]}")
    bound = bind(questions, chunks, exact)
    missing = questions.join(bound, questions["id"] == bound["query_id"], "left_anti").select("id").limit(5).collect()
    if missing:
        raise ValueError(f"no chunk contains all evidence terms of {[r.id for r in missing]}")
    return bound


def summary(questions: DataFrame) -> DataFrame:
    return questions.agg(F.count(F.lit(1)).alias("questions"), F.countDistinct("id").alias("distinct_ids"), F.countDistinct("source_id").alias("sources"))
