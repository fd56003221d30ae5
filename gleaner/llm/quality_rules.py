"""Rule-based quality: a table of thresholds compiled into one projection, with DataFrame functions only.

``RULES`` lists what a text must keep to, each as a ratio of two counts in thousandths with a least or a most value.
``compiled`` makes one column of the table: the names of the rules that a text breaks. Counts are integers and ratios are
compared by multiplication, so no rounding decides. Nothing is shuffled: a text is judged by its own row alone, and repeated
windows are found by sorting the hashes of the row's own windows.

A word is a run of ``[^\\x20\\x09-\\x0D]``; a line is what lies between two ``\\n``. Windows are compared by a 64-bit hash of their
words; within a text of a million words two different windows share one with a probability of 3e-8.

Defined cases: a null text has no words and an empty one neither, both are base_failed; lines without a word count neither as lines
nor as repeats; repeated rows are judged each by itself; a null doc_id is kept as null; an empty table gives an empty
result; other columns are ignored, whatever their names. A text of n words needs memory in proportion to n, in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import id_text

#: What parts words (fixed values of the word's definition), and the characters that count as symbols (fixed values).
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Words that running text of each language can't do without; others can be passed.
STOP_WORDS = (
    *("the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "this", "from", "by", "at", "or", "an", "not"),
    *("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht", "dem", "ein", "eine", "als"),
    *("de", "la", "le", "et", "les", "des", "du", "un", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "avec"),
    *("el", "los", "las", "del", "se", "y", "por", "con", "una", "su", "para", "es", "al", "lo", "no", "en"),
)


class Rule(NamedTuple):
    """``least`` <= 1000 * part / whole <= ``most``; None is no bound. ``part`` and ``whole`` name counts."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: In running text of any of the languages above, words are of moderate length, symbols are rare, a few words in a
#: hundred are stop words, half of the lines at least are new, and a line is not made of a word or two throughout.
RULES = (
    Rule("word length", "word_chars", "n_words", 2000, 12000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop words", "n_stop_words", "n_words", 10, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 500),
    Rule("words a line", "n_words", "n_lines", 1500, None),
)
#: Base rules: fewer words than this, or more than this many of a hundred words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of ``size`` words that occur twice or more."""

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(size)]).alias("h"), i.alias("i"))

    def covered(sorted_windows: Column) -> Column:
        same = lambda w, i, step: F.coalesce(F.get(sorted_windows, i + step)["h"] == w["h"], F.lit(False))
        twice = F.filter(sorted_windows, lambda w, i: same(w, i, 1) | ((i > 0) & same(w, F.greatest(i, F.lit(1)), -1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda w: F.array(*[w["i"] + k for k in range(size)])))))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - size), window)
    return F.when(F.size(words) >= size, held(F.sort_array(windows), covered)).otherwise(F.lit(0))


def counts(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """All counts that rules may name, as one struct."""
    has_word = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")

    def of(words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words),
            "word_chars": F.length(F.translate(text, BLANKS, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words),
            "n_lines": F.size(lines),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*stop_words))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in found.items()])

    return held(words_of(text), lambda words: held(has_word, lambda lines: of(words, lines)))


def compiled(rules: tuple[Rule, ...], count: Callable[[str], Column]) -> Column:
    """The names of the broken rules, joined by a comma; empty if all hold."""

    def broken(r: Rule) -> Column:
        part, whole = 1000 * count(r.part), count(r.whole)
        low = F.lit(False) if r.least is None else part < r.least * whole
        high = F.lit(False) if r.most is None else part > r.most * whole
        return F.when(low | high, r.name)

    return F.concat_ws(",", *[broken(r) for r in rules])


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the rules that a text breaks."""
    counted = id_text(docs).select("doc_id", counts(F.coalesce("text", F.lit("")), stop_words).alias("c"))
    base = (F.col("c.n_words") < LEAST_WORDS) | (100 * F.col("c.n_repeat_words") > MOST_REPEATED * F.col("c.n_words"))
    broken = compiled(rules, lambda name: F.col(f"c.{name}"))
    return counted.select("doc_id", "c.*", base.alias("base_failed"), (~base & (broken == "")).alias("kept"), broken.alias("broken_rules"))


def kept_by_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The rows of ``docs`` that the base rules and ``rules`` keep, with all their columns."""
    c = held(counts(F.coalesce(F.col("text").cast("string"), F.lit("")), stop_words), lambda c: (c["n_words"] >= LEAST_WORDS) & (100 * c["n_repeat_words"] <= MOST_REPEATED * c["n_words"]) & (compiled(rules, lambda name: c[name]) == ""))
    return docs.filter(c)
