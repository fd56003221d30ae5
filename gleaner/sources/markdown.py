"""Markdown and plain text as blocks: every line has a class, and neighbours of one class make a block."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, groupby

from pyspark.sql import DataFrame

from gleaner.functions.pytext import clean_block, strip_markdown
from gleaner.sources.blocks import Item, exploded, heading, rows

#: Number signs, title, and number signs that close it (fixed values of the format, as is the fence).
TITLE = re.compile(r"^\s*(#{1,6})\s+(.+?)\s*#*\s*$")
FENCE = "```"


def _classes(lines: list[str]) -> list[str]:
    """Of each line: a fence, code between fences (or behind the last), a title, blank, or words."""
    fences = [line.lstrip().startswith(FENCE) for line in lines]
    inside = accumulate(fences, lambda open_, fence: open_ != fence, initial=False)

    def of(line: str, fence: bool, code: bool) -> str:
        return "fence" if fence else "code" if code else "title" if TITLE.match(line) else "words" if line else "blank"

    return [of(*at) for at in zip(lines, fences, inside, strict=False)]


def items_of(text: str) -> Iterator[Item]:
    lines = [line.rstrip() for line in text.splitlines()]
    for kind, group in groupby(zip(_classes(lines), lines, strict=True), key=lambda pair: pair[0]):
        own = [line for _, line in group]
        if kind == "title":
            yield from (heading(strip_markdown(m[2]), len(m[1])) for m in map(TITLE.match, own) if m)
        elif kind == "code":
            yield Item("code", clean_block("\n".join(own)))
        elif kind == "words":
            yield Item("paragraph", strip_markdown(" ".join(own)))


def blocks_of(text: str) -> list[dict]:
    return rows(items_of(text))


def text_blocks(documents: DataFrame, id_col: str = "document_id", text: str = "text") -> DataFrame:
    """(id, pos, kind, page, section_path, text) of every block."""
    return exploded(documents, id_col, [text], lambda t: blocks_of(t or ""))
