"""Blocks: what every parser yields, and how section paths come about."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import ship, sliced

BLOCK_TYPE = "array<struct<pos:int,kind:string,page:int,section_path:array<string>,text:string>>"
BLOCK = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("page", pa.int32()), ("section_path", pa.list_(pa.string())), ("text", pa.string())])


class Item(NamedTuple):
    """A stretch of a text; ``level`` is None unless it is a heading."""

    kind: str
    text: str
    level: int | None = None
    page: int | None = None


def heading(text: str, level: int | None = None, page: int | None = None) -> Item:
    """A heading of a level from 1 to 6; without a level, short ones are of the first, others of the second."""
    return Item("heading", text, min(max(level or (1 if len(text) <= 35 else 2), 1), 6), page)


def rows(items: Iterable[Item]) -> list[dict]:
    """Block rows of the items that have a text. A heading's path keeps what is above its level and ends in itself; other blocks have the last one's."""
    there = [i for i in items if i.text]
    paths = accumulate(there, lambda path, i: path if i.level is None else (*path[: i.level - 1], i.text), initial=())
    next(paths)  # before the first item
    return [{"pos": pos, "kind": i.kind, "page": i.page, "section_path": list(path), "text": i.text} for pos, (i, path) in enumerate(zip(there, paths, strict=True))]


def exploded(table: DataFrame, id_col: str, columns: list[str], make: Callable[..., list[dict]], element: pa.DataType = BLOCK, ddl: str = BLOCK_TYPE) -> DataFrame:
    """(id, and the fields of every element that ``make`` returns for a row's columns)."""
    ship(table.sparkSession)
    kind = dict(table.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, columns[0]):
            found = [make(*r) for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found, pa.list_(element))], [id_col, "found"])

    return table.select(id_col, *columns).mapInArrow(work, f"{id_col} {kind}, found {ddl}").select(id_col, F.inline("found"))
