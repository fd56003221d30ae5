"""Connected components of a distributed list of links: local union-find, then alternating stars.

Each partition first contracts its own links by union-find (every node is linked to its partition's
smallest reachable node); up to MOST links fit one task, and then that is all. Else what remains is joined up by the large-star/small-star rounds of Kiveris
et al. (2014), whose number grows with the logarithm of the graph and which end in stars around the
smallest node. Links stay distributed throughout; only a count and a checksum reach the driver.
A node with a third of all links is handled by an aggregate with map-side combination and a sort-merge
join that can split it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import map_batches
from gleaner.session import cut


class UnionFind:
    """Disjoint sets of numbers; a set's root is its smallest number."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.setdefault(root, root)) != root:
            root = p
        while (p := self.up[x]) != root:
            self.up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


#: Links that one union-find holds at most: some ten MB.
MOST = 200_000


def _contract(batches: Iterator[pa.RecordBatch], most: int = 2 * MOST) -> Iterator[pa.RecordBatch]:
    def flush(sets: UnionFind) -> pa.RecordBatch:
        rows = [(x, sets.find(x)) for x in list(sets.up)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], "int64"), pa.array([r[1] for r in rows], "int64")], ["u", "v"])

    sets = UnionFind()
    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sets.join(a, b)
        if len(sets.up) > most:  # bounded memory; the stars join what is parted here
            yield flush(sets)
            sets = UnionFind()
    yield flush(sets)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str = "components", most: int = MOST) -> DataFrame:
    """(node, root) for every node with a link, root being the smallest node of its component.

    ``links`` has two long columns; nulls and self-links are dropped, repeated links count once.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    links, seen = cut(map_batches(links, "u long, v long", _contract), name), None
    small = links.count() <= most
    if small:  # nodes have one root each, as every link is in the same task
        links = cut(map_batches(links.coalesce(1), "u long, v long", _contract), name)
    while not small:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        links = cut(_small_star(_large_star(links)), name)
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
