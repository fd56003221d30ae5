"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find.

1. One pass over the texts makes, per document, the size and a 128-bit digest of its shingle set and
   the hashes of its signature's bands. Documents with equal sets collapse to one representative,
   a numbered class with its smallest doc_id (an aggregate with map-side combination, however many copies there are).
2. Representatives meet in buckets of equal band hash. With 60 bands of 6 slots a pair at the
   threshold shares none with probability 8e-6, at a similarity of 0.8 with 1e-8.
3. Pairs are never made within a whole bucket. In a *star round* each document is paired with a
   few of the buckets' centres (a member of the bucket's largest component), pairs are
   verified on the full sets, and verified links merge components. Only pairs between different
   components are ever tried, so a group of near copies costs a few pairs per member.
4. After the star rounds, what can still link is a member outside its bucket's largest component,
   with any member of another component. Such members are compared with whole blocks of lots of those
   components by an index on the block's shingles, so no link is lost and no list of pairs is made.
5. Before pairs are made, each document's *common* shingles are counted, those that any other candidate holds.
   Two sets share no more than either's common count, so copies edited too much to link with anything
   leave exactly, without a pair being made for them.

Components (``components.py``) and all tables stay distributed; each round ends in a written table.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing;
rows with a null doc_id link with nothing and are kept; repeated rows have equal sets and so one
component; rows of one doc_id with different texts are judged each by itself, and may lie in different components; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import id_text, map_batches, slices
from gleaner.llm.components import components
from gleaner.llm.shingles import mix, shingle_sets
from gleaner.llm.superminhash import signatures
from gleaner.session import cut, done_with

SIGNED = "doc_id long, version long, n_shingles long, d1 long, d2 long, bands array<long>"


def _signed(words: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                sets, at = shingle_sets(batch.column("text").to_pylist(), words)
                n = np.diff(at)
                sig = signatures(sets, at, bands * rows).reshape(len(n), bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), sig.shape[:2])
                for r in range(rows):
                    key = mix(key ^ sig[:, :, r])
                digest = []
                for salt in (1, 2):
                    part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt * 0xD1342543DE82EF95 % 2**64)))])
                    digest.append((part[at[1:]] - part[at[:-1]]).view(np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, "int32"), pa.array(np.ascontiguousarray(key).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast("int64"), batch.column("version"), pa.array(n, "int64"), pa.array(digest[0]), pa.array(digest[1]), flat], ["doc_id", "version", "n_shingles", "d1", "d2", "bands"])

    return work


def _verify(words: int, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_a", 2_000_000):
                texts: dict[str, int] = {}
                a, b = ([texts.setdefault(t, len(texts)) for t in batch.column(c).to_pylist()] for c in ("text_a", "text_b"))
                sets, at = shingle_sets(list(texts), words)
                keep = []
                for i, j in zip(a, b, strict=True):
                    x, y = sorted((sets[at[i] : at[i + 1]], sets[at[j] : at[j + 1]]), key=len)
                    spot = np.searchsorted(y, x) if len(y) else np.zeros(0, np.int64)
                    both = int((y[np.minimum(spot, max(len(y) - 1, 0))] == x).sum()) if len(y) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, "bool"))

    return work


def _common(words: int):
    """Rows (id, hash, weight) of a batch: shingles seen once with their document, others once with weight 2, and (id, null, n) for what the batch shows to be shared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                sets, at = shingle_sets(batch.column("text").to_pylist(), words)
                ids = np.asarray(batch.column("id"))
                own = np.repeat(np.arange(len(ids)), np.diff(at))
                values, back, times = np.unique(sets, return_inverse=True, return_counts=True)
                once = times[back] == 1
                several = values[times > 1]
                known = np.bincount(own[~once], minlength=len(ids))
                id_ = pa.concat_arrays([pa.array(ids[own[once]]), pa.nulls(len(several), "int64"), pa.array(ids)])
                hash_ = pa.concat_arrays([pa.array(np.concatenate([sets[once], several]).view(np.int64)), pa.nulls(len(ids), "int64")])
                weight = np.concatenate([np.ones(once.sum(), np.int64), np.full(len(several), 2), known])
                yield pa.RecordBatch.from_arrays([id_, hash_, pa.array(weight)], ["id", "hash", "weight"])

    return work


def _with_common(live: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``live`` with ``common``, the shingles of a document that any other of these documents holds.

    Similar documents have no more in common than either's count, so those whose count is too small for any
    partner of their size link with nothing and leave.
    """
    rows = cut(map_batches(texts.select("id", "text"), "id long, hash long, weight long", _common(words)), "near-common")
    shared = rows.filter("hash IS NOT NULL").groupBy("hash").agg(F.sum("weight").alias("n")).filter("n > 1").select("hash")
    met = rows.filter("id IS NOT NULL AND hash IS NOT NULL").join(shared, "hash", "left_semi").select("id", F.lit(1).cast("long").alias("weight"))
    count = met.unionByName(rows.filter("hash IS NULL").select("id", "weight")).groupBy("id").agg(F.sum("weight").alias("common"))
    return live.select("key", "id", "size").join(count, "id").filter(100 * F.col("common") >= percent * F.col("size"))


def _may_link(percent: int, *, a: str = "", b: str):
    """The sizes, and what each has in common with any other, allow a link."""
    size_a, size_b, both = F.col(f"{a}size"), F.col(f"{b}size"), F.col(f"{a}size") + F.col(f"{b}size")
    near = 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)
    return near & ((100 + percent) * F.least(F.col(f"{a}common"), F.col(f"{b}common")) >= percent * both)


def _pairs_of_centres(live: DataFrame, turn: int, most: int, percent: int) -> DataFrame:
    """(a, b): each document with up to ``most`` of its buckets' centres, those it meets most often.

    In the first turn a bucket's centre is the member that meets most others over all its buckets, later any.
    """
    order = F.xxhash64("id", F.lit(turn)) if turn else -F.col("met")
    by_comp = live.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order.alias("order"), "id", "size", "common")).alias("pick"))
    centre = by_comp.groupBy("key").agg(F.max(F.struct("n", (-F.col("pick.order")).alias("order"), (-F.col("comp")).alias("comp"), "pick")).alias("top"))
    centre = centre.select("key", (-F.col("top.comp")).alias("c_comp"), *(F.col(f"top.pick.{c}").alias(f"c_{c}") for c in ("id", "size", "common")))
    met = live.join(centre, "key").filter("comp <> c_comp").filter(_may_link(percent, b="c_"))
    count = met.groupBy(F.col("id").alias("a"), F.col("c_id").alias("b")).count()
    best = count.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", (-F.col("b")).alias("b"))), False), 1, most).alias("best"))
    return best.select("a", F.explode("best").alias("x")).select("a", (-F.col("x.b")).alias("b"))


SUPER, SUB = 8192, 128


def _lots(live: DataFrame) -> DataFrame:
    """(comp, lot): components of SUB members or more are lots themselves, smaller ones share a lot of about SUB members with those of the same largest bucket.

    Where many look alike and few link, nearly all are components of their own: lots keep the table of who meets whom in proportion to the members.
    """
    held = live.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    own = live.select("key", "id", "comp").join(held, "key").groupBy("comp").agg(F.countDistinct("id").alias("n"), F.max(F.struct("held", "key")).alias("largest"))
    small = own.filter(F.col("n") < SUB).select("comp", "n", F.col("largest.key").alias("key"))
    pools = small.groupBy("key").agg(F.ceil(F.sum("n") / SUB).alias("lots"))
    pooled = small.join(pools, "key").select("comp", F.xxhash64("key", F.pmod(F.xxhash64("comp"), F.col("lots"))).alias("lot"))
    return pooled.unionByName(own.filter(F.col("n") >= SUB).select("comp", F.col("comp").alias("lot")))


def _blocks_left(live: DataFrame, percent: int, kept: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((a, lot, part, chunk), (id, lot, part, chunk)): members outside their bucket's largest component, against blocks of lots of components.

    A lot's members fall into blocks of about SUB by hash. A member meets every block of a lot that has, in one of its buckets, a member of
    another component and may hold a link; of two lots that meet, the one with the larger number asks. Members that meet one block are dealt to chunks of about SUB too.
    """
    members = kept(live.select("id", "comp").distinct().join(_lots(live), "comp"), "near-members")
    most = SUPER // SUB
    supers = members.groupBy("lot").agg(F.ceil(F.count(F.lit(1)) / SUPER).alias("supers"), F.least(F.lit(most), F.ceil(F.count(F.lit(1)) / SUB)).alias("parts"))
    members = kept(members.join(supers, "lot"), "near-members")
    live = live.drop("comp").join(members, "id").withColumn("super", F.pmod(F.xxhash64("id"), F.col("supers")))
    by_lot = live.groupBy("key", "lot", "super", "parts").agg(F.min("comp").alias("from_comp"), F.max("comp").alias("to_comp"), F.min("size").alias("least"), F.max("size").alias("greatest"), F.max("common").alias("common"))
    top = live.groupBy("key", "comp", "lot").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", (-F.col("comp")).alias("comp"), "lot")).alias("top"))
    top = top.select("key", (-F.col("top.comp")).alias("top"), F.col("top.lot").alias("top_lot"))
    minor = live.join(top, "key").filter("comp <> top").select("key", "top_lot", *(F.col(c).alias(f"a_{c}") for c in ("id", "comp", "lot", "size", "common")))
    # bounds that hold if any member of the block may link
    may = (100 * F.col("greatest") >= percent * F.col("a_size")) & (100 * F.col("a_size") >= percent * F.col("least")) & ((100 + percent) * F.least("common", "a_common") >= percent * (F.col("least") + F.col("a_size")))
    asks = F.expr("(lot = top_lot OR lot <= a_lot) AND NOT (from_comp = a_comp AND to_comp = a_comp)")
    met = by_lot.join(minor, "key").filter(asks).filter(may).select(F.col("a_id").alias("a"), "lot", "super", "parts").distinct()
    met = kept(met.select("a", "lot", F.explode(F.sequence(F.col("super") * most, F.col("super") * most + F.col("parts") - 1)).alias("part")), "near-met")
    chunks = met.groupBy("lot", "part").agg(F.ceil(F.count(F.lit(1)) / SUB).alias("chunks"))
    left = met.join(chunks, ["lot", "part"]).select("a", "lot", "part", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk"))
    members = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("supers")) * most + F.pmod(F.xxhash64(F.lit("part"), F.col("id")), F.col("parts")))
    right = members.join(chunks, ["lot", "part"]).select("id", "lot", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return left, right


def _verify_blocks(words: int, percent: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            sets, at = shingle_sets(right.column("text").to_pylist(), words)
            owner, size = np.repeat(np.arange(right.num_rows), np.diff(at)), np.diff(at)
            order = np.argsort(sets, kind="stable")
            values, owner, ids = sets[order], owner[order], np.asarray(right.column("id"))
            own, own_at = shingle_sets(left.column("text").to_pylist(), words)
            for i, doc in enumerate(left.column("a").to_pylist()):
                x = own[own_at[i] : own_at[i + 1]]
                lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                n = hi - lo
                spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                both = np.bincount(owner[spot], minlength=right.num_rows)
                for k in np.flatnonzero((both > 0) & (100 * both >= percent * (len(x) + size - both))).tolist():
                    a.append(doc)
                    b.append(int(ids[k]))
        return pa.table({"a": pa.array(a, "int64"), "b": pa.array(b, "int64")})

    return work


def _with_components(live: DataFrame, comp: DataFrame | None) -> DataFrame:
    live = live.drop("comp")
    if comp is None:
        return live.withColumn("comp", F.col("id"))
    return live.join(comp.select(F.col("node").alias("id"), F.col("root").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _several(live: DataFrame) -> DataFrame:
    """Only buckets that still hold members of different components."""
    keys = live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return live.join(keys, "key", "left_semi")


def _of(texts: DataFrame, live: DataFrame) -> DataFrame:
    return texts.join(live.select("id").distinct(), "id", "left_semi")


def near_links(docs: DataFrame, classes: DataFrame, reps: DataFrame, words: int, percent: int, star_rounds: tuple[int, ...]) -> DataFrame | None:
    """(node, root) of the classes that link, or None if none do.

    ``classes``: node, first (doc_id, version) of each distinct non-empty set; ``reps``: node, n_shingles, bands of each.
    """
    rows = reps.select(F.explode("bands").alias("key"), F.col("node").alias("id"), F.col("n_shingles").alias("size"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    live = kept(rows.join(shared, "key", "left_semi"), "near-live")
    wanted = _of(classes.select(F.col("node").alias("id"), "first.doc_id", "first.version"), live)
    # the rows of a document and text are equal, so one of them is enough
    texts = kept(docs.withColumn("version", F.xxhash64("text")).join(wanted, ["doc_id", "version"]).distinct().select("id", "text"), "near-texts")
    live = kept(_several(_with_components(_with_common(live, texts, words, percent), None)), "near-live")
    meets = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    live = kept(live.join(live.join(meets, "key").groupBy("id").agg(F.sum("n").alias("met")), "id"), "near-live")
    comp, links = None, None
    for turn, most in enumerate(star_rounds):
        if comp is not None:
            live = kept(_several(_with_components(live, comp)), "near-live")
            texts = kept(_of(texts, live), "near-texts")
        pairs = _pairs_of_centres(live, turn, most, percent)
        loaded = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        found = kept(map_batches(loaded.select("a", "b", "text_a", "text_b"), "a long, b long", _verify(words, percent)), "near-links")
        links = found if links is None else links.unionByName(found)
        comp = components(links, "near-components")
    live = kept(_several(_with_components(live, comp)), "near-live")
    texts = _of(texts, live)
    left, right = _blocks_left(live, percent, kept)
    left = kept(left.join(texts.select(F.col("id").alias("a"), "text"), "a"), "near-left")
    right = kept(right.join(texts, "id"), "near-right")
    place = ["lot", "part", "chunk"]
    found = kept(left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_verify_blocks(words, percent), "a long, b long"), "near-links")
    comp = components(links.unionByName(found), "near-components")
    done_with(*made)
    return comp


SAME = ["n_shingles", "d1", "d2"]
TAKES_PART = "doc_id IS NOT NULL AND n_shingles > 0"


def _members(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 60, rows: int = 6, star_rounds: tuple[int, ...] = (1, 3)) -> DataFrame:
    """doc_id, version (the hash of a row's text), n_shingles, and head: the least (doc_id, version) of the row's component, null if it takes no part.

    What links are classes of rows with equal sets, numbered when they are written, so rows of one doc_id with different texts stay apart.
    """
    docs = id_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = cut(map_batches(docs.withColumn("version", F.xxhash64("text")), SIGNED, _signed(words, bands, rows)), "near-signed")
    takes_part = signed.filter(TAKES_PART)
    classes = cut(takes_part.groupBy(*SAME).agg(F.min(F.struct("doc_id", "version")).alias("first")).withColumn("node", F.monotonically_increasing_id()), "near-classes")
    firsts = classes.select("node", *SAME, "first.doc_id", "first.version")
    reps = takes_part.join(firsts, [*SAME, "doc_id", "version"]).dropDuplicates(["doc_id", "version", *SAME]).select("node", "n_shingles", "bands")
    comp = near_links(docs, classes, reps, words, percent, star_rounds)
    if comp is None:
        heads = classes.withColumn("head", F.col("first"))
    else:
        rooted = classes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
        heads = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("head")), "root")
    members = signed.drop("bands").join(heads.select(*SAME, "head"), SAME, "left")
    return members.select("doc_id", "version", "n_shingles", F.when(F.expr(TAKES_PART), F.col("head")).alias("head"))


def near_components(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    component = F.coalesce("head.doc_id", "doc_id")
    return _members(docs, **parameters).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, **parameters: int) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept: one row of each group, that of the smallest doc_id (then of the smallest hash of its text).

    Rows with one doc_id and different texts are judged each by itself: each may be the one that its group keeps. Of equal
    rows one stays; rows that take no part (no words, or a null doc_id) all stay.
    """
    members = cut(_members(docs, **parameters).filter("head IS NOT NULL"), "near-members")
    its_own = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("version") == F.col("head.version"))
    gone = members.filter(~its_own).select(F.col("doc_id").alias("id"), "version").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("version"))
    left = rows.join(gone, ["id", "version"], "left_anti")
    repeated = cut(members.filter(its_own).groupBy(F.col("doc_id").alias("id"), "version").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "near-repeated")
    if not repeated.isEmpty():
        once = left.join(repeated, ["id", "version"], "left_semi").dropDuplicates(["id", "version"])
        left = left.join(repeated, ["id", "version"], "left_anti").unionByName(once)
    return left.select("row.*")
