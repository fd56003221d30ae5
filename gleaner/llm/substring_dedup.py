"""Removal of repeated 200-byte strings by bucket-pointer refinement over distributed buckets.

A suffix matters here only up to its first 200 bytes, so sorting suffixes means finding which
200-byte windows are equal. As in bucket-pointer refinement (Schuermann and Stoye, 2005) every offset
points to its bucket, at first that of its q-gram (64 bytes); a bucket is refined by the buckets that later offsets
point to, buckets with one member left take no further part, and refined buckets are what the next refinement uses:

    b0(p) bucket of the 64 bytes at p       b1(p) from b0(p), b0(p + 64): 128 bytes
    b2(p) from b1(p), b1(p + 72): 200 bytes

A pointer is a 64-bit name of its bucket and not its place in a sorted array: names need no global order, so a bucket can be
split over tasks, and a task finds equal members by a local sort before anything is shuffled. (Ranks of all offsets would take
a shuffle of some 20 bytes for each byte of text in every round.)

Sending every offset through a shuffle would take many times the input, so offsets are refined
together as long as they agree:

1. Each window belongs to the bucket of its *anchor*, the 64-gram with the least identifier in it
   (leftmost of equals). Equal windows have equal anchors at equal places. Neighbouring windows
   with one anchor form a run, on average about 69 of them. Buckets with one run hold only unique windows and are dropped.
2. Runs are refined by b2 at their first and last window, which fixes all bytes of the run. Runs
   that share all bytes with another are repeated as a whole.
3. What is left are runs that share a bucket but not all bytes. Their windows are refined in groups
   of up to 16 with neighbouring distances from the anchor. The 185 bytes that all windows of such a group share
   (its *core*) refine the bucket by b1; where a refined bucket holds one group, its windows are unique.
   The windows of the other groups refine that bucket once more, one by one by b2, against each other and one representative
   of each repeated run. Windows that hold a 64-gram seen once in all texts are left out before: that is known of
   *markers*, 64-grams with an identifier below a threshold, which step 1 counts wherever they stand, anchors or not.

Counts are combined in each batch before any shuffle, so a string that a third of all documents hold is one
row per batch. A window is named by its refined bucket and b2, 128 bits together. Texts are shuffled once for step 3 and once to remove.

Defined cases: null or empty texts have no bytes; a text under 200 bytes loses none; repeated rows
repeat each other's strings and lose them; a null doc_id is a value like any other; an empty table
gives an empty result; other columns are ignored. A row is named by doc_id and a 64-bit hash of its text, so rows with
one doc_id, or all with none, are told apart; texts may have up to 2**31 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import id_text, map_batches, per_worker, sha256_hex
from gleaner.llm.shingles import _BASE, _BYTE, _INVERSE, mix, powers
from gleaner.session import cut, done_with, free

LENGTH, GRAM = 200, 64
SPREAD = LENGTH - GRAM + 1  # 64-grams in a window, and the most windows in a run
MARK = np.uint64(2**64 // 64)  # a 64-gram with an identifier below is a marker wherever it stands
PIECE = 1_000_000
TOGETHER = 16  # windows in a group; its core has LENGTH - TOGETHER + 1 bytes
GROUPS = "doc_id long, version long, at long, bucket long, core long, weight int, twice int, finer array<long>, n long"
ROW = ["doc_id", "version"]
RUNS = "doc_id long, version long, at long, bucket long, finer long, weight int"
CUTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _powers() -> tuple[np.ndarray, np.ndarray]:
    return per_worker("substring:powers", lambda: (powers(_BASE, PIECE + LENGTH), powers(_INVERSE, PIECE + LENGTH)))


@dataclass
class Runs:
    """Runs of one buffer of texts: first window, number of windows, anchor; ``doc`` and ``base`` lead back to the rows."""

    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    row: np.ndarray
    base: np.ndarray  # of a run: what to add to a buffer offset to get the offset in its text
    loose: np.ndarray  # markers that are no anchors
    loose_row: np.ndarray
    b0: np.ndarray
    b1: np.ndarray
    b2: np.ndarray


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of key[i : i + width] for every i."""
    n = len(key)
    full = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    full[:n] = key
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(pieces: list[tuple[int, int, bytes]]) -> Runs | None:
    """``pieces``: (row, offset in the row's text, bytes); windows don't cross pieces."""
    pieces = [p for p in pieces if len(p[2]) >= LENGTH]
    if not pieces:
        return None
    size = np.array([len(p[2]) for p in pieces])
    b = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    up, down = _powers() if len(b) <= PIECE + LENGTH else (powers(_BASE, len(b)), powers(_INVERSE, len(b)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * down[: len(b)])])
    b0 = mix((total[GRAM:] - total[:-GRAM]) * up[: len(b) - GRAM + 1])
    b1 = mix(b0[:-GRAM] ^ mix(b0[GRAM:] + np.uint64(1)))
    b2 = mix(b1[: len(b) - LENGTH + 1] ^ mix(b1[LENGTH - 2 * GRAM :] + np.uint64(2)))
    low = np.uint64(0xFFFFFF)
    key = (b0 & ~low) | np.arange(len(b0), dtype=np.uint64)
    anchor = (_sliding_least(key, SPREAD) & low).astype(np.int64)
    end = np.cumsum(size)
    valid = np.ones(len(anchor), bool)
    for e in end[:-1].tolist():
        valid[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(valid)
    own = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    start, n = at[first], np.diff(np.append(first, len(at)))
    piece = np.searchsorted(end, start, "right")
    shift, rows = np.array([p[1] for p in pieces]) - (end - size), np.array([p[0] for p in pieces])
    loose = np.setdiff1d(np.flatnonzero(b0 < MARK), own[first])
    home = np.searchsorted(end, loose, "right")
    inside = loose + GRAM <= end[home]
    return Runs(start, n, own[first], rows[piece], shift[piece], loose[inside], rows[home[inside]], b0, b1, b2)


def _pieces(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, bytes]]]:
    """The batch's texts in lists of about PIECE bytes; longer texts are cut so that each window is in one piece."""
    out, total = [], 0
    for row, text in enumerate(batch.column("text").to_pylist()):
        raw = (text or "").encode()
        for base in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            part = raw[base : base + PIECE + LENGTH - 1]
            if out and total + len(part) > PIECE:
                yield out
                out, total = [], 0
            out.append((row, base, part))
            total += len(part)
    if out:
        yield out


def _packed(start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return (start.astype(np.int64) << 8) | n


def _start_of(at: Column) -> Column:
    return F.shiftright(at, 8)


def _counted(key1: np.ndarray, key2: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first index of each distinct key pair, the summed weight of each index's key pair)."""
    order = np.lexsort((key2, key1))
    a, b = key1[order], key2[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    group = np.cumsum(fresh) - 1
    sums = np.bincount(group, weight[order])
    all_ = np.empty(len(order), np.int64)
    all_[order] = sums[group]
    return order[fresh], all_


def _merged(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows that follow each other in a row, as one; input ascends by row and start."""
    if not len(row):
        return row, start, n
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])]))
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], start[last] + n[last] - start[first]


def _rows_of(batch: pa.RecordBatch, row: np.ndarray) -> list[pa.Array]:
    """doc_id and version of a batch's rows."""
    return [batch.column("doc_id").cast("int64").take(pa.array(row)), batch.column("version").take(pa.array(row))]


def _emit(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, n: np.ndarray, bucket: np.ndarray | None, finer: np.ndarray, weight: np.ndarray | int) -> pa.RecordBatch:
    at = _packed(start, n if bucket is not None else 0)
    return pa.RecordBatch.from_arrays(
        [*_rows_of(batch, row), pa.array(at), pa.nulls(len(row), "int64") if bucket is None else pa.array(bucket.view(np.int64)), pa.array(finer.astype(np.int64) if bucket is None else finer.view(np.int64)), pa.array(np.broadcast_to(weight, len(row)).astype(np.int32))],
        ["doc_id", "version", "at", "bucket", "finer", "weight"],
    )


def _combined(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, n: np.ndarray, bucket: np.ndarray, finer: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each key of this batch, and (with a null bucket) the stretches it shows to be repeated."""
    once, summed = _counted(bucket, finer, weight)
    yield _emit(batch, row[once], start[once], n[once], bucket[once], finer[once], np.minimum(summed[once], 2))
    known = np.ones(len(row), bool)
    known[once] = False  # a first row with weight 2 counts as repeated later on
    known |= (summed >= 2) & (weight == 1)
    known &= n > 0
    if known.any():
        r, s, k = _merged(row[known], start[known], n[known])
        yield _emit(batch, r, s, k, None, k, 0)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pieces in _pieces(batch):
            if (r := runs_of(pieces)) is None:
                continue
            finer = mix(r.b2[r.start] ^ mix(r.b2[r.start + r.n - 1] + (r.n * 256 + r.anchor - r.start).astype(np.uint64)))
            none, both = np.zeros(len(r.loose), np.int64), lambda a, b: np.concatenate([a, b])  # loose markers count, but hold no windows
            yield from _combined(batch, both(r.row, r.loose_row), both(r.start + r.base, none), both(r.n, none), r.b0[both(r.anchor, r.loose)], both(finer, none.astype(np.uint64)), np.ones(len(r.n) + len(none), np.int64))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the runs that are left, and of representatives. ``shared``: start << 2 | kind; ``known``: start << 32 | n."""
    for batch in batches:
        shared = [np.sort(np.array(x or [], np.int64)) for x in batch.column("shared").to_pylist()]
        known = [np.sort(np.array(x or [], np.int64)) for x in batch.column("known").to_pylist()]
        for pieces in _pieces(batch):
            if (r := runs_of(pieces)) is None:
                continue
            kind, start = np.full(len(r.start), -1), r.start + r.base
            edge = np.flatnonzero(np.concatenate([[True], r.row[1:] != r.row[:-1]]))
            for a, z in zip(edge, [*edge[1:], len(start)], strict=True):
                own, s = int(r.row[a]), start[a:z]
                if len(k := known[own]):
                    i = np.searchsorted(k >> 32, s, "right") - 1
                    kind[a:z][(i >= 0) & (s < (k[i] >> 32) + (k[i] & 0xFFFFFFFF))] = 0
                if len(k := shared[own]):
                    i = np.minimum(np.searchsorted(k >> 2, s), len(k) - 1)
                    hit = (k[i] >> 2) == s
                    kind[a:z][hit] = k[i][hit] & 3
            todo = np.flatnonzero(kind > 0)
            if not len(todo):
                continue
            n = r.n[todo]
            run = np.repeat(todo, n)
            at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + r.start[run]
            alone = np.append(np.unique(r.anchor[(kind < 0) & (r.b0[r.anchor] < MARK)]), 2**62)
            open_ = alone[np.searchsorted(alone, at)] >= at + SPREAD
            at, run = at[open_], run[open_]
            if len(at):
                yield from _grouped(batch, r, at, run, np.where(kind[run] == 1, 2, 1))


def _grouped(batch: pa.RecordBatch, r: Runs, at: np.ndarray, run: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each group of windows; windows that this batch shows to be repeated leave as stretches, one of each staying."""
    anchor = r.anchor[run]
    bucket, finer = r.b0[anchor], r.b2[at]
    once, summed = _counted(bucket, finer, weight)
    stays = np.zeros(len(at), bool)
    stays[once] = True
    known = ~stays | ((summed >= 2) & (weight == 1))
    which = (anchor - at) // TOGETHER
    first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)]))
    n = np.diff(np.append(first, len(at)))
    start = anchor[first] - TOGETHER * which[first]
    half = LENGTH - TOGETHER + 1 - 2 * GRAM
    core = mix(r.b1[start] ^ mix(r.b1[start + half] + which[first].astype(np.uint64) + np.uint64(3)))
    _, cores = _counted(bucket[first], core, weight[first])
    group = np.repeat(np.arange(len(first)), n)
    place = np.arange(len(at)) - first[group]
    twice = np.bincount(group, ((summed >= 2) & stays) * (1 << place), minlength=len(first)).astype(np.int32)
    full = np.bincount(group, stays, minlength=len(first)) > 0
    values = pa.array(finer.view(np.int64)[full[group]], mask=~stays[full[group]])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[full])]), "int32"), values)
    keep = first[full]
    row = r.row[run]
    packed = _packed((at + r.base[run])[keep], 0)
    yield pa.RecordBatch.from_arrays(
        [*_rows_of(batch, row[keep]), pa.array(packed), pa.array(bucket[keep].view(np.int64)), pa.array(core[full].view(np.int64)), pa.array(np.minimum(cores[full], 2).astype(np.int32)), pa.array(twice[full]), lists, pa.nulls(len(keep), "int64")],
        ["doc_id", "version", "at", "bucket", "core", "weight", "twice", "finer", "n"],
    )
    if known.any():
        rows, starts, k = _merged(row[known], (at + r.base[run])[known], np.ones(known.sum(), np.int64))
        none = {t: pa.nulls(len(rows), t) for t in ("int64", "int32")}
        yield pa.RecordBatch.from_arrays(
            [*_rows_of(batch, rows), pa.array(_packed(starts, 0)), none["int64"], none["int64"], none["int32"], none["int32"], pa.nulls(len(rows), pa.list_(pa.int64())), pa.array(k.astype(np.int64))],
            ["doc_id", "version", "at", "bucket", "core", "weight", "twice", "finer", "n"],
        )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, digests = [], [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            raw = (text or "").encode()
            kept, gone, count = remove(raw, np.array(found or [], np.int64))
            sizes.append(len(raw))
            removed.append(gone)
            spans.append(count)
            digests.append(sha256_hex(kept))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast("int64"), pa.array(sizes, "int64"), pa.array(removed, "int64"), pa.array(spans, "int64"), pa.array(digests, "string")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs (start, end) from stretches start << 32 | n of repeated windows."""
    found = np.sort(found)
    start, end = found >> 32, (found >> 32) + (found & 0xFFFFFFFF) - 1 + LENGTH
    upto = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > upto[:-1]]))
    return start[first], upto[np.append(first[1:], len(start)) - 1]


def remove(raw: bytes, found: np.ndarray) -> tuple[bytes, int, int]:
    if not len(found):
        return raw, 0, 0
    start, end = spans_of(found)
    kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
    return kept, len(raw) - len(kept), len(start)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, version, found: per document the stretches of windows that also start elsewhere (start << 32 | n).

    ``docs`` has doc_id, text and version.
    """
    runs = cut(map_batches(docs, RUNS, _runs), "substring-runs")
    keyed, stretch = runs.filter("bucket IS NOT NULL"), cut(runs.filter("bucket IS NULL"), "substring-stretches")
    # written, so that the join reads two plain shuffles, of which Spark can split a hot key
    several = cut(keyed.groupBy("bucket").agg(F.sum("weight").alias("w")).filter("w > 1").select("bucket"), "substring-several")
    left = cut(keyed.filter(F.col("at").bitwiseAND(F.lit(255)) > 0).join(several, "bucket", "left_semi"), "substring-left")
    done_with(runs, several)
    mark = F.xxhash64(*ROW, "at")
    spans = cut(left.groupBy("bucket", "finer").agg(F.sum("weight").alias("w"), F.min(mark).alias("rep")), "substring-spans")
    kinds = spans.join(cut(spans.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_spans")), "substring-kinds"), "bucket")
    kind = F.when(F.col("w") < 2, 2).when((F.col("n_spans") > 1) & (mark == F.col("rep")), 1).otherwise(0)
    judged = cut(left.join(kinds, ["bucket", "finer"]).select(*ROW, "at", kind.alias("kind")), "substring-judged")
    done_with(spans, left)

    at = F.col("at")
    whole = judged.select(*ROW, (_start_of(at) * 4 + F.col("kind")).alias("shared"), F.lit(None).cast("long").alias("known"), F.col("kind"))
    local = stretch.select(*ROW, F.lit(None).cast("long").alias("shared"), (_start_of(at) * 2**32 + F.col("finer")).alias("known"), F.lit(0).alias("kind"))
    todo = whole.unionByName(local).groupBy(*ROW).agg(F.collect_list("shared").alias("shared"), F.collect_list("known").alias("known"), F.max("kind").alias("kind")).filter("kind > 0").drop("kind")
    loaded = _on_rows(docs, todo, "inner")
    groups = cut(map_batches(loaded.select("doc_id", "version", "text", "shared", "known"), GROUPS, _windows), "substring-groups")
    grouped, shown = groups.filter("bucket IS NOT NULL"), cut(groups.filter("bucket IS NULL").select(*ROW, "at", "n"), "substring-shown")
    free(docs.sparkSession)
    cores = cut(grouped.groupBy("bucket", "core").agg(F.sum("weight").alias("w")).filter("w > 1").select("bucket", "core"), "substring-cores")
    each = grouped.select(*ROW, "at", "bucket", "core", "twice", "finer").join(cores, ["bucket", "core"], "left_semi").select(*ROW, "at", F.xxhash64("bucket", "core").alias("bucket"), "twice", F.posexplode("finer").alias("place", "finer")).filter("finer IS NOT NULL")
    single = cut(each.select(*ROW, (at + F.col("place") * 256).alias("at"), "bucket", "finer", F.expr("1 + (shiftright(twice, place) & 1)").alias("weight")), "substring-windows")
    done_with(groups, cores)
    twice = cut(single.groupBy("bucket", "finer").agg(F.sum("weight").alias("w")).filter("w > 1").select("bucket", "finer"), "substring-twice")
    matched = single.filter("weight = 1").join(twice, ["bucket", "finer"], "left_semi")

    def stretches(rows: DataFrame, n: Column) -> DataFrame:
        return rows.select(*ROW, (_start_of(at) * 2**32 + n).alias("found"))

    found = stretches(judged.filter("kind < 2"), at.bitwiseAND(F.lit(255)))
    for more in (stretches(stretch, F.col("finer")), stretches(shown, F.col("n")), stretches(matched, F.lit(1))):
        found = found.unionByName(more)
    found = cut(found.groupBy(*ROW).agg(F.collect_list("found").alias("found")), "substring-found")
    done_with(single, judged, stretch, shown, twice)
    return found


def _on_rows(docs: DataFrame, more: DataFrame, how: str) -> DataFrame:
    more = more.withColumnsRenamed({"doc_id": "m_doc_id", "version": "m_version"})
    return docs.join(more, docs["doc_id"].eqNullSafe(more["m_doc_id"]) & (docs["version"] == more["m_version"]), how)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""
    docs = id_text(docs).withColumn("version", F.xxhash64("text"))
    found = repeated_windows(docs)
    return map_batches(_on_rows(docs, found, "left").select("doc_id", "text", "found"), CUTS, _cut_out)


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text by counting every 200-byte string (for tests)."""
    from collections import Counter

    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + LENGTH] for r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - LENGTH + 1):
            if count[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), sha256_hex(kept)))
    return out
