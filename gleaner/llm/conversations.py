"""Conversation structure repair: Dijkstra on the implicit lattice of edits (turn index, grammar state).

A conversation's rows are taken by turn (nulls first; ties by role, then by the first 32 characters of the text, then by its
hash). Each row is kept, given another role or deleted, and turns with empty text may be inserted, so that the roles' initials
read ``(s?(ua)+)?``. A node of the lattice is (rows used, grammar state); the queue is ordered by (cost, audit), audit being the
edits' initials so far, and the search ends at the first accepting end node that it takes from the queue. At one node
no audit of the least cost is the beginning of another (more inserts cost more), so the order of two audits holds when
both are continued, and the first visit of a node is its best.

Spark numbers all rows in one range-partitioned order, without their texts, finds each (role, text)'s first row with
an aggregate, and cuts the order into stretches of ``STRETCH`` rows at most, so no task gathers a whole conversation. A conversation
within one stretch (nearly all) is searched at once. A longer one is searched from every state a stretch may begin in,
and the stretches' ends are joined in order by the least (cost, audit), with what all four states share put aside. Equal rows are
counted, not carried: copies after the first are deleted in any repair, and a D sorts before an I, so they go behind the first one's edit.
The texts are shuffled once, each conversation's behind its audit, and pass through a task one at a time.

Defined cases: null conv_id is a conversation of its own; a null role or text is one space (so the text is blank); a role's initial
is its first character, whatever follows, and an empty role has none; null turns count in no gap; equal rows are duplicates; long
texts are hashed in passing; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import map_batches
from gleaner.session import cut

#: White space of the contract's blank texts (fixed values).
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Grammar states: nothing yet, after system, after user, after assistant. ``STEP`` gives the state after a role's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ACCEPTING = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
RESTYLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of one stretch: a power of two, since the row number's low bits tell a row's place in it.
STRETCH_BITS = 10
STRETCH = 1 << STRETCH_BITS

Row = tuple[str, bool, bool, int]  # initial, to be deleted, truncated, further copies


def due(state: int) -> tuple[str, int]:
    """The role that must come next if it is user or assistant, and the state behind it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def edits(row: Row, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, next state) of what can be done with a row."""
    initial, doomed, truncated, _ = row
    yield DELETE, "D", state
    if not doomed:
        if (after := STEP.get((state, initial))) is not None:
            yield TRUNCATED * truncated, "K", after
        yield RESTYLE + TRUNCATED * truncated, "R", due(state)[1]


def search(rows: list[Row], begin: int, whole: bool) -> dict[int, tuple[int, str]]:
    """State -> (cost, audit) of the best way through ``rows``: to the first accepting end if they are the ``whole``, else to every end."""
    queue, seen, ends = [(0, "", 0, begin)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows):
            if not whole:
                ends[state] = cost, audit
            elif state in ACCEPTING:
                return {state: (cost, audit)}
        else:
            for price, initial, after in edits(rows[i], state):
                if (i + 1, after) not in seen:
                    heapq.heappush(queue, (cost + price, audit + initial, i + 1, after))
        if (i, after := due(state)[1]) not in seen:
            heapq.heappush(queue, (cost + INSERT, audit + "I", i, after))
    return ends


def with_copies(audit: str, rows: list[Row]) -> str:
    """The audit with the deletions of the further copies, each behind its first row's edit."""
    if not any(r[3] for r in rows):
        return audit
    parts, at = [], iter(rows)
    for edit in audit:
        parts.append(edit if edit == "I" else edit + "D" * next(at)[3])
    return "".join(parts)


class Joined:
    """The best ways through a conversation's stretches so far."""

    def __init__(self):
        self.ways, self.shared = {START: (0, "")}, []

    def add(self, paths: list[tuple[int, int, int, str]]) -> None:
        """``paths``: (begin, end, cost, audit) of the next stretch."""
        ways: dict[int, tuple[int, str]] = {}
        for begin, end, cost, audit in paths:
            if begin in self.ways:
                before = self.ways[begin]
                way = before[0] + cost, before[1] + audit
                ways[end] = min(way, ways.get(end, way))
        common = commonprefix([audit for _, audit in ways.values()])
        self.shared.append(common)
        self.ways = {end: (cost, audit[len(common) :]) for end, (cost, audit) in ways.items()}

    def best(self) -> tuple[int, str]:
        cost, audit = min(self.ways[end] for end in ACCEPTING if end in self.ways)
        return cost, "".join(self.shared) + audit


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` as the contract damages them by crc32(``conv_id:turn``) % 20, with the number of ``copies`` (0: dropped)."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


ORDER = ["conv", "turn", "role", "head", "h1", "h2"]


def _keyed(rows: DataFrame) -> DataFrame:
    """conv (conv_id as text, one space for null), turn, role, text, copies, and what orders rows of one turn."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        copies.cast("long").alias("copies"),
        F.substring(text, 1, 32).alias("head"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("2"), text).alias("h2"),
    )


def _last_character(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def _stretches(keyed: DataFrame) -> DataFrame:
    """conv, stretch, and its rows in order: (at, initial, blank, repeated, truncated, copies)."""
    last = _last_character(F.col("text"))
    facts = keyed.filter("copies > 0").groupBy(*ORDER).agg(F.sum("copies").alias("copies"), F.first(last == "").alias("blank"), F.first(~last.isin(".", "!", "?")).alias("truncated"))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(facts.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).drop("head").withColumn("at", F.monotonically_increasing_id()), "conversation-rows")
    said = ["conv", "role", "h1", "h2"]
    again = ordered.groupBy(*said).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    row = F.struct("at", F.substring("role", 1, 1).alias("initial"), "blank", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("repeated"), "truncated", "copies")
    return ordered.join(again, said, "left").groupBy("conv", F.shiftright("at", STRETCH_BITS).alias("stretch")).agg(F.sort_array(F.collect_list(row)).alias("rows"))


PATHS = "conv string, stretch long, blank long, duplicate long, truncated long, illegal long, head string, tail string, extra long, paths array<struct<begin:int, end:int, cost:long, audit:string>>, whole struct<cost:long, audit:string>"
AUDITS = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch's counts and ways through it; the n-th row of a batch at a time, so one stretch is held."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            out = []
            for r in batch.slice(start, 256).to_pylist():
                rows: list[Row] = []
                blank = duplicate = truncated = illegal = extra = 0
                for x in r["rows"]:
                    more = x["copies"] - 1
                    doomed, ended = x["blank"] or x["repeated"], x["truncated"]
                    blank += (more + 1) * x["blank"]
                    duplicate += 0 if x["blank"] else more + x["repeated"]
                    truncated += ended and not doomed
                    illegal += more + (bool(rows) and rows[-1][0] + x["initial"] not in LEGAL)
                    extra += DELETE * more
                    rows.append((x["initial"], doomed, ended and not doomed, more))
                ways = [(begin, end, cost, with_copies(audit, rows)) for begin in range(4) for end, (cost, audit) in search(rows, begin, False).items()] if r["several"] else []
                cost, audit = (0, "") if r["several"] else next(iter(search(rows, START, True).values()))
                out.append({"conv": r["conv"], "stretch": r["stretch"], "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "head": rows[0][0], "tail": rows[-1][0], "extra": extra, "paths": [dict(zip(("begin", "end", "cost", "audit"), w, strict=True)) for w in ways], "whole": {"cost": cost, "audit": with_copies(audit, rows)}})
            yield pa.RecordBatch.from_pylist(out, PATH_SCHEMA)


_PATH = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
PATH_SCHEMA = pa.schema([("conv", pa.string()), ("stretch", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string()), ("extra", pa.int64()), ("paths", pa.list_(_PATH)), ("whole", pa.struct([("cost", pa.int64()), ("audit", pa.string())]))])
AUDIT_SCHEMA = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its stretches, which come in order."""
    conv, sums, tail, way = None, None, "", None

    def closed() -> pa.RecordBatch:
        cost, audit = way.best()
        return pa.RecordBatch.from_pylist([sums | {"conv": conv, "cost": cost + sums["extra"], "audit": audit}], AUDIT_SCHEMA)

    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if r["conv"] != conv:
                if sums:
                    yield closed()
                conv, sums, way = r["conv"], {c: r[c] for c in ("blank", "duplicate", "truncated", "illegal", "extra")}, Joined()
            else:
                for c in ("blank", "duplicate", "truncated", "illegal", "extra"):
                    sums[c] += r[c]
                sums["illegal"] += tail + r["head"] not in LEGAL
            way.add([(p["begin"], p["end"], p["cost"], p["audit"]) for p in r["paths"]])
            tail = r["tail"]
    if sums:
        yield closed()


def audits(rows: DataFrame) -> DataFrame:
    """conv (conv_id as text), the counts of faults, cost and audit of each conversation that has rows."""
    stretches = _stretches(_keyed(rows))
    long = stretches.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv", F.lit(True).alias("several"))
    marked = stretches.join(long, "conv", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    ways = cut(map_batches(marked, PATHS, _searched), "conversation-ways")
    short = ways.filter(F.size("paths") == 0).select("conv", "blank", "duplicate", "truncated", "illegal", (F.col("whole.cost") + F.col("extra")).alias("cost"), "whole.audit")
    long = ways.filter(F.size("paths") > 0).repartition("conv").sortWithinPartitions("conv", "stretch")
    return short.unionByName(map_batches(long, AUDITS, _joined))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str, int | None, bytes, bytes, str]]:
    """The repaired turns, conversation by conversation: (its audit's row, conv, turn, role, text, edit); edit "" opens a conversation, "D" is a row that goes."""
    conv, header, audit, at, state = None, None, "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = due(state)
            at += 1
            yield header, conv, None, role.encode(), b"", "I"

    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            for r in batch.slice(start, 64).to_pylist():
                if r["conv"] != conv:
                    yield from inserted()
                    conv, header, audit, at, state = r["conv"], None, "", 0, START
                    if r["audit"] is not None:
                        header, audit = r, r["audit"]
                    yield header, conv, None, b"", b"", ""
                for _ in range(r["copies"] or 0):
                    yield from inserted()
                    edit, role = audit[at], r["role"]
                    at += 1
                    if edit == "K":
                        state = STEP[state, role[:1].decode()]
                    elif edit == "R":
                        name, state = due(state)
                        role = name.encode()
                    yield header, conv, r["turn"], role, r["text"], edit
    yield from inserted()


def _behind_audits(rows: DataFrame) -> DataFrame:
    """The rows of each conversation together and in order, its audit first."""
    texts = _keyed(rows).select(*ORDER, F.encode("role", "UTF-8").alias("r"), F.when(F.col("copies") > 0, F.encode("text", "UTF-8")).alias("text"), "copies", *[F.lit(None).cast(t).alias(c) for c, t in HEADER])
    heads = audits(rows).select("*", F.lit(0).alias("body"))
    both = texts.withColumn("body", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "body", *ORDER[1:]).select("conv", "turn", F.col("r").alias("role"), "text", "copies", *[c for c, _ in HEADER])


HEADER = [*[(c, "long") for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", "string")]
TURNS = "conv string, place long, turn long, role string, text string, edit string"
TURN_SCHEMA = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
DIGESTS = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
DIGEST_SCHEMA = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size, place = [], 0, 0
    for _, conv, turn, role, text, edit in _walk(batches):
        if edit == "":
            place = 0
        elif edit != "D":
            rows.append({"conv": conv, "place": place, "turn": turn, "role": role.decode(), "text": text.decode(), "edit": edit})
            place, size = place + 1, size + len(text)
        if len(rows) >= 1000 or size >= 1 << 22:
            yield pa.RecordBatch.from_pylist(rows, TURN_SCHEMA)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, TURN_SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, now, sha, parts, turns = [], None, None, 0, None

    def finished() -> dict:
        least, most, n = turns
        return now | {"gaps": 0 if least is None else most - least + 1 - n, "repaired_sha256": sha.hexdigest()}

    for header, conv, turn, role, text, edit in _walk(batches):
        if edit == "":
            if now:
                done.append(finished())
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, DIGEST_SCHEMA)
                done = []
            now = {"conv": conv} | ({c: header[c] for c, _ in HEADER} if header else {c: "" if c == "audit" else 0 for c, _ in HEADER})
            sha, parts, turns = hashlib.sha256(), 0, (None, None, 0)
            continue
        if turn is not None and turn != turns[1]:  # turns come in order
            turns = turn if turns[0] is None else turns[0], turn, turns[2] + 1
        if edit != "D":
            sha.update((b"\n" if parts else b"") + role + b":")
            sha.update(text)
            parts += 1
    if now:
        done.append(finished())
    yield pa.RecordBatch.from_pylist(done, DIGEST_SCHEMA)


def _with_id(df: DataFrame) -> DataFrame:
    return df.select(F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id"), *[c for c in df.columns if c != "conv"])


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), turn (null if inserted), role, text, edit (K, R or I)."""
    return _with_id(map_batches(_behind_audits(rows), TURNS, _turns))


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, its faults' counts, the repair's cost and audit, and the digest of the repaired turns."""
    return _with_id(map_batches(_behind_audits(rows), DIGESTS, _digests))
