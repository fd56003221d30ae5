"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Each text is split by the pattern; pre-tokens not yet known to the worker are laid out as rows of
padded matrices, one matrix per length class. In each round every row merges its leftmost pair of
minimum rank; pair ranks come from a hashed open-addressing table, and rows are compacted by one
column per merge. Rows without a pair to merge leave the matrix. A pre-token that is a vocabulary
entry is that entry, as in the library.

A pre-token wider than a line (``LINE`` bytes) fills a padded matrix of its own, line after line, so that a round looks
only at the lines' least ranks and at the lines that hold the least of all. Its round merges that rank's leftmost pair and, as long
as no merge brings up a pair of lower rank, the next ones of the same rank: the same merges in the same
order, in fewer rounds. It is compacted whenever half of its places are empty.

Ids of known pre-tokens lie in one flat array per worker, of two generations: when ``most`` pre-tokens
are kept, those unused since the last such turn leave.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded
each by itself, whatever their doc_id, a null one too; an empty table gives an empty result; other columns are ignored. Very long
texts and pre-tokens take time in proportion and memory of some 30 bytes a byte.
"""

from __future__ import annotations

import base64
from collections.abc import Collection, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gleaner.llm.common import id_text, map_batches, per_worker, sha256_hex, slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NONE = np.int32(2**31 - 1)
LINE = 256
MOST, MOST_BYTES, SLICE = 400_000, 32 << 20, 1_000_000
#: White_Space of Unicode, as the library's engine reads ``\s``.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def splitter(pattern: str):
    own = pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(own).findall


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.mask, self.shift = np.uint64(2**bits - 1), np.uint64(64 - bits)
        self.keys, self.values = np.full(2**bits, 2**64 - 1, np.uint64), np.full(2**bits, NONE, np.int32)
        at, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            taken, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[taken], self.values[taken] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair doesn't merge or either id is negative (padding)."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        shape, keys = keys.shape, keys.ravel()
        out, at = np.full(keys.shape, NONE, np.int32), self.home(keys)
        live = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        while len(live):
            slot = at[live]
            seen = self.keys[slot]
            hit = seen == keys[live]
            out[live[hit]] = self.values[slot[hit]]
            live = live[~hit & (seen != np.uint64(2**64 - 1))]
            at[live] = (at[live] + np.uint64(1)) & self.mask
        return out.reshape(shape)


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


class Flat:
    """Byte strings by number, gathered into one buffer for whole arrays of numbers."""

    def __init__(self, items: list[bytes]):
        self.size = np.array([len(i) for i in items], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(items), np.uint8)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all, the end of each in them)."""
        size = self.size[numbers]
        return self.bytes[_places(self.start[numbers], size)], np.cumsum(size)


class Bpe:
    def __init__(self, blob: bytes, pattern: str):
        rows = (line.split() for line in blob.splitlines() if line.strip())
        self.ids = {base64.b64decode(a): int(b) for a, b in rows}
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.tokens, self.decimals = Flat(self.bytes), Flat([b"%d " % i for i in range(len(self.bytes))])
        self.split = splitter(pattern)
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, i) for token, i in self.ids.items() for k in range(1, len(token)) if (a := self.ids.get(token[:k])) is not None and (b := self.ids.get(token[k:])) is not None]
        p = np.array(pairs or [(0, 0, 0)], np.uint64)[: len(pairs) or 0]
        self.pairs = PairTable((p[:, 0] << np.uint64(32)) | p[:, 1], p[:, 2].astype(np.int32))

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each)."""
        n = np.zeros(len(pieces), np.int64)
        buckets: dict[int, list[int]] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (places of pieces, their ids)
        whole, own = [], []
        for at, piece in enumerate(pieces):
            if (i := self.ids.get(piece)) is not None:
                whole.append(at)
                own.append(i)
            else:
                size = len(piece)
                buckets.setdefault(size if size <= 32 else min(LINE * 2, 1 << (size - 1).bit_length()), []).append(at)
        n[whole] = 1
        found.append((np.array(whole, np.int64), np.array(own, np.int32)))
        for width, rows in buckets.items():
            if width > LINE:
                for at in rows:
                    ids = self.encode_lines(pieces[at])
                    n[at] = len(ids)
                    found.append((np.array([at]), ids))
                continue
            step = max(1, 2_000_000 // width)
            for first in range(0, len(rows), step):
                part = np.array(rows[first : first + step])
                for line, ids, count in self.encode_matrix([pieces[at] for at in part], width):
                    n[part[line]] = count
                    found.append((part[line], ids))
        start, out = np.cumsum(n) - n, np.empty(n.sum(), np.int32)
        for at, ids in found:
            out[_places(start[at], n[at])] = ids
        return out, n

    def encode_matrix(self, rows: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of rows that are done, their ids one after the other, number of ids of each), until all are."""
        size = np.array([len(r) for r in rows])
        raw = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < size[:, None], self.byte_id[raw], np.int32(-1))
        rank, at = self.pairs.get(ids[:, :-1], ids[:, 1:]), np.arange(len(rows))
        while len(at):
            j = rank.argmin(1) if rank.shape[1] else np.zeros(len(at), np.int64)  # the leftmost of equal minima
            best = rank[np.arange(len(at)), j] if rank.shape[1] else np.full(len(at), NONE)
            done = best == NONE
            if done.any():
                left = ids[done]
                yield at[done], left[left >= 0], (left >= 0).sum(1)
                ids, rank, at, j, best = ids[~done], rank[~done], at[~done], j[~done], best[~done]
                if not len(at):
                    return
            line, w = np.arange(len(at)), ids.shape[1]
            ids[line, j] = best
            ids = np.take_along_axis(ids, (c := np.arange(w - 1)) + (c > j[:, None]), 1)
            if w == 2:
                rank = rank[:, :0]
                continue
            rank = np.take_along_axis(rank, (c := np.arange(w - 2)) + (c >= j[:, None]), 1)
            for side in (-1, 0):
                k = j + side
                ok = (k >= 0) & (k < w - 2)
                rank[line[ok], k[ok]] = self.pairs.get(ids[line[ok], k[ok]], ids[line[ok], k[ok] + 1])

    def encode_lines(self, piece: bytes) -> np.ndarray:
        ids = np.append(self.byte_id[np.frombuffer(piece, np.uint8)], np.int32(-1))  # the last place stands for the end
        rank = after = before = low = np.zeros(0)
        empty = len(ids)  # laid out at first, and again when half of the places are empty
        while True:
            if 2 * empty >= len(ids):
                ids = ids[ids >= 0] if empty < len(ids) else ids[:-1]
                n, empty = len(ids), 0
                ids = np.append(ids, np.int32(-1))
                after, before = np.arange(1, n + 2), np.arange(-1, n)
                rank = np.full(-(-n // LINE) * LINE, NONE)
                rank[: n - 1] = self.pairs.get(ids[: n - 1], ids[1:n])
                low = rank.reshape(-1, LINE).min(1)
            least = low.min()
            if least == NONE:
                return ids[ids >= 0]
            lines = np.flatnonzero(low == least)
            hit = np.flatnonzero(rank.reshape(-1, LINE)[lines] == least)
            at = lines[hit // LINE] * LINE + hit % LINE
            # of pairs that share a token every second is merged, beginning with the first
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            second, previous = after[at], before[at]
            third = after[second]
            joined = np.concatenate([[False], second[:-1] == previous[1:]])  # what stands before was merged just now
            left = self.pairs.get(np.where(joined, least, np.where(previous >= 0, ids[previous], -1)).astype(np.int32), np.full(len(at), least))
            right = self.pairs.get(np.full(len(at), least), ids[third])
            lower = np.flatnonzero((left < least) | (right < least))
            if len(lower):  # that pair comes first, then the others
                at, second, previous, third, joined, left, right = (v[: lower[0] + 1] for v in (at, second, previous, third, joined, left, right))
            ids[at], ids[second], rank[second] = least, -1, NONE
            after[at], before[third] = third, at
            rank[at] = right
            rank[np.where(joined, np.concatenate([[0], at[:-1]]), previous)[joined | (previous >= 0)]] = left[joined | (previous >= 0)]
            empty += len(at)
            touched = np.unique(np.concatenate([at, second, previous[previous >= 0]]) // LINE)
            low[touched] = rank.reshape(-1, LINE)[touched].min(1)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.gather(ids)[0].tobytes()


def _held(pieces: Collection[str]) -> int:
    """About how many bytes pre-tokens take as keys: their characters, and what a string and an entry need besides."""
    return 160 * len(pieces) + 2 * sum(map(len, pieces))


class CachedBpe:
    """Encodes texts; ids of pre-tokens are kept, about ``most`` of them and about ``most_bytes`` of memory."""

    def __init__(self, blob: bytes, pattern: str, most: int, most_bytes: int = MOST_BYTES):
        self.bpe, self.most, self.most_bytes = Bpe(blob, pattern), most, most_bytes
        self._keep([], np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _keep(self, pieces: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.place = dict(zip(pieces, range(len(pieces)), strict=True))
        self.size = _held(pieces) + 4 * len(ids)
        self.ids, self.n, self.start, self.used = ids, n, np.cumsum(n) - n, np.zeros(len(n), bool)

    def _turn(self) -> None:
        """The pre-tokens used since the last turn stay (none, if that is nearly all)."""
        stay, names = np.flatnonzero(self.used), list(self.place)
        if 4 * len(stay) > 3 * self.most or 4 * _held([names[i] for i in stay.tolist()]) > 3 * self.most_bytes:
            stay = stay[:0]
        self._keep([names[i] for i in stay.tolist()], self.ids[_places(self.start[stay], self.n[stay])], self.n[stay])

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's end)."""
        pieces = [self.bpe.split(t) for t in texts]
        every = list(chain.from_iterable(pieces))
        new = set(every).difference(self.place)
        if (len(self.place) + len(new) > self.most or self.size + _held(new) > self.most_bytes) and self.place:
            self._turn()
            new = set(every).difference(self.place)
        if new:
            names = list(new)
            ids, n = self.bpe.encode_pieces([p.encode() for p in names])
            self.place.update(zip(names, range(len(self.n), len(self.n) + len(names)), strict=True))
            self.size += _held(names) + 4 * len(ids)
            self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
            self.start, self.used = np.cumsum(self.n) - self.n, np.concatenate([self.used, np.zeros(len(names), bool)])
        at = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
        self.used[at] = True
        upto = np.concatenate([[0], np.cumsum(self.n[at])])
        return self.ids[_places(self.start[at], self.n[at])], upto[np.cumsum([len(p) for p in pieces], dtype=np.int64)]


def _coder(blob: bytes, pattern: str, most: int) -> CachedBpe:
    return per_worker(f"bpe:{sha256_hex(blob + pattern.encode())}:{most}", lambda: CachedBpe(blob, pattern, most))


def _load(docs: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, most_cached: int = MOST) -> DataFrame:
    """doc_id and the array of ids of each text."""
    sent = _load(docs, ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, pattern, most_cached)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, end = coder.encode_texts([t or "" for t in batch.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), "int32"), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast("int64"), lists], ["doc_id", "ids"])

    return map_batches(id_text(docs), "doc_id long, ids array<int>", work)


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of each array of ids (null: no ids)."""
    sent = _load(encoded, ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(sent.value, pattern, MOST).bpe
        for batch in batches:
            out = [bpe.decode(np.array(ids or (), np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast("int64"), pa.array(out, "binary")], ["doc_id", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, decoded binary", work)


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, most_cached: int = MOST) -> DataFrame:
    """Encode, decode the ids, and return per document the count and the digests of both.

    One pass: ids and decoded bytes of a text exist only while its slice of a batch is worked on.
    """
    sent = _load(docs, ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, pattern, most_cached)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, end = coder.encode_texts([t or "" for t in batch.column("text").to_pylist()])
                n = np.diff(end, prepend=0)
                enc, dec = (digests(flat, ids, end, last) for flat, last in ((coder.bpe.decimals, 1), (coder.bpe.tokens, 0)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast("int64"), pa.array(n, "int64"), pa.array(enc, "string"), pa.array(dec, "string")],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_batches(id_text(docs), SCHEMA, work)


def digests(flat: Flat, ids: np.ndarray, end: np.ndarray, less: int) -> list[str]:
    """SHA-256 of each text's strings put together, without the last ``less`` bytes."""
    data, upto = flat.gather(ids)
    upto = np.concatenate([[0], upto])[np.concatenate([[0], end])].tolist()
    view = data.data
    return [sha256_hex(view[a : max(a, z - less)]) for a, z in zip(upto, upto[1:], strict=False)]
