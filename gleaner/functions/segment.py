"""Word segmentation of runs without blanks: the cheapest path through the lattice of dictionary words (unigram Viterbi), in batches.

Words and their costs, minus the logarithm of their share, are counted from a corpus and kept as a trie over their UTF-8 bytes (a double array), which all
places of a batch of runs descend together. A place that no word bridges parts a run into pieces, and the best way to the first, second, ... place of all
pieces is found at once, the longest pieces first, so that those still running are always the first ones. A character that no word covers costs more than any word.

Costs add up from the beginning of a run. Within a piece they add up from 0, which is the same but for rounding; a piece in which rounding may decide, and the few
longest, are gone through word by word from the cost of what stands before them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import pytext
from gleaner.session import ship, sliced, spread

#: Bytes of runs that are parted together (one run at least).
BATCH = 1 << 17
#: Pieces that are gone through together at least.
LANES = 8
#: Between two runs: no byte of a character.
BETWEEN = 0xFF


def _placed(parent: np.ndarray, symbol: np.ndarray, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a trie's nodes the base, from which a child lies as far as its symbol says, and the slot; and how many slots there are.

    Edge i leads from ``parent`` (ascending) to node i + 1. Nodes with many children come first; bases are drawn, and where two nodes want a slot the first has it.
    """
    children = np.bincount(parent, minlength=nodes)
    first = np.concatenate([[0], np.cumsum(children)])
    base, slot = np.ones(nodes, np.int64), np.zeros(nodes, np.int64)
    taken = np.zeros(1 << int(2 * nodes + 2 * width).bit_length(), bool)
    drawn = np.random.default_rng(1)
    for low, high in ((17, width), (9, 16), (5, 8), (3, 4), (2, 2), (1, 1)):
        left, tries = np.flatnonzero((children >= low) & (children <= high)), 0
        while len(left):
            tries += 1
            if tries % 64 == 0:
                taken = np.concatenate([taken, np.zeros(len(taken), bool)])
            at, counts = drawn.integers(1, len(taken) - width, len(left)), children[left]
            begin = np.cumsum(counts) - counts
            edges = np.arange(counts.sum()) + np.repeat(first[left] - begin, counts)
            wanted, who = np.repeat(at, counts) + symbol[edges], np.repeat(np.arange(len(left)), counts)
            claimed = np.empty(len(taken), np.int32)
            claimed[wanted[::-1]] = who[::-1]
            got = np.logical_and.reduceat((claimed[wanted] == who) & ~taken[wanted], begin)
            mine = np.repeat(got, counts)
            taken[wanted[mine]] = True
            slot[edges[mine] + 1] = wanted[mine]
            base[left[got]] = at[got]
            left = left[~got]
    return base, slot, len(taken)


@dataclass(frozen=True)
class Dictionary:
    """A trie of words: a slot's upper half is a base, its lower half names the parent's slot. A child lies at its parent's base and its symbol; the base is below 0 where a word ends."""

    symbol: np.ndarray
    slots: np.ndarray
    #: The cost of the word that ends at a slot.
    price: np.ndarray
    #: The slot that two symbols lead to (0: none), and what each byte costs as a character of its own.
    pairs: np.ndarray
    one: np.ndarray
    longest: int
    #: The cost of a character that no word covers.
    unknown: float

    @staticmethod
    def of(counts: dict[str, int]) -> Dictionary:
        total = max(sum(counts.values()), 1)
        counts = {w.encode("utf-8", "surrogatepass"): n for w, n in counts.items() if w}
        words, sizes, longest = list(counts), np.array([len(w) for w in counts], np.int64), max(map(len, counts), default=0)
        costs = np.array([-np.log(n / total) for n in counts.values()])
        letters = np.frombuffer(b"".join(w.ljust(longest, b"\xff") for w in words), np.uint8).reshape(len(words), longest)
        used = np.bincount(letters.ravel(), minlength=256)[:BETWEEN] > 0
        symbol, width = np.zeros(256, np.int32), int(used.sum()) + 1
        symbol[:BETWEEN][used] = np.arange(1, width)
        # the words' nodes, a letter at a time; nodes are numbered so that parents ascend
        node, nodes, parents, symbols, prices = np.zeros(len(words), np.int64), 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.array([np.inf])]
        for k in range(longest):
            own = np.flatnonzero(sizes > k)
            edges, which = np.unique(node[own] * width + symbol[letters[own, k]], return_inverse=True)
            node[own] = nodes + which
            ends = own[sizes[own] == k + 1]
            price = np.full(len(edges), np.inf)
            price[node[ends] - nodes] = costs[ends]
            parents.append(edges // width)
            symbols.append(edges % width)
            prices.append(price)
            nodes += len(edges)
        parent, by_node = np.concatenate(parents), np.concatenate(prices)
        bases, slot, size = _placed(parent, np.concatenate(symbols), nodes, width)
        base, check, price = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, np.inf)
        base[slot] = np.where(np.isfinite(by_node), -bases, bases)
        check[slot[1:]] = slot[parent]
        price[slot] = by_node
        after = base[0] + np.arange(width)
        after = np.where(check[after] == 0, after, 0)
        next_ = np.abs(base[after])[:, None] + np.arange(width)
        pairs = np.where((after[:, None] > 0) & (check[next_] == after[:, None]), next_, 0).ravel()
        unknown = 2 * np.log(total + 1) + 1
        one = np.where(np.arange(256) < 0x80, np.minimum(price[after][symbol], unknown), np.inf)
        return Dictionary(symbol, (base.astype(np.int64) << 32) | (check.astype(np.int64) & 0xFFFFFFFF), price, pairs, one, longest, float(unknown))

    def segment(self, runs: list[str]) -> list[list[str]]:
        """The words of each run. Of equally cheap ways the one whose last word is longest, and so on from the end."""
        out, own, size = [], [], 0
        for run in runs:
            raw = run.encode("utf-8", "surrogatepass")
            if own and size + len(raw) >= BATCH:
                out += self._batch(own)
                own, size = [], 0
            own.append(raw)
            size += len(raw) + 1
        return out + self._batch(own) if own else out

    def _batch(self, runs: list[bytes]) -> list[list[str]]:
        data = np.frombuffer(b"".join(r + b"\xff" for r in runs), np.uint8)
        starts, letters = self._starts(data), data != BETWEEN
        at = np.cumsum(letters.astype(np.int32) + starts)
        parted = np.full(at[-1], BETWEEN, np.uint8)  # that byte before every word
        parted[at[letters] - 1] = data[letters]
        if all(map(bytes.isascii, runs)):
            words = parted.tobytes().decode("latin-1").split("\xff")
        else:
            words = [w.decode("utf-8", "surrogatepass") for w in parted.tobytes().split(b"\xff")]
        end = (np.cumsum(starts)[~letters] + 1).tolist()
        return [words[a:b] for a, b in zip([1, *end], end)]

    def _words(self, data: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(size, where they begin, costs) of all words of several bytes in ``data``, and of characters of several bytes as such; the longest first."""
        symbols = np.concatenate([self.symbol.take(data), np.zeros(self.longest + 2, np.int32)])
        n, found, width = len(data), [], self.symbol.max() + 1
        state = self.pairs.take(symbols[:n] * width + symbols[1 : n + 1])
        place, size = np.flatnonzero(state), 2
        state = state.take(place).astype(np.int32)
        base = (self.slots.take(state) >> 32).astype(np.int32)
        while len(place):
            ends = np.flatnonzero(base < 0)
            if len(ends):
                found.append((size, place.take(ends), self.price.take(state.take(ends))))
            slot = np.abs(base) + symbols[size:].take(place)
            here = self.slots.take(slot)
            on = np.flatnonzero(here.astype(np.int32) == state)
            place, state, base, size = place.take(on), slot.take(on), (here.take(on) >> 32).astype(np.int32), size + 1
        for size, least, most in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
            place = np.flatnonzero((data >= least) & (data <= most))
            if len(place):
                found.append((size, place, np.full(len(place), self.unknown)))
        return sorted(found, key=lambda x: -x[0])

    def _starts(self, data: np.ndarray) -> np.ndarray:
        """Where words begin in runs of bytes."""
        n, places, found = len(data), np.arange(len(data)), self._words(data)
        far = places + 1
        for size, at, _ in reversed(found):
            far[at] = at + size
        bridged = np.maximum.accumulate(far)
        cut = np.concatenate([[True], bridged[:-1] <= places[1:]])
        begin = np.flatnonzero(cut)
        lengths = np.diff(np.append(begin, n))
        order = np.argsort(-lengths, kind="stable")
        begin_of, length_of = begin[order], lengths[order]  # by lane: pieces, the longest first
        lane = np.empty(len(order), np.int64)
        lane[order] = np.arange(len(order))
        # rows: the places of all pieces, first place 0 of each lane, then place 1 of those that have one, ...
        row = np.concatenate([[0], np.cumsum(np.cumsum(np.bincount(lengths)[::-1])[::-1])])
        piece = np.cumsum(cut) - 1
        within, lane_at = places - begin[piece], lane[piece]
        before, after = row[within] + lane_at, row[within + 1] + lane_at
        rows, lanes = int(row[-1]), len(order)
        byte = np.empty(rows, np.int64)
        byte[before] = places
        # of every row the words that end there, the longest first, a byte of its own last
        count = np.ones(rows, np.int64)
        count[:lanes] = 0
        ends = [after[size - 1 :].take(at) for size, at, _ in found]
        for end in ends:
            count[end] += 1
        first = np.concatenate([[0], np.cumsum(count)])
        source, cost = np.empty(first[-1], np.int64), np.empty(first[-1])
        last = first[1:].take(after) - 1
        source[last], cost[last] = before, self.one.take(data)
        free = first[:-1].copy()
        for (_, at, price), end in zip(found, ends, strict=True):
            to = free.take(end)
            free[end] = to + 1
            source[to], cost[to] = before.take(at), price
        # the best way to each row, place by place as far as there are enough lanes
        steps = int(max(length_of[min(LANES, lanes) - 1], min(64, length_of[0])))
        best, way = np.zeros(rows), np.empty(len(source))
        at, of = row.tolist(), first[row].tolist()
        for j in range(1, steps + 1):
            a, b, x, y = at[j], at[j + 1], of[j], of[j + 1]
            part = way[x:y]
            best.take(source[x:y], out=part, mode="clip")
            part += cost[x:y]
            np.minimum.reduceat(part, first[a:b] - x, out=best[a:b])
        known, y = at[steps + 1], of[steps + 1]
        near = np.flatnonzero(way[:y] <= np.repeat(best[lanes:known] + 4 * steps * np.spacing(n * self.unknown), count[lanes:known]))
        of_row = np.repeat(np.arange(lanes, known), count[lanes:known]).take(near)
        chosen, close = np.empty(known, np.int64), np.zeros(known, bool)
        chosen[of_row] = near
        close[of_row[1:][of_row[1:] == of_row[:-1]]] = True  # which is the least, rounding may decide
        # from the end of each piece to its beginning
        starts, paid = np.zeros(n, bool), np.zeros(n)
        again = length_of > steps
        own = np.flatnonzero(~again & (data[begin_of] != BETWEEN))
        here = row[length_of[own]] + own
        while len(here):
            again[own[close.take(here)]] = True
            word = chosen.take(here)
            here = source.take(word)
            to = byte.take(here)
            starts[to], paid[to] = True, cost.take(word)
            on = np.flatnonzero(here >= lanes)
            here, own = here.take(on), own.take(on)
        if again.any():
            self._again(data, np.flatnonzero(again), begin_of, length_of, row, first, source, cost, byte, starts, paid)
        return starts

    def _again(self, data: np.ndarray, lanes: np.ndarray, begin_of: np.ndarray, length_of: np.ndarray, row: np.ndarray, first: np.ndarray, source: np.ndarray, cost: np.ndarray, byte: np.ndarray, starts: np.ndarray, paid: np.ndarray) -> None:
        """Pieces word by word, from the cost of the words before them in their run."""
        run_begins = np.concatenate([[0], np.flatnonzero(data == BETWEEN) + 1])
        lanes = lanes[np.argsort(begin_of[lanes])]
        runs = run_begins[np.searchsorted(run_begins, begin_of[lanes], "right") - 1]
        run, value, done = -1, 0.0, 0
        for lane, begin, length, run_begin in zip(lanes.tolist(), begin_of[lanes].tolist(), length_of[lanes].tolist(), runs.tolist(), strict=True):
            if run_begin != run:
                run, value, done = run_begin, 0.0, run_begin
            value = float(np.add.accumulate(np.concatenate([[value], paid[done:begin]]))[-1])  # one after the other
            rows = row[1 : length + 1] + lane
            counts = first[rows + 1] - first[rows]
            words = np.arange(counts.sum()) + np.repeat(first[rows] - np.cumsum(counts) + counts, counts)
            ends = np.repeat(np.arange(1, length + 1), counts)
            ways, steps = [value] + [np.inf] * length, [0] * (length + 1)
            for at, price, end in zip((byte[source[words]] - begin).tolist(), cost[words].tolist(), ends.tolist(), strict=True):
                if (way := ways[at] + price) < ways[end]:
                    ways[end], steps[end] = way, at
            starts[begin : begin + length] = False
            j = length
            while j:
                j = steps[j]
                starts[begin + j] = True
            value, done = ways[-1], begin + length


def segmenter(dictionary: Dictionary) -> Callable[[str], list[str]]:
    """The dictionary as a segmenter of the lexical index."""
    return lambda run: dictionary.segment([run])[0]


def segmented(texts: DataFrame, dictionary: Dictionary, id_col: str, text: str, runs_of: Callable[[pa.Array], list[str | None]] = pa.Array.to_pylist) -> DataFrame:
    """(id, words) of runs of characters, one a row; a null is no words. ``runs_of``: what makes runs of the texts."""
    spark = texts.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(dictionary)
    kind = dict(texts.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = sent.value.segment([t or "" for t in runs_of(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], [id_col, "words"])

    return spread(texts.select(id_col, text)).mapInArrow(work, f"{id_col} {kind}, words array<string>")


def counted_tokens(texts: DataFrame, text: str) -> DataFrame:
    """(w, n): search tokens and how often each occurs, a slice of the texts at a time, so a token in several rows."""
    ship(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            found = pc.value_counts(pytext.token_lists(batch.column(0)).flatten())
            yield pa.RecordBatch.from_arrays(found.flatten(), ["w", "n"])

    return spread(texts.select(text)).mapInArrow(work, "w string, n long")


def counted_dictionary(words: DataFrame, least: int = 2, longest: int = 24, most: int = 200_000) -> Dictionary:
    """The dictionary of a column of words, or of words and how often each occurs: the ``most`` most frequent of those that occur ``least`` times, of ``longest`` characters at most.

    Counting is an aggregate; a dictionary is a model of bounded size, which the driver holds and a broadcast brings to the tasks.
    The driver reads the sorted counts a partition at a time until it has enough: the best of all partitions together would be as many times that size.
    """
    word, *number = words.columns
    given = words.select(F.col(word).alias("w"), (F.col(number[0]) if number else F.lit(1)).alias("n"))
    counts = given.filter(F.length("w").between(1, longest)).groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = islice(counts.orderBy(F.desc("n"), "w").toLocalIterator(), most)
    return Dictionary.of({r.w: r.n for r in rows})
