"""Best-fit packing of documents into sequences, mended by a swap-based local search.

Every task packs the documents of its own split: a window of pieces goes largest first
into the fullest bins that hold them (best fit). Then a local search works on the bins
that are not full: it moves a piece, exchanges one for one, or one for two, whenever
that raises the sum of the bins' squared fills, so fuller bins grow and emptier ones
shrink until they are empty and go. Full bins are written; the others stay open for the
next window. What is open at the end of all splits is a small rest; it alone is
shuffled, and packed again in rounds.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.session import stored

SIZE = 2048
END_ID = 0
#: Ids that a task gathers before it packs them; also those of a task of the rest.
WINDOW_TOKENS = 1 << 21
#: A bin whose gap is at most this part of it is written, not kept open.
CLOSED = 1 / 256
#: Looks at all open bins that a local search takes at most.
ROUNDS = 8
#: Candidates that are looked at for one growth at most.
LOOK = 8
#: Emptiest bins, and pieces of each, that two-for-one exchanges look at.
PAIR_BINS = 64
PAIR_PIECES = 32


class Encoder:
    """Ids of whole texts in a byte-level vocabulary of `tokenizers`.

    Where the vocabulary is one of plain merges, numbered in their order, its ids are
    also those of the same bytes as ranks, which is several times faster (tests compare
    both). Any other vocabulary, and any text that the ranks cannot do, goes through
    `tokenizers` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        plain = {t: i for t, i in told["model"]["vocab"].items() if t not in special}
        step = told["pre_tokenizer"] or {}
        if (step.get("type"), step.get("add_prefix_space"), step.get("use_regex"), told["normalizer"]) != (
            "ByteLevel", False, True, None,
        ):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        if any(plain.get("".join(m)) != 256 + k for k, m in enumerate(merges)):
            return None
        # Printable bytes stand for themselves, the others for the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
        return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.ranked is not None:
            try:
                return self.ranked.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
            except BaseException as error:  # its own panics are no Exception
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Bins:
    """Open bins of pieces (length, name), and the local search on them."""

    def __init__(self, size: int):
        self.size, self.next = size, 0
        self.pieces: dict[int, list[tuple[int, int]]] = {}
        self.where: dict[int, int] = {}
        self.fills: dict[int, int] = {}
        self.by_gap: list[tuple[int, int]] = []

    def _fill(self, bin_: int, fill: int) -> None:
        old = self.fills.get(bin_)
        if old is not None:
            del self.by_gap[bisect_left(self.by_gap, (self.size - old, bin_))]
        if fill:
            self.fills[bin_] = fill
            insort(self.by_gap, (self.size - fill, bin_))
        else:
            del self.fills[bin_], self.pieces[bin_]

    def add(self, piece: tuple[int, int]) -> None:
        """Best fit: the fullest bin that holds it, else a new one."""
        at = bisect_left(self.by_gap, (piece[0], -1))
        if at < len(self.by_gap):
            bin_ = self.by_gap[at][1]
        else:
            bin_, self.next = self.next, self.next + 1
            self.pieces[bin_] = []
        self.pieces[bin_].append(piece)
        self.where[piece[1]] = bin_
        self._fill(bin_, self.fills.get(bin_, 0) + piece[0])

    def exchange(self, a: int, given: list, b: int, taken: list) -> None:
        """Bin a gives `given` to bin b for `taken`."""
        for bin_, out, put in ((a, given, taken), (b, taken, given)):
            self.pieces[bin_] = [p for p in self.pieces[bin_] if p not in out] + put
            for _, name in put:
                self.where[name] = bin_
        grown = sum(p[0] for p in taken) - sum(p[0] for p in given)
        fill_a, fill_b = self.fills[a], self.fills[b]
        self._fill(a, fill_a + grown)
        self._fill(b, fill_b - grown)

    def _pairs_of(self, bin_: int) -> list[tuple]:
        """(sum, bin, first, second) of pairs of a bin's pieces, one for each sum."""
        own = sorted(set(self.pieces[bin_]))
        if len(own) > PAIR_PIECES:  # evenly from shortest to longest
            own = [own[k * len(own) // PAIR_PIECES] for k in range(PAIR_PIECES)]
        sums = {}
        for k, first in enumerate(own):
            for second in own[k + 1 :]:
                sums.setdefault(first[0] + second[0], (first, second))
        return [(total, bin_, *pair) for total, pair in sums.items()]

    def improve(self, rounds: int = ROUNDS) -> None:
        """Raise the sum of squared fills by moves and exchanges between the bins.

        If a bin of fill x grows by d at the cost of one of fill y, the sum rises exactly
        if x + d > y. Bins are tried from the fullest down, each with the change that
        leaves it the smallest gap, so the emptiest bins pay, and go when they are empty.
        A change moves a piece, or exchanges one for one, one for two or two for one.
        """
        for _ in range(rounds):
            singles = sorted((length, b, (length, name)) for b, own in self.pieces.items() for length, name in own)
            pairs = sorted(pair for _, b in self.by_gap[-PAIR_BINS:] for pair in self._pairs_of(b))
            changed = False
            for gap, a in list(self.by_gap):
                if gap and self.size - self.fills.get(a, 0) == gap:
                    found = self._best(a, gap, singles, pairs)
                    if found:
                        self.exchange(a, *found)
                        changed = True
            if not changed:
                return

    def _best(self, a: int, gap: int, singles: list, pairs: list):
        """(given, b, taken) of the change that fills bin a most, or None."""
        best, growth, fill = None, 0, self.fills[a]
        one = {length: [(length, name)] for length, name in self.pieces[a]}
        two = {total: list(pair) for total, _, *pair in self._pairs_of(a)}
        for givings, table in (({0: []} | one, singles), (one, pairs), (two, singles)):
            for lost, given in givings.items():
                if growth == gap:
                    return best
                # From the largest that fits down; pieces that have gone elsewhere are passed over.
                at = bisect_left(table, (lost + gap + 1,))
                lowest = bisect_left(table, (lost + growth + 1,))
                for k in range(at - 1, max(lowest, at - LOOK) - 1, -1):
                    total, b, *taken = table[k]
                    grown = total - lost
                    if b == a or fill + grown <= self.fills.get(b, self.size):
                        continue
                    if all(self.where[name] == b for _, name in taken):
                        best, growth = (given, b, taken), grown
                        break
        return best

    def pop(self, most_gap: int) -> list[list[int]]:
        """Take out the bins with at most this gap: the names of their pieces."""
        at = bisect_left(self.by_gap, (most_gap + 1,))
        out = []
        for _, bin_ in self.by_gap[:at]:
            out.append([name for _, name in self.pieces.pop(bin_)])
            del self.fills[bin_]
            for name in out[-1]:
                del self.where[name]
        del self.by_gap[:at]
        return out


_FIELDS = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "open"]
SCHEMA = (
    "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, open boolean"
)
_ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]


class _Packer:
    """Pieces in, rows of packed sequences out; holds a window of ids at most."""

    def __init__(self, size: int, window: int, mark: int, last: bool):
        self.size, self.window, self.last = size, window, last
        self.number = mark << 36
        self.bins = Bins(size)
        self.held: dict[int, tuple] = {}
        self.fresh: list[tuple[int, int]] = []
        self.count = self.tokens = 0
        self.rows = [[] for _ in _FIELDS]
        self.bytes = 0

    def put(self, doc_id, piece: int, start: int, ids: bytes) -> Iterator[pa.RecordBatch]:
        length = len(ids) // 4
        if length == self.size:
            self._write([(doc_id, piece, start, ids)], False)
        else:
            self.held[self.count] = (doc_id, piece, start, ids)
            self.fresh.append((length, self.count))
            self.count += 1
            self.tokens += length
            if self.tokens >= self.window:
                self._pack()
                gap = int(self.size * CLOSED)
                self._close(gap)
                # Never more than half a window stays open.
                while sum(self.bins.fills.values()) > self.window // 2:
                    gap = 2 * gap + 1
                    self._close(gap)
                self.tokens = sum(self.bins.fills.values())
        if self.bytes > 1 << 24:
            yield self._batch()

    def _pack(self) -> None:
        for piece in sorted(self.fresh, reverse=True):
            self.bins.add(piece)
        self.fresh = []
        self._close(int(self.size * CLOSED))
        self.bins.improve()

    def _close(self, gap: int, open_: bool = False) -> None:
        for pieces in self.bins.pop(gap):
            self._write([self.held.pop(p) for p in pieces], open_)

    def _write(self, pieces: list[tuple], open_: bool) -> None:
        offset = 0
        for doc_id, piece, start, ids in pieces:
            values = (doc_id, piece, start, len(ids) // 4, ids, self.number, offset, open_)
            for column, value in zip(self.rows, values, strict=True):
                column.append(value)
            offset += len(ids) // 4
            self.bytes += len(ids) + 64
        self.number += 1

    def _batch(self) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(self.rows, _ARROW, strict=True)], names=_FIELDS)
        self.rows, self.bytes = [[] for _ in _FIELDS], 0
        return batch

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._pack()
        self._close(int(self.size * CLOSED))
        self._close(self.size, not self.last)
        yield self._batch()


def pieces_of(ids: np.ndarray, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids): whole if it fits, else pieces of `size`, the first one shorter."""
    start = 0
    first = (len(ids) - 1) % size + 1
    for piece in range(-(-len(ids) // size)):
        end = first + piece * size
        yield piece, start, ids[start:end].tobytes()
        start = end


def _first_task(batches: Iterator[pa.RecordBatch], path: str, size: int, window: int, end: int):
    encode = encoder(path).encode
    packer = _Packer(size, window, TaskContext.get().partitionId(), last=False)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(encode(text.as_py()), np.uint32(end)).astype("<u4")
            for piece in pieces_of(ids, size):
                yield from packer.put(doc_id, *piece)
    yield from packer.finish()


def _rest_task(batches: Iterator[pa.RecordBatch], size: int, window: int, mark: int):
    packer = _Packer(size, window, mark + TaskContext.get().partitionId(), last=True)
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            yield from packer.put(*row)
    yield from packer.finish()


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = SIZE,
    end_id: int = END_ID,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """Pieces of all documents' ids and their places in sequences of at most `size` ids.

    `tokenizer` is the path of a vocabulary file of `tokenizers`. One row per piece:
    doc_id, piece (from 0), start (ids of its document before it), length, ids
    (little-endian unsigned 32-bit), sequence_id and offset in the sequence (gapless
    from 0). Every document ends with `end_id`. Only documents of more than `size` ids
    are cut, into pieces of that size, of which the first may be shorter.

    A null text counts as empty and so is a piece of one id. Null or repeated doc_ids
    are packed as they come, equal rows each on its own; ties of lengths go by the order
    of the split's rows. Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = stored(rows.mapInArrow(lambda b: _first_task(b, tokenizer, size, window_tokens, end_id), SCHEMA))
    closed = first.filter("NOT open").drop("open")
    rest = first.filter("open")
    left = rest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    # The rest is dealt to as many tasks as it fills windows, each bin whole.
    tasks = max(1, round(left / window_tokens))
    unit = F.pmod(F.xxhash64("sequence_id"), F.lit(tasks))
    dealt = rest.select("doc_id", "piece", "start", "ids", unit.alias("unit"), "sequence_id", "offset")
    dealt = dealt.repartition(tasks, "unit").sortWithinPartitions("sequence_id", "offset")
    packed = dealt.select("doc_id", "piece", "start", "ids").mapInArrow(
        lambda b: _rest_task(b, size, window_tokens, 1 << 26), SCHEMA
    )
    return closed.unionByName(packed.drop("open"))
