"""Fill-in-middle transformation on a sparse exception index.

Texts stay UTF-8 bytes. Of a text only its multibyte characters are recorded, by
position and by the bytes they have beyond one: in the spans between them a character
is a byte, so places there are mere arithmetic, and `searchsorted` on the exceptions
turns cuts in code points into cuts in bytes and back. A plain ASCII text has no index
at all, and no text is ever held as an array of characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
UNITS = ("token", "char")
#: Bytes of a text that are looked at together.
SLICE = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True


class ExceptionIndex:
    """The multibyte characters of a text, as (byte position, excess bytes so far)."""

    def __init__(self, data: bytes):
        self.n_bytes = len(data)
        places, excess = [], []
        if not data.isascii():
            view = np.frombuffer(data, np.uint8)
            for at in range(0, len(view), SLICE):
                part = view[at : at + SLICE]
                lead = np.flatnonzero(part >= 0xC0)
                places.append(lead + at)
                excess.append(1 + (part[lead] >= 0xE0).astype(np.int64) + (part[lead] >= 0xF0))
        self.places = np.concatenate(places) if places else np.empty(0, np.int64)
        # excess[i]: of all exceptions before the i-th one
        self.excess = np.concatenate([[0], np.cumsum(np.concatenate(excess) if excess else [])]).astype(np.int64)
        self.n_chars = self.n_bytes - int(self.excess[-1])

    def char_of(self, byte: int) -> int:
        """The code points before a character boundary in bytes."""
        return byte - int(self.excess[np.searchsorted(self.places, byte)])

    def byte_of(self, char: int) -> int:
        """The bytes before the given code point."""
        return char + int(self.excess[np.searchsorted(self.places - self.excess[:-1], char)])


class TokenStarts:
    """Where tokens `[A-Za-z]+|[^A-Za-z]` begin, counted by slice, found within one."""

    def __init__(self, data: bytes):
        self.view = np.frombuffer(data, np.uint8)
        counts = [int(self._begins(at).sum()) for at in range(0, len(self.view), SLICE)]
        self.before = np.cumsum([0, *counts])
        self.n = int(self.before[-1])

    def _begins(self, at: int) -> np.ndarray:
        part = self.view[at : at + SLICE]
        letter = _LETTER[part]
        # Bytes 0x80 to 0xBF continue a character.
        begins = (part & 0xC0) != 0x80
        begins[1:] &= ~(letter[1:] & letter[:-1])
        if at:
            begins[0] &= not (letter[0] and _LETTER[self.view[at - 1]])
        return begins

    def byte_of(self, token: int) -> int:
        """The bytes before the given token; all bytes for the one after the last."""
        if token >= self.n:
            return len(self.view)
        part = int(np.searchsorted(self.before, token, "right")) - 1
        at = part * SLICE
        return at + int(np.flatnonzero(self._begins(at))[token - self.before[part]])


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 of a document; without an id, those of no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def split(data: bytes, seed: int, doc_id: int | None, percent: int, spm_percent: int, unit: str):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    index = starts = None
    if unit == "token":
        starts = TokenStarts(data)
        n = starts.n
    else:
        index = ExceptionIndex(data)
        n = index.n_chars
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or any(mark in data for mark in _MARKS) or h3 % 100 >= percent:
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if unit == "token":
        index = ExceptionIndex(data)
        a, b = starts.byte_of(low), starts.byte_of(high)
        low, high = index.char_of(a), index.char_of(b)
    else:
        a, b = index.byte_of(low), index.byte_of(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_percent:
        output = b"".join((_MARKS[1], suffix, _MARKS[0], prefix, _MARKS[2], middle))
        return n, "spm", low, high - low, output
    return n, "psm", low, high - low, b"".join((_MARKS[0], prefix, _MARKS[1], suffix, _MARKS[2], middle))


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _split_task(batches: Iterator[pa.RecordBatch], seed: int, percent: int, spm_percent: int, unit: str):
    def rows(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(out[:5], kinds, strict=True)]
        texts = pa.array(out[5], pa.binary()).cast(pa.string())
        return pa.record_batch([*columns, texts], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    for batch in batches:
        out, size = [[] for _ in range(6)], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
            row = (doc_id, *split(data, seed, doc_id, percent, spm_percent, unit))
            for column, value in zip(out, row, strict=True):
                column.append(value)
            size += len(row[5])
            if size > 1 << 24:
                yield rows(out)
                out, size = [[] for _ in range(6)], 0
        if out[0]:
            yield rows(out)


def fill_in_middle(
    docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, unit: str = "token"
) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output.

    A text of n units (`unit`: "token", runs of ASCII letters or single other
    characters; or "char", code points) is cut at two of its n + 1 boundaries, drawn by
    the seed and the doc_id. Of 100 texts `percent` are rearranged (form psm: prefix,
    suffix, middle; of these `spm_percent` in 100 spm: suffix, prefix, middle), each
    part behind its mark; the others, empty ones and those that hold a mark stay as they
    are (form plain, no lengths). Lengths are code points.

    A null text counts as empty; a null doc_id draws like no digits. Rows with equal
    ids draw alike, each on its own text. Texts are taken whole at any length, row by
    row, so nothing is shuffled. Extra columns are ignored; an empty table gives no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda b: _split_task(b, seed, percent, spm_percent, unit), _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone.

    Rearranged texts hold no marks of their own, so the three marks part the output.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
