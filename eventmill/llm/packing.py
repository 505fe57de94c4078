"""Hierarchical multi-length packing of documents into training sequences.

Each task packs the documents of its own split as they stream by, so memory is
bounded by one window and one step group a tier, at any size of the input. Within a
window, documents are routed by their length to the smallest of several context
sizes (tiers) that holds them; each tier is packed, and the gap behind a document
is filled from shorter ones, largest first, cutting the last one to fit. Filled
sequences have exactly the length of their tier, so they carry no padding. What
does not fill a sequence waits for the next window; only the end of a split can
leave one short sequence. A task hands out its sequences in full step groups; what is
left of each tier at its end is grouped over all tasks, so that at most one group of a
tier is short in the whole table.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventmill.session import stored

TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
#: Tokens that a task gathers before it packs them.
WINDOW_TOKENS = 1 << 20
#: Tokens of a step group: sequences of one tier that one training step takes.
STEP_TOKENS = 1 << 16
#: Words whose ids a worker remembers; beyond it starts afresh.
CACHE_WORDS = 1_000_000
_TEXT_SLICE = 1 << 20
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: A run of these at a word's end is a token of its own kind, whatever letter is before it.
MARKS = ".,;:!?*%&$#|+-=()[]/\""
DIGITS = "0123456789"

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, tier long, step_group long"
)
#: Step groups made of several tasks' sequences have numbers from here.
SHARED_GROUPS = 1 << 62


class Encoder:
    """Ids of whole texts, as little-endian 32-bit numbers, with a memory of words.

    The vocabulary's pre-tokenizer drops white space and never looks across it, so
    a text's ids are its words' ids in turn (tests compare with whole texts). ASCII
    case is folded by the vocabulary itself; folding it first saves memory.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        # Tasks already use every core; threads within one would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of words; those before a run of marks are shared by all its forms."""
        if len(self.known) + 2 * len(words) > self.limit:
            self.known.clear()
        known, parts = self.known, []
        for word in words:
            text = word.decode("utf-8")
            stem = text.rstrip(MARKS)
            if len(stem) == len(text) or not stem or not (stem[-1].isalpha() or stem[-1] in DIGITS):
                stem = text
            parts.append((word, stem.encode("utf-8"), text[len(stem) :].encode("utf-8")))
        new = {part for _, *both in parts for part in both if part not in known}
        # A word of plain letters is one pre-token and needs the model alone.
        tokenize, other = self.tokenizer.model.tokenize, []
        for part in new:
            if part.isalpha() and part.islower():
                ids = [token.id for token in tokenize(part.decode("ascii"))]
                known[part] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                other.append(part)
        found = self.tokenizer.encode_batch_fast(
            [part.decode("utf-8") for part in other], add_special_tokens=False
        )
        for part, encoding in zip(other, found, strict=True):
            ids = encoding.ids
            known[part] = struct.pack(f"<{len(ids)}I", *ids)
        for word, stem, tail in parts:
            if tail:
                known[word] = known[stem] + known[tail]

    def encode(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace")
        if b"<|" not in data:  # names of special tokens are told apart by case
            data = data.lower()
        out, at = [], 0
        while at < len(data):
            blank = _BLANK.search(data, at + _TEXT_SLICE)
            end = blank.start() if blank else len(data)
            words = data[at:end].split()
            at = end
            known = self.known
            missing = [w for w in set(words) if w not in known]
            for i in range(0, len(missing), 50_000):
                self.learn(missing[i : i + 50_000])
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:  # the memory was emptied while this slice was learnt
                own = {}
                for i in range(0, len(words), 50_000):
                    part = sorted({w for w in words[i : i + 50_000] if w not in own})
                    self.learn(part)
                    own.update((w, known[w]) for w in part)
                out.append(b"".join([own[w] for w in words]))
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_window(fragments: list[tuple[int, int, int]], tiers=TIERS, last: bool = False):
    """Fill sequences from (length, document, start) fragments.

    Returns the filled sequences, as (tier, pieces), and the fragments left over.
    With `last`, what is left over is cut into the largest tiers that it fills and
    at most one short sequence, whose tier is the largest.
    """
    pool, full = [], []
    top = tiers[-1]
    for length, doc, start in fragments:
        while length >= top:
            full.append((top, [(top, doc, start)]))
            length, start = length - top, start + top
        if length:
            pool.append((length, doc, start))
    pool.sort()
    while pool:
        first = pool.pop()
        tier = next(t for t in tiers if t >= first[0])
        gap, pieces = tier - first[0], [first]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0))
            if at:
                piece = pool.pop(at - 1)
                pieces.append(piece)
                gap -= piece[0]
            else:
                length, doc, start = pool.pop()
                pieces.append((gap, doc, start))
                insort(pool, (length - gap, doc, start + gap))
                gap = 0
        if gap:
            if not last:
                return full, pieces
            return full + _close(pieces, tiers), []
        full.append((tier, pieces))
    return full, []


def _close(pieces, tiers):
    """Sequences of the given pieces in turn, exactly filled but for the last."""
    out, left = [], sum(p[0] for p in pieces)
    queue = list(reversed(pieces))
    while left:
        size = next((t for t in reversed(tiers) if t <= left), left)
        left -= size
        taken, need = [], size
        while need:
            length, doc, start = queue.pop()
            part = min(need, length)
            taken.append((part, doc, start))
            if part < length:
                queue.append((length - part, doc, start + part))
            need -= part
        out.append((size if size in tiers else tiers[-1], taken))
    return out


def _pack_task(batches: Iterator[pa.RecordBatch], path: str, tiers, window: int, step: int):
    task = TaskContext.get().partitionId() << 36
    encode = encoder(path).encode
    schema = pa.schema(
        [(n, pa.binary() if n == "ids" else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))]
    )
    end = END_ID.to_bytes(4, "little")
    docs: dict[int, tuple] = {}
    fragments: list[tuple[int, int, int]] = []
    held = number = seen = 0
    groups = dict.fromkeys(tiers, 0)
    # Sequences of each tier that wait for their step group to fill, as lists of rows.
    waiting: dict[int, list] = {tier: [] for tier in tiers}

    def batch_of(rows):
        columns = zip(*rows, strict=True)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def emit(last: bool):
        nonlocal fragments, held, number
        sequences, fragments = pack_window(fragments, tiers, last)
        out, size = [], 0
        for tier, pieces in sequences:
            offset, rows = 0, []
            for length, doc, start in pieces:
                doc_id, data = docs[doc]
                cut = data[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, cut, len(data) // 4, task | number, offset, tier))
                offset += length
            number += 1
            waiting[tier].append(rows)
            if (len(waiting[tier]) + 1) * tier > step:
                group = task | (tiers.index(tier) << 30) | groups[tier]
                groups[tier] += 1
                out += [(*row, group) for sequence in waiting[tier] for row in sequence]
                size += 4 * tier * len(waiting[tier])
                waiting[tier] = []
            if size > 1 << 24:
                yield batch_of(out)
                out, size = [], 0
        if last:
            # The number within the tier, below 0, until the groups over all tasks are made.
            for sequences in waiting.values():
                out += [(*row, -1 - i) for i, sequence in enumerate(sequences) for row in sequence]
        if out:
            yield batch_of(out)
        needed = {doc for _, doc, _ in fragments}
        for doc in [d for d in docs if d not in needed]:
            del docs[doc]
        held = sum(f[0] for f in fragments)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = encode(text.as_py()) + end
            docs[seen] = (doc_id, data)
            fragments.append((len(data) // 4, seen, 0))
            seen += 1
            held += len(data) // 4
            if held >= window:
                yield from emit(False)
    yield from emit(True)


def _shared_groups(rest: DataFrame, tiers, step: int) -> DataFrame:
    """Number the step groups of what the tasks had left over, tier by tier, over all tasks.

    `rest` is stored, with step_group -1 - i at the i-th sequence of its task and tier.
    Only a count per task and tier goes through the window.
    """
    task = F.shiftright("sequence_id", 36)
    counts = rest.groupBy(task.alias("_task"), F.col("tier").alias("_tier"))
    counts = counts.agg((-F.min("step_group")).alias("_n"))
    ahead = Window.partitionBy("_tier").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_task", "_tier", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    place = F.col("_base") - 1 - F.col("step_group")
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step) / F.col("tier"))).cast("long")
    tier = F.array_position(F.array(*[F.lit(t).cast("long") for t in tiers]), F.col("tier")) - 1
    group = F.lit(SHARED_GROUPS) + F.shiftleft(tier, 48) + F.floor(place / per_step)
    joined = rest.join(bases, (task == F.col("_task")) & (F.col("tier") == F.col("_tier")))
    return joined.withColumn("step_group", group.cast("long")).select(*rest.columns)


def pack(
    docs: DataFrame,
    tokenizer: str,
    tiers: tuple[int, ...] = TIERS,
    window_tokens: int = WINDOW_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pieces of all documents' ids and their places in sequences.

    `tokenizer` is the path of a vocabulary file of `tokenizers`. One row per piece:
    doc_id, start (ids of its document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence (gapless from
    0), tier (the sequence's length; a short one is to be padded to it) and
    step_group: sequences of one tier, as many as `step_tokens` hold and at least one,
    so that every step of a tier has the same shape; only the last group of a tier in
    the whole table can have fewer. The pieces are written once to the shared folder;
    those in groups of one task stay where they lie.

    A null text counts as empty; every document ends with id 2, so it has a piece.
    Null or repeated doc_ids are packed as they come. Extra columns are ignored; an
    empty table gives no rows. Documents longer than a window are cut like others.
    """
    tiers = tuple(sorted(tiers))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = stored(
        rows.mapInArrow(
            lambda batches: _pack_task(batches, tokenizer, tiers, window_tokens, step_tokens), SCHEMA
        )
    )
    rest = _shared_groups(pieces.filter("step_group < 0"), tiers, step_tokens)
    return pieces.filter("step_group >= 0").unionByName(rest)
