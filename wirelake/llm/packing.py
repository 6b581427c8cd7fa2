"""Hierarchical multi-length packing of tokenised documents.

A document becomes the ids of its text and an end id. Whole long windows are cut off its front; what is
left goes to the smallest context-size tier that holds it. Each tier packs its pieces best fit first; a
window's gap is filled from shorter tiers, the last piece cut to measure, so no window of a tier is
padded. What a task has left at its end becomes windows of powers of two.

Every window gets a step group: a tier's windows of all tasks stand in one row, the longest first, and the row is cut
by tokens. As the lengths are powers of two, no window lies across a cut; so every group of a tier holds the
same number of tokens but for the tier's last one.

Each task packs what it reads, holding at most ``PENDING`` pieces of each tier. The pieces are written; of them,
only the number of windows of each task, tier and length is shuffled to find where each task's windows begin.

Defined cases: a null text is the empty one and yields the end id alone; equal rows are packed each for
itself; an empty table yields no pieces; further columns are ignored. doc_id may be null.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import batch_of, bounded_batches, few, text_of, written

#: Context sizes of the tiers, longest first; all are powers of two.
TIERS = (1024, 512, 256, 128)
END_ID = 0
#: Pieces that a tier holds before it packs.
PENDING = 512
#: Tokens of one tier's windows in one step group.
STEP_TOKENS = 16 * 1024

#: The bits of a sequence id below its task's number.
TASK_BITS = 40

#: window: the tokens of the piece's window; nth: the number of the window among the task's of this tier and length.
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, window long, nth long"
_ARROW = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "window", "nth")])
_COLUMNS = (*_ARROW.names[:-2], "step_group")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE encoder from a rank file; it gives the same ids as the tokenizer file of that vocabulary.

    The rank file is read by the faster of the two libraries; tests hold it against the other one.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(path: str, text: str) -> np.ndarray:
    """uint32 ids of the text; the end-of-text string in a text is one id, as the tokenizer file has it."""
    text = text.encode("utf-8", "replace").decode("utf-8")
    return np.asarray(encoder(path).encode(text, allowed_special="all"), np.uint32)


class Packer:
    """Packs the documents of one task; pieces() hands over what is placed so far."""

    def __init__(self, first_id: int, tiers: tuple[int, ...] = TIERS, pending: int = PENDING):
        self.tiers, self.pending, self.next_id = tiers, pending, first_id
        self.waiting: list[list[tuple]] = [[] for _ in tiers]  # (length, order, doc, start, total, ids), by length
        self.tokens = [0] * len(tiers)  # that wait in each tier
        self.made: Counter[tuple[int, int]] = Counter()  # windows, by tier and length
        self.order = 0
        self.out: dict[str, list] = {n: [] for n in _ARROW.names}

    def add(self, doc, ids: np.ndarray) -> None:
        long, total = self.tiers[0], len(ids)
        whole = total - total % long
        for start in range(0, whole, long):
            self._place([(long, 0, doc, start, total, ids[start : start + long])], 0)
        if total > whole:
            self._wait(doc, whole, total, ids[whole:])

    def _wait(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        """Queue a piece in the smallest tier that holds it; a tier with many pieces packs half of them."""
        tier = self._queue(doc, start, total, ids)
        if len(self.waiting[tier]) >= self.pending:
            self._pack(tier, self.pending // 2)

    def _queue(self, doc, start: int, total: int, ids: np.ndarray) -> int:
        tier = max(i for i, size in enumerate(self.tiers) if size >= len(ids))
        self.order += 1
        bisect.insort(self.waiting[tier], (len(ids), self.order, doc, start, total, ids))
        self.tokens[tier] += len(ids)
        return tier

    def _take(self, tier: int, gap: int) -> tuple | None:
        """The longest waiting piece of this tier or a shorter one that fits the gap; else None."""
        for i in range(tier, len(self.tiers)):
            k = bisect.bisect_right(self.waiting[i], gap, key=lambda x: x[0])
            if k:
                piece = self.waiting[i].pop(k - 1)
                self.tokens[i] -= piece[0]
                return piece
        return None

    def _pack(self, tier: int, leave: int) -> None:
        """Make full windows of a tier until at most so many of its pieces wait or they don't fill a window."""
        size = self.tiers[tier]
        while len(self.waiting[tier]) > leave and sum(self.tokens[tier:]) >= size:
            window, gap = [], size
            while gap:
                piece = self._take(tier, gap)
                if piece is None:  # nothing fits whole: cut the shortest that waits
                    shortest = min((w[0] for w in self.waiting[tier:] if w), key=lambda x: x[:2])
                    i = next(i for i in range(tier, len(self.tiers)) if self.waiting[i] and self.waiting[i][0] is shortest)
                    self.waiting[i].pop(0)
                    self.tokens[i] -= shortest[0]
                    length, _, doc, start, total, ids = shortest
                    window.append((gap, 0, doc, start, total, ids[:gap]))
                    self._queue(doc, start + gap, total, ids[gap:])
                    gap = 0
                else:
                    window.append(piece)
                    gap -= piece[0]
            self._place(window, tier)

    def _place(self, window: list[tuple], tier: int) -> None:
        offset, size = 0, sum(x[0] for x in window)
        for length, _, doc, start, total, ids in window:
            for name, value in zip(_ARROW.names, (doc, start, length, zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset, self.tiers[tier], size, self.made[tier, size]), strict=True):
                self.out[name].append(value)
            offset += length
        self.next_id += 1
        self.made[tier, size] += 1

    def finish(self) -> None:
        """Full windows tier by tier, then the rest in windows of ever smaller powers of two."""
        for tier in range(len(self.tiers)):
            self._pack(tier, 0)
        rest = [x for w in self.waiting for x in reversed(w)]
        self.waiting, self.tokens = [[] for _ in self.tiers], [0] * len(self.tiers)
        left = sum(x[0] for x in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            tier = max((i for i, t in enumerate(self.tiers) if t >= size), default=0)
            size, window, gap = min(size, self.tiers[0]), [], min(size, self.tiers[0])
            while gap:
                length, order, doc, start, total, ids = rest.pop(0)
                cut = min(length, gap)
                window.append((cut, 0, doc, start, total, ids[:cut]))
                if cut < length:
                    rest.insert(0, (length - cut, order, doc, start + cut, total, ids[cut:]))
                gap -= cut
            self._place(window, tier)
            left -= size

    def pieces(self) -> pa.RecordBatch:
        out, self.out = self.out, {n: [] for n in _ARROW.names}
        return batch_of(_ARROW, out)


def pack(documents: DataFrame, vocabulary: str, tiers: tuple[int, ...] = TIERS, pending: int = PENDING) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence.

    vocabulary: path of a rank file, readable on every executor. A sequence is named by its task's
    partition and a number, so a task that is run again gives the same rows.
    """
    bounded_batches(documents.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << TASK_BITS, tiers, pending)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.append(token_ids(vocabulary, text.as_py()), np.uint32(END_ID)))
            yield packer.pieces()
        packer.finish()
        yield packer.pieces()

    pieces = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_of(documents["text"]).alias("text")).mapInArrow(task, PIECES)
    return with_step_groups(written(pieces, "pieces"))


def with_step_groups(pieces: DataFrame) -> DataFrame:
    """The written pieces with step_group: a tier's windows of all tasks, the longest first, cut at equal numbers of tokens."""
    pieces = pieces.withColumn("task", F.shiftright("sequence_id", TASK_BITS))
    made = pieces.groupBy("tier", "window", "task").agg((F.max("nth") + 1).alias("made"))
    earlier = Window.partitionBy("tier").orderBy(F.desc("window"), "task").rowsBetween(Window.unboundedPreceding, -1)
    before = made.select("tier", "window", "task", F.coalesce(F.sum(F.col("made") * F.col("window")).over(earlier), F.lit(0)).alias("before"))
    group = F.expr(f"(before + nth * window) div (tier * greatest(1, {STEP_TOKENS} div tier))")
    return pieces.join(few(before, "windows"), ["tier", "window", "task"]).withColumn("step_group", group).select(*_COLUMNS)
