"""Hierarchical multi-length packing of tokenised documents.

Each document is tokenised and ends with an end id. Whole windows of the longest tier are cut off its front; what remains is routed to the
shortest tier (256, 512, 1024 or 2048) that holds it. Each tier is packed from its largest remainders down; the gap that a window has left
is filled from the largest pieces of shorter tiers that fit, and at last by cutting one. So windows of every tier are full; only the
last window of a task can be padded. Full windows of one tier form step groups of equal token count.

Tasks pack pools of bounded size in the order of their input and carry the open rest on, so memory is bounded by a pool and a task that is
run again after a loss gives the same pieces. No shuffle and no driver state: ids of sequences hold the task's number above bit 40.

Null and empty texts are one end id. Repeated rows are packed as often as they stand there; a null doc_id stays null. An empty table
gives no pieces. Columns beyond doc_id and text are ignored. Ties: of equally long remainders the one that came last is taken first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.tokens import encoder

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32_768
POOL_TOKENS = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs (doc_id, ids) into rows of SCHEMA; take() a document at a time, then rows(), at last finish()."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS):
        self.tiers, self.step_tokens, self.pool_tokens = tiers, step_tokens, pool_tokens
        self.base = task << 40
        self.next = 0
        self.steps = 0
        self.open_step: dict[int, tuple[int, int]] = {}
        self.out: list[list] = [[] for _ in range(9)]
        self.rest: list[tuple[int, int, int, bytes]] = []  # length, order, start, ids of the piece with doc
        self.docs: dict[int, tuple] = {}
        self.order = 0
        self.held = 0

    def emit(self, pieces: list[tuple], tier: int) -> None:
        """pieces: (doc_id, start, ids, doc_tokens) of one window."""
        left = self.open_step.get(tier, (0, 0))
        if left[1] <= 0:
            left = (self.steps, self.step_tokens)
            self.steps += 1
        self.open_step[tier] = (left[0], left[1] - tier)
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) >> 2
            for col, v in zip(self.out, (doc, start, n, zlib.crc32(ids), total, self.base + self.next, offset, tier, self.base + left[0]), strict=True):
                col.append(v)
            offset += n
        self.next += 1

    def take(self, doc: int | None, ids: bytes) -> None:
        total, top = len(ids) >> 2, self.tiers[-1]
        start = 0
        while total - start >= top:
            self.emit([(doc, start, ids[4 * start : 4 * (start + top)], total)], top)
            start += top
        if start < total:
            insort(self.rest, (total - start, self.order, start, ids[4 * start :]))
            self.docs[self.order] = (doc, total)
            self.order += 1
            self.held += total - start
        if self.held >= self.pool_tokens:
            self.pack(self.tiers[-1])

    def _fill(self, size: int) -> list[tuple]:
        """One full window of size from the largest pieces that fit, the last one cut; the caller knows that enough is held."""
        window, gap = [], size
        while gap:
            i = bisect_right(self.rest, (gap, 1 << 62)) - 1
            if i < 0:  # all that is left is longer than the gap: cut the shortest
                i = 0
            n, order, start, ids = self.rest.pop(i)
            doc, total = self.docs[order]
            use = min(n, gap)
            window.append((doc, start, ids[: 4 * use], total))
            if use < n:
                insort(self.rest, (n - use, order, start + use, ids[4 * use :]))
            else:
                del self.docs[order]
            gap -= use
        self.held -= size
        return window

    def pack(self, keep: int) -> None:
        """Windows of every tier, longest first, while more than keep tokens are held."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.held >= size + keep and self.rest and self.rest[-1][0] > below:
                self.emit(self._fill(size), size)

    def rows(self) -> pa.RecordBatch | None:
        if not self.out[0]:
            return None
        kinds = (*[pa.int64()] * 7, pa.int32(), pa.int64())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.out, kinds, strict=True)], names=names)
        self.out = [[] for _ in range(9)]
        return batch

    def finish(self) -> None:
        self.pack(0)
        for size in reversed(self.tiers):
            while self.held >= size:
                self.emit(self._fill(size), size)
        if self.held:
            self.emit(self._fill(self.held), self.tiers[-1])


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, words: bool = True) -> DataFrame:
    """One row per piece of docs(doc_id, text); see SCHEMA. A window that is not full belongs to the longest tier, which it is padded to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, enc, end = Packer(TaskContext.get().partitionId()), encoder(vocabulary, words), end_id.to_bytes(4, "little")
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.batch(b.column(1).to_pylist()), strict=True):
                packer.take(doc, ids + end)
            if (rows := packer.rows()) is not None:
                yield rows
        packer.finish()
        if (rows := packer.rows()) is not None:
            yield rows

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


