"""1, Packing: sum-of-squares online packing of token sequences into fixed windows.

Every task packs the documents of its own partition, so nothing is shuffled and no group of rows (a hot
source, copies) matters. Whole windows are cut off a document first; the rest, of s < capacity ids, goes to
the fill level h that minimises the sum over levels of n[h]^2, n[h] being the number of partially filled
windows at level h, kept in one level array. Placing s at level h changes the sum by
(n[h+s]+1)^2 - n[h+s]^2 + (n[h]-1)^2 - n[h]^2, without the first pair where h+s is the capacity (that window
is closed) and without the second for h = 0 (a new window). Ties go to the fullest level.

What is open at the end, or when more than max_open windows are open (the memory bound), is topped up: the
pieces of the emptiest windows are cut to fill the fullest. At most one window of a partition is then left;
it is cut at powers of two, at which a sequence needs no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gravelock.llm.common import batches, doc_text
from gravelock.llm.tokens import word_tokens

CAPACITY = 4096
END_ID = 2
MAX_OPEN = 2048
#: Sequence ids: the partition's number above, the number within the partition below.
LOCAL_BITS = 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

#: A piece: the document's row number, its first id's place in the document, its ids.
Piece = tuple[int, int, memoryview]


class SumOfSquares:
    """Packs pieces as they come; `closed` yields (pieces of one sequence)."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.level = np.zeros(capacity + 1, np.int64)  # the level array
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.n_open = 0

    def choose(self, s: int) -> int:
        """The level to put s ids on."""
        room = self.capacity - s
        cost = 2 * (self.level[s : self.capacity + 1] - self.level[: room + 1]) + 2
        cost[0] = 2 * self.level[s] + 1
        cost[room] = 1 - 2 * self.level[room] if room else 0
        usable = self.level[: room + 1] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return int(room - np.argmin(cost[::-1]))

    def add(self, doc: int, ids: memoryview) -> Iterator[list[Piece]]:
        n, at = len(ids) // 4, 0
        while n - at >= self.capacity:
            yield [(doc, at, ids[4 * at : 4 * (at + self.capacity)])]
            at += self.capacity
        s = n - at
        if not s:
            return
        h = self.choose(s)
        window = self.open[h].pop() if h else []
        if h:
            self.level[h] -= 1
            self.n_open -= 1
        window.append((doc, at, memoryview(bytes(ids[4 * at :])) if at else ids))  # a copy: a view would keep the whole document
        if h + s == self.capacity:
            yield window
        else:
            self.open[h + s].append(window)
            self.level[h + s] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                yield from self.top_up()

    def top_up(self, last: bool = False) -> Iterator[list[Piece]]:
        """Cuts the emptiest windows into the fullest; the one left stays open, or is cut at powers of two."""
        order = [(h, w) for h in range(self.capacity) for w in self.open[h]]
        lo, hi, spare = 0, len(order) - 1, []
        while lo <= hi:
            h, window = order[hi]
            hi -= 1
            while h < self.capacity and (spare or lo <= hi):
                if not spare:
                    spare = order[lo][1][::-1]
                    lo += 1
                doc, at, ids = spare.pop()
                k = min(self.capacity - h, len(ids) // 4)
                window.append((doc, at, ids[: 4 * k]))
                h += k
                if 4 * k < len(ids):
                    spare.append((doc, at + k, ids[4 * k :]))
            if h == self.capacity:
                yield window
            else:
                spare, lo = window[::-1], hi + 1
        self.level[:] = 0
        self.open = [[] for _ in range(self.capacity)]
        self.n_open = 0
        rest = spare[::-1]
        total = sum(len(p[2]) // 4 for p in rest)
        while total >= self.capacity:
            first, rest = cut(rest, self.capacity)
            total -= self.capacity
            yield first
        if last:
            while total:
                k = 1 << (total.bit_length() - 1)
                first, rest = cut(rest, k)
                total -= k
                yield first
        elif total:
            self.open[total].append(rest)
            self.level[total] += 1
            self.n_open = 1


def cut(pieces: list[Piece], k: int) -> tuple[list[Piece], list[Piece]]:
    """The first k ids, and the rest."""
    first, i = [], 0
    while k:
        doc, at, ids = pieces[i]
        n = len(ids) // 4
        if n > k:
            return [*first, (doc, at, ids[: 4 * k])], [(doc, at + k, ids[4 * k :]), *pieces[i + 1 :]]
        first.append(pieces[i])
        k -= n
        i += 1
    return first, pieces[i:]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """One row for each piece of a document (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone; a null doc_id stays null; repeated rows are
    packed once each, as documents of their own; equal levels go to the fullest; a very long text is cut into whole
    windows at once; an empty table gives no pieces; other columns are ignored. Memory: the ids of at most
    max_open open windows (64 MB; on 6,410 documents of the check tables 329 were open at most), one batch of rows
    and one document's ids. The order of a partition's rows decides the
    packing, so read docs from files (as Spark's file scan does) for reruns after a lost executor to agree.
    """
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer = word_tokens(path), SumOfSquares(capacity, max_open)
        known: dict[int, tuple[int | None, int]] = {}
        base, n_seq = TaskContext.get().partitionId() << LOCAL_BITS, 0
        out: list[list] = [[] for _ in NAMES]

        def put(sequences: Iterator[list[Piece]]) -> None:
            nonlocal n_seq
            for pieces in sequences:
                offset = 0
                for doc, at, ids in pieces:
                    n = len(ids) // 4
                    for column, x in zip(out, (known[doc][0], at, n, zlib.crc32(ids), known[doc][1], base + n_seq, offset), strict=True):
                        column.append(x)
                    offset += n
                n_seq += 1

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], NAMES)
            for c in out:
                c.clear()
            return done

        row = 0
        for _, doc_ids, texts in batches(found):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = memoryview(table.ids(text) + end)
                known[row] = (doc_id, len(ids) // 4)
                put(packer.add(row, ids))
                row += 1
            if packer.n_open < len(known) // 2 and len(known) > 10_000:  # forget the documents that have no piece in an open window
                kept = {p[0] for level in packer.open for w in level for p in w}
                known = {k: known[k] for k in kept}
            if len(out[0]) > 10_000:
                yield flush()
        put(packer.top_up(last=True))
        yield flush()

    return doc_text(docs).mapInArrow(run, SCHEMA)
