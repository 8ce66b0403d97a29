"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

A task streams its documents through bounded groups of pieces. A group's pieces start as one-piece partial partitions;
the two with the largest imbalance are merged, the heaviest windows of one onto the lightest of the other, until one
partition of near-equal windows is left. If its heaviest window exceeds the capacity the group is dealt out again with
one window more. Groups never cross tasks and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridloom.llm.common import doc_and_text, give_back, small_batches
from gridloom.llm.encoding import encoder

#: Bytes of text that are encoded at once: what a batch's words and ids take together is many times its text.
ENCODED = 1 << 20
#: Windows of a full group, and tokens a window leaves free for imbalance.
GROUP_WINDOWS = 64
SLACK = 16
#: The last tokens of a full group are cut this fine: differencing places them last, where they level the windows. Other
#: documents are cut only if they are longer than a window or lie on a group's edge.
FINE_TOKENS, FINE = 8192, 32


def difference(sizes: Sequence[int], windows: int) -> tuple[list[list[int]], int]:
    """Deals sizes to `windows` windows by multiway differencing; the indices in each window, and the heaviest sum."""
    if not len(sizes):
        return [[] for _ in range(windows)], 0
    ticket = count()
    left: list[int] = []
    right: list[int] = []
    heap = []
    for i, size in enumerate(sizes):
        sums, held = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], held[0] = size, i
        heap.append((-int(size) if windows > 1 else 0, next(ticket), sums, held))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        sums, back = a + b[::-1], held_b[::-1]
        held = np.where(held_a < 0, back, held_a)
        for at in np.nonzero((held_a >= 0) & (back >= 0))[0].tolist():
            left.append(int(held_a[at]))
            right.append(int(back[at]))
            held[at] = n + len(left) - 1
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), next(ticket), sums, held))
    out = []
    for top in heap[0][3].tolist():
        found, todo = [], [top] if top >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                found.append(x)
            else:
                todo += [right[x - n], left[x - n]]
        out.append(found)
    return out, max(sum(int(sizes[i]) for i in w) for w in out)


def pack(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`; their number starts at the least possible and rises while one is too heavy."""
    if len(sizes) and max(sizes) > capacity:
        raise ValueError("a piece is longer than a window")
    windows = max(1, -(-sum(map(int, sizes)) // capacity))
    while True:
        dealt, heaviest = difference(sizes, windows)
        if heaviest <= capacity:
            return [w for w in dealt if w]
        windows += 1


def cuts(length: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of near-equal pieces of at most `longest`; one empty piece for length 0."""
    parts = max(1, -(-length // longest))
    edges = [length * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _groups(pieces: Iterator[tuple], room: int) -> Iterator[list[tuple]]:
    """Groups of pieces that fill `room` exactly, cutting the piece that would overflow; the last is what is left."""
    group, used = [], 0
    for doc, start, ids, doc_tokens in pieces:
        while len(ids) and used + len(ids) >= room:
            take = room - used
            group.append((doc, start, ids[:take], doc_tokens))
            yield group
            group, used, start, ids = [], 0, start + take, ids[take:]
        if len(ids):
            group.append((doc, start, ids, doc_tokens))
            used += len(ids)
    if group:
        yield group


def _fine_end(group: list[tuple]) -> list[tuple]:
    """The group with its last FINE_TOKENS tokens in fine pieces."""
    out, seen = [], 0
    for doc, start, ids, doc_tokens in reversed(group):
        parts = cuts(len(ids), FINE) if seen < FINE_TOKENS else [(0, len(ids))]
        out += [(doc, start + a, ids[a : a + n], doc_tokens) for a, n in reversed(parts)]
        seen += len(ids)
    return out[::-1]


def parts_of(batch: pa.RecordBatch, most: int = ENCODED) -> Iterator[pa.RecordBatch]:
    """The batch (doc_id, text) in runs of rows of about `most` bytes of text at most, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.nonzero(np.diff(run))[0] + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def padding_of(length: int, capacity: int) -> int:
    """Padding a window costs: none when its length is a power of two, else up to the capacity."""
    return 0 if length & (length - 1) == 0 else capacity - length


def _tail(group: list[tuple], capacity: int) -> Iterator[list[tuple]]:
    """The last, part-filled group of a task: whole windows as far as they go, then powers of two, which need no padding."""
    total = sum(len(p[2]) for p in group)
    windows = total // capacity
    size = windows * capacity - SLACK * windows
    wanted = [size] if windows else []
    rest = total - sum(wanted)
    if rest >= capacity:
        wanted.append(capacity)
        rest -= capacity
    wanted += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    queue = list(reversed(group))
    for want in wanted:
        part, used = [], 0
        while used < want:
            doc, start, ids, doc_tokens = queue.pop()
            take = min(len(ids), want - used)
            part.append((doc, start, ids[:take], doc_tokens))
            if take < len(ids):
                queue.append((doc, start + take, ids[take:], doc_tokens))
            used += take
        yield part


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Packs every document's ids, `end_id` after each, into sequences of at most `capacity` tokens.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is its end
    id alone; equal texts and repeated doc_ids are packed each on its own; an empty table gives no rows. A task holds one
    group of pieces and one Arrow batch at a time. Sequence ids are unique, and those of a task start at its number times 2^33.
    """
    small_batches(documents.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        doc_type = pa.int64()
        context = TaskContext.get()
        sequence = count((context.partitionId() if context else 0) << 33)

        def pieces() -> Iterator[tuple]:
            nonlocal doc_type
            for batch in (part for whole in batches for part in parts_of(whole)):
                doc_type, at = batch.schema.field(0).type, 0
                ends, ids = encode.ended(batch.column(1), end_id)
                for doc, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                    for start, length in cuts(end - at, capacity):
                        yield doc, start, ids[at + start : at + start + length], end - at
                    at = end
                del batch, ends, ids
                give_back()

        def rows_of(group: list[tuple]) -> list[tuple]:
            rows = []
            for window in pack([len(p[2]) for p in group], capacity):
                number, offset = next(sequence), 0
                for doc, start, ids, doc_tokens in (group[i] for i in window):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, number, offset))
                    offset += len(ids)
            return rows

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        room = GROUP_WINDOWS * (capacity - SLACK)
        waiting: list[tuple] | None = None
        for group in _groups(pieces(), room):
            if waiting is not None:
                yield table(rows_of(_fine_end(waiting)))
            waiting = group
        if waiting is not None:
            rows: list[tuple] = []
            for part in _tail(waiting, capacity):
                rows += rows_of(_fine_end(part) if sum(len(p[2]) for p in part) > capacity else part)
            yield table(rows)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return doc_and_text(documents).mapInArrow(run, schema)
