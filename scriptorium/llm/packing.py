"""Packing documents into sequences of fixed length by Karmarkar-Karp differencing.

Each task takes its documents in their order, cuts what fills a whole sequence alone, and gathers the rest until some
hundreds of sequences' worth is held.  The held pieces are divided into k windows by multiway differencing: partial
partitions, the one with the widest gap between its fullest and emptiest window first, are merged two at a time, the
fullest windows of one onto the emptiest of the other.  k starts at the least that can hold all and rises by one while
a window exceeds the capacity.  What that leaves of room is then taken up: the emptiest windows, as many as the room of
the others holds, are dissolved into it, pieces being cut where needed, and a rest of less than one sequence waits for
the next documents.  No shuffle is needed: any document may share a window with any other of its task.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, prepare
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The indices of sizes dealt into k windows of near-equal sums (some may be empty)."""
    if not sizes:
        return [[] for _ in range(k)]
    # A partial partition lists its windows, fullest first, without empty ones: (sum, serial, tree of indices).
    heap = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            keep = len(a) - over
            merged = a[:keep] + b[: len(b) - over]
            for x, y in zip(a[keep:], reversed(b[len(b) - over :]), strict=True):
                serial += 1
                merged.append((x[0] + y[0], serial, (x[2], y[2])))
        merged.sort(reverse=True)
        serial += 1
        gap = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heapreplace(heap, (-gap, serial, merged))
    out = []
    for _, _, tree in heap[0][2]:
        stack, window = [tree], []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                window.append(x)
        out.append(sorted(window))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most capacity; the count starts at the least possible and rises while one is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return [w for w in out if w]
        k += 1


def topped_up(parts: list[tuple], dealt: list[list[int]], capacity: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Full sequences made of the fullest of the dealt windows and the pieces of the others; and the pieces left over,
    of less than capacity together.  A part is (doc_id, start, data, ids of its document), 4 bytes an id."""
    size = [sum(len(parts[i][2]) for i in w) // 4 for w in dealt]
    order = sorted(range(len(dealt)), key=lambda i: (-size[i], i))
    full = sum(size) // capacity
    loose = [parts[i] for w in order[full:] for i in dealt[w]][::-1]
    out = []
    for w in order[:full]:
        sequence, room = [parts[i] for i in dealt[w]], capacity - size[w]
        while room:
            doc, start, data, whole = loose.pop()
            if len(data) > 4 * room:
                loose.append((doc, start + room, data[4 * room :], whole))
                data = data[: 4 * room]
            sequence.append((doc, start, data, whole))
            room -= len(data) // 4
        out.append(sequence)
    return out, loose[::-1]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, piece: int | None = None, held_windows: int = 256) -> DataFrame:
    """Pack docs (doc_id long, text string); a row for each piece, columns as in SCHEMA.

    piece: the longest piece of what does not fill a sequence alone (a quarter of capacity where not given).
    held_windows: the sequences' worth of ids gathered before they are dealt.  A sequence is padded to capacity, except
    where its length is a power of two (padded_to).  Null or empty texts are the end id alone; every row is packed,
    equal ids too; other columns are ignored; an empty table gives no rows.  sequence_id counts in each task from a multiple of
    2^33, so ids never meet.
    """
    prepare(docs.sparkSession)
    piece = piece or max(1, capacity // 4)
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        use, end = encoder(vocabulary), int(end_id).to_bytes(4, "little")
        serial = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        total = 0

        def sequence(parts: list[tuple]) -> Iterator[dict]:
            nonlocal serial
            n = sum(len(p[2]) for p in parts) // 4
            at = 0
            for doc, start, data, whole in parts:
                yield {"doc_id": doc, "start": start, "length": len(data) // 4, "ids_crc32": zlib.crc32(data), "doc_tokens": whole, "sequence_id": serial, "offset": at, "sequence_tokens": n, "padded_to": n if n & (n - 1) == 0 else capacity}
                at += len(data) // 4
            serial += 1

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = use.encode(text.as_py()) + end
                n, at = len(data) // 4, 0
                while at < n:
                    length = capacity if n - at >= capacity else min(piece, n - at)
                    part = (doc, at, data[4 * at : 4 * (at + length)], n)
                    if length == capacity:
                        yield from sequence([part])
                    else:
                        held.append(part)
                        total += length
                    at += length
                if total >= held_windows * capacity:
                    full, held = topped_up(held, windows([len(p[2]) // 4 for p in held], capacity), capacity)
                    total = sum(len(p[2]) for p in held) // 4
                    for parts in full:
                        yield from sequence(parts)
        full, held = topped_up(held, windows([len(p[2]) // 4 for p in held], capacity), capacity)
        for parts in [*full, *([held] if held else [])]:
            yield from sequence(parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lambda batches: batches_of(rows(batches), schema), SCHEMA)
