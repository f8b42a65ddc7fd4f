"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at the capacity; full pieces are windows of their own.
The rest is packed block by block.  In a block of n pieces and k windows, every
piece starts as a partial partition into k windows, all but one empty.  The two
partitions with the largest imbalance are merged again and again, the fullest
windows of one with the emptiest of the other, so that imbalances cancel; what
is left is one partition into near-equal windows.  k starts at the least that
could hold the block.  Whenever a window exceeds the capacity, k rises and the
block is packed anew.

Blocks hold at most ``block_windows`` windows' worth of ids and come from one
partition, in its order; so a task's memory is bounded by a block, there is no
shuffle, and a task that is run again after a loss gives the same rows.

Edge cases: a null or empty text has only the end id.  Null ids of documents
pass through.  Rows may repeat; each is packed.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import tokens

CAPACITY = 2048
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_SIZE = itemgetter(0)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Items in k windows by differencing: lists of indexes into ``sizes``.

    A partition is held as its windows above the least, (sum less the least,
    items), ascending; windows at the least follow as a count with items, or
    none.  Ties go by order of entry, so the result is a function of sizes."""
    if k == 1:
        return [list(range(len(sizes)))]
    # Each window is (size, tree of items); trees are joined in constant time.
    heap = [(-s, i, [(s, i)], None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, low_a = heapq.heappop(heap)
        _, _, b, low_b = heapq.heappop(heap)
        # a and b: windows above the least, descending.  low: trees of windows
        # that sit at the least but are not empty.
        la, lb = len(a), len(b)
        rest_a, rest_b = low_a or [], low_b or []
        if la + lb + len(rest_a) + len(rest_b) < k:
            # All fit beside each other, with an empty window left.
            merged, low = sorted(a + b, key=_SIZE, reverse=True), rest_a + rest_b
        else:
            full_a = a + [(0, t) for t in rest_a] + [(0, None)] * (k - la - len(rest_a))
            full_b = b + [(0, t) for t in rest_b] + [(0, None)] * (k - lb - len(rest_b))
            both = [(x + y, t if u is None else u if t is None else (t, u)) for (x, t), (y, u) in zip(full_a, reversed(full_b))]
            both.sort(key=_SIZE, reverse=True)
            least = both[-1][0]
            merged = [(s - least, t) for s, t in both if s > least]
            low = [t for s, t in both if s == least and t is not None]
        n += 1
        heapq.heappush(heap, (-(merged[0][0] if merged else 0), n, merged, low))
    _, _, windows, low = heap[0] if heap else (0, 0, [], [])
    return [_items(t) for t in [t for _, t in windows] + (low or [])]


def _items(tree: object) -> list[int]:
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo += t
        elif t is not None:
            out.append(t)
    return sorted(out)


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of item indexes, none over the capacity."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        windows = difference(sizes, k)
        over = max((sum(sizes[i] for i in w) for w in windows), default=0)
        if over <= capacity:
            return [w for w in windows if w]
        k += max(1, k // 512)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, most: int) -> Iterator[list[tuple[int | None, bytes]]]:
    tokenizer, end = tokens.tokenizer(path), np.array([end_id], "<u4").tobytes()
    block, held = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = tokenizer.ids(text.as_py()) + end
            block.append((doc, ids))
            held += len(ids) // 4
            if held >= most:
                yield block
                block, held = [], 0
    if block:
        yield block


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, block_windows: int = 512, id_col: str = "doc_id", text: str = "text", longest_piece: int = 1024, grain: int = 32, fine: float = 0.04) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, doc_tokens,
    sequence_id, offset, and ids (little-endian unsigned 32-bit).

    What is left of a document after full windows is cut evenly into pieces of
    at most ``longest_piece``.  The first documents of a block that hold the
    share ``fine`` of its ids are cut into pieces of ``grain`` instead: small
    pieces, merged last, level the windows, and few documents pay for it."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for block in _blocks(batches, path, end_id, capacity * block_windows):
            pieces = []  # document, start, length
            full = []
            held, level = sum(len(ids) // 4 % capacity for _, ids in block), 0
            for d, (_, ids) in enumerate(block):
                n = len(ids) // 4
                whole = n - n % capacity
                full += [(d, s, capacity) for s in range(0, whole, capacity)]
                small = level < fine * held and n - whole >= 8 * grain
                level += (n - whole) * small
                parts = -(-(n - whole) // (grain if small else longest_piece))
                at = [whole + (n - whole) * i // max(parts, 1) for i in range(parts + 1)]
                pieces += [(d, x, y - x) for x, y in zip(at, at[1:])]
            windows = [[p] for p in full] + [[pieces[i] for i in w] for w in pack([p[2] for p in pieces], capacity)]
            rows = []
            for w in windows:
                offset = 0
                for d, s, n in w:
                    doc, ids = block[d]
                    rows.append((doc, s, n, len(ids) // 4, number, offset, ids[4 * s : 4 * (s + n)]))
                    offset += n
                number += 1
            for part in tokens.chunks(rows, [r[2] for r in rows], 1 << 20):
                columns = list(zip(*part))
                types = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
