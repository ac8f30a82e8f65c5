"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document's ids, with an end id, are cut into full windows and a remainder in a few pieces. These are pooled as they
come, a fixed number at a time, and a pool is divided into windows by multiway differencing: the two partial
partitions with the largest spread are merged, largest part with smallest, until one partition is left. A pool
starts with the least number of windows that could hold it; the number rises while any window exceeds the capacity.

It is one pass over the input without a shuffle: a pool is bounded, no row waits for another partition, and a lost
task is simply run again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.scratch import in_arrow
from haulgrid.llm.tokens import encoder

WINDOW = 2048
END_ID = 1
#: Remainders divided at once: enough for even windows, few enough to keep the differencing cheap.
POOL = 384
#: Most ids of a remainder's piece: with several pieces to a window, differencing brings the windows within a few ids.
PIECE = 512

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def differencing(sizes: list[int], parts: int) -> np.ndarray:
    """The part (0 to parts - 1) of each size, with nearly equal sums.

    A node holds its parts' sums in falling order. Merging two nodes adds the one's sums to the other's in reverse
    and sorts; the order is kept, so that one walk back from the root names each leaf's part.
    """
    n = len(sizes)
    if parts < 2 or n < 2:
        return np.zeros(n, np.int64)
    sums = {}
    for i, size in enumerate(sizes):
        sums[i] = np.zeros(parts, np.int64)
        sums[i][0] = size
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        node = n + len(merges)
        sums[node] = total[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(sums[node][0] - sums[node][-1]), node))
    names = {n + len(merges) - 1: np.arange(parts)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        own = np.empty(parts, np.int64)
        own[order] = names.pop(n + k)
        names[a], names[b] = own, own[::-1]
    return np.array([names[i][0] for i in range(n)])


def divide(sizes: list[int], capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """The window of each size and the number of windows, none of them over the capacity."""
    if not sizes:
        return np.zeros(0, np.int64), 0
    if max(sizes) > capacity:
        raise ValueError(f"a size of {max(sizes)} exceeds the capacity {capacity}")
    parts = -(-sum(sizes) // capacity)
    while True:
        at = differencing(sizes, parts)
        if np.bincount(at, weights=sizes, minlength=parts).max() <= capacity:
            return at, parts
        parts = min(len(sizes), parts + max(1, parts // 100))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, pool: int = POOL, piece: int = PIECE) -> DataFrame:
    """One row for each piece of a document: its place in the document and in a sequence, and its ids.

    ids are little-endian unsigned 32-bit. A null or empty text is a single end id. Repeated rows are packed each on
    its own, a null doc_id stays null, an empty table gives no rows; other columns are ignored. sequence_id joins
    the task's number and a count, so it is unique and the same when a task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4").tobytes()
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        count = 0
        out: list[list] = [[] for _ in range(8)]
        held = ended = 0
        waiting: list[tuple] = []

        def put(*row):
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def settle():
            nonlocal count, ended
            at, parts = divide([len(x[2]) // 4 for x in waiting], window)
            total, offset = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
            for x, w in zip(waiting, at, strict=True):
                total[w] += len(x[2]) // 4
            number = np.cumsum(total > 0) - 1
            for (doc_id, start, ids, tokens), w in zip(waiting, at, strict=True):
                put(doc_id, start, len(ids) // 4, ids, tokens, first + count + int(number[w]), int(offset[w]), int(total[w]))
                offset[w] += len(ids) // 4
            count += int((total > 0).sum())
            waiting.clear()
            ended = 0

        def flush():
            nonlocal held
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])
            for column in out:
                column.clear()
            held = 0
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                doc_id, tokens = doc_id.as_py(), len(ids) // 4
                whole = tokens // window * window
                for start in range(0, whole, window):
                    put(doc_id, start, window, ids[4 * start : 4 * (start + window)], tokens, first + count, 0, window)
                    count += 1
                for start in range(whole, tokens, piece):
                    waiting.append((doc_id, start, ids[4 * start : 4 * (start + piece)], tokens))
                held += len(ids)
                ended += whole < tokens
                if ended >= pool:
                    settle()
                if held > 1 << 23:
                    yield flush()
        settle()
        yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow, run, SCHEMA)


def packing_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return pack(docs, tokenizer_path).select(*columns)
