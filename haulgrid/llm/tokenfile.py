"""Token ids in Arrow files of equal-length sequences.

The ids of all documents, in ascending doc_id order, are one stream, cut into rows of a fixed length. A file is in
the Arrow IPC file format; each batch has a fixed-size list of ids and one of mask bits (true: an id, false: padding
after the last id of a file). As rows are of equal length and batches of equal size, the place of any id follows
from its number, and a memory-mapped file is read there without a copy. Beside each file lies a second one with
the documents' borders.

Documents are dealt to files by ranges of doc_id and sorted within; a task writes under a name of its own and renames
at the end, so a task that is run again replaces the same file with the same bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.scratch import in_arrow, shared_root
from haulgrid.llm.tokens import encoder

LENGTH = 2048
BATCH_ROWS = 256
END_ID = 2
#: Bytes of text (as UTF-8) for each file, about, and most files: beyond, files grow (at 100 TB to 2 GB), which are
#: written and read a batch at a time. The driver keeps a row for each file.
FILE_BYTES, FILES = 24 << 20, 50_000
#: Code points of a text that ranges are cut by, beside its doc_id: so that equal doc_ids may lie in several files.
HEAD = 64


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.removeprefix("file:"))


class TokenWriter:
    """Writes a stream of ids as rows of ``length``; ``close`` pads the last row."""

    def __init__(self, sink, length: int = LENGTH, rows: int = BATCH_ROWS, dtype: str = "<u2"):
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        kind = pa.uint16() if self.dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.kind, self.out = kind, pa.ipc.new_file(sink, self.schema)
        self.parts: list[bytes] = []
        self.held = self.total = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        if self.held >= self.length * self.rows:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.dtype)
        block = self.length * self.rows
        upto = len(ids) if last else len(ids) // block * block
        for at in range(0, upto, block):
            part = ids[at : min(at + block, upto)]
            rows = -(-len(part) // self.length)
            full = np.zeros(rows * self.length, self.dtype)
            full[: len(part)] = part
            mask = pa.array(np.arange(len(full)) < len(part))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(full, self.kind), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.parts = [ids[upto:].tobytes()]
        self.held = len(ids) - upto

    def close(self) -> None:
        self._write(True)
        self.out.close()


class TokenFile:
    """Random access to a file of TokenWriter; batches are read when asked for, without a copy where mapped."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.batch, self.at = None, -1

    def _values(self, k: int) -> np.ndarray:
        if self.at != k:
            self.batch, self.at = self.file.get_batch(k), k
        return self.batch.column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of one row."""
        k, at = divmod(row, self.rows)
        ids = self._values(k)[at * self.length : (at + 1) * self.length]
        return ids, self.batch.column(1).slice(at, 1).flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids of the stream from ``start`` on."""
        block, out = self.rows * self.length, []
        while count > 0:
            k, at = divmod(start, block)
            part = self._values(k)[at : at + count]
            out.append(part)
            start, count = start + len(part), count - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write(docs: DataFrame, tokenizer_path: str, root: str | None = None, files: int | None = None, end_id: int = END_ID) -> tuple[str, list[dict]]:
    """Writes all texts below ``root`` and returns (folder, one entry for each file in stream order).

    The entries are as many as the files: the driver keeps nothing for each document.
    """
    spark = docs.sparkSession
    folder = f"{root or shared_root(spark)}/haulgrid-tokens-{uuid.uuid4().hex[:12]}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if files is None:
        size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, min(FILES, -(-size // FILE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files_in, path = _open(folder)
        files_in.create_dir(path, recursive=True)
        name, mark = f"{path}/part-{part:06d}", uuid.uuid4().hex[:8]
        encode = encoder(tokenizer_path, "<u2").encode
        end = np.array([end_id], "<u2").tobytes()
        ids_at: list[int | None] = []
        counts: list[int] = []
        borders = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        with files_in.open_output_stream(f"{name}.{mark}.tmp") as sink, files_in.open_output_stream(f"{name}.docs.{mark}.tmp") as index:
            writer, table = TokenWriter(sink), pa.ipc.new_file(index, borders)
            n = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = encode(text.as_py()) + end
                    writer.add(ids)
                    ids_at.append(doc_id.as_py())
                    counts.append(len(ids) // 2)
                    n += 1
                table.write_batch(pa.RecordBatch.from_arrays([pa.array(ids_at, pa.int64()), pa.array(counts, pa.int64())], schema=borders))
                ids_at, counts = [], []
            writer.close()
            table.close()
        files_in.move(f"{name}.docs.{mark}.tmp", f"{name}.docs.arrow")
        files_in.move(f"{name}.{mark}.tmp", f"{name}.arrow")
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([writer.total], pa.int64())], ["part", "n_docs", "n_tokens"])

    head = F.substring("text", 1, HEAD).asc_nulls_first()
    dealt = docs.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), head).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = sorted(dealt.transform(in_arrow, run, "part int, n_docs long, n_tokens long").collect())
    entries, start = [], 0
    for part, n_docs, n_tokens in done:
        entries.append({"part": part, "start": start, "n_docs": n_docs, "n_tokens": n_tokens})
        start += n_tokens
    return folder, entries


def read(spark, folder: str, entries: list[dict]) -> DataFrame:
    """doc_id, start in the whole stream, n_tokens and ids (little-endian unsigned 32-bit) of each document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    listed = spark.createDataFrame([(e["part"], e["start"]) for e in entries], "part int, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        files_in, path = _open(folder)
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{path}/part-{part:06d}"
                local = isinstance(files_in, pafs.LocalFileSystem)
                source = pa.memory_map(f"{name}.arrow") if local else files_in.open_input_file(f"{name}.arrow")
                with source, files_in.open_input_file(f"{name}.docs.arrow") as index:
                    tokens, table = TokenFile(source), pa.ipc.open_file(index)
                    at = 0
                    for k in range(table.num_record_batches):
                        docs = table.get_batch(k)
                        counts = docs.column(1).to_numpy()
                        for lo in range(0, len(counts), 512):
                            some = counts[lo : lo + 512]
                            begins = at + np.concatenate([[0], np.cumsum(some)[:-1]]) if len(some) else some
                            ids = [tokens.ids(int(b), int(c)).astype("<u4").tobytes() for b, c in zip(begins, some, strict=True)]
                            at += int(some.sum())
                            yield pa.RecordBatch.from_arrays([docs.column(0).slice(lo, len(some)), pa.array(base + begins, pa.int64()), pa.array(some, pa.int64()), pa.array(ids, pa.binary())], names)

    return listed.repartition(max(1, len(entries)), "part").transform(in_arrow, run, schema)


def token_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes all documents, reads the files back and gives each document's place and checksum.

    A null or empty text is a single end id; a null doc_id comes first; rows with the same doc_id are ordered by text;
    an empty table gives no rows.
    """
    folder, entries = write(docs, tokenizer_path)
    return read(docs.sparkSession, folder, entries).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
