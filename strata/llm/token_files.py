"""Token files of fixed-width packed ids (operator 2).

A file holds blocks of 16,384 ids, each id in the fewest bits that the vocabulary
needs, and a footer: the documents' ids and ends, the byte offset of every block,
and a JSON line with the sizes. 64 ids of b bits fill exactly b 64-bit words, so
packing and unpacking are a few array operations for any b, and the id at place i
is found without reading what stands before its block.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.bpe import encoded, encoder, vocabulary
from strata.session import Scratch

BLOCK = 1 << 14
FILE_TOKENS = 1 << 24  # a task rolls to a new file beyond so many ids
READ_TOKENS = 1 << 20
MAGIC = b"STRATAB1"
_FILES = "file string, part int, seq int, n_docs long, n_tokens long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def width(vocabulary_size: int) -> int:
    """The fewest bits that hold every id below ``vocabulary_size``."""
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width bits of the ids, filled up with zeros to whole groups of 64."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(groups, 64)
    out = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of ``pack``'s bytes."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        lanes[:, j] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lanes[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    return (lanes & np.uint64((1 << bits) - 1)).ravel()[:count].astype(np.uint32)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path; the shared folder may lie in any that pyarrow reaches."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


class TokenWriter:
    """Writes one file; ``close`` returns (documents, ids)."""

    def __init__(self, path: str, bits: int):
        store, place = filesystem(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(place)
        self.bits, self.at, self.total = bits, 0, 0
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.blocks: list[int] = []
        self.rest = np.zeros(0, np.uint32)

    def _blocks(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        step = BLOCK // 64 * self.bits * 8  # bytes of a full block
        self.blocks += range(self.at, self.at + len(data), step)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id doesn't fit into {self.bits} bits")
        self.docs.append(doc_ids)
        self.nulls.append(nulls)
        self.ends.append(self.total + bounds[1:])
        self.total += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // BLOCK * BLOCK
        self._blocks(self.rest[:full])
        self.rest = self.rest[full:]

    def close(self) -> tuple[int, int]:
        self._blocks(self.rest)
        docs = np.concatenate([np.zeros(0, np.int64), *self.docs])
        for column in (docs, np.concatenate([np.zeros(0, np.int64), *self.ends]), np.array(self.blocks, np.int64)):
            self.out.write(column.astype("<i8").tobytes())
        self.out.write(np.concatenate([np.zeros(0, bool), *self.nulls]).astype(np.uint8).tobytes())
        head = json.dumps(
            {"bits": self.bits, "block": BLOCK, "docs": len(docs), "tokens": self.total, "blocks": len(self.blocks), "body": self.at}
        ).encode()
        self.out.write(head + len(head).to_bytes(4, "little") + MAGIC)
        self.out.close()
        return len(docs), self.total


class TokenReader:
    """Random access to one file: ``docs``, ``ends`` and ``ids(start, stop)``."""

    def __init__(self, path: str):
        store, place = filesystem(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        n = int.from_bytes(tail[:4], "little")
        self.head = json.loads(self.file.read_at(n, size - 12 - n))
        d, k, at = self.head["docs"], self.head["blocks"], self.head["body"]
        table = self.file.read_at(16 * d + 8 * k + d, at)
        numbers = np.frombuffer(table, "<i8", 2 * d + k)
        self.docs, self.ends, self.blocks = numbers[:d], numbers[d : 2 * d], numbers[2 * d :]
        self.nulls = np.frombuffer(table, np.uint8, d, 16 * d + 8 * k).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, reading only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        block, bits = self.head["block"], self.head["bits"]
        first, last = start // block, (stop - 1) // block
        limits = [*self.blocks, self.head["body"]]
        data = self.file.read_at(int(limits[last + 1] - limits[first]), int(limits[first]))
        return unpack(data, bits, stop - first * block)[start - first * block :]

    def close(self) -> None:
        self.file.close()


def _write(batches: Iterator[pa.RecordBatch], root: str, name: str, end: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(vocabulary(name), spaces=True)
    bits = width(max(coder.size, end + 1))
    part = TaskContext.get().partitionId()
    attempt, writer, path, done = uuid.uuid4().hex, None, "", []
    for batch in batches:
        ids = batch.column("doc_id")
        nulls = np.asarray(ids.is_null())
        numbers = np.asarray(ids.fill_null(0)).astype(np.int64)
        for first, tokens, bounds in encoded(batch.column("text").to_pylist(), coder, end):
            if writer is None:
                path = f"{root}/part-{part:06d}-{len(done):04d}-{attempt}.tok"
                writer = TokenWriter(path, bits)
            rows = slice(first, first + len(bounds) - 1)
            writer.add(numbers[rows], nulls[rows], tokens, bounds)
            if writer.total >= FILE_TOKENS:
                done.append((path, part, len(done), *writer.close()))
                writer = None
    if writer is not None:
        done.append((path, part, len(done), *writer.close()))
    columns = list(zip(*done, strict=True)) or [[]] * 5
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    names = ["file", "part", "seq", "n_docs", "n_tokens"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
            reader = TokenReader(path)
            ends = reader.ends
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            first = 0
            while first < len(ends):
                last = max(first + 1, int(np.searchsorted(ends, starts[first] + READ_TOKENS, side="right")))
                ids = reader.ids(int(starts[first]), int(ends[last - 1])).astype("<u4")
                cuts = zip(starts[first:last] - starts[first], ends[first:last] - starts[first], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.docs[first:last], pa.int64(), mask=reader.nulls[first:last]),
                        pa.array(starts[first:last] + before, pa.int64()),
                        pa.array(ends[first:last] - starts[first:last], pa.int64()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in cuts], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                first = last
            reader.close()


def write_tokens(
    docs: DataFrame, scratch: Scratch, name: str = "byte_bpe_50k.json", end: int = 2, root: str | None = None
) -> DataFrame:
    """Encode whole texts and write token files in ascending order of doc_id.

    Returns the written list of files: file, part, seq, n_docs, n_tokens and
    ``before`` (ids in all files before it). Files that a lost or repeated task
    left behind are in no list and are never read.

    Null and empty text give the end id alone. Null doc_ids come first; rows with
    equal doc_id stand together, in order of a hash of their text, all kept.
    An empty table gives no file. Other columns are not read.
    """
    root = root or scratch.path("tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    files = scratch.table(ordered.mapInArrow(lambda it: _write(it, root, name, end), _FILES), "files")
    # one row for each file: a short list
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document of the listed files: doc_id, start, n_tokens, ids_crc32."""
    tasks = max(1, min(files.count(), 20_000))
    return files.select("file", "before").repartition(tasks).mapInArrow(_read, _ROWS)
