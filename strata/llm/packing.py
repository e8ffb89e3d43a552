"""Best-fit packing planned on a histogram of lengths (operator 5)."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.bpe import encoded, encoder, vocabulary
from strata.session import Scratch

LENGTH = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, place long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _cut(batches: Iterator[pa.RecordBatch], name: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of whole texts; ``place`` counts this task's earlier pieces of the same length."""
    coder = encoder(vocabulary(name), spaces=False)
    chunk = TaskContext.get().partitionId()
    met = np.zeros(size + 1, np.int64)
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for first, tokens, bounds in encoded(batch.column("text").to_pylist(), coder, end):
            tokens = tokens.astype("<u4")
            counts = -(-np.diff(bounds) // size)
            row = np.repeat(np.arange(len(counts)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * size
            length = np.minimum(size, np.diff(bounds)[row] - start)
            at = bounds[row] + start
            order = np.argsort(length, kind="stable")
            kinds, firsts, amounts = np.unique(length[order], return_index=True, return_counts=True)
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.repeat(firsts, amounts) + np.repeat(met[kinds], amounts)
            met[kinds] += amounts
            sums = [zlib.crc32(tokens[a:b]) for a, b in zip(at, at + length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(first + row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(np.full(len(row), chunk), pa.int32()),
                    pa.array(place, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "place"],
            )


def plan(counts: dict[int, int], size: int = LENGTH) -> np.ndarray:
    """Best fit, longest first, over counts of lengths instead of documents.

    Sequences in the same state are one group: a range of numbers and the space
    used. The ``n`` pieces of a length go to the groups with the least room that
    takes them, as many to a sequence as fit. Rows of the result: length, first
    rank, number of ranks, pieces to a sequence, first sequence, offset. A length
    splits at most two groups and opens at most two, and a group that takes pieces
    keeps less than half its room, so a plan has at most about
    4 * size * log2(size) rows whatever the number of documents.
    """
    room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    runs: list[tuple[int, int, int, int, int, int]] = []
    fresh = 0
    for length in sorted(counts, reverse=True):
        left, rank = int(counts[length]), 0

        def fill(first: int, number: int, used: int, each: int) -> None:
            nonlocal left, rank
            runs.append((length, rank, number * each, each, first, used))
            room[size - used - each * length].append((first, number, used + each * length))
            rank += number * each
            left -= number * each

        for space in sorted(s for s in room if s >= length and room[s]):
            kept, each = [], space // length
            for first, number, used in room.pop(space):
                full = min(number, left // each)
                if full:
                    fill(first, full, used, each)
                    first, number = first + full, number - full
                if number and left:
                    fill(first, 1, used, left)
                    first, number = first + 1, number - 1
                if number:
                    kept.append((first, number, used))
            room[space] += kept
            if not left:
                break
        each = size // length
        if left // each:
            number = left // each
            fill(fresh, number, 0, each)
            fresh += number
        if left:
            fill(fresh, 1, 0, left)
            fresh += 1
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def _seat(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = (runs[:, 0] << 48) + runs[:, 1]
    for batch in batches:
        length = np.asarray(batch.column("length")).astype(np.int64)
        rank = np.asarray(batch.column("rank")).astype(np.int64)
        run = runs[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
        nth = rank - run[:, 1]
        columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        sequence, offset = run[:, 4] + nth // run[:, 3], run[:, 5] + nth % run[:, 3] * length
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_documents(
    docs: DataFrame, scratch: Scratch, name: str = "word_bpe_49k.json", end: int = 0, size: int = LENGTH
) -> DataFrame:
    """Pack token ids of whole texts into few sequences of at most ``size`` ids.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id and
    offset (gapless from 0 in each sequence). Only texts longer than ``size`` are cut.

    The driver sees counts of the ``size`` lengths alone. Ranks within a length are
    counted inside each task while encoding and shifted by the sum of the tasks
    before, so a length that a third of all pieces have is never gathered.

    Null and empty texts give the end id alone. Null, repeated and equal doc_ids are
    kept as they are. An empty table gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.table(rows.mapInArrow(lambda it: _cut(it, name, end, size), _PIECES), "pieces")
    counts = scratch.table(pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(histogram, size))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["chunk", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    return ranked.drop("chunk", "place", "before").mapInArrow(lambda it: _seat(it, runs.value), _PACKED)
