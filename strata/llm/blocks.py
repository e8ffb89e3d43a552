"""Pairs within buckets of any size: a bucket is cut into chunks, compared chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(entries: DataFrame, place: list[str], item: str, sizes: DataFrame, chunk: int) -> DataFrame:
    """Rows of each pair of chunks together and in order: adds mine, low and high.

    ``sizes`` (place, n) lists the buckets to compare. A row goes to as many blocks
    as its bucket has chunks; a block holds two chunks, or one against itself.
    """
    cut = sizes.select(*place, F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    dealt = (
        entries.join(cut, place)
        .withColumn("mine", F.pmod(F.xxhash64(item), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("low", F.least("mine", "other"))
        .withColumn("high", F.greatest("mine", "other"))
        .drop("other", "chunks")
    )
    block = [*place, "low", "high"]
    return dealt.repartition(*block).sortWithinPartitions(*block)


def apart(entries: DataFrame, place: list[str], item: str, chunk: int) -> DataFrame:
    """Like ``blocks``, but rows without ``stray`` needn't meet each other.

    ``entries`` carry how many ``strays`` and ``others`` their bucket has. Strays fill the
    first chunks and go to all blocks of theirs, the others meet only the strays' chunks:
    a row that is no stray is copied as often as there are chunks of strays.
    """
    mine = F.pmod(F.xxhash64(item), F.when(F.col("stray"), F.col("_first")).otherwise(F.greatest(F.col("_rest"), F.lit(1))))
    dealt = (
        entries.withColumn("_first", F.ceil(F.col("strays") / chunk).cast("int"))
        .withColumn("_rest", F.ceil(F.col("others") / chunk).cast("int"))
        .withColumn("mine", (mine + F.when(F.col("stray"), 0).otherwise(F.col("_first"))).cast("int"))
        .withColumn("_stop", F.col("_first") + F.when(F.col("stray"), F.col("_rest")).otherwise(0) - 1)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_stop"))))
        .withColumn("low", F.least("mine", "_other"))
        .withColumn("high", F.greatest("mine", "_other"))
        .drop("_first", "_rest", "_stop", "_other", "stray", "strays", "others")
    )
    block = [*place, "low", "high"]
    return dealt.repartition(*block).sortWithinPartitions(*block)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by ``keys``: a table and the bounds of its groups."""

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(n)[i].as_py() for n in keys)

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts)
        mark = np.ones(table.num_rows, bool)
        mark[1:] = False
        for n in keys:
            column = np.asarray(table.column(n).to_pylist())
            mark[1:] |= column[1:] != column[:-1]
        return table, np.append(np.flatnonzero(mark), table.num_rows)

    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last, end = key(batch, batch.num_rows - 1), batch.num_rows
        while end and key(batch, end - 1) == last:
            end -= 1
        if end:
            yield cut([*pending, batch.slice(0, end)])
            pending = [batch.slice(end)]
        elif pending and key(pending[-1], pending[-1].num_rows - 1) != last:
            yield cut(pending)
            pending = [batch]
        else:
            pending.append(batch)
    if pending:
        yield cut(pending)
