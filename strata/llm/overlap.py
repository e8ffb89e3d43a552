"""Benchmark decontamination by winnowed fingerprints (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.text import ALNUM, flat, grams, list_array, mix, row_of, slices, word_hashes, words
from strata.session import Scratch

SPAN = 10  # words of a window
GRAM = 5  # words of a fingerprint; one of any SPAN - GRAM + 1 neighbours is kept
_SIDE = SPAN - GRAM  # words looked at on either side of a fingerprint
_WIDE = 2 * _SIDE + GRAM
FILTER_BITS = 25  # of the filter's size, so 4 MB whatever the benchmark holds
_SCAN = "row long, doc_id long, n_words long, at long, fingerprint long, around array<long>"
_ITEMS = "item_id string, size int, fingerprint long, around array<long>"


def winnow(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First words of the kept fingerprints: the last smallest of each window of neighbours.

    Any SPAN words that two texts share contain one window of neighbouring grams,
    so both keep a fingerprint at the same place of it.
    """
    shingles = grams(hashes, GRAM)
    count = len(hashes) - SPAN + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best, step = shingles[:count].copy(), np.zeros(count, np.int8)
    for j in range(1, _SIDE + 1):
        other = shingles[j : j + count]
        better = other <= best
        np.copyto(best, other, where=better)
        step[better] = j
    whole = np.zeros(len(hashes), bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        whole[a : max(a, b - SPAN + 1)] = True
    first = np.flatnonzero(whole[:count])
    kept = np.zeros(len(hashes), bool)
    kept[first + step[first]] = True
    return np.flatnonzero(kept)


def _around(hashes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, outside: int) -> np.ndarray:
    """The words next to each fingerprint, ``outside`` where its text has none."""
    place = at[:, None] + np.arange(-_SIDE, GRAM + _SIDE)
    inside = (place >= low[:, None]) & (place < high[:, None])
    return np.where(inside, hashes[np.clip(place, 0, max(len(hashes) - 1, 0))], np.uint64(outside))


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n words, apart from those of longer items."""
    return mix(grams(hashes, n) ^ np.uint64(n))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    body, offsets = flat(batch.column("text"))
    for first, last in slices(offsets):
        part, local = body[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, bounds = words(part, local, ALNUM)
        yield first, last, word_hashes(part, starts, ends), bounds


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("item_id").cast(pa.string())
        for first, _, hashes, bounds in _texts(batch):
            rows, sizes, prints, around = [], [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                own, n = hashes[a:b], int(b - a)
                if n == 0:
                    continue
                if n < SPAN:
                    near = np.zeros((1, _WIDE), np.uint64)
                    near[0, :n] = own
                    found = _short(own, n)
                else:
                    at = winnow(own, np.array([0, n]))
                    found = grams(own, GRAM)[at]
                    near = _around(own, at, np.zeros_like(at), np.full_like(at, n), 1)
                rows += [first + i] * len(found)
                sizes += [n if n < SPAN else 0] * len(found)
                prints.append(found)
                around.append(near.ravel())
            prints, around = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (prints, around))
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(rows, pa.int64())),
                    pa.array(sizes, pa.int32()),
                    pa.array(prints, pa.int64()),
                    list_array(around, np.arange(len(prints) + 1) * _WIDE, pa.int64()),
                ],
                ["item_id", "size", "fingerprint", "around"],
            )


def _maybe(words_: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether a fingerprint may be in the filter; true for all that are."""
    ok = np.ones(len(prints), bool)
    for shift in (0, 32):
        bit = (prints >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        ok &= (words_[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _scan(batches: Iterator[pa.RecordBatch], words_: np.ndarray, short: list[int]) -> Iterator[pa.RecordBatch]:
    """A row for each document (at = -1) and one for each fingerprint that may be an item's."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for first, last, hashes, bounds in _texts(batch):
            owner = row_of(bounds)
            at = winnow(hashes, bounds)
            prints = grams(hashes, GRAM)[at] if len(at) else np.zeros(0, np.uint64)
            keep = _maybe(words_, prints)
            at, prints = at[keep], prints[keep]
            near = _around(hashes, at, bounds[owner[at]], bounds[owner[at] + 1], 0)
            parts = [(at, prints, near)]
            for n in short:
                found = _short(hashes, n)
                keep = np.flatnonzero(_maybe(words_, found))
                keep = keep[keep + n <= bounds[owner[keep] + 1]]
                near = np.zeros((len(keep), _WIDE), np.uint64)
                near[:, :n] = hashes[keep[:, None] + np.arange(n)]
                parts.append((keep, found[keep], near))
            at = np.concatenate([x[0] for x in parts])
            prints = np.concatenate([x[1] for x in parts])
            near = np.concatenate([x[2] for x in parts])
            rows, hit = last - first, owner[at]
            order = np.concatenate([np.arange(rows), hit])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + order, pa.int64()),
                    ids.take(pa.array(first + order)),
                    pa.array(np.concatenate([np.diff(bounds), np.zeros(len(at), np.int64)]), pa.int64()),
                    pa.array(np.concatenate([np.full(rows, -1), at - bounds[hit]]), pa.int64()),
                    pa.array(np.concatenate([np.zeros(rows, np.uint64), prints]).view(np.int64), pa.int64()),
                    list_array(
                        near.ravel().view(np.int64),
                        np.concatenate([np.zeros(rows, np.int64), np.arange(len(at) + 1) * _WIDE]),
                        pa.int64(),
                    ),
                ],
                ["row", "doc_id", "n_words", "at", "fingerprint", "around"],
            )
            number += rows


def overlap(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, hit runs of words, and the items found, as three tables.

    (row, doc_id, n_words), (row, low, high) and (row, item_id). ``row`` numbers the
    documents of this run; runs are of words from 0, end exclusive, within a document.
    """
    spark = docs.sparkSession
    items = scratch.table(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_item_rows, _ITEMS), "items"
    )
    # equal surroundings are one context, however many items have them
    contexts = scratch.table(
        items.select("size", "fingerprint", "around").distinct().withColumn("context", F.monotonically_increasing_id()), "contexts"
    )
    members = items.join(contexts, ["fingerprint", "around", "size"]).select("context", "item_id").distinct()
    members = scratch.table(members, "members")
    bits = contexts.select(F.explode(F.array("fingerprint", F.expr("shiftrightunsigned(fingerprint, 32)"))).alias("h")).select(
        F.col("h").bitwiseAND((1 << FILTER_BITS) - 1).alias("bit")
    )
    # at most 2 ** (FILTER_BITS - 6) words reach the driver
    filled = bits.groupBy(F.expr("shiftright(bit, 6)").cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("value")
    )
    words_ = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for word, value in filled.collect():
        words_[word] = value & 0xFFFFFFFFFFFFFFFF
    short = sorted(r["size"] for r in contexts.select("size").where("size > 0").distinct().collect())
    sent = spark.sparkContext.broadcast(words_)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = scratch.table(rows.mapInArrow(lambda it: _scan(it, sent.value, short), _SCAN), "scan")
    found = seen.where("at >= 0").join(contexts.withColumnRenamed("around", "theirs"), "fingerprint")

    def same(i: int) -> str:
        return f"around[{i}] = theirs[{i}]"

    core = " and ".join(same(i) for i in range(_SIDE, _SIDE + GRAM))
    before = "case " + " ".join(f"when not {same(_SIDE - 1 - i)} then {i}" for i in range(_SIDE)) + f" else {_SIDE} end"
    after = "case " + " ".join(f"when not {same(_SIDE + GRAM + i)} then {i}" for i in range(_SIDE)) + f" else {_SIDE} end"
    whole = " and ".join(f"({same(i)} or size <= {i})" for i in range(SPAN - 1))
    extended = (
        found.withColumn("before", F.expr(f"if(size = 0 and {core}, {before}, 0)"))
        .withColumn("after", F.expr(f"if(size = 0 and {core}, {after}, 0)"))
        .where(f"if(size = 0, {core} and before + {GRAM} + after >= {SPAN}, {whole})")
        .selectExpr(
            "row", "context", "at - before as low", f"at + if(size = 0, {GRAM} + after, size) as high"
        )
    )
    matched = scratch.table(extended, "matched")
    named = matched.select("row", "context").distinct().join(members, "context").select("row", "item_id").distinct()
    return seen.where("at < 0").select("row", "doc_id", "n_words"), matched.select("row", "low", "high").distinct(), named


def decontaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """How much of every document stands in a benchmark item.

    Returns per document: doc_id, n_words, n_hit (words inside any occurrence of
    an item's window), n_items, items_sha256 and contaminated (n_hit > 0).

    Words are runs of digits, letters and non-ASCII signs, A-Z as a-z. A window is
    ten words of an item, or all words of an item with fewer. Documents and items
    keep the smallest five-word hash of every six neighbours, which guarantees that
    each shared run of ten words shows; such hits are joined and extended word by
    word over the ten words around them. A filter of fixed size, made from all the
    benchmark's fingerprints, holds back most others before the join; what it lets
    through wrongly, the join drops.

    Null and wordless texts have no words and no hits. Items without words have no
    window; items with a null item_id mark words but aren't counted. Repeated rows
    and equal doc_ids are judged each by itself; other columns aren't read.
    """
    rows, runs, named = overlap(docs, benchmark, scratch)
    hits = (
        runs.select("row", F.explode(F.sequence("low", F.col("high") - 1)).alias("word"))
        .distinct()
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    # no longer than the benchmark's list of items
    lists = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return (
        rows.join(hits, "row", "left")
        .join(lists, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
