"""Near-duplicate texts by min-max hashing (operator 6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.blocks import apart, grouped
from strata.llm.components import components
from strata.llm.text import SPACED, blobs, flat, grams, list_array, mix, row_of, slices, word_hashes, words
from strata.session import Scratch

WIDTH = 5  # words in a shingle
PERMUTATIONS = 48  # each gives two signature values, its minimum and its maximum
BAND = 2  # permutations in a band, so four values
SMALL = 16  # sets of so many shingles or fewer also meet by pairs of shingles, which loses no link
CHUNK = 512  # texts of a bucket compared at a time with so many others
_SIGNATURE = "doc_id long, n_shingles long, set_key binary, bits binary, bands array<long>"


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For a run of rows: distinct shingle hashes, sorted in each row, and each row's bounds."""
    body, offsets = flat(batch.column("text"))
    for first, last in slices(offsets):
        part, local = body[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, rows = words(part, local, SPACED)
        hashes = word_hashes(part, starts, ends)
        shingles = grams(hashes, WIDTH)
        sets, bounds = [], [0]
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            if b - a >= WIDTH:
                own = np.sort(shingles[a : b - WIDTH + 1])
                if len(own) > 1:
                    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                own = grams(hashes[a:b], int(b - a))
            else:
                own = shingles[:0]
            sets.append(own)
            bounds.append(bounds[-1] + len(own))
        yield first, last, np.concatenate(sets), np.array(bounds, np.int64)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return seeds[:n] | np.uint64(1), seeds[n:]


def parity(items: np.ndarray) -> bytes:
    """Bitmap of a set, at least two bits an item: whether an odd number of items fell on each bit.

    Two sets differ in at least as many items as their bitmaps differ in bits, so a
    bitmap can rule a pair out for certain. Half of a bitmap XOR the other half is
    the bitmap of half the size.
    """
    size = max(64, 1 << int(2 * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _halved(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def small_keys(items: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two sets share one for certain if they are similar enough and the smaller has SMALL items or fewer.

    A set of n items shares at least k = ceil(n * percent / 100) with any such partner,
    and k >= 2 from two items on. The two smallest shared items are then among the
    n - k + 2 smallest of either set, so all pairs of those are the keys. Larger sets than
    SMALL * 100 / percent have no such partner and no keys. ``items`` are sorted.
    """
    n = len(items)
    if n < 2 or n * percent > SMALL * 100:
        return items[:0]
    head = items[: n - -(-n * percent // 100) + 2]
    first, second = np.triu_indices(len(head), 1)
    with np.errstate(over="ignore"):
        return mix(mix(head[first] + np.uint64(1)) * np.uint64(31) + head[second])


def _signatures(batches: Iterator[pa.RecordBatch], permutations: int, percent: int) -> Iterator[pa.RecordBatch]:
    factors, shifts = _permutations(permutations)
    n_bands = permutations // BAND
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for first, last, items, bounds in _sets(batch):
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            at = bounds[:-1][full]
            keys = np.zeros((len(full), n_bands), np.uint64)
            turned = np.empty_like(items)
            with np.errstate(over="ignore"):
                for p in range(permutations if len(full) else 0):
                    np.multiply(items, factors[p], out=turned)
                    turned += shifts[p]
                    for extreme in (np.minimum, np.maximum):
                        keys[:, p // BAND] = mix(keys[:, p // BAND] * np.uint64(31) + extreme.reduceat(turned, at))
                keys = mix(keys + np.arange(1, n_bands + 1, dtype=np.uint64))
            digests: list[bytes | None] = [None] * (last - first)
            bits: list[bytes | None] = [None] * (last - first)
            bands, counts = [keys[:0].ravel()], np.zeros(last - first, np.int64)
            for i, banded in zip(full, keys, strict=True):
                own = items[bounds[i] : bounds[i + 1]]
                bands += [banded, small_keys(own, percent)]
                counts[i] = len(bands[-2]) + len(bands[-1])
                digests[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                bits[i] = parity(own)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, last - first),
                    pa.array(sizes, pa.int64()),
                    blobs(digests),
                    blobs(bits),
                    list_array(np.concatenate(bands).view(np.int64), np.concatenate([[0], np.cumsum(counts)]), pa.int64()),
                ],
                ["doc_id", "n_shingles", "set_key", "bits", "bands"],
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for first, last, items, bounds in _sets(batch):
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, last - first),
                    blobs([items[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
                ],
                ["doc_id", "items"],
            )


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("items_a"), batch.column("items_b")
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a = np.frombuffer(left[i].as_buffer(), np.uint64)
            b = np.frombuffer(right[i].as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            shared = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(b) else 0
            keep[i] = shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _possible(batches: Iterator[pa.RecordBatch], percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a block in different components that their bitmaps don't rule out.

    With ``every`` all of them, else for each text the likeliest in each other component.
    """
    for table, bounds in grouped(batches, ["bucket", "low", "high"]):
        data = {n: table.column(n).to_numpy() for n in ("doc_id", "n", "component", "mine", "low", "high")}
        bits = table.column("bits").to_pylist()
        found: list[np.ndarray] = []
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            own = {k: v[start:stop] for k, v in data.items()}
            square = own["low"][0] == own["high"][0]
            level = np.array([len(x) for x in bits[start:stop]])
            stacks = {}
            for size in np.unique(level):
                at = np.flatnonzero(level == size)
                rows = np.frombuffer(b"".join(bits[start + i] for i in at), np.uint64).reshape(len(at), -1)
                stacks[size] = (at, rows)
            for size, (at, rows) in stacks.items():
                # sizes of a pair differ by a third at most, so bitmaps by a factor of two
                for other in (size, 2 * size):
                    if other not in stacks:
                        continue
                    yours, theirs = stacks[other]
                    theirs = theirs if other == size else _halved(theirs)
                    for i, mine in zip(at, rows, strict=True):
                        usable = own["component"][yours] != own["component"][i]
                        usable &= (yours > i) if other == size else True
                        if not square:
                            usable &= own["mine"][yours] != own["mine"][i]
                        total = own["n"][yours] + own["n"][i]
                        usable &= 100 * np.minimum(own["n"][yours], own["n"][i]) >= percent * np.maximum(own["n"][yours], own["n"][i])
                        if not usable.any():
                            continue
                        pick = np.flatnonzero(usable)
                        apart = np.bitwise_count(theirs[pick] ^ mine).sum(1, dtype=np.int64)
                        fine = apart * (100 + percent) <= total[pick] * (100 - percent)
                        pick, apart = yours[pick[fine]], apart[fine]
                        if not every and len(pick) > 1:
                            order = np.lexsort((apart, own["component"][pick]))
                            pick = pick[order]
                            kin = own["component"][pick]
                            pick = pick[np.append(True, kin[1:] != kin[:-1])]
                        if len(pick):
                            pairs = np.stack([np.full(len(pick), own["doc_id"][i]), own["doc_id"][pick]])
                            found.append(np.sort(pairs, axis=0))
        pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])


def near_duplicates(
    docs: DataFrame, scratch: Scratch, percent: int = 75, permutations: int = PERMUTATIONS
) -> DataFrame:
    """Groups of texts whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Takes (doc_id, text, ...) and returns one row per input row: doc_id,
    n_shingles (size of its set), component_id (smallest doc_id reachable over
    links, itself included) and kept (doc_id is component_id).

    Words are runs between white space, A-Z as a-z; a set holds the distinct runs
    of five words, or the whole sequence where there are fewer. Every permutation
    gives its minimum *and* its maximum over the set, both equal between two texts
    with probability J, so 48 hash evaluations make 96 values in 24 bands of four:
    a pair at J = 0.75 shares a band with probability 0.9999, more above it. In small
    sets minimum and maximum depend on each other and bands miss more; so sets of up to
    SMALL shingles meet their partners also by ``small_keys``, which miss none.
    ``percent`` lies above 50 (else ValueError): bands and bitmaps aren't made for less.

    Texts with equal sets are one class and go on as one row. Each bucket first links
    its members to its most central one. Then members of a bucket that are still in
    different components are compared in blocks by bitmaps, which rule out pairs for
    certain: first each text with the likeliest of every other component, at last all
    that remain. Members of the largest component of a bucket meet only the others. Every candidate is confirmed on full sets, which are made only for
    texts that share a bucket.

    Null text, empty text and text without words have an empty set and link with
    nothing. Rows with a null doc_id never link: component_id is null, kept true.
    Rows with the same doc_id count as one document, which has the links of all
    of them; repeated rows are all returned. Other columns of ``docs`` are not read.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.table(texts.mapInArrow(lambda it: _signatures(it, permutations, percent), _SIGNATURE), "signatures")
    able = signed.where("set_key is not null and doc_id is not null")
    classes = scratch.table(
        able.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bits", "bands")).alias("rep")).select("set_key", "rep.*"),
        "classes",
    )
    wide = F.col("n_shingles").alias("n")
    buckets = classes.select("doc_id", wide, F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = scratch.table(buckets.join(sizes, "bucket"), "buckets")
    sets = _full_sets(texts, shared.select("doc_id").distinct(), scratch)
    # the text with the fullest buckets is the likeliest centre of its bucket
    central = shared.groupBy("doc_id").agg(F.sum("members").alias("weight"))
    ranked = scratch.table(shared.join(central, "doc_id").drop("members"), "ranked")
    hubs = ranked.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "n"), F.struct("weight", "doc_id")).alias("hub"))
    stars = (
        ranked.join(hubs, "bucket")
        .where(f"doc_id <> hub.doc_id and 100 * least(n, hub.n) >= {int(percent)} * greatest(n, hub.n)")
        .select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b"))
        .distinct()
    )
    tested = scratch.table(stars, "pairs")
    links = _confirmed(tested, sets, percent, scratch)
    groups = components(links, scratch)
    for every in (False, True):
        placed = scratch.table(
            shared.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
                "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")
            ),
            "placed",
        )
        mixed = (
            placed.groupBy("bucket")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
            .where("lo < hi")
        )
        mixed = scratch.table(mixed.select("bucket", "n"), "mixed")
        kin = (
            placed.join(mixed.where(F.col("n") > CHUNK), "bucket", "left_semi")
            .groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("kin"))
            .groupBy("bucket").agg(F.max(F.struct("kin", "component")).alias("most"))
        )
        kinds = mixed.join(kin, "bucket", "left").select(
            "bucket", F.col("most.component").alias("main"), F.coalesce("most.kin", F.lit(0)).alias("others"),
            (F.col("n") - F.coalesce("most.kin", F.lit(0))).alias("strays"),
        )
        rows = (
            placed.join(kinds, "bucket")
            .withColumn("stray", ~F.col("component").eqNullSafe(F.col("main")))
            .join(classes.select("doc_id", wide, "bits"), "doc_id")
            .drop("main")
        )
        dealt = apart(rows, ["bucket"], "doc_id", CHUNK)
        more = dealt.mapInArrow(lambda it, every=every: _possible(it, percent, every), "a long, b long").distinct()
        more = scratch.table(more.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = _confirmed(more, sets, percent, scratch)
        known = groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found)
        groups = components(scratch.table(known, "known"), scratch)
        tested = tested.union(more)
    final = groups
    named = scratch.table(
        classes.select("set_key", "doc_id")
        .join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("set_key", F.coalesce("component", "doc_id").alias("component"))
        .distinct(),
        "components",
    )
    scratch.drop(shared, ranked, sets, links, classes)
    return signed.join(named, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "doc_id"))).alias("kept"),
    )


def _full_sets(texts: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, items): the sets of the wanted texts.

    The list of ids grows with the table, so it is never broadcast: texts are
    shuffled once, and their sets, much fewer, are written.
    """
    chosen = texts.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return scratch.table(chosen.mapInArrow(_packed, "doc_id long, items binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets pass."""
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b"
    )
    return scratch.table(full.mapInArrow(lambda it: _verified(it, percent), "a long, b long"), "links")
