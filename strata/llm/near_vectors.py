"""Near-duplicate vectors by cross-polytope hashing (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.blocks import blocks, grouped
from strata.llm.components import components
from strata.session import Scratch

TABLES = 4
HASHES = 3  # rotations in a table; a bucket is one corner from each
PROBES = 2  # nearest corners of each rotation that a vector is filed under
CHUNK = 256  # vectors of a bucket compared at a time with so many others
_FOUND = "a long, b long, n long"


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, step = x.shape[1], 1
    while step < n:
        halves = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def corners(unit: np.ndarray) -> np.ndarray:
    """The nearest ``PROBES`` corners of the cross-polytope under every rotation.

    A rotation is three rounds of random signs and a fast Hadamard transform; corner
    2i or 2i + 1 is the i-th axis in its positive or negative direction. Result:
    vectors x TABLES x HASHES x PROBES.
    """
    size = max(2, 1 << (unit.shape[1] - 1).bit_length())
    wide = np.zeros((len(unit), size))
    wide[:, : unit.shape[1]] = unit
    out = np.empty((len(unit), TABLES, HASHES, PROBES), np.int32)
    for t in range(TABLES):
        for h in range(HASHES):
            signs = np.random.default_rng([7, size, t, h]).choice([-1.0, 1.0], (3, size))
            turned = wide
            for own in signs:
                turned = _hadamard(turned * own)
            order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :PROBES]
            out[:, t, h] = order * 2 + (np.take_along_axis(turned, order, 1) < 0)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector with its corners and the buckets that they combine to."""
    for batch in batches:
        lists = batch.column("embedding").to_pylist()
        codes: list[bytes] = [b""] * len(lists)
        values: list[bytes] = [b""] * len(lists)
        buckets: list[list[int]] = [[]] * len(lists)
        sizes = np.array([len(x) for x in lists], np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            rows = np.array([lists[i] for i in at], np.float64)
            corner = corners(_unit(rows))
            keys = np.arange(TABLES)[None, :, None] + np.zeros((len(at), 1, 1), np.int64)
            for h in range(HASHES):
                keys = (keys[:, :, :, None] * (1 << 19) + corner[:, :, h][:, :, None, :]).reshape(len(at), TABLES, -1)
            for j, i in enumerate(at):
                codes[i], values[i] = corner[j].tobytes(), rows[j].tobytes()
                buckets[i] = keys[j].ravel().tolist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                batch.column("vec_id"),
                batch.column("copies"),
                pa.array(sizes, pa.int32()),
                pa.array(codes, pa.binary()),
                pa.array(values, pa.binary()),
                pa.array(buckets, pa.list_(pa.int64())),
            ],
            ["label", "vec_id", "copies", "size", "corners", "vector", "buckets"],
        )


def _first_meeting(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Whether this bucket is the first that the two vectors of each row share.

    Buckets of a table are products of its rotations' corners, so the first one
    two vectors share has, for each rotation, the smallest corner they share.
    """
    own = []
    for _ in range(HASHES):
        own.append(bucket & ((1 << 19) - 1))
        bucket >>= 19
    table = bucket
    least = np.full(a.shape[:3], np.iinfo(np.int32).max, np.int32)
    for i in range(PROBES):
        for j in range(PROBES):
            same = a[..., i] == b[..., j]
            np.minimum(least, np.where(same, a[..., i], least), out=least)
    meets = (least < np.iinfo(np.int32).max).all(2)
    return ~meets[:, :table].any(1) & (least[:, table] == np.array(own[::-1])).all(1)


def _compared(rows: dict[str, np.ndarray], cosine: float) -> Iterator[tuple[int, int | None, int | None]]:
    """Links of one block: each vector's count of linked copies, and a spanning forest."""
    left = np.flatnonzero(rows["mine"] == rows["low"])
    right = np.flatnonzero(rows["mine"] == rows["high"])
    square = rows["low"][0] == rows["high"][0]
    if len(left) == 0 or len(right) == 0 or (square and len(left) < 2):
        return
    unit, codes = rows["vector"], rows["corners"]
    close = unit[left] @ unit[right].T >= cosine
    if square:
        close = np.triu(close, 1)
    x, y = np.nonzero(close)
    if len(x) == 0:
        return
    first = _first_meeting(codes[left[x]], codes[right[y]], int(rows["bucket"][0]))
    x, y = left[x[first]], right[y[first]]
    ids, copies = rows["vec_id"], rows["copies"]
    linked = np.bincount(x, weights=copies[y], minlength=len(ids)) + np.bincount(y, weights=copies[x], minlength=len(ids))
    for i in np.flatnonzero(linked):
        yield int(ids[i]), None, int(linked[i])
    label = np.arange(len(ids))
    while True:  # smallest label of the neighbours, until nothing changes
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(label != np.arange(len(ids))):
        yield int(ids[i]), int(ids[label[i]]), None


def _links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for table, bounds in grouped(batches, ["label", "size", "bucket", "low", "high"]):
        data = {n: table.column(n).to_numpy() for n in ("vec_id", "copies", "size", "bucket", "low", "high", "mine")}
        corner, vector = table.column("corners").to_pylist(), table.column("vector").to_pylist()
        out: list[tuple[int, int | None, int | None]] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            rows = {n: v[a:b] for n, v in data.items()}
            rows["corners"] = np.frombuffer(b"".join(corner[a:b]), np.int32).reshape(b - a, TABLES, HASHES, PROBES)
            rows["vector"] = _unit(np.frombuffer(b"".join(vector[a:b]), np.float64).reshape(b - a, -1))
            out += _compared(rows, cosine)
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = 0.98) -> DataFrame:
    """Groups of vectors of one label whose cosine is ``cosine`` or more.

    Takes (vec_id, embedding, label, ...) and returns per row: vec_id, n_links
    (other vectors linked directly), component_id (smallest vec_id reachable) and
    kept (vec_id is component_id).

    Each of 4 tables files a vector under 8 buckets, the products of its two nearest
    corners under 3 rotations. Two vectors at cosine 0.98 in 64 dimensions share a
    bucket with probability 0.9999 or more, and all pairs in a bucket are verified in
    double precision. Equal vectors of a label go on as one with a count. A bucket is
    cut into chunks and compared chunk against chunk, so no task holds a whole bucket;
    a block returns counts and a spanning forest, never its pairs. A pair that shares
    several buckets counts in the first only.

    Vectors that are null, empty, zero, or hold null or non-finite components, and
    rows with a null label or vec_id, link with nothing; for a null vec_id
    component_id is null and kept true. Vectors of different length don't link.
    Repeated rows link as equal vectors. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    sound = F.expr(
        "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and "
        "exists(embedding, x -> x <> 0)"
    )
    classes = scratch.table(
        rows.where(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "classes",
    )
    kind = dict(vectors.dtypes)["label"]
    filed = scratch.table(
        classes.select("label", F.col("rep").alias("vec_id"), "copies", "embedding").mapInArrow(
            _filed,
            f"label {kind}, vec_id long, copies long, size int, corners binary, vector binary, buckets array<long>",
        ),
        "filed",
    )
    place = ["label", "size", "bucket"]
    spread = filed.select("label", "size", F.explode("buckets").alias("bucket"))
    full = spread.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = scratch.table(full, "buckets")
    entries = filed.withColumn("bucket", F.explode("buckets")).drop("buckets")
    dealt = blocks(entries, place, "vec_id", full, CHUNK)
    found = scratch.table(dealt.mapInArrow(lambda it: _links(it, cosine), _FOUND), "found")
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("linked"))
    groups = components(found.where("b is not null").select("a", "b"), scratch)
    named = scratch.table(
        classes.join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            F.col("label").alias("own_label"),
            F.col("embedding").alias("own_embedding"),
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        ),
        "named",
    )
    scratch.drop(classes, filed, full, found)
    usable = rows.withColumn("sound", sound)
    match = F.expr("sound and label = own_label and embedding = own_embedding")
    component = F.coalesce("component", "vec_id")
    return usable.join(named, match, "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"),
    )
