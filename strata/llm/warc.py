"""Archive files and their Merkle fixity audit (operator 4)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.token_files import filesystem
from strata.session import Scratch

FAN_OUT = 16  # children of a node
FILE_BYTES = 1 << 26  # a task rolls to a new file beyond so many bytes
READ_BYTES = 1 << 16
WINDOW_BYTES = 1 << 27  # a frame that asks for more memory than that can't be read
_MAGIC = b"\x28\xb5\x2f\xfd"  # opens a frame; no UTF-8 text holds it
_FILES = "file string, part int, seq int, n_records long, n_bytes long"
_LEAVES = "file string, seq long, offset long, length long, page_id long, hash binary, place long, stored long, readable boolean"


def record(url: str | None, page_id: int | None, body: bytes) -> bytes:
    """One WARC/1.1 resource record. Its id is derived from what it holds, so equal pages give equal bytes."""
    address = "".join(c for c in url or "" if c not in "\r\n")
    name = uuid.UUID(bytes=hashlib.sha256(f"{page_id}\n{address}\n".encode() + body).digest()[:16])
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:uuid:{name}>\r\n"
        f"WARC-Target-URI: {address}\r\n"
        f"X-Page-ID: {'' if page_id is None else page_id}\r\n"
        "WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\n"
        f"Content-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def _leaf(data: bytes) -> bytes:
    return hashlib.sha256(b"\0" + data).digest()


def _create(path: str) -> pa.NativeFile:
    store, place = filesystem(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    return store.open_output_stream(place, compression=None)


def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(write_checksum=True, write_content_size=True)


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Records in the order of the rows; each task writes files of its own."""
    part, attempt, done, out = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None
    packer = _packer()
    path, n, size = "", 0, 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("url", "page_id", "html"))
        for url, page_id, html in zip(*columns, strict=True):
            if out is None:
                path, n, size = f"{root}/part-{part:06d}-{len(done):04d}-{attempt}.warc.zst", 0, 0
                out = _create(path)
            data = record(url, page_id, (html or "").encode())
            out.write(packer.compress(data))
            n, size = n + 1, size + len(data)
            if size >= FILE_BYTES:
                out.close()
                done.append((path, part, len(done), n, size))
                out = None
    if out is not None:
        out.close()
        done.append((path, part, len(done), n, size))
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    columns = list(zip(*done, strict=True)) or [[]] * 5
    names = ["file", "part", "seq", "n_records", "n_bytes"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def write_archive(pages: DataFrame, scratch: Scratch, root: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as compressed archive files, without a shuffle.

    Each task writes its own rows in their order, every record as a compressed frame of its
    own with a checksum, so that damage stays within the records that it hits. Returns the written list of files:
    file, part, seq, n_records, n_bytes (before compression, as all offsets are). Null
    html is an empty body, null url an empty address; repeated rows and null page_ids
    are all written. No rows, no files.
    """
    root = root or scratch.path("archive")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return scratch.table(rows.mapInArrow(lambda it: _write(it, root), _FILES), "files")


def _copy(batches: Iterator[pa.RecordBatch], root: str, damage) -> Iterator[pa.RecordBatch]:
    packer = _packer()
    for batch in batches:
        new = []
        for path in batch.column("file").to_pylist():
            target = f"{root}/{uuid.uuid4().hex}-{path.rpartition('/')[2]}"
            out = _create(target)
            for _, _, data, raw in frames(path):
                changed = raw if data is None else damage(_page(data), data)
                if data is not None and changed:
                    changed = packer.compress(changed)
                out.write(changed)
            out.close()
            new.append(target)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(new, pa.string())], ["file", "replica"])


def replicate(files: DataFrame, scratch: Scratch, damage, root: str | None = None) -> DataFrame:
    """Copy every file; ``damage(page_id, bytes)`` returns the bytes that the copy gets.

    Returns (file, replica). For drills: a plain copy gives the bytes back unchanged, and
    no bytes leave the record out. Ranges that can't be read are copied as they are.
    """
    root = root or scratch.path("replica")
    listed = files.select("file").repartition(max(1, files.count()))
    return scratch.table(listed.mapInArrow(lambda it: _copy(it, root, damage), "file string, replica string"), "replicas")


def frames(path: str) -> Iterator[tuple[int, int, bytes | None, bytes]]:
    """(place, stored, record, raw) of a file, in order: where a frame lies and what it holds.

    Frames that are damaged or cut, and whatever lies between frames, make one range up to
    the next frame that can be read; its record is None and raw are its bytes (else empty).
    A missing or empty file has none. A task holds one frame, or one unreadable range.
    """
    store, name = filesystem(path)
    try:
        file = store.open_input_stream(name, compression=None)
    except FileNotFoundError:
        return
    with file:
        raw, at, lost, since = file.read(READ_BYTES), 0, [], 0
        while raw:
            reader = zstandard.ZstdDecompressor(max_window_size=WINDOW_BYTES).decompressobj()
            pieces, out, whole = [raw], [], False
            try:
                out.append(reader.decompress(raw))
                while not reader.eof and (more := file.read(READ_BYTES)):
                    pieces.append(more)
                    out.append(reader.decompress(more))
                whole = reader.eof
            except zstandard.ZstdError:
                pass
            if whole:
                if lost:
                    yield since, at - since, None, b"".join(lost)
                    lost, since = [], at
                rest = reader.unused_data
                stored = sum(map(len, pieces)) - len(rest)
                yield at, stored, b"".join(out), b""
                raw, at = rest or file.read(READ_BYTES), at + stored
                since = at
                continue
            raw = b"".join(pieces)
            found = raw.find(_MAGIC, 1)
            while found < 0:
                # the last bytes may be the first of a frame's mark
                keep = min(len(raw) - 1, len(_MAGIC) - 1)
                more = file.read(READ_BYTES)
                if not more:
                    found = len(raw)
                    break
                lost.append(raw[: len(raw) - keep])
                at += len(raw) - keep
                raw = raw[len(raw) - keep :] + more
                found = raw.find(_MAGIC)
            lost.append(raw[:found])
            raw, at = raw[found:], at + found
            if not raw:
                raw = file.read(READ_BYTES)
        if lost:
            yield since, at - since, None, b"".join(lost)


def _field(head: bytes, name: bytes) -> bytes | None:
    at = head.find(b"\r\n" + name + b": ")
    return None if at < 0 else head[at + len(name) + 4 :].partition(b"\r\n")[0]


def _size(raw: bytes) -> int:
    """Length of the record of a frame that can't be read, as its head states it, else 0."""
    try:
        return max(0, zstandard.frame_content_size(raw))
    except zstandard.ZstdError:
        return 0


def _page(data: bytes) -> int | None:
    value = _field(data.partition(b"\r\n\r\n")[0], b"X-Page-ID")
    return int(value) if value and value.lstrip(b"-").isdigit() and len(value) < 20 else None


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist(), strict=True):
            rows: list[tuple] = []
            offset = 0
            for seq, (place, stored, data, raw) in enumerate(frames(path)):
                length = _size(raw) if data is None else len(data)
                what = (None, hashlib.sha256(b"\1" + raw).digest()) if data is None else (_page(data), _leaf(data))
                rows.append((name, seq, offset, length, *what, place, stored, data is not None))
                offset += length
                if len(rows) == 10_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    whole = pa.int64()
    kinds = (pa.string(), whole, whole, whole, whole, pa.binary(), whole, whole, pa.bool_())
    names = ["file", "seq", "offset", "length", "page_id", "hash", "place", "stored", "readable"]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def leaves(files: DataFrame, scratch: Scratch) -> DataFrame:
    """Hash of every record of the listed files (file, path): the leaves of their trees.

    offset and length count bytes before compression, place and stored those in the file.
    A range that can't be read is a leaf too: not ``readable``, hashed as it lies there,
    without a page_id and as long as its frame's head says. Missing and empty files have
    no leaves.
    """
    listed = files.select("file", "path").repartition(max(1, files.count()))
    return scratch.table(listed.mapInArrow(_hashed, _LEAVES), "leaves")


def tree(records: DataFrame, scratch: Scratch, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels of nodes (file, node, hash, first, last) from the leaves up to one root a file.

    A node hashes its children in order together with the range of offsets that it
    covers; at most ``fan_out`` children meet in a task's group.
    """
    level = records.select(
        "file", F.col("seq").alias("node"), F.lower(F.hex("hash")).alias("hash"), F.col("offset").alias("first"),
        (F.col("offset") + F.col("length")).alias("last"),
    )
    levels = [level]
    width = records.agg(F.max("seq")).first()[0]
    while width:
        child = F.struct("node", "hash")
        level = (
            level.groupBy("file", F.floor(F.col("node") / fan_out).alias("node"))
            .agg(F.array_sort(F.collect_list(child)).alias("c"), F.min("first").alias("first"), F.max("last").alias("last"))
            .select(
                "file",
                "node",
                F.sha2(
                    F.concat(
                        F.lit("node:"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(":"),
                        F.array_join("c.hash", ","),
                    ),
                    256,
                ).alias("hash"),
                "first",
                "last",
            )
        )
        level = scratch.table(level, "level")
        levels.append(level)
        width //= fan_out
    return levels


def _complete(records: DataFrame) -> DataFrame:
    """Leaves without stored ranges lie as they are, and all were read."""
    has = records.columns
    return records.select(
        "file", "seq", "offset", "length", "page_id", "hash",
        (F.col("place") if "place" in has else F.col("offset")).alias("place"),
        (F.col("stored") if "stored" in has else F.col("length")).alias("stored"),
        (F.col("readable") if "readable" in has else F.lit(True)).alias("readable"),
    )


def _counterparts(mine: DataFrame, other: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(file, seq, their_seq): rows of equal ``key`` and file, the first with the first and so on."""

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        place = Window.partitionBy("file", key).orderBy("seq")  # a file is of bounded size
        return rows.select("file", key, F.row_number().over(place).alias("nth"), F.col("seq").alias(name))

    a, b = ranked(mine, "seq"), ranked(other, "their_seq").withColumnRenamed("file", "f").withColumnRenamed(key, "k").withColumnRenamed("nth", "n")
    same = (F.col("file") == F.col("f")) & F.col(key).eqNullSafe(F.col("k")) & (F.col("nth") == F.col("n"))
    return scratch.table(a.join(b, same).select("file", "seq", "their_seq"), "counterparts")


def _touching(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, seq) of ``rows`` whose stored range overlaps one of ``ranges`` of the same file.

    One pass over a file by place: the furthest end of the ranges that open before a row ends.
    """
    stop = F.col("place") + F.col("stored")
    opened = ranges.select("file", F.lit(None).cast("long").alias("seq"), F.col("place").alias("at"), F.lit(1).alias("turn"), stop.alias("reach"), F.lit(None).cast("long").alias("start"))
    closed = rows.select("file", "seq", stop.alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("reach"), F.col("place").alias("start"))
    so_far = Window.partitionBy("file").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    met = opened.unionByName(closed).withColumn("far", F.max("reach").over(so_far))
    return met.where("seq is not null and far > start").select("file", "seq")


def audit(ours: DataFrame, theirs: DataFrame, scratch: Scratch, fan_out: int = FAN_OUT) -> DataFrame:
    """Records on which two replicas of the same files differ.

    Roots are compared first; below, only children of nodes that differ are read,
    so a clean file costs one comparison. Where records were lost or gained, those that
    only got another number are found again by their hash and aren't listed.

    Returns file, seq, offset, length and page_id of our copy (null where only theirs has
    the record), their_offset, their_length and status: changed (the other copy has
    another record of this page, or else of this number), missing (from theirs), extra
    (only in theirs) or unreadable: a range of our copy that can't be read, a record of ours
    that lies where theirs can't be read, or a range of theirs where we have nothing amiss.
    A range that is damaged alike in both copies is equal, and not listed.
    """
    ours, theirs = _complete(ours), _complete(theirs)
    left, right = tree(ours, scratch, fan_out), tree(theirs, scratch, fan_out)
    top = max(len(left), len(right))
    suspects = None
    for level in range(top - 1, -1, -1):
        a = left[level] if level < len(left) else left[-1].where("false")
        b = right[level] if level < len(right) else right[-1].where("false")
        if suspects is not None:
            parent = F.floor(F.col("node") / fan_out).alias("parent")
            chosen = suspects.select("file", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", parent).join(chosen, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        both = a.select("file", "node", F.col("hash").alias("h1")).join(
            b.select("file", "node", F.col("hash").alias("h2")), ["file", "node"], "full"
        )
        # a shorter tree has its root below ours: then all of the level is looked at
        suspects = scratch.table(both.where("not (h1 <=> h2)").select("file", "node"), "suspects")
    found = suspects.withColumnRenamed("node", "seq")
    mine = scratch.table(ours.join(found, ["file", "seq"], "left_semi"), "ours")
    other = scratch.table(theirs.join(found, ["file", "seq"], "left_semi"), "theirs")
    changed = None
    for key in ("hash", "page_id", "number"):
        able = [x.where("readable" if key != "hash" else "true").withColumn("number", F.col("seq")) for x in (mine, other)]
        pairs = _counterparts(*able, key, scratch)
        if key != "hash":
            changed = pairs if changed is None else changed.unionByName(pairs)
        mine = mine.join(pairs, ["file", "seq"], "left_anti")
        other = other.join(pairs.select("file", F.col("their_seq").alias("seq")), ["file", "seq"], "left_anti")
    mine, other = scratch.table(mine, "only_ours"), scratch.table(other, "only_theirs")
    broken = other.where("not readable")
    hidden = _touching(mine, broken).withColumn("hidden", F.lit(True))
    status = F.when(~F.col("readable") | F.col("hidden"), "unreadable").otherwise("missing")
    ours_only = mine.join(hidden, ["file", "seq"], "left").select("file", "seq", F.lit(None).cast("long").alias("their_seq"), status.alias("status"))
    seen = _touching(broken, mine).withColumn("seen", F.lit(True))
    status = F.when(F.col("readable"), "extra").otherwise("unreadable")
    theirs_only = other.join(seen, ["file", "seq"], "left").where("seen is null").select(
        "file", F.lit(None).cast("long").alias("seq"), F.col("seq").alias("their_seq"), status.alias("status")
    )
    rows = changed.withColumn("status", F.lit("changed")).unionByName(ours_only).unionByName(theirs_only)
    return rows.join(ours.select("file", "seq", "offset", "length", "page_id"), ["file", "seq"], "left").join(
        theirs.select("file", F.col("seq").alias("their_seq"), F.col("offset").alias("their_offset"), F.col("length").alias("their_length")),
        ["file", "their_seq"], "left",
    ).select("file", "seq", "offset", "length", "page_id", "their_offset", "their_length", "status")


def rot(page_id: int | None, data: bytes) -> bytes:
    """The drill's fault: one bit of the last byte of the body, for one page in 97."""
    if page_id is None or (page_id * 7919) % 97 != 13:
        return data
    spot = len(data) - 5
    return data[:spot] + bytes([data[spot] ^ 1]) + data[spot + 1 :]


def fixity(pages: DataFrame, scratch: Scratch, damage=rot) -> DataFrame:
    """Archive all pages, copy the archive with damage, audit the copy: one row per record.

    page_id, file, seq, offset, length, status (intact, changed, missing, extra, unreadable).
    Rows that only the copy has come with a null seq.
    """
    files = write_archive(pages, scratch)
    replicas = replicate(files, scratch, damage)
    ours = leaves(files.select("file", F.col("file").alias("path")), scratch)
    theirs = leaves(replicas.select("file", F.col("replica").alias("path")), scratch)
    wrong = scratch.table(audit(ours, theirs, scratch), "audit")
    told = wrong.where("seq is not null").select("file", "seq", "status")
    kept = ours.join(told, ["file", "seq"], "left").select(
        "page_id", "file", "seq", "offset", "length",
        F.coalesce("status", F.when(F.col("readable"), "intact").otherwise("unreadable")).alias("status"),
    )
    extra = wrong.where("seq is null").select("page_id", "file", "seq", F.col("their_offset").alias("offset"), F.col("their_length").alias("length"), "status")
    return kept.unionByName(extra)


FIXED = len(record("", None, b"")) - 1  # bytes of a record besides its fields and body

SQL = f"""
SELECT page_id,
       {FIXED} + strlen(url) + strlen(CAST(page_id AS VARCHAR)) + strlen(CAST(strlen(html) AS VARCHAR)) + strlen(html) AS length,
       CASE WHEN (page_id * 7919) % 97 = 13 THEN 'changed' ELSE 'intact' END AS status
FROM pages
"""
