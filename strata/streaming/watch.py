"""Change streams (W1-W8) on Structured Streaming.

Every operator has a batch twin in ``strata.operators``; stateful results go to
Parquet in a shared folder, never to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from strata.functions.globs import matches_any
from strata.operators.diffs import FINGERPRINT
from strata.operators.ordered import running
from strata.operators.scoring import severity_columns
from strata.session import materialise
from strata.streaming.state import Bursts, Changes, Snapshots


def latest_op() -> Column:
    """The last operation of a group: newest timestamp, ties by operation name."""
    return F.max_by("op", F.struct("ts", "op")).alias("op")


#: precise to the microsecond, both ways
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def keyed_state(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, so it need not fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("bucket")


def debounce_changes(events: DataFrame, gap_seconds: float = 0.5, delay: str = "0 seconds", buckets: int = 1) -> DataFrame:
    """W1 ``debounce_changes``: the latest operation of every path of a burst, once the burst is over.

    Events wait in the keyed state of their project; an event-time timer at a burst's end
    plus the gap closes it when the watermark (``delay`` behind the newest event) gets
    there. Returns (project_id, started, ended, path, op, ts). With several ``buckets`` a
    project's paths are dealt over that many keys, whose bursts ``merge_bursts`` joins; then
    there are also rows without a path, the bounds of what each key has received so far.
    """
    keyed_state(events.sparkSession)
    gap = int(gap_seconds * 1_000_000)
    rows = events.withWatermark("ts", delay).select("project_id", _bucket("path", buckets), "path", "op", "ts")
    closed = rows.groupBy("project_id", "bucket").transformWithStateInPandas(
        Bursts(gap), "project_id string, started long, ended long, path string, op string, at long", "Append", "EventTime"
    )
    closed = closed if buckets > 1 else closed.where("path is not null")
    return closed.select(
        "project_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "path", "op", F.timestamp_micros("at").alias("ts")
    )


def merge_bursts(closed: DataFrame, gap_seconds: float = 0.5) -> DataFrame:
    """Bursts of a project's buckets joined: those closer than the gap are one.

    Works on bounds, one row per bucket and burst. Returns (project_id, burst, until,
    path, op, ts): ``burst`` counts a project's bursts, and one is over when the watermark
    is the gap beyond ``until``, its last event received.
    """
    gap = int(gap_seconds * 1_000_000)
    bounds = closed.select("project_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended")).distinct()
    # bounds open and close; where none is open, a burst begins
    opens = bounds.select("project_id", F.col("started").alias("at"), F.lit(1).alias("delta"), F.col("ended").alias("other"))
    ends = bounds.select("project_id", (F.col("ended") + gap).alias("at"), F.lit(-1).alias("delta"), F.col("started").alias("other"))
    order = ["at", "delta", "other"]
    swept = running(opens.unionByName(ends), ["project_id"], order, sums={"open": F.col("delta")}, unique=True)
    first = ((F.col("delta") == 1) & (F.col("open") == 1)).cast("int")
    numbered = running(swept, ["project_id"], order, sums={"burst": first}, unique=True).where("delta = 1")
    numbered = numbered.select(
        "project_id", F.timestamp_micros("at").alias("started"), F.timestamp_micros("other").alias("ended"), "burst"
    )
    numbered = materialise(numbered)
    untils = numbered.groupBy("project_id", "burst").agg(F.max("ended").alias("until"))
    joined = closed.where("path is not null").join(numbered, ["project_id", "started", "ended"])
    latest = joined.groupBy("project_id", "burst", "path").agg(latest_op(), F.max("ts").alias("ts"))
    return latest.join(untils, ["project_id", "burst"]).select("project_id", "burst", "until", "path", "op", "ts")


def burst_of(events: DataFrame, gap_seconds: float) -> DataFrame:
    """Number each project's bursts: a new one starts after ``gap_seconds`` of quiet."""
    rows = events.select("project_id", "path", "op", "ts").distinct()
    moments = rows.select("project_id", "ts").distinct()
    ranked = running(moments, ["project_id"], ["ts"], position="_i", unique=True)
    earlier = ranked.select("project_id", (F.col("_i") + 1).alias("_i"), F.col("ts").alias("_before"))
    quiet = F.col("_before").isNull() | (
        F.unix_micros("ts") - F.unix_micros("_before") >= int(gap_seconds * 1_000_000)
    )
    marked = ranked.join(earlier, ["project_id", "_i"], "left").select(
        "project_id", "ts", quiet.cast("int").alias("_first")
    )
    bursts = running(marked, ["project_id"], ["ts"], sums={"burst": F.col("_first")}, unique=True)
    return rows.join(bursts.select("project_id", "ts", "burst"), ["project_id", "ts"])


def debounce_batch(events: DataFrame, gap_seconds: float = 0.5) -> DataFrame:
    """W1's batch twin: latest operation per burst and path over a whole history."""
    return burst_of(events, gap_seconds).groupBy("project_id", "burst", "path").agg(latest_op())


def ignore_events(events: DataFrame, patterns: list[str]) -> DataFrame:
    """W2 ``ignore_events``: drop events on ignored paths (narrow, stream or batch)."""
    return events.where(~matches_any(F.col("path"), patterns, "watch")) if patterns else events


def late_events(events: DataFrame, delay: str) -> DataFrame:
    """W8 ``late_events``: bound lateness by a watermark; later rows are dropped by rule."""
    return events.withWatermark("ts", delay)


def violation_windows(violations: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """W7 ``violation_windows``: violations per time window and severity."""
    bucket = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        late_events(violations, delay)
        .groupBy("project_id", bucket.alias("w"), "severity")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("project_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "severity", "cnt")
    )


def state_payload(violations: DataFrame) -> DataFrame:
    """W6 ``state_payload``: current severity counts and debt per project, as columns and JSON."""
    out = violations.groupBy("project_id").agg(*severity_columns())
    return out.withColumn("debt", F.col("errors") * 3 + F.col("warnings")).withColumn(
        "payload", F.to_json(F.struct("total", "errors", "warnings", "info", "debt"))
    )


def periodic(writer: DataStreamWriter, every: str = "30 seconds") -> DataStreamWriter:
    """W5 ``periodic_refresh``: a micro-batch per interval."""
    return writer.trigger(processingTime=every)


def newest_runs(rows: DataFrame) -> DataFrame:
    """Rows of every project's newest run (by ``ts``) in a log of runs: what W4 is to be given of it.

    A batch. The newest moments, a row a project, are written; the log meets them on their
    size and is neither shuffled nor sorted.
    """
    newest = materialise(rows.groupBy("project_id").agg(F.max("ts").alias("ts")))
    return rows.join(newest, ["project_id", "ts"], "left_semi")


def change_feed(runs: DataFrame, buckets: int = 8, hours: float | None = None) -> DataFrame:
    """W4 ``change_feed``: added / resolved / unchanged rows of every run, against the project's run before.

    ``runs`` streams full check results, each row with its run's ``ts``; a run arrives in
    one micro-batch, and of several runs of a project there only the newest counts; all rows
    of a micro-batch pass through Python, so a log of runs goes through ``newest_runs`` first.
    Every run has one row without a rule_id, so a clean run is a run too. Fingerprints are map
    state by (project, bucket); that row goes to all buckets, the others to their own, so
    a project's rows are not one task's. A run older than the last one is ignored. With
    ``hours`` (T9) fingerprints that no run has had for so long are forgotten. Adds
    ``change`` and ``run``, which counts the runs of a project.
    """
    keyed_state(runs.sparkSession)
    header = F.col("rule_id").isNull()
    fp = F.when(~header, F.to_json(F.struct(*FINGERPRINT), {"ignoreNullFields": "false"}))
    rows = runs.select("project_id", F.unix_micros("ts").alias("at"), fp.alias("fp"), F.to_json(F.struct(*runs.columns), _JSON).alias("payload"))
    own = F.array(F.pmod(F.xxhash64("fp"), F.lit(buckets)).cast("int"))
    every = F.array(*[F.lit(i) for i in range(buckets)])
    rows = rows.withColumn("bucket", F.explode(F.when(F.col("fp").isNull(), every).otherwise(own)))
    changes = rows.groupBy("project_id", "bucket").transformWithStateInPandas(
        Changes(hours), "change string, run int, payload string", "Append", "None" if hours is None else "ProcessingTime"
    )
    return changes.select(F.from_json("payload", runs.schema, _JSON).alias("r"), "change", "run").select("r.*", "change", "run")


_VERSION = "\u0001"


def project_snapshots(
    changes: DataFrame, extract: Callable[[DataFrame], DataFrame], builds: Column | None = None, buckets: int = 8
) -> DataFrame:
    """W3's state: files and imports of every project that a micro-batch touches, as they are after it.

    Input rows are (project_id, path, op, ts, content). ``extract`` runs on changed files
    only, before the state, and must be narrow. Files (with the content of those that
    ``builds`` picks) and imports are map state by (project, bucket of the path); a change
    wakes all buckets of its project. Returns (project_id, kind, path, payload): kind
    ``file`` with its content, or ``import`` with the import row as JSON. Of several
    versions of a file the newest counts, also across micro-batches.
    """
    keyed_state(changes.sparkSession)
    version = F.concat_ws(":", F.lpad(F.unix_micros("ts").cast("string"), 20, "0"), "op", F.hex(F.xxhash64("content")))
    named = changes.withColumn("version", version)
    kept = F.when(builds, F.col("content")) if builds is not None else F.lit(None).cast("string")
    files = named.select("project_id", F.lit("file").alias("kind"), "path", "version", (F.col("op") == "remove").alias("gone"), kept.alias("payload"))
    # extraction hands the project on, and with it the version
    tagged = named.where("op <> 'remove'").withColumn("project_id", F.concat("project_id", F.lit(_VERSION), "version"))
    found = extract(tagged.drop("version", "op", "ts"))
    project = F.substring_index("project_id", _VERSION, 1)
    imports = found.withColumns({"version": F.substring_index("project_id", _VERSION, -1), "project_id": project})
    payload = F.to_json(F.struct(*found.columns), _JSON)
    imports = imports.select("project_id", F.lit("import").alias("kind"), F.col("source_file").alias("path"), "version", F.lit(False).alias("gone"), payload.alias("payload"))
    rows = files.unionByName(imports).withColumn("bucket", _bucket("path", buckets))
    others = F.filter(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: b != F.col("bucket"))
    touches = files.withColumn("bucket", _bucket("path", buckets)).select(
        "project_id", F.lit("touch").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("path", "version")],
        F.lit(False).alias("gone"), F.lit(None).cast("string").alias("payload"), F.explode(others).alias("bucket"),
    )
    return rows.unionByName(touches).groupBy("project_id", "bucket").transformWithStateInPandas(
        Snapshots(), "project_id string, kind string, path string, payload string", "Append", "None"
    )


def incremental_check(
    imports: T.StructType, check: Callable[[DataFrame, DataFrame], DataFrame], out: str
) -> Callable[[DataFrame, int], None]:
    """W3 ``incremental_check``: a ``foreachBatch`` body over ``project_snapshots``.

    ``check(imports, files)`` resolves and judges the projects of the batch alone, so
    imports of unchanged files see a target that was added or removed.
    """

    def body(batch: DataFrame, epoch: int) -> None:
        batch = materialise(batch)
        found = batch.where("kind = 'import'").select(F.from_json("payload", imports, _JSON).alias("r")).select("r.*")
        found = found.withColumn("project_id", F.substring_index("project_id", _VERSION, 1))
        present = batch.where("kind = 'file'").select("project_id", "path", F.col("payload").alias("content"))
        check(found, present).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return body


def refresh(check: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body that judges anew the projects of a tick, given their ids."""

    def body(batch: DataFrame, epoch: int) -> None:
        projects = materialise(batch.select("project_id").distinct())
        check(projects).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return body


def run_available(
    stream: DataFrame,
    checkpoint: str,
    out: str | None = None,
    each: Callable[[DataFrame, int], None] | None = None,
    mode: str = "append",
) -> None:
    """Drain what the source holds now into Parquet or a ``foreachBatch`` body."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", out).start()
    query.awaitTermination()

