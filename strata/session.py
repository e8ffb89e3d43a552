"""Session helpers: runtime tuning and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive settings every plan here relies on: hot join keys are split at run
# time and small sides are broadcast only after Spark has measured them.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # join partitions measured below this size hash instead of sorting
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
}

# Plans here are built from many small Columns; recording the call site of each
# one costs more than planning them. Static, so only a new session can set it.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume and send the package to workers."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return ship(spark)


def build_session(app: str = "strata", master: str | None = None, **settings: str) -> SparkSession:
    """Create (or get) a session with the runtime settings applied."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **STATIC_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, from ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a fresh local folder; a
    cluster without the setting is an error, since executors could not read
    each other's files.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-strata-")
    spark.sparkContext.setCheckpointDir(configured)
    return jsc.getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage by a written table in the shared folder.

    Parquet rather than a row checkpoint: later reads are column-pruned and
    carry size statistics, so joins against the result can be planned on facts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OPEN: list[Scratch] = []


def _close_open() -> None:
    for scratch in list(_OPEN):
        try:
            scratch.close()
        except Exception:  # noqa: BLE001 - the session may be gone, and with it the way to the folder
            _OPEN.clear()
            return


@contextmanager
def closing() -> Iterator[None]:
    """Close, on leaving, the owners that were made inside."""
    before = list(_OPEN)
    try:
        yield
    finally:
        for scratch in [x for x in _OPEN if x not in before]:
            scratch.close()


class Scratch:
    """Owner of the tables that one job writes to the shared folder.

    ``table`` writes and rereads, ``drop`` deletes one table as soon as no later
    plan reads it, ``close`` (or leaving the ``with`` block) deletes the rest.
    What a lazy result still reads must stay until that result has been written; an
    owner that nobody closes is closed when the program ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        if not _OPEN:
            atexit.register(_close_open)
        _OPEN.append(self)

    def path(self, name: str) -> str:
        """A fresh path below this owner's folder."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(read)] = path
        return read

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self._paths.pop(id(table), None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        self._paths.clear()
        if self in _OPEN:
            _OPEN.remove(self)
        _delete(self.spark, self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_strata_shipped", False):
        return spark
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # the driver serves this file to executors until the application ends
    folder = tempfile.mkdtemp(prefix="strata-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "strata-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(os.path.join(root, "strata")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    context._strata_shipped = True
    return spark
