"""Audit history as a log of snapshots on partitioned Parquet."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.history import latest_snapshot, retention
from strata.session import materialise

_SAVED = "_saved"


class HistoryStore:
    """S9 ``history_store``: one audit per project and date, the last save wins.

    A date is one partition folder. Saving appends files to the dates it has and touches
    nothing else; reading takes the newest save of each (project, date), and within a save
    the newest ``ts``. ``compact`` drops what later saves replaced, ``delete_old`` what the
    retention no longer keeps; both rewrite only the dates that hold such rows.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, audits: DataFrame) -> None:
        """Append audits (project_id, run_date, ts, ...)."""
        # the rebalance packs a date into few files and still splits a hot date
        (
            audits.withColumn(_SAVED, F.lit(time.time_ns()))
            .hint("rebalance", "run_date")
            .write.mode("append")
            .partitionBy("run_date")
            .parquet(self.path)
        )

    def _log(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def load(self, date: str | None = None) -> DataFrame:
        """All audits, or those of one date (reads one partition)."""
        log = self._log()
        if date is not None:
            log = log.where(F.col("run_date") == F.lit(date).cast("date"))
        rest = [c for c in log.columns if c not in ("project_id", "run_date", "ts", _SAVED)]
        newest = log.groupBy("project_id", "run_date").agg(F.max(F.struct(_SAVED, "ts", *rest)).alias("a"))
        return newest.select("project_id", "run_date", "a.ts", *[F.col(f"a.{c}").alias(c) for c in rest])

    def dates(self) -> DataFrame:
        """Stored dates per project, newest first."""
        return self._log().select("project_id", "run_date").distinct().orderBy("project_id", F.desc("run_date"))

    def latest(self) -> DataFrame:
        """Newest audit of each project."""
        return latest_snapshot(self.load())

    def compact(self) -> None:
        """Leave one row per project on every date that holds replaced ones."""
        rows = self._log().groupBy("project_id", "run_date").agg(F.count(F.lit(1)).alias("n"))
        self._rewrite(rows.where("n > 1").select("run_date").distinct(), self.load())

    def delete_old(self, keep: int = 10) -> int:
        """Delete the audits beyond each project's newest ``keep`` dates; returns how many."""
        dates = self._log().select("project_id", "run_date").distinct()
        gone = materialise(retention(dates, keep).where("not kept").select("project_id", "run_date"))
        n = gone.count()
        if n:
            self._rewrite(gone.select("run_date").distinct(), self.load().join(gone, ["project_id", "run_date"], "left_anti"))
        return n

    def _rewrite(self, dates: DataFrame, rows: DataFrame) -> None:
        """Replace whole dates by ``rows`` of them."""
        dates = materialise(dates)
        # pinned first, since the write replaces what they are read from
        kept = materialise(rows.join(dates, "run_date", "left_semi").withColumn(_SAVED, F.lit(time.time_ns())))
        (
            kept.hint("rebalance", "run_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_date")
            .parquet(self.path)
        )
        # an overwrite leaves a date without rows as it was; one value a day comes here
        empty = dates.join(kept.select("run_date").distinct(), "run_date", "left_anti")
        jvm = self.spark._jvm
        for row in empty.collect():
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/run_date={row.run_date}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.spark.catalog.refreshByPath(self.path)
