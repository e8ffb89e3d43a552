"""Ordered scans over groups of any size.

A plain window sorts one whole group inside one task, which fails when a single
project holds a third of the table. Here rows are range-partitioned by
(group, order), so a hot group spreads over many tasks; each partition computes
its local result, one small summary row per (group, partition) carries the
running state across, and the two are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.session import materialise

_PID, _POS, _TIE = "_chunk", "_pos", "_tie"


def _chunked(df: DataFrame, keys: list[str], order: list[str], unique: bool) -> DataFrame:
    """Rows with the number of their range chunk and a position inside it, as a written table.

    The chunk number depends on sampled range bounds, so it is pinned before
    anything reads it twice. Copies of one row compare equal and would all fall
    into one range; a row number pinned by a first write tells them apart.
    """
    by = [*keys, *order]
    if not unique:
        df = materialise(df.withColumn(_TIE, F.monotonically_increasing_id()))
        by.append(_TIE)
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialise(
        spread.withColumn(_PID, F.spark_partition_id()).withColumn(_POS, F.monotonically_increasing_id())
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    position: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add running sums, last-seen values and a row number per group.

    ``sums[name]`` is a running total up to and including the row,
    ``lasts[name]`` the latest non-null value up to and including the row,
    ``position`` the 1-based rank. ``order`` must be a total order (ties must
    be exact copies); ``unique=True`` promises there are no ties at all.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    if position:
        sums[position] = F.lit(1).cast("bigint")
    staged = df
    for name, value in sums.items():
        staged = staged.withColumn(f"_s_{name}", value.cast("bigint"))
    for name, value in lasts.items():
        staged = staged.withColumn(f"_l_{name}", value)
    chunks = _chunked(staged, keys, order, unique)

    totals = chunks.groupBy(*keys, _PID).agg(
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
        *[
            F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col(_POS))).alias(f"_u_{n}")
            for n in lasts
        ],
    )
    before = W.partitionBy(*keys).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        _PID,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_u_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    )
    local = W.partitionBy(*keys, _PID).orderBy(_POS).rowsBetween(W.unboundedPreceding, 0)
    scanned = chunks.select(
        *[F.col(c) for c in df.columns if c not in sums and c not in lasts],
        _PID,
        *[F.sum(f"_s_{n}").over(local).alias(f"_r_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(local).alias(f"_r_{n}") for n in lasts],
    )
    joined = scanned.join(carry, [*keys, _PID], "left")
    kept = [c for c in df.columns if c not in sums and c not in lasts]
    return joined.select(
        *kept,
        *[(F.col(f"_r_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_r_{n}", f"_c_{n}").alias(n) for n in lasts],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based rank of each row inside its group."""
    return running(df, keys, order, position=name)


def set_digest(df: DataFrame, keys: list[str], item: str, name: str = "digest") -> DataFrame:
    """Order-independent digest of all ``item`` values of a group, copies counted.

    Each item's SHA-256 falls into sixteen 16-bit words; the digest is the SHA-256 of
    the sixteen sums and the number of items. The same formula holds for any size:
    sums combine before the shuffle and no task ever holds a list of items. Null items
    count like the empty one.
    """
    word = [F.conv(F.substring("_h", 1 + 4 * i, 4), 16, 10).cast("bigint") for i in range(16)]
    sums = [F.sum(w).cast("string").alias(f"_w{i}") for i, w in enumerate(word)]
    totals = (
        df.select(*keys, F.sha2(F.coalesce(F.col(item), F.lit("")), 256).alias("_h"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).cast("string").alias("_n"), *sums)
    )
    parts = ["_n", *[f"_w{i}" for i in range(16)]]
    return totals.select(*keys, F.sha2(F.concat_ws(":", *parts), 256).alias(name))


def since_last(
    df: DataFrame, keys: list[str], order: list[str], marked: Column, name: str
) -> DataFrame:
    """Add the number of rows since the last marked row of the group, 0 on a marked one.

    One ordered scan: ranks and the rank of the last mark are carried across chunks
    together. Tied rows stand in one order, the same for both; (keys, order) should be
    unique where that order matters.
    """
    chunks = _chunked(df.withColumn("_m", F.coalesce(marked, F.lit(False))), keys, order, unique=True)
    local = W.partitionBy(*keys, _PID).orderBy(_POS).rowsBetween(W.unboundedPreceding, 0)
    ranked = chunks.withColumn("_k", F.sum(F.lit(1)).over(local))
    totals = ranked.groupBy(*keys, _PID).agg(
        F.max("_k").alias("_t"), F.max(F.when(F.col("_m"), F.col("_k"))).alias("_u")
    )
    before = W.partitionBy(*keys).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_c", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .withColumn("_last", F.max(F.col("_c") + F.col("_u")).over(before))
        .select(*keys, _PID, "_c", "_last")
    )
    mark = F.max(F.when(F.col("_m"), F.col("_k"))).over(local)
    scanned = ranked.withColumn("_mark", mark).join(carry, [*keys, _PID], "left")
    rank = F.col("_k") + F.col("_c")
    last = F.coalesce(F.col("_mark") + F.col("_c"), F.col("_last"), F.lit(0))
    return scanned.select(*df.columns, (rank - last).alias(name))
