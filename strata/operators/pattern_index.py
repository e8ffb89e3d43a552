"""Globs that come from tables, found by the directories of a path.

A pattern that begins with literal directories can only match paths below them. Paths
therefore meet patterns by an equality join on (config, directory), and only what meets
is confirmed. Hot directories are ordinary hot join keys, which adaptive joins split.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.globs import compile_glob
from strata.functions.paths import ancestors


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "head", "anchor", "rx")]))
def _compiled(glob: pd.Series, dialect: pd.Series) -> pd.DataFrame:
    rows = [compile_glob(g, d) for g, d in zip(glob, dialect, strict=True)]
    return pd.DataFrame(rows, columns=["kind", "head", "anchor", "rx"])


def compiled(patterns: DataFrame, glob: str = "glob", dialect: str = "dialect") -> DataFrame:
    """Adds kind, head, anchor and rx to a pattern table; malformed patterns match nothing and go.

    Python sees the configuration only, once per row of it; paths never leave the JVM.
    """
    found = patterns.where(F.col(glob).isNotNull()).withColumn("_c", _compiled(F.col(glob), F.col(dialect)))
    return found.select(*patterns.columns, "_c.*").where("kind <> 'never'")


def matching(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(config, path) rows with each compiled pattern of their config that matches them.

    ``paths`` should be distinct: a path takes part once per directory above it.
    """
    steps = F.array_distinct(F.concat(F.array(F.lit("")), ancestors(F.col("path")), F.array("path")))
    near = paths.select("config", "path", F.explode(steps).alias("anchor")).join(patterns, ["config", "anchor"])
    path, head = F.col("path"), F.col("head")
    hit = (
        F.when(F.col("kind") == "subtree", F.lit(True))
        .when(F.col("kind") == "prefix", path.startswith(head))
        .when(F.col("kind") == "exact", path == head)
        .otherwise(F.regexp_like(path, F.col("rx")))
    )
    return near.where(hit).drop("anchor", "kind", "head", "rx")


def first_layers(paths: DataFrame, layers: DataFrame) -> DataFrame:
    """(config, path, layer) of the paths that a layer table (config, ord, name, paths) places: first listed wins."""
    globs = layers.select("config", "ord", "name", F.explode("paths").alias("glob"), F.lit("layer").alias("dialect"))
    hits = matching(paths, compiled(globs))
    return hits.groupBy("config", "path").agg(F.min_by("name", "ord").alias("layer"))
