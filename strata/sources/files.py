"""File and plugin sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLUGIN_SCHEMA = (
    "capabilities struct<name:string,languages:array<string>,version:string>, "
    "detect struct<detected:boolean>, "
    "extract struct<dependencies:array<struct<source_file:string,source_line:int,"
    "import_path:string,resolved_layer:string>>>, "
    "error struct<message:string>"
)


def scan_corpus(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """S1 ``scan_corpus``: a folder of projects -> (project_id, path, content).

    The first folder below ``root`` is the project. Listing is distributed and
    ``pattern`` prunes files before they are opened. Bytes that are no UTF-8 are
    replaced and the row is flagged in ``decode_error``; no file is lost.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString()
    inner = F.substring("path", len(full.rstrip("/")) + 2, F.length("path"))
    text = F.col("content").cast("string")
    return raw.select(
        F.substring_index(inner, "/", 1).alias("project_id"),
        F.regexp_replace(inner, "^[^/]*/", "").alias("path"),
        F.make_valid_utf8(text).alias("content"),
        (~F.is_valid_utf8(text)).alias("decode_error"),
    )


def plugin_rows(responses: DataFrame, language: Column) -> DataFrame:
    """Explode extractor responses to edges; '' layers become NULL, failed responses give none."""
    return (
        responses.where(F.col("error").isNull())
        .select(
            *[c for c in responses.columns if c not in ("capabilities", "detect", "extract", "error")],
            language.alias("language"),
            F.explode("extract.dependencies").alias("d"),
        )
        .select(
            "project_id",
            "d.source_file",
            "d.source_line",
            "d.import_path",
            F.nullif(F.col("d.resolved_layer"), F.lit("")).alias("resolved_layer"),
            "language",
        )
    )


def read_plugin_json(spark: SparkSession, path: str, project_id: str, language: str) -> DataFrame:
    """S8 ``read_plugin_json``: third-party extractor output, one response per line."""
    rows = spark.read.schema(PLUGIN_SCHEMA).json(path).withColumn("project_id", F.lit(project_id))
    return plugin_rows(rows, F.lit(language))


def parse_plugin_json(texts: DataFrame, column: str, language: Column) -> DataFrame:
    """S8 on a table of JSON texts with a ``project_id``."""
    rows = texts.select("project_id", F.from_json(column, PLUGIN_SCHEMA).alias("r")).select("project_id", "r.*")
    return plugin_rows(rows, language)
