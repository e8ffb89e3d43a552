"""Address rules by hashed expressions (operator 8), in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path of an address; both empty without ``://`` and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _folder(path: Column) -> Column:
    """The part of a path up to its last slash."""
    return F.regexp_extract(path, "^(?s:.*)/", 0)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the hash prefix and full digest of their expression.

    The expression is the host and the path up to its last slash; what follows
    the slash is compared as text later. Null hosts, paths and verdicts drop out.
    """
    expression = F.concat(F.translate("host", UPPER, LOWER), _folder(F.col("path")))
    return (
        rules.dropna(subset=["host", "path", "verdict"])
        .where("host <> ''")
        .select(
            F.concat("host", "path").alias("rule"),
            F.col("path").alias("rule_path"),
            F.col("verdict").alias("rule_verdict"),
            (F.length("host") - F.length(F.replace("host", F.lit("."))) + 1).alias("labels"),
            (F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("depth"),
            F.sha2(expression, 256).alias("digest"),
        )
        .distinct()
        .withColumn("prefix", F.substring("digest", 1, 8))
    )


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages`` (url).

    Each distinct address is expanded into its host suffixes times its path
    prefixes, but not beyond the labels and slashes that any rule has, joined with
    the rules on the first 32 bits of a digest, and confirmed on the whole digest
    and on the rest of the rule's path. The longest rule wins; of equal rules with
    different verdicts the later in the alphabet (block). An address that no
    rule fits gets ``default`` and a null rule.

    A rule fits its host and all subdomains if the address's path starts with the
    rule's; an address without a path fits only rules with an empty path. Null
    addresses and those without ``://`` have an empty host, which no rule fits.
    Every row is returned once, repeated ones too; columns of ``pages`` with the
    names of the added ones are replaced. No rules: everything gets ``default``.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    known = rule_table(rules)
    widest = known.agg(F.max("labels").alias("labels"), F.max("depth").alias("depth")).first()
    labels, depth = widest["labels"] or 0, widest["depth"] or 0
    host, path = host_and_path(F.col("url"))
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    placed = pages.select(*rest, host.alias("host"), path.alias("path"))
    suffixes = F.expr(
        f"""transform(sequence(greatest(1, size(split(host, '[.]')) - {labels - 1}), size(split(host, '[.]'))),
            i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"""
    )
    prefixes = F.expr(
        f"""transform(sequence(0, least({depth}, size(split(path, '/')) - 1)),
            i -> if(i = 0, '', concat(array_join(slice(split(path, '/'), 1, i), '/'), '/')))"""
    )
    addresses = placed.select("host", "path").where("host <> ''").distinct()
    expanded = (
        addresses.withColumn("suffix", F.explode(suffixes))
        .withColumn("folder", F.explode(prefixes))
        .select("host", "path", F.sha2(F.concat("suffix", "folder"), 256).alias("own"))
        .withColumn("prefix", F.substring("own", 1, 8))
    )
    hits = (
        expanded.join(known, "prefix")
        .where((F.col("own") == F.col("digest")) & F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule_verdict", "rule")).alias("best"))
    )
    return placed.join(hits, ["host", "path"], "left").select(
        *rest,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )


SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), placed AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
), rules(rhost, rpath, rverdict) AS (VALUES {", ".join(map(str, RULES))})
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(rverdict, length(rhost || rpath)), 'allow') AS verdict
FROM placed LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""
