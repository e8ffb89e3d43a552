"""Path arithmetic on slash-separated, project-relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.globs import base_name

__all__ = ["base_name", "dir_name", "extension", "stem", "clean_path", "ancestors", "join_path"]


def dir_name(path: Column) -> Column:
    """Everything before the last slash; '' for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Extension with its dot, lower-cased; '' when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def join_path(folder: Column, rest: Column) -> Column:
    """Join two relative paths."""
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def clean_path(path: Column) -> Column:
    """Fold ``.``, ``..`` and empty segments of a relative path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."),
            F.slice(acc, F.lit(1), F.size(acc) - 1),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")


def ancestors(path: Column) -> Column:
    """All proper parent directories of a path, shortest first."""
    parts = F.split(path, "/")
    steps = F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, 1 << 20)
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
