"""Total orders for reports (O1, O2)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sort_deps(deps: DataFrame) -> DataFrame:
    """O1 ``sort_deps``: by source file, then import, then line (range-partitioned global sort)."""
    return deps.orderBy("project_id", "source_file", "import_path", "source_line")


def sort_violations(violations: DataFrame) -> DataFrame:
    """O2 ``sort_violations``: by file, then line, then rule order."""
    return violations.orderBy("project_id", "file", "line", "rule_ord")
