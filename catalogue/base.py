"""Query registry and the shared SQL building blocks of the oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BLOCKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under an operator id, with its oracle when SQL can say it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_blocks(sql)
        return fn

    return register


def digest_sql(hashes: str) -> str:
    """SQL twin of ``set_digest`` over a column of hex SHA-256 values."""
    words = ", ".join(f"sum(CAST('0x' || substr({hashes}, {1 + 4 * i}, 4) AS BIGINT))" for i in range(16))
    return f"sha256(concat_ws(':', count(*), {words}))"


def block(name: str, sql: str) -> None:
    """Define a named sub-query oracles may read."""
    BLOCKS[name] = sql.strip()


def with_blocks(sql: str) -> str:
    """Prefix a statement with the blocks it reads, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(BLOCKS[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in order) + "\n" + sql.strip()
