"""Extension points: user extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.languages import LANGUAGES

IMPORTS_SCHEMA = "project_id string, source_file string, source_line int, import_path string, language string"


@dataclass(frozen=True)
class Extractor:
    """A language's extractor: which files apply, and files -> imports."""

    name: str
    applies: Callable[[DataFrame], DataFrame]
    extract: Callable[[DataFrame], DataFrame]


class ExtractorRegistry:
    """P1 ``register_extractor``: extractors beyond the built-in languages.

    One faulty extractor is reported in ``status`` and the others still run.
    """

    def __init__(self) -> None:
        self._extractors: dict[str, Extractor] = {}
        self.status: dict[str, str] = {}

    def register(self, extractor: Extractor) -> None:
        if not extractor.name:
            raise ValueError("extractor needs a name")
        if extractor.name in LANGUAGES or extractor.name in self._extractors:
            raise ValueError(f"extractor {extractor.name!r} already exists")
        self._extractors[extractor.name] = extractor

    def run(self, files: DataFrame) -> DataFrame | None:
        """Imports of all registered extractors; planning errors go to ``status``."""
        found = self._planned(files)
        out = None
        for rows in found.values():
            kept = rows.where("error is null").drop("error") if "error" in rows.columns else rows
            out = kept if out is None else out.unionByName(kept)
        return out

    def failures(self, files: DataFrame) -> DataFrame | None:
        """What went wrong while running: (project_id, language, source_file, source_line, error).

        The input of G13's failures. Extractors whose rows have an ``error`` column
        report there; ``line_extractor`` does.
        """
        out = None
        for rows in self._planned(files).values():
            if "error" in rows.columns:
                bad = rows.where("error is not null").select("project_id", "language", "source_file", "source_line", "error")
                out = bad if out is None else out.unionByName(bad)
        return out

    def _planned(self, files: DataFrame) -> dict[str, DataFrame]:
        planned = {}
        for name, extractor in self._extractors.items():
            try:
                rows = extractor.extract(extractor.applies(files))
                extra = [c for c in rows.columns if c == "error"]
                planned[name] = rows.select(
                    "project_id", "source_file", "source_line", "import_path", F.lit(name).alias("language"), *extra
                )
            except Exception as error:  # isolation: report and go on
                self.status[name] = f"error: {type(error).__name__}"
                continue
            self.status[name] = "ok"
        return planned


def line_extractor(parse: Callable[[str], list[str]]) -> Callable[[DataFrame], DataFrame]:
    """Lift a Python line parser to a DataFrame extractor over Arrow batches.

    The lines arrive exploded, so one batch never holds a whole large file. A line
    that makes the parser fail gives a row with the name of the error and no import.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_parsed(parse, text) for text in frame["text"]]
            rows = frame.assign(import_path=[x for x, _ in found], error=[e for _, e in found]).explode("import_path")
            rows = rows[rows["import_path"].notna() | rows["error"].notna()]
            yield rows[["project_id", "source_file", "source_line", "import_path", "error"]]

    def extract(files: DataFrame) -> DataFrame:
        from strata.operators.extraction import file_lines

        lines = file_lines(files.select("project_id", F.col("path").alias("source_file"), "content")).withColumnRenamed(
            "line_no", "source_line"
        )
        schema = "project_id string, source_file string, source_line int, import_path string, error string"
        return lines.mapInPandas(batches, schema)

    return extract


def _parsed(parse: Callable[[str], list[str]], text: str) -> tuple[list[str], str | None]:
    try:
        return list(parse(text)), None
    except Exception as error:
        return [], type(error).__name__
