"""Configuration objects and table schemas.

Layers, rules and expectations are small, human-written dimensions: they live on
the driver as plain objects and are compiled into Column expressions. Every
fact-sized thing is a DataFrame with a leading ``project_id``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
RULE_TYPES = ("Cannot", "Must", "Can", "MustNotCircular")
SEVERITIES = ("error", "warning", "info")
SEVERITY_WEIGHTS = {"error": 3, "warning": 1, "info": 0}
CIRCULAR_PENALTY = 5
VIOLATING_TYPES = ("Cannot", "MustNotCircular")
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Layer:
    """A named set of path patterns; list order decides first match."""

    name: str
    paths: tuple[str, ...]
    description: str = ""
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Override:
    """Path-scoped change of a rule; ``enabled`` is tri-state."""

    path: str
    severity: str = ""
    enabled: bool | None = None


@dataclass(frozen=True)
class Rule:
    """One dependency rule."""

    id: str
    from_layer: str = ""
    to_layers: tuple[str, ...] = ()
    type: str = "Cannot"
    severity: str = "error"
    explanation: str = ""
    pattern: str = ""
    exclude: tuple[str, ...] = ()
    overrides: tuple[Override, ...] = ()
    template: str = ""
    params: dict[str, Any] = field(default_factory=dict, hash=False)
    check: Any = None

    @property
    def violates(self) -> bool:
        return fold_rule_type(self.type) in VIOLATING_TYPES


@dataclass(frozen=True)
class Config:
    """Layers and rules shared by a fleet of projects."""

    layers: tuple[Layer, ...]
    rules: tuple[Rule, ...] = ()
    exclude: tuple[str, ...] = ()
    max_violations: int = 0


def fold_rule_type(value: str) -> str:
    """Case-insensitive rule type; unknown spellings pass through."""
    return {t.lower(): t for t in RULE_TYPES}.get(value.lower(), value)


def fold_severity(value: str) -> str:
    """Case-insensitive severity; unknown spellings pass through."""
    return value.lower() if value.lower() in SEVERITIES else value


OVERRIDE_TYPE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)

DEPS_SCHEMA = (
    "project_id string, source_file string, source_line int, import_path string, "
    "resolved_layer string, language string"
)
LAYERS_SCHEMA = (
    "project_id string, ord int, name string, paths array<string>, description string, tags array<string>"
)
RULES_SCHEMA = (
    "project_id string, ord int, id string, from_layer string, to_layers array<string>, type string, "
    "severity string, explanation string, pattern string, exclude array<string>, "
    "overrides array<struct<path:string,severity:string,enabled:boolean>>, "
    "template string, params map<string,string>"
)
VIOLATION_COLUMNS = (
    "project_id",
    "rule_ord",
    "rule_id",
    "file",
    "line",
    "source_layer",
    "target_layer",
    "import_path",
    "message",
    "severity",
    "original_severity",
    "overridden",
)


def layers_table(spark: SparkSession, layers: tuple[Layer, ...], project_id: str | None = None) -> DataFrame:
    """The layer dimension as a table (for linting and per-project configs)."""
    rows = [
        (project_id, i, layer.name, list(layer.paths), layer.description, list(layer.tags))
        for i, layer in enumerate(layers, 1)
    ]
    return spark.createDataFrame(rows, LAYERS_SCHEMA)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...], project_id: str | None = None) -> DataFrame:
    """The rule dimension as a table."""
    rows = [
        (
            project_id,
            i,
            r.id,
            r.from_layer,
            list(r.to_layers),
            r.type,
            r.severity,
            r.explanation,
            r.pattern,
            list(r.exclude),
            [(o.path, o.severity, o.enabled) for o in r.overrides],
            r.template,
            {k: v if isinstance(v, str) else json.dumps(v) for k, v in r.params.items()},
        )
        for i, r in enumerate(rules, 1)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)
