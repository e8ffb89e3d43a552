"""Report sinks (S10-S14): every report is rows first, files second."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.scoring import severity_columns
from strata.session import materialise

# --- fixed values -----------------------------------------------------------
SCHEMA_VERSION = "1.0"
SARIF_VERSION = "2.1.0"
TITLE_LENGTH = 50
# ----------------------------------------------------------------------------


def report_severity() -> Column:
    """Severity as reports show it: anything unknown is an error."""
    return F.when(F.col("severity").isin("warning", "info"), F.col("severity")).otherwise("error")


def _json_object() -> Column:
    """A violation as JSON."""
    fields = F.struct(
        "id",
        "rule_id",
        report_severity().alias("severity"),
        "file",
        "line",
        "source_layer",
        "target_layer",
        F.col("import_path").alias("import"),
        "message",
        F.when(F.col("overridden"), F.lit(True)).alias("overridden"),
    )
    return F.to_json(fields)


def json_rows(violations: DataFrame) -> DataFrame:
    """S10 ``export_json`` as lines: one JSON object per violation, in any number of part files."""
    return violations.select("project_id", _json_object().alias("payload"))


#: bytes copied at once when parts become one document
_COPY = 1 << 20


def _write_parts(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Payloads of sorted rows into one file per project; a row (project_id, part, path) for each."""
    store, place = pyarrow.fs.FileSystem.from_uri(root)
    part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
    done: list[tuple[str, int, str]] = []
    project, out = None, None
    for batch in batches:
        for owner, payload in zip(batch.column("project_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if out is None or owner != project:
                if out is not None:
                    out.close()
                name = f"part-{part:06d}-{len(done):06d}-{attempt}"
                out, project = store.open_output_stream(f"{place}/{name}"), owner
                done.append((owner, part, f"{place}/{name}"))
            else:
                out.write(b",\n")
            out.write(payload.encode())
    if out is not None:
        out.close()
    columns = list(zip(*done, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["project_id", "part", "path"]
    )


def _join_parts(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Head, parts and tail of each project copied into its document, a piece at a time."""
    store, place = pyarrow.fs.FileSystem.from_uri(root)
    for batch in batches:
        files, sizes = [], []
        rows = [batch.column(c).to_pylist() for c in ("project_id", "head", "tail", "parts")]
        for project, head, tail, parts in zip(*rows, strict=True):
            final = f"{place}/{quote(project, safe='')}.json"
            draft = f"{final}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(head.encode())
                for i, path in enumerate(parts or []):
                    out.write(b",\n" if i else b"\n")
                    with store.open_input_stream(path) as source:
                        while piece := source.read(_COPY):
                            out.write(piece)
                out.write(tail.encode())
                sizes.append(out.tell())
            store.move(draft, final)  # a second attempt replaces the same document
            files.append(final)
        yield pa.RecordBatch.from_arrays([batch.column("project_id"), pa.array(files, pa.string()), pa.array(sizes, pa.int64())], ["project_id", "file", "bytes"])


def json_documents(violations: DataFrame, projects: DataFrame, root: str, work: str) -> DataFrame:
    """S10 ``export_json``: one JSON document per project below ``root``: (project_id, file, bytes).

    ``root`` and ``work`` are URIs of folders that every executor reaches; parts are written
    below ``work`` and are the caller's to delete. Violations are dealt by ranges of
    (project, file, line, id), so a project of any size is written by many tasks, each a
    part in order; the parts, as many as there were tasks at most, are then copied into the
    document without being held. A project without violations has an empty list.
    """
    for folder in (root, work):
        store, place = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
    order = ["project_id", "file", "line", "id"]
    ranged = violations.select(*order, _json_object().alias("payload")).where("project_id is not null").repartitionByRange(*order)
    lines = ranged.sortWithinPartitions(*order).select("project_id", "payload")
    parts = materialise(lines.mapInArrow(lambda b: _write_parts(b, work), "project_id string, part int, path string"))
    listed = parts.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("part", "path"))).getField("path").alias("parts"))
    overridden = F.count(F.when(F.col("overridden"), 1)).alias("overridden_count")
    counts = violations.groupBy("project_id").agg(*severity_columns(), overridden)
    body = F.struct("total", "errors", "warnings", "info", "overridden_count")
    each = projects.select("project_id").where("project_id is not null").distinct().join(counts, "project_id", "left").na.fill(0)
    head = F.lit(f'{{"schema_version":"{SCHEMA_VERSION}","violations":[')
    whole = each.join(listed, "project_id", "left").select(
        "project_id", head.alias("head"), F.concat(F.lit('],"summary":'), F.to_json(body), F.lit("}\n")).alias("tail"), "parts"
    )
    return materialise(whole.mapInArrow(lambda b: _join_parts(b, root), "project_id string, file string, bytes long"))


def json_summary(violations: DataFrame, coupling: DataFrame | None = None) -> DataFrame:
    """S10 summary object per project, with the coupling matrix when given."""
    overridden = F.count(F.when(F.col("overridden"), 1)).alias("overridden_count")
    out = violations.groupBy("project_id").agg(*severity_columns(), overridden)
    body = F.struct("total", "errors", "warnings", "info", "overridden_count")
    if coupling is not None:
        cells = coupling.groupBy("project_id", "from_layer").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("to_layer", "cnt")))).alias("row")
        )
        matrix = cells.groupBy("project_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("from_layer", "row")), _by_name)).alias("coupling_matrix")
        )
        out = out.join(matrix, "project_id", "left")
        return out.select(
            "project_id",
            F.to_json(
                F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), body.alias("summary"), "coupling_matrix")
            ).alias("payload"),
        )
    return out.select(
        "project_id",
        F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), body.alias("summary"))).alias("payload"),
    )


def _by_name(a: Column, b: Column) -> Column:
    return F.when(a["from_layer"] < b["from_layer"], -1).when(a["from_layer"] > b["from_layer"], 1).otherwise(0)


def artifact_path(file: Column) -> Column:
    """File of a location: ``layer (file:line)`` loses its wrapping."""
    inner = F.regexp_extract(file, r"^[^(]*\((.*)\)[^)]*$", 1)
    unclosed = F.regexp_extract(file, r"^[^(]*\((.*)$", 1)
    body = F.when(inner != "", inner).otherwise(unclosed)
    return F.when(file.contains("("), F.regexp_replace(body, r":[^:]*$", "")).otherwise(file)


def sarif_results(violations: DataFrame) -> DataFrame:
    """S11 ``export_sarif``: one result per violation."""
    return violations.select(
        "project_id",
        F.col("rule_id").alias("rule_id"),
        F.when(F.lower("severity") == "warning", "warning").otherwise("error").alias("level"),
        F.col("message").alias("text"),
        artifact_path(F.col("file")).alias("uri"),
        F.col("line").alias("start_line"),
        "source_layer",
        "target_layer",
        "import_path",
    )


def sarif_json(results: DataFrame) -> DataFrame:
    """S11 result objects as JSON lines."""
    location = F.struct(
        F.struct(
            F.struct(F.col("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")
        ).alias("physicalLocation")
    )
    return results.select(
        "project_id",
        F.to_json(
            F.struct(
                F.col("rule_id").alias("ruleId"),
                "level",
                F.struct("text").alias("message"),
                F.array(location).alias("locations"),
                F.struct("source_layer", "target_layer", F.col("import_path").alias("import")).alias("properties"),
            )
        ).alias("payload"),
    )


def junit_cases(violations: DataFrame) -> DataFrame:
    """S12 ``export_junit``: error fails, warning is skipped, anything else passes."""
    outcome = F.when(F.col("severity") == "error", "failure").when(F.col("severity") == "warning", "skipped")
    pair = F.concat("source_layer", F.lit(" → "), "target_layer")
    return violations.select(
        "project_id",
        F.col("id").alias("name"),
        F.col("file").alias("classname"),
        outcome.otherwise("passed").alias("outcome"),
        F.when(F.col("severity").isin("error", "warning"), pair).otherwise("").alias("detail"),
        F.when(F.col("severity") == "error", F.col("message")).otherwise("").alias("body"),
    )


def junit_suite(violations: DataFrame) -> DataFrame:
    """S12 suite counts per project."""
    return violations.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("tests"),
        F.count(F.when(F.col("severity") == "error", 1)).alias("failures"),
        F.count(F.when(F.col("severity") == "warning", 1)).alias("skipped"),
    )


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def junit_lines(cases: DataFrame) -> DataFrame:
    """S12 test cases as XML elements, one per row."""
    detail, body = xml_escape(F.col("detail")), xml_escape(F.col("body"))
    inner = (
        F.when(
            F.col("outcome") == "failure",
            F.concat(F.lit('<failure message="'), detail, F.lit('" type="error">'), body, F.lit("</failure>")),
        )
        .when(F.col("outcome") == "skipped", F.concat(F.lit('<skipped message="'), detail, F.lit('"></skipped>')))
        .otherwise("")
    )
    return cases.select(
        "project_id",
        F.concat(
            F.lit('<testcase name="'),
            xml_escape(F.col("name")),
            F.lit('" classname="'),
            xml_escape(F.col("classname")),
            F.lit('">'),
            inner,
            F.lit("</testcase>"),
        ).alias("value"),
    )


def command_escape(text: Column) -> Column:
    """Escape a CI command value."""
    for raw, safe in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def annotation_lines(violations: DataFrame) -> DataFrame:
    """S13 ``export_annotations``: CI annotation commands."""
    kind = (
        F.when(F.col("severity") == "warning", "warning").when(F.col("severity") == "info", "notice").otherwise("error")
    )
    return violations.select(
        "project_id",
        F.concat(
            F.lit("::"),
            kind,
            F.lit(" file="),
            command_escape(F.col("file")),
            F.lit(",line="),
            F.col("line").cast("string"),
            F.lit(",title="),
            command_escape(F.substring("rule_id", 1, TITLE_LENGTH)),
            F.lit("::"),
            command_escape(F.col("message")),
        ).alias("value"),
    )


def markdown_summary(violations: DataFrame) -> DataFrame:
    """S14 ``export_markdown_summary``: executive summary rows of each project."""
    totals = violations.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("Total Violations"),
        *[
            F.count(F.when(F.lower("severity") == s, 1)).alias(n)
            for s, n in (("error", "Errors"), ("warning", "Warnings"), ("info", "Info"))
        ],
        F.count_distinct("file").alias("Files Affected"),
        F.count_distinct("rule_id").alias("Rules Violated"),
    )
    names = ["Total Violations", "Errors", "Warnings", "Info", "Files Affected", "Rules Violated"]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("metric"), F.col(f"`{n}`").alias("n")) for i, n in enumerate(names)])
    return totals.select("project_id", F.explode(rows).alias("r")).select(
        "project_id",
        F.col("r.ord").alias("ord"),
        F.concat(F.lit("| "), "r.metric", F.lit(" | "), F.col("r.n").cast("string"), F.lit(" |")).alias("value"),
    )


def markdown_pairs(violations: DataFrame) -> DataFrame:
    """S14 layer-pair table rows."""
    counts = violations.groupBy("project_id", "source_layer", "target_layer").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "project_id",
        F.concat(
            F.lit("| "), "source_layer", F.lit(" → "), "target_layer", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")
        ).alias("value"),
    )


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    """Write report lines as text, one folder per project."""
    rows.select("project_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("project_id").text(path)
