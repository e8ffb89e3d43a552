"""Import extraction (X0-X12, X20-X22): files -> lines -> imports.

Everything is one narrow pass: split content into numbered lines, keep the
lines a language's patterns can match, explode the matches. Block state (Go
import groups) is computed per file from the positions of the few marker
lines, so no window or shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import languages as lg
from strata.functions.globs import any_of
from strata.functions.paths import base_name

BLANKS = " \t\r\n\x0b\x0c"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _all_of(text: Column, patterns) -> Column:
    return F.array_compact(F.array(*[_group(text, p) for p in patterns]))


def _first_of(text: Column, patterns) -> Column:
    return F.array_compact(F.array(F.coalesce(*[_group(text, p) for p in patterns])))


def _none() -> Column:
    return F.array().cast("array<string>")


def _code(text: Column, marker: str) -> Column:
    """Trimmed line without its trailing comment."""
    return trimmed(F.substring_index(trimmed(text), marker, 1))


def file_lines(files: DataFrame, of: Column | None = None) -> DataFrame:
    """X0 ``file_lines``: 1-based numbered lines; with ``of``, those of the files it picks.

    ``of`` may read the content. As a filter it would be pushed to where the content is
    made, which would then be made twice.
    """
    keep = [c for c in files.columns if c != "content"]
    rows = F.split("content", "\n")
    rows = rows if of is None else F.when(of, rows)
    return files.select(*keep, F.posexplode(rows).alias("_pos", "text")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "text"
    )


def go_blocks(content: Column, open_rx: str, close_rx: str) -> Column:
    """Line ranges of import groups: array of (opens, closes), exclusive."""
    rows = F.transform(F.split(content, "\n"), lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    opens = F.transform(F.filter(rows, lambda r: r["t"].rlike(open_rx)), lambda r: r["i"] + 1)
    closes = F.transform(F.filter(rows, lambda r: r["t"].rlike(close_rx)), lambda r: r["i"] + 1)
    return F.transform(
        opens,
        lambda o: F.struct(
            o.alias("opens"),
            F.coalesce(F.array_min(F.filter(closes, lambda c: c > o)), F.lit(1 << 30)).alias("closes"),
        ),
    )


def in_block(blocks: Column, line_no: Column) -> Column:
    return F.exists(blocks, lambda b: (line_no > b["opens"]) & (line_no < b["closes"]))


def go_first_decl(content: Column) -> Column:
    """Line number of the first non-import declaration."""
    rows = F.transform(F.split(content, "\n"), lambda t, i: F.when(t.rlike(lg.GO_DECL), i + 1))
    return F.coalesce(F.array_min(rows), F.lit(1 << 30))


def extract_go(text: Column, inside: Column) -> Column:
    """X1 ``extract_go``: single, grouped and aliased imports."""
    return F.when(inside, _all_of(text, [lg.GO_BLOCK])).otherwise(_all_of(text, [lg.GO_SINGLE]))


def extract_typescript(text: Column) -> Column:
    """X2 ``extract_typescript``: type import alone, else every other form once."""
    other = F.array_distinct(_all_of(text, [lg.TS_FROM, lg.TS_REQUIRE, lg.TS_EXPORT, lg.TS_DYNAMIC]))
    kind = _group(text, lg.TS_TYPE)
    return F.when(trimmed(text).startswith("//"), _none()).when(kind.isNotNull(), F.array(kind)).otherwise(other)


def extract_python(text: Column) -> Column:
    """X3 ``extract_python``: a relative ``from`` matches two patterns and counts twice."""
    line = trimmed(text)
    return F.when(line.startswith("#") | (line == ""), _none()).otherwise(_all_of(line, lg.PY_IMPORTS))


def extract_java(text: Column) -> Column:
    """X4 ``extract_java``: standard, static, wildcard."""
    return _all_of(text, lg.JAVA_IMPORTS)


def extract_kotlin(text: Column) -> Column:
    """X5 ``extract_kotlin``: wildcard, then alias, then standard."""
    return _first_of(text, lg.KOTLIN_IMPORTS)


def extract_rust(text: Column) -> Column:
    """X6 ``extract_rust``: pub use, crate, self, super, plain."""
    line = trimmed(text)
    return F.when(line.startswith("//") | line.startswith("#"), _none()).otherwise(
        _first_of(_code(text, "//"), lg.RUST_IMPORTS)
    )


def extract_csharp(text: Column) -> Column:
    """X7 ``extract_csharp``: alias, static, standard."""
    line = trimmed(text)
    skip = line.startswith("//") | line.startswith("/*") | line.startswith("*")
    return F.when(skip, _none()).otherwise(
        F.transform(_first_of(_code(text, "//"), lg.CSHARP_IMPORTS), trimmed)
    )


def extract_ruby(text: Column) -> Column:
    """X8 ``extract_ruby``: relative, all, expand_path, plain."""
    line = trimmed(text)
    return F.when(line.startswith("#"), _none()).otherwise(_first_of(_code(text, "#"), lg.RUBY_IMPORTS))


def extract_php(text: Column) -> Column:
    """X9 ``extract_php``: alias, function, const, class, require_once."""
    line = trimmed(text)
    found = _first_of(_code(text, "//"), lg.PHP_IMPORTS)
    return F.when(line.startswith("//") | line.startswith("#"), _none()).otherwise(
        F.transform(found, lambda p: F.regexp_replace(p, "^/", ""))
    )


def extract_swift(text: Column) -> Column:
    """X10 ``extract_swift``: exported, member, plain."""
    line = trimmed(text)
    return F.when(line.startswith("//"), _none()).otherwise(_first_of(_code(text, "//"), lg.SWIFT_IMPORTS))


EXTRACTORS = {
    "typescript": extract_typescript,
    "python": extract_python,
    "java": extract_java,
    "kotlin": extract_kotlin,
    "rust": extract_rust,
    "csharp": extract_csharp,
    "ruby": extract_ruby,
    "php": extract_php,
    "swift": extract_swift,
}

# --- fixed values: a line must contain one of these to hold an import ---------
HINTS = {
    "go": ('"',),
    "typescript": ("import", "require", "export"),
    "python": ("import",),
    "java": ("import",),
    "kotlin": ("import",),
    "rust": ("use",),
    "csharp": ("using",),
    "ruby": ("require",),
    "php": ("use", "require_once"),
    "swift": ("import",),
}
# --------------------------------------------------------------------------------


def _may_import(language: str) -> Column:
    """Can a file of the language hold an import at all?"""
    content = F.col("content")
    held = any_of([content.contains(h) for h in HINTS[language]])
    # a Go import is single or in a group, both of which say so
    return held & content.contains("import") if language == "go" else held


def extract_imports(files: DataFrame, languages: tuple[str, ...] = lg.LANGUAGES) -> DataFrame:
    """All languages in one pass: (project_id, source_file, source_line, import_path, language).

    ``files`` carries ``language`` (S4). A cheap substring test drops most files before
    they are split, and most lines before any regex runs.
    """
    lang, text, line_no = F.col("language"), F.col("text"), F.col("line_no")
    wanted = files.where(lang.isin(*languages))
    if "go" in languages:
        is_go = (lang == "go") & _may_import("go")
        wanted = wanted.withColumns(
            {
                "_blocks": F.when(is_go, go_blocks(F.col("content"), lg.GO_OPEN, lg.GO_CLOSE)),
                "_decl": F.when(is_go, go_first_decl(F.col("content"))),
            }
        )
    lines = file_lines(wanted, any_of([(lang == k) & _may_import(k) for k in languages]))
    lines = lines.where(any_of([(lang == k) & any_of([text.contains(h) for h in HINTS[k]]) for k in languages]))
    branches = [F.when(lang == k, fn(text)) for k, fn in EXTRACTORS.items() if k in languages]
    if "go" in languages:
        go = F.when(line_no < F.col("_decl"), extract_go(text, in_block(F.col("_blocks"), line_no)))
        branches.append(F.when(lang == "go", go))
    return lines.withColumn("import_path", F.explode(F.coalesce(*branches, _none()))).select(
        "project_id",
        F.col("path").alias("source_file"),
        F.col("line_no").alias("source_line"),
        "import_path",
        "language",
    )


def extract_declared_unit(files: DataFrame) -> DataFrame:
    """X11 ``extract_declared_unit``: first package, namespace or module a file declares.

    The declaration is found inside the file row itself: no line explode.
    """
    rows = F.split("content", "\n")

    def first_unit(pattern: str) -> Column:
        units = F.transform(rows, lambda t: _group(t, pattern))
        return F.get(F.filter(units, lambda u: u.isNotNull()), F.lit(0))

    options = [
        F.when(F.col("language") == k, first_unit(p.declares)) for k, p in lg.PROFILES.items() if p.declares
    ]
    return files.select("project_id", "path", "language", F.coalesce(*options).alias("unit")).where("unit is not null")


def import_scan(files: DataFrame) -> DataFrame:
    """X12 ``import_scan``: light scan of Go and TypeScript/JavaScript; first form wins."""
    path, text, line_no = F.col("path"), F.col("text"), F.col("line_no")
    lang = F.coalesce(
        *[
            F.when(any_of([path.endswith(e) for e in exts]), F.lit(k))
            for k, exts in lg.SCAN_EXTENSIONS.items()
        ]
    )
    kept = files.withColumn("language", lang).where(
        F.col("language").isNotNull() & ~any_of([path.startswith(d) for d in lg.SCAN_SKIP])
    )
    kept = kept.withColumn(
        "_blocks", F.when(F.col("language") == "go", go_blocks(F.col("content"), r"^import \(", r"^\)"))
    )
    lines = file_lines(kept).where(text.contains('"') | text.contains("'"))
    inside = in_block(F.col("_blocks"), line_no)
    go = F.when(inside, _group(text, lg.SCAN_GO_BLOCK)).otherwise(_group(text, lg.SCAN_GO_SINGLE))
    ts = F.coalesce(*[_group(text, p) for p in lg.SCAN_TS])
    return (
        lines.withColumn("import_path", F.when(F.col("language") == "go", go).otherwise(ts))
        .where("import_path is not null")
        .select("project_id", path.alias("file"), line_no.alias("line"), "import_path", "language")
    )


def generated_header(files: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """X20 ``generated_header``: files whose first line holds a header pattern.

    A custom list replaces the default one; only the first line is cut out.
    """
    first = F.substring_index(F.col("content"), "\n", 1)
    return files.where(any_of([first.contains(p) for p in (patterns or lg.GENERATED_HEADERS)]))


#: lines of a hunk counted one after the other; their blocks are counted likewise
_BLOCK = 64
_HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def _hunk_lines(diffs: DataFrame, marks: bool = False) -> DataFrame:
    """(project_id, pr, file, old_start, new_start, lines): a row per hunk, all found inside the diff's row.

    With ``marks`` lines may come as their first character alone.
    """
    keys = ["project_id", "pr"]
    sections = diffs.select(*keys, F.explode(F.split("text", r"\n(?=diff --git )")).alias("section"))
    head = F.substring_index("section", "\n", 1)
    name = F.when(
        head.startswith("diff --git "), F.regexp_replace(F.substring_index(head, " ", -1), "^b/", "")
    ).otherwise("")
    # the first character tells a line's side; heads of hunks begin with @
    section = F.regexp_replace("section", r"\n([^@\n])[^\n]*", "\n$1") if marks else F.col("section")
    hunks = sections.select(*keys, name.alias("file"), F.explode(F.split(section, r"\n(?=@@)")).alias("hunk"))
    # patterns meet the hunk's first line alone
    top = F.substring_index("hunk", "\n", 1)
    return hunks.where(top.rlike(_HUNK)).select(
        *keys,
        "file",
        *[F.regexp_extract(top, _HUNK, i).cast("long").alias(f"{side}_start") for i, side in ((1, "old"), (2, "new"))],
        F.slice(F.split("hunk", "\n"), F.lit(2), F.lit(1 << 30)).alias("lines"),
    )


def _hunks(diffs: DataFrame) -> DataFrame:
    """(project_id, pr, file, lines, seen): a row per hunk.

    ``seen`` holds for every line the old and new line number at which it stands, as
    old * 2**32 + new.
    """
    start = F.shiftleft("old_start", 32) + F.col("new_start")
    return _hunk_lines(diffs).select("project_id", "pr", "file", "lines", _counted(F.col("lines"), start).alias("seen"))


def _counted(lines: Column, start: Column) -> Column:
    """Counters before every line: running sums by blocks, then by lines of a block.

    Arrays grow by one element a step, so blocks keep the work close to linear in long
    hunks. A one-element ``transform`` binds what is used more than once.
    """
    old = F.lit(1 << 32)
    step = F.transform(
        lines, lambda t: F.when(t.startswith("+"), F.lit(1).cast("long")).when(t.startswith("-"), old).otherwise(old + 1)
    )
    block = F.expr(f"sequence(0, int((size(lines) - 1) / {_BLOCK}))")

    def bind(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def sums(steps: Column, first: Column) -> Column:
        return F.aggregate(steps, F.array(first), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def by_blocks(steps: Column) -> Column:
        cut = F.transform(block, lambda i: F.slice(steps, i * _BLOCK + 1, F.lit(_BLOCK)))
        return bind(cut, lambda b: bind(
            sums(F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda t, v: t + v)), start),
            lambda first: F.flatten(F.transform(b, lambda x, i: F.slice(sums(x, F.get(first, i)), F.lit(1), F.size(x)))),
        ))

    return F.when(F.size(lines) > 0, bind(step, by_blocks))


def parse_diff(diffs: DataFrame) -> DataFrame:
    """X21 ``parse_diff``: unified diff text -> (file, old_line, new_line, content).

    Input (project_id, pr, text). Sections, hunks and line counters are found inside the
    row: nothing is shuffled or sorted.
    """
    lines = _hunks(diffs).select(
        "project_id", "pr", "file", F.inline(F.arrays_zip(F.col("seen").alias("seen"), F.col("lines").alias("content")))
    )
    added, removed = F.col("content").startswith("+"), F.col("content").startswith("-")
    return lines.select(
        "project_id",
        "pr",
        "file",
        F.when(added, 0).otherwise(F.shiftright("seen", 32).cast("int")).alias("old_line"),
        F.when(removed, 0).otherwise(F.col("seen").bitwiseAND((1 << 32) - 1).cast("int")).alias("new_line"),
        "content",
    )


def diff_files(diffs: DataFrame) -> DataFrame:
    """X21 by file: (project_id, pr, file, kept, cut, added), one row per file of a change.

    ``kept``: a line stands on the new side; ``cut``: a line is removed; ``added``: the
    new numbers of added lines. Lines become numbers inside their row before the shuffle:
    a side's lines are numbered by their place among them, so nothing is summed up.
    """
    added, removed = (lambda t: t.startswith("+")), (lambda t: t.startswith("-"))
    new_side = F.filter("lines", lambda t: ~removed(t))
    number = F.transform(new_side, lambda t, i: F.when(added(t), (F.col("new_start") + i).cast("int")))
    # only a side that starts at 0 has a line numbered 0
    gone = F.transform(F.filter("lines", lambda t: ~added(t)), lambda t, i: removed(t) & (F.col("old_start") + i > 0))
    kept = F.when(F.col("new_start") > 0, F.exists("lines", lambda t: ~removed(t))).otherwise(F.size(new_side) > 1)
    cut = F.when(F.col("old_start") > 0, F.exists("lines", removed)).otherwise(F.exists(gone, lambda x: x))
    return (
        _hunk_lines(diffs, marks=True)
        .select(
            "project_id",
            "pr",
            "file",
            kept.alias("kept"),
            cut.alias("cut"),
            F.filter(number, lambda n: n > 0).alias("added"),
        )
        .groupBy("project_id", "pr", "file")
        .agg(F.max("kept").alias("kept"), F.max("cut").alias("cut"), F.array_distinct(F.flatten(F.collect_list("added"))).alias("added"))
    )


def diff_stats(diffs: DataFrame) -> DataFrame:
    """X22 ``diff_stats``: files, insertions and deletions per change.

    Counted inside each diff row: nothing is exploded, sorted or shuffled.
    """
    lines = F.split("text", "\n")
    names = F.transform(
        F.filter(lines, lambda t: t.startswith("diff --git ")),
        lambda t: F.regexp_replace(F.substring_index(t, " ", -1), "^b/", ""),
    )
    hunks = F.flatten(
        F.transform(
            F.split("text", r"\n(?=diff --git )"),
            lambda s: F.filter(
                F.split(s, r"\n(?=@@)"), lambda h: h.rlike(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")
            ),
        )
    )
    body = F.flatten(F.transform(hunks, lambda h: F.split(h, "\n")))
    return diffs.select(
        "project_id",
        "pr",
        F.size(F.array_distinct(names)).alias("files"),
        F.size(F.filter(body, lambda t: t.startswith("+"))).alias("insertions"),
        F.size(F.filter(body, lambda t: t.startswith("-"))).alias("deletions"),
    )


def file_stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)
