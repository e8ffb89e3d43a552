"""Queries over the source corpus: filters, extraction, resolution, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.base import block, digest_sql, query
from strata.functions import languages as lg
from strata.operators import corpus as cp
from strata.operators import diffs, extraction, layers, resolution, rules, scoring
from strata.operators.registry import Extractor, ExtractorRegistry, line_extractor
from strata.operators.resolution import Mapping
from strata.plans.check import build_deps
from strata.sources.adapters import (
    ALIASES,
    BUILD_FILES,
    CORPUS,
    CORPUS_LAYERS,
    LINES,
    PATHS,
    diffs_from_documents,
    files_from_documents,
    table,
)
from strata.sources.files import parse_plugin_json, scan_corpus
from strata.session import materialise

# --- the corpus in SQL -------------------------------------------------------------


def _q(text: str) -> str:
    """A SQL string literal; control characters by code."""
    out = "'" + text.replace("'", "''") + "'"
    for raw, code in (("\n", 10), ("\t", 9)):
        out = out.replace(raw, f"' || chr({code}) || '")
    return "(" + out + ")"


def _layer_of(number: str) -> str:
    return f"['domain', 'application', 'infrastructure', 'presentation'][CAST(floor({number} / 10) AS BIGINT) % 4 + 1]"


def _cap(text: str) -> str:
    return f"upper(substr({text}, 1, 1)) || substr({text}, 2)"


def _filled(template: str) -> str:
    out = _q(template)
    for key in ("w", "T", "l", "c", "m"):
        out = f"replace({out}, '{{{key}}}', v_{key})"
    return out


def _line_sql() -> str:
    arms = []
    for n, language in enumerate(lg.LANGUAGES):
        options = LINES[language]
        inner = " ".join(f"WHEN {i} THEN {_filled(t)}" for i, t in enumerate(options))
        arms.append(f"WHEN kind = {n} THEN CASE i % {len(options)} {inner} END")
    return "CASE " + " ".join(arms) + " END"


def _path_sql() -> str:
    arms = []
    for n, language in enumerate(lg.LANGUAGES):
        where, name, ext, test = PATHS[language]
        head = f"replace(replace('{where}', '{{m}}', own), '{{k}}', {_cap('own')})"
        arms.append(
            f"WHEN kind = {n} THEN {head} || '/{name}' || doc_id || CASE WHEN doc_id % 53 = 5 THEN '{test}' ELSE '{ext}' END"
        )
    return "CASE WHEN doc_id % 97 = 3 THEN 'vendor/' ELSE '' END || CASE " + " ".join(arms) + " END"


block(
    "c_text",
    f"""
SELECT doc_id, lang, kind, own, i, t, CASE WHEN w = '' THEN 'w' ELSE lower(w) END AS v_w, CAST(target AS VARCHAR) AS v_T,
       {_layer_of('target')} AS v_l, {_cap(_layer_of('target'))} AS v_c, own AS v_m
FROM (SELECT *, regexp_extract(t, '[A-Za-z]+') AS w, greatest(doc_id + 10 * (i % 3 - 1), kind) AS target
      FROM (SELECT doc_id, lang, doc_id % 10 AS kind, {_layer_of('doc_id')} AS own,
                   unnest(string_split(text, chr(10))) AS t,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))
""",
)
block(
    "c_source",
    f"SELECT lang AS project_id, any_value({_path_sql()}) AS path, string_agg({_line_sql()}, chr(10) ORDER BY i) AS content FROM c_text GROUP BY lang, doc_id",
)
block(
    "c_gen",
    "SELECT lang AS project_id, 'gen/d' || doc_id || '.pb.go' AS path, CASE WHEN n_chars % 2 = 0 THEN '// Code generated by protoc-gen-go. DO NOT EDIT.' "
    "ELSE '// by hand' END || chr(10) || text AS content FROM documents",
)
block(
    "c_builds",
    "SELECT project_id, path, content FROM (VALUES "
    + ", ".join(f"('{k}', '{p}', {_q(c)})" for k, v in BUILD_FILES.items() for p, c in v)
    + ") b(project_id, path, content) WHERE project_id IN (SELECT lang FROM documents)",
)
block("c_files", "SELECT * FROM c_source UNION ALL SELECT * FROM c_gen UNION ALL SELECT * FROM c_builds")


def _any_dir(names) -> str:
    return "(" + " OR ".join(f"('/' || path) LIKE '%/{n}/%'" for n in names) + ")" if names else "false"


def _lang_sql() -> str:
    arms = []
    for name, profile in lg.PROFILES.items():
        keep = "(" + " OR ".join(f"ends_with(path, '{e}')" for e in profile.extensions) + ")"
        tests = [f"NOT ends_with(path, '{s}')" for s in profile.test_suffixes]
        arms.append(f"WHEN {' AND '.join([keep, *tests, 'NOT ' + _any_dir(profile.skip_dirs)])} THEN '{name}'")
    return "CASE " + " ".join(arms) + " END"


block("c_src", f"SELECT * FROM (SELECT *, {_lang_sql()} AS language FROM c_files) WHERE language IS NOT NULL")
block(
    "c_lines",
    "SELECT project_id, path, language, unnest(string_split(content, chr(10))) AS text, "
    "CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no FROM c_src",
)
WS = "' ' || chr(9) || chr(13)"


def _rx(column: str, pattern: str) -> str:
    return f"nullif(regexp_extract({column}, '{pattern.replace(chr(39), chr(39) * 2)}', 1), '')"


def _list(column: str, patterns) -> str:
    return f"list_filter([{', '.join(_rx(column, p) for p in patterns)}], lambda x: x IS NOT NULL)"


def _one(column: str, patterns) -> str:
    return f"list_filter([coalesce({', '.join(_rx(column, p) for p in patterns)})], lambda x: x IS NOT NULL)"


block(
    "c_marks",
    f"""
SELECT *, trim(text, {WS}) AS line, trim(string_split(trim(text, {WS}), '//')[1], {WS}) AS code,
       trim(string_split(trim(text, {WS}), '#')[1], {WS}) AS rcode,
       max(CASE WHEN regexp_matches(text, '{lg.GO_OPEN}') THEN line_no END) OVER w AS last_open,
       max(CASE WHEN regexp_matches(text, '{lg.GO_CLOSE}') THEN line_no END) OVER w AS last_close,
       regexp_matches(text, '{lg.GO_CLOSE}') AS closes,
       min(CASE WHEN regexp_matches(text, '{lg.GO_DECL}') THEN line_no END) OVER (PARTITION BY project_id, path) AS first_decl
FROM c_lines WINDOW w AS (PARTITION BY project_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
)
block(
    "c_found",
    f"""
SELECT project_id, path, line_no, language, unnest(CASE language
  WHEN 'go' THEN CASE WHEN line_no >= coalesce(first_decl, 1000000000) THEN []
       WHEN last_open > coalesce(last_close, 0) AND NOT closes THEN {_list('text', [lg.GO_BLOCK])} ELSE {_list('text', [lg.GO_SINGLE])} END
  WHEN 'typescript' THEN CASE WHEN starts_with(line, '//') THEN [] WHEN {_rx('text', lg.TS_TYPE)} IS NOT NULL THEN [{_rx('text', lg.TS_TYPE)}]
       ELSE list_distinct({_list('text', [lg.TS_FROM, lg.TS_REQUIRE, lg.TS_EXPORT, lg.TS_DYNAMIC])}) END
  WHEN 'python' THEN CASE WHEN starts_with(line, '#') OR line = '' THEN [] ELSE {_list('line', lg.PY_IMPORTS)} END
  WHEN 'java' THEN {_list('text', lg.JAVA_IMPORTS)}
  WHEN 'kotlin' THEN {_one('text', lg.KOTLIN_IMPORTS)}
  WHEN 'rust' THEN CASE WHEN starts_with(line, '//') OR starts_with(line, '#') THEN [] ELSE {_one('code', lg.RUST_IMPORTS)} END
  WHEN 'csharp' THEN CASE WHEN starts_with(line, '//') OR starts_with(line, '/*') OR starts_with(line, '*') THEN [] ELSE {_one('code', lg.CSHARP_IMPORTS)} END
  WHEN 'ruby' THEN CASE WHEN starts_with(line, '#') THEN [] ELSE {_one('rcode', lg.RUBY_IMPORTS)} END
  WHEN 'php' THEN CASE WHEN starts_with(line, '//') OR starts_with(line, '#') THEN [] ELSE {_one('code', lg.PHP_IMPORTS)} END
  WHEN 'swift' THEN CASE WHEN starts_with(line, '//') THEN [] ELSE {_one('code', lg.SWIFT_IMPORTS)} END END) AS import_path
FROM c_marks
""",
)
block(
    "c_imports",
    "SELECT project_id, path AS source_file, line_no AS source_line, import_path, language FROM c_found WHERE import_path IS NOT NULL",
)


def _external_sql() -> str:
    arms = []
    for name, profile in lg.PROFILES.items():
        tests = [f"import_path = '{e}'" for e in profile.external_exact]
        tests += [f"starts_with(import_path, '{p}')" for p in profile.external_prefixes]
        if tests:
            arms.append(f"WHEN '{name}' THEN {' OR '.join(tests)}")
    ruby_own = " OR ".join(f"starts_with(import_path, '{p}')" for p in lg.RUBY_INTERNAL)
    ruby_known = " OR ".join(f"import_path = '{p}' OR starts_with(import_path, '{p}/')" for p in lg.RUBY_EXTERNAL)
    arms.append(f"WHEN 'ruby' THEN ({ruby_known}) OR NOT ({ruby_own})")
    php = " OR ".join(f"import_path = '{p}' OR starts_with(import_path, '{p}' || chr(92))" for p in lg.PHP_EXTERNAL)
    arms.append(
        f"WHEN 'php' THEN NOT (starts_with(import_path, './') OR starts_with(import_path, '../')) AND (starts_with(import_path, 'vendor/') OR {php})"
    )
    return "CASE language " + " ".join(arms) + " ELSE false END"


block("c_ext", f"SELECT *, {_external_sql()} AS is_external FROM c_imports")
block(
    "c_alias",
    """
SELECT *, CASE WHEN language <> 'typescript' THEN import_path WHEN import_path = '@app' THEN 'src/application'
  WHEN import_path = '@app/views' THEN 'src/presentation' WHEN import_path = '@domain' THEN 'src/domain'
  WHEN starts_with(import_path, '@app/views/') THEN 'src/presentation/' || substr(import_path, 12)
  WHEN starts_with(import_path, '@domain/') THEN 'src/domain/' || substr(import_path, 9)
  WHEN starts_with(import_path, '@app/') THEN 'src/application/' || substr(import_path, 6) ELSE import_path END AS resolved_import
FROM c_ext
""",
)
# A relative import of the corpus climbs at most once, so folding is one replace.
_FOLD = "regexp_replace(regexp_replace({p}, '/[.]/', '/', 'g'), '[^/]+/[.][.]/', '', 'g')"
_DIR = "regexp_extract(source_file, '^(.*)/[^/]*$', 1)"
block(
    "c_norm",
    f"""
SELECT *, resolved_import <> import_path AS aliased, CASE language
  WHEN 'go' THEN CASE WHEN starts_with(import_path, 'example.com/fleet') AND project_id IN ('en', 'fr') THEN substr(import_path, 19)
       WHEN starts_with(import_path, 'internal/') THEN import_path END
  WHEN 'typescript' THEN CASE WHEN starts_with(resolved_import, '.') THEN {_FOLD.format(p=_DIR + " || '/' || resolved_import")} ELSE resolved_import END
  WHEN 'python' THEN CASE WHEN starts_with(import_path, '..') THEN {_FOLD.format(p=_DIR + " || '/../' || replace(substr(import_path, 3), '.', '/')")}
       WHEN starts_with(import_path, '.') THEN {_DIR} || '/' || replace(substr(import_path, 2), '.', '/') ELSE replace(import_path, '.', '/') END
  WHEN 'rust' THEN replace(regexp_replace(import_path, '^(crate::)?(self::)?(super::)*', ''), '::', '/')
  WHEN 'php' THEN CASE WHEN starts_with(import_path, '../') THEN {_FOLD.format(p=_DIR + " || '/' || import_path")} ELSE replace(import_path, chr(92), '/') END
  WHEN 'ruby' THEN CASE WHEN starts_with(import_path, '../') THEN {_FOLD.format(p=_DIR + " || '/' || import_path")} ELSE import_path END
  WHEN 'swift' THEN import_path ELSE replace(import_path, '.', '/') END AS norm FROM c_alias
""",
)


def _candidates_sql() -> str:
    arms = []
    for name, profile in lg.PROFILES.items():
        if profile.candidates:
            items = []
            for t in profile.candidates:
                body = t.replace("{b}", "{p}", 0)
                items.append(f"replace(replace('{body}', '{{p}}', p), '{{b}}', regexp_extract(p, '[^/]*$'))")
            arms.append(f"WHEN '{name}' THEN [{', '.join(items)}]")
    return "CASE language " + " ".join(arms) + " ELSE [] END"


block(
    "c_index",
    "SELECT project_id, candidate, min(path) AS target_path FROM (SELECT project_id, path AS candidate, path FROM c_files "
    "UNION ALL SELECT project_id, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/*.' || regexp_extract(path, '[^.]*$'), path FROM c_files "
    "WHERE ends_with(path, '.java') OR ends_with(path, '.kt')) GROUP BY 1, 2",
)
block(
    "c_asked",
    f"""
SELECT project_id, language, norm, unnest(list) AS candidate, generate_subscripts(list, 1) AS pos FROM (
  SELECT *, {_candidates_sql()} AS list FROM (
    SELECT DISTINCT project_id, language, norm, CASE WHEN language = 'ruby' THEN replace(norm, '.', '/') ELSE norm END AS p FROM c_norm WHERE norm IS NOT NULL))
""",
)
block(
    "c_located",
    "SELECT n.*, target_path FROM c_norm n LEFT JOIN (SELECT project_id, language, norm, arg_min(target_path, pos) AS target_path "
    "FROM c_asked JOIN c_index USING (project_id, candidate) GROUP BY 1, 2, 3) f USING (project_id, language, norm)",
)


def _corpus_layer(p: str, suffix: bool = False) -> str:
    arms = []
    for name in ("domain", "application", "infrastructure", "presentation"):
        own = f"{name}|" if name != "infrastructure" else ""
        heads = f"({own}src/{name}|src/main/[^/]*/{name}|lib/{name}|Sources/{name}|src/{name.capitalize()})"
        anchor = "(^|/)" if suffix else "^"
        arms.append(f"WHEN regexp_matches({p}, '{anchor}{heads}(/.*)?$') THEN '{name}'")
    return "CASE " + " ".join(arms) + " END"


_NAMES = ("domain", "application", "infrastructure", "presentation")
_SCOPE = "CASE " + " ".join(
    f"WHEN substr(string_split(import_path, '/')[1], 2) = '{n}' OR string_split(import_path, '/')[2] = '{n}' THEN '{n}'" for n in _NAMES
) + " END"
_PREFIX = "CASE " + " ".join(
    f"WHEN starts_with(import_path, '{n}') OR contains(import_path, '/{n}/') THEN '{n}'" for n in _NAMES
) + " END"
_SWIFT = "CASE " + " ".join(f"WHEN lower(import_path) = '{n}' THEN '{n}'" for n in _NAMES) + " END"
block(
    "c_layered",
    f"""
SELECT *, coalesce(CASE WHEN is_external THEN NULL
  WHEN language = 'typescript' THEN CASE WHEN aliased THEN {_corpus_layer('norm')}
       WHEN starts_with(import_path, '.') OR starts_with(import_path, '/') THEN {_corpus_layer('norm')}
       ELSE coalesce(CASE WHEN starts_with(import_path, '@') AND contains(import_path, '/') THEN {_SCOPE} END, {_PREFIX}) END
  WHEN language = 'swift' THEN coalesce({_SWIFT}, {_corpus_layer('norm')})
  WHEN language = 'csharp' THEN coalesce({_corpus_layer('norm')}, {_corpus_layer('norm', True)})
  ELSE {_corpus_layer('norm')} END, CASE WHEN NOT is_external THEN {_corpus_layer('target_path')} END) AS resolved_layer FROM c_located
""",
)
block(
    "c_deps",
    "SELECT project_id, source_file, source_line, import_path, resolved_layer, language FROM c_layered "
    "WHERE language IN ('go', 'typescript') OR resolved_layer IS NOT NULL",
)
block("c_edges", f"SELECT * FROM (SELECT *, {_corpus_layer('source_file')} AS source_layer FROM c_deps) WHERE source_layer IS NOT NULL AND resolved_layer IS NOT NULL")
block(
    "c_viol",
    """
SELECT project_id, rule_id, source_file AS file, source_line AS line, source_layer, resolved_layer AS target_layer, import_path, severity, message FROM (
SELECT *, 'domain-imports-infrastructure' AS rule_id, 'error' AS severity, source_layer || ' cannot depend on ' || resolved_layer || ' (import: ' || import_path || ')' AS message
  FROM c_edges WHERE source_layer = 'domain' AND resolved_layer = 'infrastructure'
UNION ALL SELECT *, 'domain-imports-presentation', 'warning', source_layer || ' cannot depend on ' || resolved_layer || ' (import: ' || import_path || ')'
  FROM c_edges WHERE source_layer = 'domain' AND resolved_layer = 'presentation'
UNION ALL SELECT *, 'application-imports-presentation', 'error', 'Views stay outside: ' || source_layer || ' cannot import ' || resolved_layer
  FROM c_edges WHERE source_layer = 'application' AND resolved_layer = 'presentation'
UNION ALL SELECT *, 'no-wildcards', 'info', source_layer || ' cannot depend on ' || resolved_layer || ' (import: ' || import_path || ')'
  FROM c_edges WHERE regexp_matches(import_path, '^[a-z]+$'))
""",
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return files_from_documents(spark, folder)


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return cp.filter_source_files(files(spark, folder))


def deps(spark: SparkSession, folder: str) -> DataFrame:
    return build_deps(files(spark, folder), CORPUS_LAYERS, ALIASES)


def violations(spark: SparkSession, folder: str) -> DataFrame:
    return rules.standard_violations(deps(spark, folder), CORPUS)


# --- sources -----------------------------------------------------------------------


@query(
    "s1_scan_corpus",
    """
SELECT lang AS project_id, count(*) AS n_lines, sum(length(line)) AS n_chars, sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT))::BIGINT AS digest,
       false AS decode_error
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1
""",
)
def s1(spark: SparkSession, folder: str) -> DataFrame:
    # the texts go out as files of each project and are then scanned back
    from catalogue.streams import scratch

    root = scratch(spark, "corpus")
    docs = table(spark, folder, "documents").select(F.col("lang").alias("project"), "text")
    docs.write.option("maxRecordsPerFile", 1000).partitionBy("project").text(root)
    found = scan_corpus(spark, root, "*.txt")
    lines = F.explode(F.split(F.expr("left(content, length(content) - 1)"), "\n", -1))
    return (
        found.select(F.regexp_replace("project_id", "^project=", "").alias("project_id"), "decode_error", lines.alias("line"))
        .groupBy("project_id")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(F.length("line")).alias("n_chars"),
            F.sum(F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("bigint")).alias("digest"),
            F.bool_or("decode_error").alias("decode_error"),
        )
    )


@query(
    "s2_walk_layers",
    """
SELECT project_id, path FROM c_files WHERE (starts_with(path, 'src/domain/') OR starts_with(path, 'lib/') OR regexp_matches(path, '^gen/[^/]*[.]go$'))
AND NOT regexp_matches('/' || path, '/(node_modules|vendor|.git|dist|build|.next|out)/') AND NOT regexp_matches(path, '^gen/d1[^/]*$')
AND NOT starts_with(path, 'lib/presentation/')
""",
)
def s2(spark: SparkSession, folder: str) -> DataFrame:
    kept = cp.walk_layers(files(spark, folder), ["src/domain/**", "lib/**", "gen/*.go"], ["gen/d1*", "lib/presentation/**"])
    return kept.select("project_id", "path")


@query(
    "s3_detect_languages",
    """
SELECT DISTINCT project_id, language FROM c_files JOIN (VALUES ('go', '^go[.]mod$'), ('typescript', '^(tsconfig|package)[.]json$'),
 ('python', '^(requirements.txt|setup.py|pyproject.toml|Pipfile|poetry.lock)$'), ('java', '^(pom.xml|build.gradle|build.gradle.kts)$'),
 ('kotlin', '^(build|settings)[.]gradle[.]kts$'), ('rust', '^Cargo.toml$'), ('csharp', '^[^/]*[.](csproj|sln)$'), ('ruby', '^Gemfile$'),
 ('php', '^composer.json$'), ('swift', '^Package.swift$')) m(language, rx) ON regexp_matches(path, rx)
UNION SELECT a.project_id, 'kotlin' FROM c_builds a WHERE path = 'pom.xml' AND EXISTS (SELECT 1 FROM c_src s WHERE s.project_id = a.project_id AND language = 'kotlin')
""",
)
def s3(spark: SparkSession, folder: str) -> DataFrame:
    return cp.detect_languages(files(spark, folder))


@query("s4_filter_source_files", "SELECT project_id, path, language FROM c_src")
def s4(spark: SparkSession, folder: str) -> DataFrame:
    return sources(spark, folder).select("project_id", "path", "language")


@query(
    "s5_ignore_filter",
    """
SELECT project_id, path FROM c_files WHERE NOT starts_with(path, 'vendor/') AND NOT regexp_matches(path, '(^|/)[^/]*_spec[.]rb$')
AND NOT starts_with(path, 'src/main/java/') AND NOT (starts_with(path, 'src/') AND regexp_matches(path, '(^|/)[^/]*7[.]rs$'))
AND NOT regexp_matches(path, '^Sources/[^/]*ation(/.*)?$')
""",
)
def s5(spark: SparkSession, folder: str) -> DataFrame:
    ignore = cp.parse_ignore("# build\nvendor/\n\n**/*_spec.rb\nsrc/main/java/**\nsrc/**/*7.rs\nSources/*ation\n")
    return cp.ignore_filter(files(spark, folder), ignore).select("project_id", "path")


@query(
    "s6_dirty_files",
    "SELECT project_id, path, language FROM c_src WHERE regexp_matches(path, '3[.a-zA-Z_]*$') OR project_id = 'es'",
)
def s6(spark: SparkSession, folder: str) -> DataFrame:
    now = sources(spark, folder)
    # the stored manifest knows another version of some files, and one project under another config
    touched = F.col("path").rlike("3[.a-zA-Z_]*$")
    then = now.withColumn("content", F.when(touched, F.concat("content", F.lit("\nold"))).otherwise(F.col("content")))
    config = F.when(F.col("project_id") == "es", "v1").otherwise("v2")
    known = cp.manifest(then, config)
    return cp.dirty_files(now, known, F.lit("v2")).select("project_id", "path", "language")


@query(
    "s6_retained_rows",
    "SELECT project_id, source_file, count(*) AS n FROM c_imports WHERE NOT regexp_matches(source_file, '3[.a-zA-Z_]*$') "
    "AND NOT starts_with(source_file, 'lib/') GROUP BY 1, 2",
)
def s6_retained(spark: SparkSession, folder: str) -> DataFrame:
    now = sources(spark, folder)
    touched = now.where(F.col("path").rlike("3[.a-zA-Z_]*$"))
    alive = now.where(~F.col("path").startswith("lib/"))
    kept = cp.retained_rows(extraction.extract_imports(now), touched, alive)
    return kept.groupBy("project_id", "source_file").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s7_project_fingerprint",
    f"SELECT project_id, {digest_sql('sha256(h)')} AS fingerprint FROM (SELECT project_id, sha256(content) AS h FROM c_files "
    "WHERE regexp_matches(path, '[.](ts|tsx|js|jsx)$') AND NOT starts_with(path, 'vendor/')) GROUP BY 1",
)
def s7(spark: SparkSession, folder: str) -> DataFrame:
    return cp.project_fingerprint(files(spark, folder), "typescript")


@query(
    "s8_read_plugin_json",
    "SELECT project_id, source_file, source_line, import_path, CASE WHEN source_line % 2 = 0 THEN 'domain' END AS resolved_layer, 'lua' AS language "
    "FROM c_imports WHERE NOT ends_with(source_file, '.rb')",
)
def s8(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.extract_imports(sources(spark, folder))
    answer = F.struct(
        F.when(
            ~F.col("source_file").endswith(".rb"),
            F.struct(
                F.array(
                    F.struct(
                        "source_file",
                        "source_line",
                        "import_path",
                        F.when(F.col("source_line") % 2 == 0, "domain").otherwise("").alias("resolved_layer"),
                    )
                ).alias("dependencies")
            ),
        ).alias("extract"),
        F.when(F.col("source_file").endswith(".rb"), F.struct(F.lit("cannot parse").alias("message"))).alias("error"),
    )
    return parse_plugin_json(found.select("project_id", F.to_json(answer).alias("text")), "text", F.lit("lua"))


# --- extraction --------------------------------------------------------------------


@query("x0_file_lines", "SELECT project_id, path, language, line_no, text FROM c_lines")
def x0(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.file_lines(sources(spark, folder)).select("project_id", "path", "language", "line_no", "text")


for _n, _language in enumerate(lg.LANGUAGES, 1):

    @query(f"x{_n}_extract_{_language}", f"SELECT * FROM c_imports WHERE language = '{_language}'")
    def _extract(spark: SparkSession, folder: str, language: str = _language) -> DataFrame:
        return extraction.extract_imports(sources(spark, folder), (language,))


@query("x_extract_all", "SELECT * FROM c_imports")
def x_all(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_imports(sources(spark, folder))


@query(
    "x11_extract_declared_unit",
    "SELECT project_id, path, language, arg_min(unit, line_no) AS unit FROM (SELECT *, CASE language "
    + " ".join(f"WHEN '{k}' THEN {_rx('text', p.declares)}" for k, p in lg.PROFILES.items() if p.declares)
    + " END AS unit FROM c_lines) WHERE unit IS NOT NULL GROUP BY 1, 2, 3",
)
def x11(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_declared_unit(sources(spark, folder))


block(
    "c_scan",
    f"""
SELECT project_id, path AS file, line_no AS line, import_path, language FROM (
  SELECT *, CASE WHEN language = 'go' THEN CASE WHEN last_open > coalesce(last_close, 0) AND NOT starts_with(text, ')') THEN {_rx('text', lg.SCAN_GO_BLOCK)}
         ELSE {_rx('text', lg.SCAN_GO_SINGLE)} END ELSE coalesce({', '.join(_rx('text', p) for p in lg.SCAN_TS)}) END AS import_path
  FROM (SELECT *, max(CASE WHEN starts_with(text, 'import (') THEN line_no END) OVER w AS last_open, max(CASE WHEN starts_with(text, ')') THEN line_no END) OVER w AS last_close
    FROM (SELECT project_id, path, CASE WHEN ends_with(path, '.go') THEN 'go' ELSE 'typescript' END AS language, unnest(string_split(content, chr(10))) AS text,
          CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no FROM c_files
          WHERE regexp_matches(path, '[.](go|ts|tsx|js|jsx)$') AND NOT regexp_matches(path, '^(vendor|.git|node_modules|dist|build|target)'))
    WINDOW w AS (PARTITION BY project_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) WHERE import_path IS NOT NULL
""",
)


@query("x12_import_scan", "SELECT * FROM c_scan")
def x12(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.import_scan(files(spark, folder))


def _scan_layer_sql(column: str, test: str, default: str) -> str:
    arms = []
    for layer in CORPUS_LAYERS:
        heads = [p.removesuffix("/**") for p in layer.paths]
        arms.append(f"WHEN {' OR '.join(f'{test}({column}, {_q(h)})' for h in heads)} THEN '{layer.name}'")
    return f"CASE {' '.join(arms)} ELSE '{default}' END"


block(
    "c_scan_layers",
    f"SELECT *, {_scan_layer_sql('file', 'starts_with', 'unknown')} AS source_layer, {_scan_layer_sql('import_path', 'contains', 'external')} AS target_layer FROM c_scan",
)


@query("l4_scan_layer", "SELECT * FROM c_scan_layers")
def l4(spark: SparkSession, folder: str) -> DataFrame:
    return layers.scan_layer(extraction.import_scan(files(spark, folder)), CORPUS_LAYERS)


@query("g14_import_summary", "SELECT project_id, source_layer, target_layer, count(*) AS cnt FROM c_scan_layers GROUP BY 1, 2, 3")
def g14(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.import_summary(layers.scan_layer(extraction.import_scan(files(spark, folder)), CORPUS_LAYERS))


@query("x13_is_external", "SELECT * FROM c_ext")
def x13(spark: SparkSession, folder: str) -> DataFrame:
    return resolution.is_external(extraction.extract_imports(sources(spark, folder)))


@query(
    "x14_build_metadata",
    """
SELECT project_id, path AS build_file, CASE WHEN path = 'go.mod' THEN regexp_extract(content, 'module ([^ ' || chr(10) || ']+)', 1)
  WHEN path = 'pom.xml' THEN 'com.fleet.core' WHEN contains(content, 'de.fleet') THEN 'de.fleet.kern' ELSE 'fr.fleet.coeur' END AS module_prefix,
  CASE WHEN path = 'pom.xml' THEN 'api,db' ELSE '' END AS modules FROM c_files WHERE path IN ('go.mod', 'pom.xml', 'build.gradle', 'build.gradle.kts')
""",
)
def x14(spark: SparkSession, folder: str) -> DataFrame:
    found = resolution.build_metadata(files(spark, folder))
    return found.withColumn("modules", F.array_join("modules", ","))


@query("x15_resolve_alias", "SELECT project_id, source_file, source_line, import_path, resolved_import FROM c_alias")
def x15(spark: SparkSession, folder: str) -> DataFrame:
    found = resolution.resolve_alias(extraction.extract_imports(sources(spark, folder)), ALIASES)
    return found.select("project_id", "source_file", "source_line", "import_path", "resolved_import")


def _normalised(spark: SparkSession, folder: str) -> DataFrame:
    rows = files(spark, folder)
    found = resolution.is_external(extraction.extract_imports(cp.filter_source_files(rows)))
    modules = materialise(resolution.build_metadata(rows).where("build_file = 'go.mod'").select("project_id", "module_prefix"))
    return materialise(resolution.normalise_import(resolution.resolve_alias(found.join(modules, "project_id", "left"), ALIASES)))


@query("x16_normalise_import", "SELECT project_id, source_file, source_line, import_path, language, norm FROM c_norm")
def x16(spark: SparkSession, folder: str) -> DataFrame:
    return _normalised(spark, folder).select("project_id", "source_file", "source_line", "import_path", "language", "norm")


@query("x17_resolve_candidates", "SELECT project_id, source_file, source_line, import_path, target_path FROM c_located")
def x17(spark: SparkSession, folder: str) -> DataFrame:
    found = resolution.resolve_candidates(_normalised(spark, folder), files(spark, folder))
    return found.select("project_id", "source_file", "source_line", "import_path", "target_path")


@query("l3_assign_target_layer", "SELECT project_id, source_file, source_line, import_path, resolved_layer FROM c_layered")
def l3(spark: SparkSession, folder: str) -> DataFrame:
    located = resolution.resolve_candidates(_normalised(spark, folder), files(spark, folder))
    return layers.assign_target_layer(located, CORPUS_LAYERS).select(
        "project_id", "source_file", "source_line", "import_path", "resolved_layer"
    )


@query("c1_build_deps", "SELECT * FROM c_deps")
def c1(spark: SparkSession, folder: str) -> DataFrame:
    return deps(spark, folder)


STEM = Mapping("src/*/d*.ts", "gen/*.pb.go", "go")
GLOB = Mapping("lib/*/d*.rb", "gen/d*5.pb.go", "go", "glob", ("protoc-gen-go",))


@query(
    "x18_cross_lang_stem",
    "SELECT s.project_id, s.path AS source_file, 1 AS source_line, g.path AS import_path, CAST(NULL AS VARCHAR) AS resolved_layer, 'cross' AS language "
    "FROM c_source s JOIN c_gen g ON s.project_id = g.project_id AND regexp_extract(s.path, '/(d[0-9]+)[.]', 1) = regexp_extract(g.path, '/(d[0-9]+)[.]', 1) "
    "WHERE regexp_matches(s.path, '^src/[^/]*/d[^/]*[.]ts$') AND starts_with(g.content, '// Code generated')",
)
def x18(spark: SparkSession, folder: str) -> DataFrame:
    return resolution.cross_lang_stem(files(spark, folder), STEM)


block("c_ruby", "SELECT * FROM c_source WHERE regexp_matches(path, '^lib/[^/]*/d[^/]*[.]rb$')")
block("c_headed", "SELECT * FROM c_gen WHERE starts_with(content, '// Code generated') AND regexp_matches(path, '5[.]pb[.]go$')")


@query(
    "x19_cross_lang_glob",
    "SELECT project_id, 'source' AS side, path, (SELECT count(*) FROM c_headed h WHERE h.project_id = r.project_id) AS n_other FROM c_ruby r "
    "WHERE project_id IN (SELECT project_id FROM c_headed) UNION ALL "
    "SELECT project_id, 'generated', path, (SELECT count(*) FROM c_ruby r WHERE r.project_id = h.project_id) FROM c_headed h WHERE project_id IN (SELECT project_id FROM c_ruby)",
)
def x19(spark: SparkSession, folder: str) -> DataFrame:
    return resolution.cross_lang_glob(files(spark, folder), GLOB)


@query(
    "x19_cross_lang_glob_coupling",
    "SELECT r.project_id, regexp_extract(r.path, '^lib/([^/]*)', 1) AS source_layer, '' AS target_layer, count(*) AS cnt "
    "FROM c_ruby r JOIN c_headed h USING (project_id) GROUP BY 1, 2",
)
def x19_coupling(spark: SparkSession, folder: str) -> DataFrame:
    layer = F.regexp_extract("path", "^lib/([^/]*)", 1)
    return resolution.cross_lang_glob_coupling(files(spark, folder), GLOB, layer)


@query(
    "x20_generated_header",
    "SELECT project_id, path FROM c_files WHERE starts_with(content, '// Code generated by protoc-gen-')",
)
def x20(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.generated_header(files(spark, folder)).select("project_id", "path")


# --- layers of the corpus, lines, detectors ---------------------------------------


@query(
    "l6_infer_layers",
    """
SELECT project_id, ord, name, string_agg(folder || '/**', ',' ORDER BY pos) AS paths FROM (
  SELECT DISTINCT f.project_id, ord, name, pos, folder FROM c_files f JOIN (VALUES (1, 'domain', 1, 'src/domain'), (1, 'domain', 2, 'domain'),
    (2, 'application', 1, 'src/application'), (2, 'application', 2, 'application'), (3, 'infrastructure', 1, 'src/infrastructure'), (3, 'infrastructure', 2, 'infrastructure'),
    (4, 'presentation', 1, 'src/presentation'), (4, 'presentation', 2, 'presentation')) c(ord, name, pos, folder) ON starts_with(path, folder || '/')) GROUP BY 1, 2, 3
""",
)
def l6(spark: SparkSession, folder: str) -> DataFrame:
    return layers.infer_layers(files(spark, folder)).withColumn("paths", F.array_join("paths", ","))


_TEMPLATE_RULES = (
    "(1, 'domain-imports-infrastructure', 'domain', 'infrastructure', 'Cannot', 'error'), (2, 'domain-imports-application', 'domain', 'application', 'Cannot', 'error'), "
    "(3, 'application-imports-infrastructure', 'application', 'infrastructure', 'Cannot', 'error'), (4, 'presentation-imports-infrastructure', 'presentation', 'infrastructure', 'Cannot', 'warning'), "
    "(5, 'presentation-imports-domain', 'presentation', 'domain', 'Cannot', 'warning'), (7, 'application-imports-domain', 'application', 'domain', 'Can', 'info'), "
    "(8, 'infrastructure-imports-domain', 'infrastructure', 'domain', 'Can', 'info')"
)
block(
    "c_present",
    "SELECT DISTINCT f.project_id, ord, name FROM c_files f JOIN (VALUES (1, 'domain'), (2, 'application'), (3, 'infrastructure'), (4, 'presentation')) c(ord, name) "
    "ON starts_with(path, 'src/' || name || '/') OR starts_with(path, name || '/')",
)


@query(
    "l7_infer_rules",
    f"""
SELECT a.project_id, t.ord, t.id, t.f AS from_layer, t.t AS to_layers, t.type, t.severity FROM c_present a JOIN c_present b USING (project_id)
JOIN (VALUES {_TEMPLATE_RULES}) t(ord, id, f, t, type, severity) ON a.name = t.f AND b.name = t.t
UNION ALL SELECT project_id, 6, 'layer-circular', 'domain', string_agg(name, ',' ORDER BY ord) FILTER (WHERE name <> 'domain'), 'MustNotCircular', 'error' FROM c_present GROUP BY 1 HAVING count(*) >= 2
""",
)
def l7(spark: SparkSession, folder: str) -> DataFrame:
    return layers.infer_rules(layers.infer_layers(files(spark, folder))).withColumn("to_layers", F.array_join("to_layers", ","))


@query(
    "g11_violation_density",
    "SELECT project_id, violations, lines, round(violations / (lines / 1000.0), 6)::DOUBLE AS density FROM (SELECT project_id, count(*) AS lines FROM c_lines GROUP BY 1) "
    "JOIN (SELECT project_id, count(*) AS violations FROM c_viol GROUP BY 1) USING (project_id)",
)
def g11(spark: SparkSession, folder: str) -> DataFrame:
    lines = scoring.project_lines(sources(spark, folder))
    counts = violations(spark, folder).groupBy("project_id").agg(F.count(F.lit(1)).alias("violations"))
    return scoring.violation_density(counts.join(lines, "project_id")).withColumn("density", F.round("density", 6))


@query(
    "g13_detector_status",
    """
SELECT g.project_id, g.language, '' AS error, a.language IS NOT NULL AS applicable, CASE WHEN a.language IS NULL THEN 0 ELSE coalesce(n, 0) END AS dep_count
FROM (SELECT project_id, unnest(['go', 'typescript', 'python', 'java', 'kotlin', 'rust', 'csharp', 'ruby', 'php', 'swift']) AS language FROM (SELECT DISTINCT lang AS project_id FROM documents)) g
LEFT JOIN (SELECT DISTINCT project_id, language FROM c_builds JOIN (VALUES ('go', '^go[.]mod$'), ('typescript', '^(tsconfig|package)[.]json$'), ('python', '^(setup.py|pyproject.toml)$'),
 ('java', '^(pom.xml|build.gradle|build.gradle.kts)$'), ('kotlin', '^((build|settings)[.]gradle[.]kts|pom.xml)$'), ('rust', '^Cargo.toml$'), ('csharp', '[.](csproj|sln)$'), ('ruby', '^Gemfile$'),
 ('php', '^composer.json$'), ('swift', '^Package.swift$')) m(language, rx) ON regexp_matches(path, rx)) a ON a.project_id = g.project_id AND a.language = g.language
LEFT JOIN (SELECT project_id, language, count(*) AS n FROM c_imports GROUP BY 1, 2) d ON d.project_id = g.project_id AND d.language = g.language
""",
)
def g13(spark: SparkSession, folder: str) -> DataFrame:
    rows = files(spark, folder)
    found = extraction.extract_imports(cp.filter_source_files(rows))
    known = rows.select("project_id").distinct()
    return scoring.detector_status(cp.detect_languages(rows), list(lg.LANGUAGES), found, known)


@query(
    "c2_corpus_violations",
    "SELECT * FROM c_viol",
)
def c2(spark: SparkSession, folder: str) -> DataFrame:
    return violations(spark, folder).drop("rule_ord", "original_severity", "overridden")


block(
    "c_context",
    "SELECT v.project_id, v.file, v.line, l.line_no, l.text, CASE WHEN l.line_no = v.line THEN '→' ELSE ' ' END AS marker FROM (SELECT DISTINCT project_id, file, line FROM c_viol) v "
    "JOIN c_lines l ON l.project_id = v.project_id AND l.path = v.file AND l.line_no BETWEEN v.line - 3 AND v.line + 3",
)


@query("h16_code_context", "SELECT * FROM c_context")
def h16(spark: SparkSession, folder: str) -> DataFrame:
    context = diffs.code_context(violations(spark, folder), sources(spark, folder))
    return context.select("project_id", "file", "line", "line_no", "text", "marker")


# --- changes -----------------------------------------------------------------------

block(
    "d_lines",
    """
SELECT lang AS project_id, doc_id AS pr, 'src/' || own || '/d' || doc_id || '.py' AS file,
       CAST(CASE WHEN mark = '+' THEN 0 ELSE h * 20 + 1 + coalesce(sum(CASE WHEN mark <> '+' THEN 1 ELSE 0 END) OVER w, 0) END AS INTEGER) AS old_line,
       CAST(CASE WHEN mark = '-' THEN 0 ELSE h * 20 + 1 + coalesce(sum(CASE WHEN mark <> '-' THEN 1 ELSE 0 END) OVER w, 0) END AS INTEGER) AS new_line,
       mark || t AS content
FROM (SELECT doc_id, lang, own, t, i, i // 20 AS h, CASE i % 4 WHEN 3 THEN '-' WHEN 1 THEN ' ' ELSE '+' END AS mark FROM c_text)
WINDOW w AS (PARTITION BY doc_id, h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
)


@query("x21_parse_diff", "SELECT * FROM d_lines")
def x21(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.parse_diff(diffs_from_documents(spark, folder))


@query(
    "x22_diff_stats",
    "SELECT project_id, pr, CAST(count(DISTINCT file) AS INTEGER) AS files, CAST(count(*) FILTER (WHERE old_line = 0) AS INTEGER) AS insertions, "
    "CAST(count(*) FILTER (WHERE new_line = 0) AS INTEGER) AS deletions FROM d_lines GROUP BY 1, 2",
)
def x22(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.diff_stats(diffs_from_documents(spark, folder))


block(
    "d_new",
    "SELECT d.pr, v.* FROM c_viol v JOIN (SELECT DISTINCT project_id, pr, file, new_line FROM d_lines WHERE old_line = 0) d "
    "ON d.project_id = v.project_id AND d.file = v.file AND d.new_line = v.line",
)


def _pr(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All violations (written once) and those on added lines."""
    everything = materialise(violations(spark, folder))
    return everything, diffs.pr_filter(everything, extraction.diff_files(diffs_from_documents(spark, folder)))


@query("h10_pr_filter", "SELECT project_id, pr, rule_id, file, line, import_path FROM d_new")
def h10(spark: SparkSession, folder: str) -> DataFrame:
    return _pr(spark, folder)[1].select("project_id", "pr", "rule_id", "file", "line", "import_path")


@query(
    "h11_pr_annotations",
    "SELECT project_id, pr, file AS path, line AS start_line, line AS end_line, 'failure' AS annotation_level, message, "
    "'[' || rule_id || '] ' || source_layer || ' → ' || target_layer AS title FROM d_new",
)
def h11(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.pr_annotations(_pr(spark, folder)[1])


@query(
    "h11_pr_summary",
    """
SELECT *, n_new = 0 AS passed, CASE WHEN n_new = 0 THEN '✅ No new architecture violations in this PR (' || n_total || ' total violations unchanged).'
  ELSE '❌ ' || n_new || ' new architecture violation(s) found in this PR.' END AS summary
FROM (SELECT p.project_id, p.pr, coalesce(n.n, 0) AS n_new, coalesce(v.n, 0) AS n_total FROM (SELECT DISTINCT lang AS project_id, doc_id AS pr FROM documents) p
      LEFT JOIN (SELECT project_id, pr, count(*) AS n FROM d_new GROUP BY 1, 2) n USING (project_id, pr)
      LEFT JOIN (SELECT project_id, count(*) AS n FROM c_viol GROUP BY 1) v USING (project_id))
""",
)
def h11_summary(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "documents").select(F.col("lang").alias("project_id"), F.col("doc_id").alias("pr"))
    everything, new = _pr(spark, folder)
    return diffs.pr_summary(new, everything, known)


# --- file graph and extension points -------------------------------------------------


def file_graph(spark: SparkSession, folder: str) -> DataFrame:
    """File -> file edges of resolved imports."""
    located = resolution.resolve_candidates(_normalised(spark, folder), files(spark, folder))
    direct = F.coalesce("target_path", F.concat("norm", F.lit(".ts")))
    return located.where("target_path is not null or language = 'typescript'").select(
        "project_id", F.col("source_file").alias("src"), direct.alias("dst")
    )


block(
    "c_graph",
    "SELECT DISTINCT project_id, source_file AS src, coalesce(target_path, norm || '.ts') AS dst FROM c_located "
    "WHERE (target_path IS NOT NULL OR language = 'typescript') AND source_file <> coalesce(target_path, norm || '.ts')",
)
block(
    "c_reach",
    "SELECT project_id, src, dst FROM c_graph UNION SELECT r.project_id, r.src, g.dst FROM c_reach r JOIN c_graph g ON g.project_id = r.project_id AND g.src = r.dst",
)


@query(
    "f9_file_cycles",
    "SELECT a.project_id, a.src AS file, least(a.src, min(a.dst)) AS component FROM c_reach a JOIN c_reach b ON a.project_id = b.project_id AND a.src = b.dst AND a.dst = b.src "
    "WHERE a.src <> a.dst GROUP BY a.project_id, a.src",
)
def f9(spark: SparkSession, folder: str) -> DataFrame:
    from strata.operators.graph import file_cycles

    return file_cycles(file_graph(spark, folder))


@query(
    "p1_register_extractor",
    "SELECT project_id, path AS source_file, line_no AS source_line, word AS import_path, 'shout' AS language FROM (SELECT project_id, path, "
    "CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no, regexp_extract(unnest(string_split(content, chr(10))), '^[A-Z][a-z]+') AS word "
    "FROM c_gen) WHERE word <> ''",
)
def p1(spark: SparkSession, folder: str) -> DataFrame:
    import re

    first_word = re.compile("^[A-Z][a-z]+")

    def parse(text: str) -> list[str]:
        hit = first_word.match(text)
        return [hit.group(0)] if hit else []

    registry = ExtractorRegistry()
    registry.register(
        Extractor("shout", lambda rows: rows.where(F.col("path").startswith("gen/")), line_extractor(parse))
    )
    found = registry.run(files(spark, folder))
    if found is None:
        raise RuntimeError(str(registry.status))
    return found


