"""Extraction, resolution, corpus filters, diffs, sources, sinks, registries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strata.model import Layer
from strata.operators import corpus, extraction, layers, resolution
from strata.operators.registry import Extractor, ExtractorRegistry, line_extractor
from strata.plans.check import build_deps
from strata.sources import exports
from strata.sources.files import read_plugin_json, scan_corpus
from strata.sources.history_store import HistoryStore

FILES = "project_id string, path string, content string"


def files_of(spark, tree, project="p"):
    return spark.createDataFrame([(project, p, c) for p, c in tree.items()], FILES)


def found(spark, rows, path, content):
    src = corpus.filter_source_files(files_of(spark, {path: content}))
    return rows(extraction.extract_imports(src), "source_line", "import_path")


CASES = {
    "a.go": (
        'package a\nimport "one"\nimport alias "two"\nimport (\n\t"three"\n\t_ "four"\n\n\t// "no"\n\t. "five"\n)\nfunc f() {\n\timport "late"\n}\n',
        [(2, "one"), (3, "two"), (5, "three"), (6, "four"), (9, "five")],
    ),
    "a.ts": (
        "import type { T } from './t'\nimport x, { y } from \"x\"; require('x')\n// import z from 'z'\nexport { q } from 'q'\nconst m = await import('m')\nimport 'side'",
        [(1, "./t"), (2, "x"), (4, "q"), (5, "m"), (6, "side")],
    ),
    "a.py": (
        "import os.path\n  from a.b import c\n# import no\nfrom .rel import x\n",
        [(1, "os.path"), (2, "a.b"), (4, ".rel"), (4, ".rel")],
    ),
    "A.java": (
        "import a.b.C;\nimport static a.b.D;\nimport a.b.*;\nimportant x;\n",
        [(1, "a.b.C"), (2, "a.b.D"), (3, "a.b")],
    ),
    "a.kt": ("import a.B as C\nimport a.*\nimport a.b.D;\n", [(1, "a.B"), (2, "a"), (3, "a.b.D")]),
    "a.rs": (
        "use crate::a::b; // c\npub use self::x;\nuse super::y;\nuse std::io;\n# use no;\nuse a::{b, c};\n",
        [(1, "crate::a::b"), (2, "self::x"), (3, "super::y"), (4, "std::io")],
    ),
    "a.cs": (
        "using X = A.B;\nusing static A.C;\nusing A.D; // c\n* using no;\n",
        [(1, "A.B"), (2, "A.C"), (3, "A.D")],
    ),
    "a.rb": (
        "require_relative './a'\nrequire_all 'b'\nrequire File.expand_path('c', x)\nrequire 'd' # e\n# require 'no'\n",
        [(1, "./a"), (2, "b"), (3, "c"), (4, "d")],
    ),
    "a.php": (
        "use A\\B;\nuse A\\C as D;\nuse function A\\f;\nuse const A\\X;\nrequire_once __DIR__ . '/e.php';\n// use A\\No;\n",
        [(1, "A\\B"), (2, "A\\C"), (3, "A\\f"), (4, "A\\X"), (5, "e.php")],
    ),
    "a.swift": (
        "@_exported import A\nimport struct B.C\nimport D // e\n// import No\n",
        [(1, "A"), (2, "B"), (3, "D")],
    ),
}


@pytest.mark.parametrize("path", CASES)
def test_extractors(spark, rows, path):
    content, want = CASES[path]
    assert found(spark, rows, path, content) == want


def test_no_crash_on_noise(spark):
    noise = "\x00\n'\"\\\n((((\nimport\nuse ;\n é import ''\n" * 3
    tree = {p: noise for p in CASES}
    assert extraction.extract_imports(corpus.filter_source_files(files_of(spark, tree))).count() >= 0


def test_source_filter(spark, rows):
    keep = ["a.go", "x/a.ts", "a.py", "m/A.java", "s/a.swift"]
    drop = ["a_test.go", "vendor/a.go", "x/a.spec.ts", "node_modules/a.ts", ".next/a.ts", "venv/a.py", "ATest.java",
            "target/A.java", "obj/a.cs", "b_spec.rb", "tests/a.php", "Tests/a.swift", "README.md"]
    out = corpus.filter_source_files(files_of(spark, {p: "" for p in keep + drop}))
    assert rows(out, "path") == sorted((p,) for p in keep)
    extra = corpus.filter_source_files(files_of(spark, {"a.pyx": ""}), {"python": (".pyx",)})
    assert rows(extra, "language") == [("python",)]


def test_detect_languages(spark, rows):
    tree = {"go.mod": "", "pom.xml": "", "src/a.kt": "", "sub/Cargo.toml": "", "x.csproj": ""}
    assert rows(corpus.detect_languages(files_of(spark, tree)), "language") == [
        ("csharp",), ("go",), ("java",), ("kotlin",)
    ]


def test_python_without_marker(spark, rows):
    assert rows(corpus.detect_languages(files_of(spark, {"pkg/a.py": ""})), "language") == [("python",)]
    assert corpus.detect_languages(files_of(spark, {"a/b/c.py": "", "d.py": ""})).count() == 0


def test_php_named_from_inside_the_source_folder(spark, rows):
    tree = {"src/App/a.php": "require_once __DIR__ . '/../Domain/b.php';\n"}
    out = build_deps(files_of(spark, tree), (Layer("domain", ("Domain/**",)),))
    assert rows(out, "import_path", "resolved_layer") == [("../Domain/b.php", "domain")]


def test_walk_and_ignore(spark, rows):
    tree = {p: "" for p in ("src/a.go", "src/gen/b.go", "src/.hid/c.go", "vendor/src/d.go", "lib/e.go")}
    assert rows(corpus.walk_layers(files_of(spark, tree), ["src/**"], ["**/gen"]), "path") == [("src/a.go",)]
    assert rows(corpus.ignore_filter(files_of(spark, tree), ["gen", "lib/"]), "path") == [
        ("src/.hid/c.go",), ("src/a.go",), ("vendor/src/d.go",)
    ]
    assert corpus.parse_ignore("# c\n\n a/ \nb\n") == ["a/", "b"]


def test_dirty_files(spark, rows):
    old = corpus.filter_source_files(files_of(spark, {"a.go": "1", "b.go": "1", "gone.go": "1"}))
    new = corpus.filter_source_files(files_of(spark, {"a.go": "1", "b.go": "2", "c.go": "1"}))
    known = corpus.manifest(old, F.lit("h"))
    dirty = corpus.dirty_files(new, known, F.lit("h"))
    assert rows(dirty, "path") == [("b.go",), ("c.go",)]
    assert corpus.dirty_files(new, known, F.lit("other")).count() == 3
    deps = spark.createDataFrame([("p", f) for f in ("a.go", "b.go", "gone.go")], "project_id string, source_file string")
    assert rows(corpus.retained_rows(deps, dirty, new), "source_file") == [("a.go",)]


def test_fingerprint_ignores_order_and_skipped_dirs(spark):
    a = files_of(spark, {"a.go": "1", "b.go": "2", "vendor/c.go": "3"})
    b = files_of(spark, {"b.go": "1", "z/a.go": "2", "x.md": "9"})
    digests = [corpus.project_fingerprint(x, "go").first().fingerprint for x in (a, b)]
    assert digests[0] == digests[1]


LAYERS = (
    Layer("domain", ("domain/**", "src/domain/**", "internal/domain/**")),
    Layer("infrastructure", ("src/infrastructure/**", "internal/infrastructure/**")),
)


def test_build_deps_across_languages(spark, rows):
    tree = {
        "go.mod": "module m.io/x\n",
        "internal/domain/a.go": 'import "m.io/x/internal/infrastructure/db"\nimport "fmt"\n',
        "src/domain/b.ts": "import x from '@infra/db'\nimport y from './c'\nimport z from '../infrastructure/q'\n",
        "domain/c.py": "from infrastructure.db import x\nimport os\n",
        "src/infrastructure/db.py": "",
        "src/domain/d.rs": "use crate::infrastructure::pool;\nuse std::io;\n",
        "src/infrastructure/pool/mod.rs": "",
    }
    out = build_deps(files_of(spark, tree), LAYERS, {"@infra/*": "src/infrastructure/*"})
    assert rows(out, "source_file", "source_line", F.coalesce("resolved_layer", F.lit("-"))) == [
        ("domain/c.py", 1, "infrastructure"),
        ("internal/domain/a.go", 1, "infrastructure"),
        ("internal/domain/a.go", 2, "-"),
        ("src/domain/b.ts", 1, "infrastructure"),
        ("src/domain/b.ts", 2, "domain"),
        ("src/domain/b.ts", 3, "infrastructure"),
        ("src/domain/d.rs", 1, "infrastructure"),
    ]


def test_longest_alias_wins(spark, rows):
    df = spark.createDataFrame([("@a/b/c", "typescript"), ("@a/x", "typescript"), ("@a/b", "go")], "import_path string, language string")
    out = resolution.resolve_alias(df, {"@a/*": "one/*", "@a/b/*": "two/*"})
    assert rows(out, "import_path", "resolved_import") == [("@a/b", "@a/b"), ("@a/b/c", "two/c"), ("@a/x", "one/x")]


def test_external(spark, rows):
    names = [("java", "java.util.List"), ("java", "javafx.X"), ("csharp", "System"), ("csharp", "Systems"), ("ruby", "json"),
             ("ruby", "./a"), ("ruby", "bundler/x"), ("php", "Symfony\\X"), ("php", "SymfonyX"), ("swift", "os"), ("rust", "std::io")]
    df = spark.createDataFrame(names, "language string, import_path string")
    out = {(r.language, r.import_path): r.is_external for r in resolution.is_external(df).collect()}
    assert [out[n] for n in names] == [True, False, True, False, True, False, True, True, False, True, True]


def test_java_folder_candidate(spark, rows):
    df = spark.createDataFrame([("p", "java", "a/b")], "project_id string, language string, norm string")
    tree = files_of(spark, {"src/main/java/a/b/Z.java": "", "src/main/java/a/b/C.java": "", "a/b.java": ""})
    assert rows(resolution.resolve_candidates(df, tree), "target_path") == [("src/main/java/a/b/C.java",)]


def test_build_metadata(spark, rows):
    tree = {
        "go.mod": "// x\nmodule a.b/c\n",
        "pom.xml": "<project><parent><groupId>no</groupId></parent><groupId>g</groupId><artifactId>a</artifactId>"
        "<modules><module>m1</module><module>m2</module></modules><dependencies><dependency><groupId>z</groupId></dependency></dependencies></project>",
        "build.gradle": "group = 'g'\nrootProject.name = 'r'\nproject.name = 'q'\n",
    }
    out = resolution.build_metadata(files_of(spark, tree))
    assert rows(out, "build_file", "module_prefix", F.array_join("modules", ",")) == [
        ("build.gradle", "g.r", ""), ("go.mod", "a.b/c", ""), ("pom.xml", "g.a", "m1,m2")
    ]


def test_cross_language(spark, rows):
    head = "// @generated\n"
    tree = {"api/a.proto": "", "api/b.proto": "", "gen/a.pb.go": head, "gen/b.pb.go": "hand", "gen/c.pb.go": head}
    stem = resolution.Mapping("api/*.proto", "gen/*.pb.go", "go")
    assert rows(resolution.cross_lang_stem(files_of(spark, tree), stem), "source_file", "import_path") == [("api/a.proto", "gen/a.pb.go")]
    out = resolution.cross_lang_glob(files_of(spark, tree), resolution.Mapping("api/*.proto", "gen/*.pb.go", "go", "glob"))
    assert rows(out, "side", "path", "n_other") == [
        ("generated", "gen/a.pb.go", 2), ("generated", "gen/c.pb.go", 2), ("source", "api/a.proto", 2), ("source", "api/b.proto", 2)
    ]
    custom = extraction.generated_header(files_of(spark, tree), ("hand",))
    assert rows(custom, "path") == [("gen/b.pb.go",)]


DIFF = """diff --git a/x.go b/x.go
index 1..2
--- a/x.go
+++ b/x.go
@@ -1,3 +1,4 @@ ctx
 a
-b
+c
+d

@@ bad header
+ignored
diff --git a/gone.go b/gone.go
deleted file mode 1
@@ -5 +0,0 @@
-z"""


def test_parse_diff(spark):
    df = spark.createDataFrame([("p", 1, DIFF), ("p", 2, "")], "project_id string, pr int, text string")
    got = [(r.file, r.old_line, r.new_line, r.content) for r in extraction.parse_diff(df).collect()]
    assert sorted(got) == sorted([
        ("x.go", 1, 1, " a"), ("x.go", 2, 0, "-b"), ("x.go", 0, 2, "+c"), ("x.go", 0, 3, "+d"), ("x.go", 3, 4, ""),
        ("gone.go", 5, 0, "-z"),
    ])
    stats = {r.pr: (r.files, r.insertions, r.deletions) for r in extraction.diff_stats(df).collect()}
    assert stats == {1: (2, 2, 2), 2: (0, 0, 0)}


def test_diff_files_match_their_lines(spark):
    """A side's line numbers are places among its lines, also where a side starts at 0 or a hunk is empty."""
    rng = random.Random(4)
    marks = ["+a", "-b", " c", "", "+", "-", "+@@", "-\r", "\\\\ No newline"]
    data = []
    for pr in range(40):
        text = []
        for f in range(rng.randint(1, 3)):
            text.append(f"diff --git a/f{f} b/f{f}")
            for _ in range(rng.randint(0, 3)):
                text.append(f"@@ -{rng.randint(0, 2)} +{rng.randint(0, 2)},3 @@ part")
                text += [rng.choice(marks) for _ in range(rng.randint(0, 6))]
        data.append(("p", pr, "\n".join(text)))
    df = spark.createDataFrame(data, "project_id string, pr int, text string")
    want = {}
    for r in extraction.parse_diff(df).collect():
        kept, cut, added = want.setdefault((r.pr, r.file), [False, False, set()])
        cut = cut or (r.content.startswith("-") and r.old_line > 0)
        added |= {r.new_line} if r.content.startswith("+") and r.new_line > 0 else set()
        want[(r.pr, r.file)] = [kept or r.new_line > 0, cut, added]
    got = {(r.pr, r.file): [r.kept, r.cut, set(r.added)] for r in extraction.diff_files(df).collect()}
    empty = [k for k in got if k not in want]
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(got[k] == [False, False, set()] for k in empty)


def test_files_without_a_hint_are_not_split(spark, rows):
    tree = {
        "a.go": 'package a\nimport "x/y"\nfunc f() {}', "b.go": 'package b\nvar s = "no"', "c.go": "import none",
        "d.go": 'import (\n\t"g/h"\n)', "e.py": "x = 1", "f.rb": "require 'lib/a'",
    }
    found = extraction.extract_imports(corpus.filter_source_files(files_of(spark, tree)))
    assert rows(found, "source_file", "import_path") == [("a.go", "x/y"), ("d.go", "g/h"), ("f.rb", "lib/a")]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(split(" not in text and "posexplode(CASE WHEN" in text


def test_declared_units_and_scan(spark, rows):
    tree = {"A.java": "\npackage a.b;\npackage c;\n", "a.cs": "namespace N.M\n{", "a.rs": "pub mod x1;\n"}
    units = extraction.extract_declared_unit(corpus.filter_source_files(files_of(spark, tree)))
    assert rows(units, "unit") == [("N.M",), ("a.b",), ("x1",)]
    scan = extraction.import_scan(files_of(spark, {
        "a.go": 'import "x/domain"\nimport (\n\t"y"\n\tz "w"\n)\nfunc f() {\n\timport "late"\n}', "b.jsx": "const q = require('q')\nimport * as n from 'n'",
        "dist/c.js": "import 'no'",
    }))
    assert rows(scan, "line", "import_path") == [(1, "q"), (1, "x/domain"), (2, "n"), (3, "y"), (4, "w"), (7, "late")]
    placed = layers.scan_layer(scan, (Layer("domain", ("domain/**",)), Layer("root", ("a.go",))))
    assert rows(placed.where("line = 1"), "source_layer", "target_layer") == [("root", "domain"), ("unknown", "external")]


def test_infer(spark, rows):
    tree = files_of(spark, {"internal/domain/a.go": "", "core/b.go": "", "infra/x/c.go": "", "cmd/m.go": ""})
    found_layers = layers.infer_layers(tree)
    assert rows(found_layers, "name", F.array_join("paths", ",")) == [
        ("domain", "internal/domain/**,core/**"), ("infrastructure", "infra/**"), ("presentation", "cmd/**")
    ]
    inferred = layers.infer_rules(found_layers)
    assert rows(inferred, "ord", "id", F.array_join("to_layers", ",")) == [
        (1, "domain-imports-infrastructure", "infrastructure"), (4, "presentation-imports-infrastructure", "infrastructure"),
        (5, "presentation-imports-domain", "domain"), (6, "layer-circular", "infrastructure,presentation"),
        (8, "infrastructure-imports-domain", "domain"),
    ]


def test_registry(spark, rows):
    registry = ExtractorRegistry()
    lua = Extractor("lua", lambda f: f.where(F.col("path").endswith(".lua")), line_extractor(lambda t: t.split()[1:] if t.startswith("use ") else []))
    registry.register(lua)
    registry.register(Extractor("bad", lambda f: f.select("ghost"), lambda f: f))
    with pytest.raises(ValueError):
        registry.register(lua)
    with pytest.raises(ValueError):
        registry.register(Extractor("go", lua.applies, lua.extract))
    out = registry.run(files_of(spark, {"a.lua": "use x y\nno\n", "b.go": "use z"}))
    assert rows(out, "source_line", "import_path", "language") == [(1, "x", "lua"), (1, "y", "lua")]
    assert registry.status["lua"] == "ok" and registry.status["bad"].startswith("error")


def test_failing_parser_is_reported(spark, rows):
    def parse(text):
        if "bad" in text:
            raise ValueError(text)
        return [text]

    registry = ExtractorRegistry()
    registry.register(Extractor("loud", lambda files: files, line_extractor(parse)))
    files = files_of(spark, {"x": "one\nbad\ntwo"})
    assert rows(registry.run(files), "source_line", "import_path") == [(1, "one"), (3, "two")]
    assert rows(registry.failures(files), "source_file", "source_line", "error") == [("x", 2, "ValueError")]


def test_scan_and_plugin(spark, rows, tmp_path):
    root = tmp_path / "fleet"
    (root / "p1" / "src").mkdir(parents=True)
    (root / "p1" / "src" / "a.go").write_text("é")
    (root / "p2").mkdir()
    (root / "p2" / "b.txt").write_text("x")
    assert rows(scan_corpus(spark, str(root), "*.go")) == [("p1", "src/a.go", "é", False)]
    # a folder named like the root, and bytes that are no UTF-8
    (root / "p1" / "fleet" / "x").mkdir(parents=True)
    (root / "p1" / "fleet" / "x" / "c.go").write_bytes(b"// caf\xe9\nimport \"x\"")
    odd = rows(scan_corpus(spark, str(root), "c.go"))
    assert odd == [("p1", "fleet/x/c.go", "// caf\ufffd\nimport \"x\"", True)]
    answers = tmp_path / "out.json"
    good = {"extract": {"dependencies": [{"source_file": "a", "source_line": 2, "import_path": "x", "resolved_layer": ""}]}}
    answers.write_text(json.dumps(good) + "\n" + json.dumps({"error": {"message": "m"}}) + "\n")
    got = read_plugin_json(spark, str(answers), "p", "lua").collect()
    assert [(r.source_file, r.source_line, r.resolved_layer, r.language) for r in got] == [("a", 2, None, "lua")]


def test_exports(spark, rows, tmp_path):
    df = spark.createDataFrame(
        [("p", "D-01", "r" * 60, "domain (a<b.go:7)", 7, "domain", "infra", "x", "50% off\nnow", "error", False)],
        "project_id string, id string, rule_id string, file string, line int, source_layer string, target_layer string, "
        "import_path string, message string, severity string, overridden boolean",
    )
    assert exports.sarif_results(df).first().uri == "a<b.go"
    line = exports.annotation_lines(df).first().value
    assert line == f"::error file=domain (a<b.go:7),line=7,title={'r' * 50}::50%25 off%0Anow"
    xml = exports.junit_lines(exports.junit_cases(df)).first().value
    assert '<failure message="domain → infra" type="error">' in xml and "a&lt;b.go" in xml
    body = json.loads(exports.json_rows(df).first().payload)
    assert body["import"] == "x" and "overridden" not in body
    exports.write_lines(exports.annotation_lines(df), str(tmp_path / "notes"))
    assert spark.read.text(str(tmp_path / "notes")).count() == 1
    assert json.loads(exports.sarif_json(exports.sarif_results(df)).first().payload)["ruleId"] == "r" * 60


def test_history_store(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "audits"))
    schema = "project_id string, run_date date, ts timestamp, violations int"

    def save(*data):
        store.save(spark.sql("select 1").sparkSession.createDataFrame(list(data), schema))

    from datetime import datetime

    t = datetime
    save(("p", t(2024, 1, 1).date(), t(2024, 1, 1, 8), 5), ("q", t(2024, 1, 1).date(), t(2024, 1, 1, 8), 7))
    save(("p", t(2024, 1, 1).date(), t(2024, 1, 1, 9), 6), ("p", t(2024, 1, 2).date(), t(2024, 1, 2, 9), 1))
    got = {(r.project_id, str(r.run_date)): r.violations for r in store.load().collect()}
    assert got == {("p", "2024-01-01"): 6, ("q", "2024-01-01"): 7, ("p", "2024-01-02"): 1}
    assert store.load("2024-01-02").count() == 1
    assert {r.project_id: r.violations for r in store.latest().collect()} == {"p": 1, "q": 7}
    assert [str(r.run_date) for r in store.dates().where("project_id = 'p'").collect()] == ["2024-01-02", "2024-01-01"]
