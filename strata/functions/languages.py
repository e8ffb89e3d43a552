"""Per-language profiles: markers, file filters, external prefixes and import patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

LANGUAGES = ("go", "typescript", "python", "java", "kotlin", "rust", "csharp", "ruby", "php", "swift")


@dataclass(frozen=True)
class Profile:
    """What identifies a language's projects and source files."""

    markers: tuple[str, ...]
    extensions: tuple[str, ...]
    test_suffixes: tuple[str, ...] = ()
    skip_dirs: tuple[str, ...] = ()
    external_exact: tuple[str, ...] = ()
    external_prefixes: tuple[str, ...] = ()
    candidates: tuple[str, ...] = ()
    declares: str = ""
    hidden_dirs: bool = field(default=False)


# --- fixed values -----------------------------------------------------------
_EDITOR = (".git", "node_modules", ".idea", ".vscode")
_JVM = ("java.", "javax.", "sun.", "com.sun.", "org.ietf.", "org.w3c.", "org.xml.")

PROFILES: dict[str, Profile] = {
    "go": Profile(("go.mod",), (".go",), ("_test.go",), ("vendor",)),
    "typescript": Profile(
        ("tsconfig.json", "package.json"),
        (".ts", ".tsx", ".mts", ".cts"),
        (".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx"),
        ("node_modules", ".git"),
        hidden_dirs=True,
    ),
    "python": Profile(
        ("requirements.txt", "setup.py", "pyproject.toml", "Pipfile", "poetry.lock"),
        (".py",),
        (),
        ("venv", ".venv", "env", ".env", "__pycache__", ".git", "node_modules"),
        candidates=("{p}.py", "{p}/__init__.py", "src/{p}.py", "src/{p}/__init__.py"),
    ),
    "java": Profile(
        ("pom.xml", "build.gradle", "build.gradle.kts"),
        (".java",),
        ("Test.java", "Tests.java"),
        ("target", "build", *_EDITOR),
        external_prefixes=_JVM,
        candidates=(
            "src/main/java/{p}.java",
            "src/main/java/{p}/*.java",
            "src/test/java/{p}.java",
            "{p}.java",
        ),
        declares=r"^\s*package\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s*;",
    ),
    "kotlin": Profile(
        ("build.gradle.kts", "settings.gradle.kts"),
        (".kt",),
        ("Test.kt", "Tests.kt"),
        ("target", "build", *_EDITOR),
        external_prefixes=("kotlin.", "kotlinx.", *_JVM),
        candidates=("src/main/kotlin/{p}.kt", "src/main/kotlin/{p}/*.kt", "src/test/kotlin/{p}.kt", "{p}.kt"),
        declares=r"^\s*package\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s*(?:;)?\s*$",
    ),
    "rust": Profile(
        ("Cargo.toml",),
        (".rs",),
        ("_test.rs",),
        ("target", "build", *_EDITOR),
        external_prefixes=("std::", "core::", "alloc::", "test::"),
        candidates=("src/{p}.rs", "src/{p}/mod.rs", "{p}.rs"),
        declares=r"^\s*pub\s+mod\s+([a-zA-Z_][a-zA-Z0-9_]+)\s*;\s*$",
    ),
    "csharp": Profile(
        ("*.csproj", "*.sln"),
        (".cs",),
        ("Test.cs", "Tests.cs"),
        ("bin", "obj", ".vs", *_EDITOR),
        external_exact=("System", "Mono", "UnityEditor", "UnityEngine", "Xamarin", "Windows"),
        external_prefixes=(
            "System.",
            "Microsoft.",
            "Mono.",
            "UnityEditor.",
            "UnityEngine.",
            "Xamarin.",
            "Windows.",
            "SystemRuntime.",
            "NETStandard.",
        ),
        candidates=("{p}.cs", "{p}/index.cs", "src/{p}.cs", "src/{p}/index.cs"),
        declares=r"^\s*namespace\s+([a-zA-Z_][a-zA-Z0-9_.]+)\s*",
    ),
    "ruby": Profile(
        ("Gemfile",),
        (".rb",),
        ("_test.rb", "_spec.rb"),
        ("vendor", "bundle", *_EDITOR),
        candidates=("lib/{p}.rb", "lib/{p}/{b}.rb", "{p}.rb"),
    ),
    "php": Profile(
        ("composer.json",),
        (".php",),
        ("Test.php",),
        ("vendor", "tests", *_EDITOR),
        candidates=("src/{p}.php", "src/{p}/{b}.php", "{p}.php"),
    ),
    "swift": Profile(
        ("Package.swift",),
        (".swift",),
        ("Tests.swift",),
        (".build", "DerivedData", "Tests", *_EDITOR),
        external_exact=(
            "Foundation",
            "UIKit",
            "SwiftUI",
            "AppKit",
            "CoreData",
            "Combine",
            "Dispatch",
            "os",
            "CoreGraphics",
            "QuartzCore",
        ),
        candidates=("Sources/{p}.swift", "Sources/{p}/{b}.swift"),
    ),
}

# Ruby and PHP decide by prefix with boundaries rather than plain startswith.
RUBY_EXTERNAL = ("rubygems", "bundler")
RUBY_INTERNAL = ("./", "../", "lib/", "app/", "config/", "spec/", "test/")
PHP_EXTERNAL = ("Symfony", "Doctrine", "GuzzleHttp", "Psr", "Monolog", "Composer")
PHP_INTERNAL = ("./", "../")

# Import statement patterns; group 1 is the import unless noted.
GO_SINGLE = r'^\s*import\s+(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?"([^"]+)"'
GO_BLOCK = r'^\s*(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?"([^"]+)"'
GO_OPEN = r"^\s*import\s*\("
GO_CLOSE = r"^\s*\)"
GO_DECL = r"^(?:func|type|var|const)\b"
TS_TYPE = r"""import\s+type\s+\{[^}]*\}\s+from\s+["']([^"']+)["']"""
TS_FROM = r"""import\s+(?:[\w\s{},*]+\s+from\s+)?["']([^"']+)["']"""
TS_REQUIRE = r"""require\s*\(\s*["']([^"']+)["']\s*\)"""
TS_EXPORT = r"""export\s+(?:\*|\{[^}]*\}|\w+)\s+from\s+["']([^"']+)["']"""
TS_DYNAMIC = r"""\bimport\s*\(\s*["']([^"']+)["']\s*\)"""
PY_IMPORTS = (r"^import\s+([\w.]+)", r"^from\s+([\w.]+)\s+import", r"^from\s+(\.[\w.]+)\s+import")
JAVA_IMPORTS = (
    r"^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]+)\s*;",
    r"^\s*import\s+static\s+([a-zA-Z_][a-zA-Z0-9_.]+)\s*;",
    r"^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*)\.\*\s*;",
)
KOTLIN_IMPORTS = (
    r"^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*)\.\*\s*(?:;)?\s*$",
    r"^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]+)\s+as\s+[a-zA-Z_][a-zA-Z0-9_]*\s*(?:;)?\s*$",
    r"^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*[a-zA-Z0-9_*])\s*(?:as\s+[a-zA-Z_][a-zA-Z0-9_]*\s*)?(?:;)?\s*$",
)
RUST_IMPORTS = (
    r"^\s*pub\s+use\s+([a-zA-Z_][a-zA-Z0-9_:]*)\s*;\s*$",
    r"^\s*use\s+(crate::[a-zA-Z_][a-zA-Z0-9_:]*)\s*;\s*$",
    r"^\s*use\s+(self::[a-zA-Z_][a-zA-Z0-9_:]*)\s*;\s*$",
    r"^\s*use\s+(super::[a-zA-Z_][a-zA-Z0-9_:]*)\s*;\s*$",
    r"^\s*use\s+([a-zA-Z_][a-zA-Z0-9_:]*)\s*;\s*$",
)
CSHARP_IMPORTS = (
    r'^\s*using\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*([a-zA-Z_][a-zA-Z0-9_.<>"\s,]+?)\s*;\s*$',
    r'^\s*using\s+static\s+([a-zA-Z_][a-zA-Z0-9_.<>"\s,]+?)\s*;\s*$',
    r'^\s*using\s+([a-zA-Z_][a-zA-Z0-9_.<>"\s,]+?)\s*;\s*$',
)
RUBY_IMPORTS = (
    r"""^\s*require_relative\s+['"]([^'"]+)['"]\s*$""",
    r"""^\s*require_all\s+['"]([^'"]+)['"]\s*$""",
    r"""^\s*require\s+File\.expand_path\s*\(\s*['"]([^'"]+)['"]""",
    r"""^\s*require\s+['"]([^'"]+)['"]\s*$""",
)
PHP_IMPORTS = (
    r"^\s*use\s+([A-Z][A-Za-z0-9_]*(?:\\[A-Z][A-Za-z0-9_]*)+)\s+as\s+\w+\s*;\s*$",
    r"^\s*use\s+function\s+([A-Za-z_][A-Za-z0-9_]*(?:\\[A-Za-z_][A-Za-z0-9_]*)+)\s*;\s*$",
    r"^\s*use\s+const\s+([A-Z_][A-Za-z0-9_]*(?:\\[A-Z_][A-Za-z0-9_]*)+)\s*;\s*$",
    r"^\s*use\s+([A-Z][A-Za-z0-9_]*(?:\\[A-Z][A-Za-z0-9_]*)+)\s*;\s*$",
    r"""^\s*require_once\s+__DIR__\s*\.\s*['"]\.?/([^'"]+)['"]\s*;?\s*$""",
)
SWIFT_IMPORTS = (
    r"^\s*@_exported\s+import\s+([A-Za-z_][A-Za-z0-9_]*)\s*$",
    r"^\s*import\s+(?:struct|class|enum|protocol|typealias|let|var|func)\s+([A-Za-z_][A-Za-z0-9_]*)\.\S+\s*$",
    r"^\s*import\s+([A-Za-z_][A-Za-z0-9_]*)\s*$",
)

# The light scan reads Go and TypeScript/JavaScript only.
SCAN_EXTENSIONS = {"go": (".go",), "typescript": (".ts", ".tsx", ".js", ".jsx")}
SCAN_SKIP = ("vendor", ".git", "node_modules", "dist", "build", "target")
SCAN_GO_SINGLE = r'^\s*import\s+"([^"]+)"'
SCAN_GO_BLOCK = r'^\s+(?:[a-zA-Z0-9_]+\s+)?"([^"]+)"'
SCAN_TS = (
    r"""^\s*import\s+(?:\{[^}]*\}\s*from\s+)?(?:\*\s*as\s+\w+\s+from\s+)?(?:\w+\s*,?\s*)?(?:\{[^}]*\}\s*from\s+)?['"]([^'"]+)['"]""",
    r"""(?:const|let|var)\s+\w+\s*=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""^\s*import\s+['"]([^'"]+)['"]""",
)

# First-line markers of generated files.
GENERATED_HEADERS = (
    "// Code generated by protoc-gen-",
    "// @generated",
    "// Generated by OpenAPI Generator",
    "// auto-generated",
    "// Code generated by protoc-gen-grpc-gateway",
)

# Directories a walk never enters, and those a project digest ignores.
WALK_SKIP = ("node_modules", "vendor", ".git", "dist", "build", ".next", "out")
DIGEST_SKIP = (".git", "node_modules", "vendor")
DIGEST_EXTENSIONS = {
    "go": (".go",),
    "typescript": (".ts", ".tsx", ".js", ".jsx"),
    "python": (".py",),
    "java": (".java",),
}
DIGEST_BINARIES = ("", ".exe", ".dll", ".so")
# ----------------------------------------------------------------------------
