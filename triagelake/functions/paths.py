"""Predicates and normal forms of paths. What does not depend on a row is a constant regular expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of package manifests, and patterns of further ones.
MANIFESTS = (
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "requirements.txt", "pyproject.toml", "poetry.lock", "Pipfile", "Pipfile.lock", "setup.py", "setup.cfg", "go.mod", "go.sum",
    "Cargo.toml", "Cargo.lock", "pom.xml", "composer.json", "composer.lock", "Gemfile", "Gemfile.lock", "mix.exs", "mix.lock", "pubspec.yaml", "pubspec.lock", "Package.swift",
)
MANIFEST_PATTERNS = (r"(?i)^requirements[-\w]*\.txt$", r"(?i)^build\.gradle(\.kts)?$", r"(?i)\.csproj$")
#: Patterns of whole paths.
WORKFLOW = r"(?i)^\.github/workflows/[^/]+\.ya?ml$"
CONTENT_TEXT = r"(?i)\.(?:[cm]?[jt]sx?|html?|svelte|vue|json|ya?ml|md|txt|scss|css|hbs)$"
GENERATED = r"(?i)(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|bun\.lockb|dist|build|coverage|vendor)\b"
RUNTIME = r"(?i)\.(?:[cm]?[jt]sx?|go|java|py)$"
IMAGE = r"(?i)\.(?:png|jpe?g|gif|webp|bmp|ico|svg)$"
HIDING = r"(?i)(?:steg|hidden|easter|secret)"
SOLIDITY = r"(?i)\.sol$"
IGNORED_CONTENT = r"(?i)(^|/)(test|tests|__tests__|fixtures|docs)/|\.(?:test|spec)\.[cm]?[jt]sx?$|(^|/)data/static/(?:codefixes/|challenges\.ya?ml$)|(^|/)frontend/src/assets/private/"
IGNORED_CONTRACT = r"(?i)(^|/)(test|tests|__tests__|fixtures|docs)/|(^|/)data/static/codefixes/"
#: Extensions of languages that code analysis supports, and of those it knows but does not.
SUPPORTED = {"cjs": "javascript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cts": "typescript", "mts": "typescript", "ts": "typescript", "tsx": "typescript", "java": "java", "py": "python", "go": "go"}
UNSUPPORTED = {"c": "c", "cc": "c++", "cpp": "c++", "cs": "csharp", "kt": "kotlin", "php": "php", "rb": "ruby", "rs": "rust", "scala": "scala", "swift": "swift"}
#: Directories of static assets.
ASSETS = ("assets", "build", "dist", "docs", "public", "static", "template", "templates", "vendor", "wwwroot")
#: Rules that are not reported in packaged scripts.
QUIET_RULES = ("javascript-eval", "javascript-function-constructor")
LIBRARIES = ("/libs/", "/lib/", "/vendor/", "/vendors/", "/third_party/", "/bower_components/")
#: Manifests of an ecosystem, the preferred first.
PREFERRED = {"maven": ("pom.xml", "build.gradle", "build.gradle.kts"), "npm": ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "package.json"), "golang": ("go.sum", "go.mod"), "pypi": ("requirements.txt", "poetry.lock", "Pipfile.lock", "pyproject.toml")}
#: Where scanners see the files of a repository.
SOURCE_DIR = "/work/source"


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name of a file without .yml or .yaml."""
    return F.regexp_replace(base(path), r"(?i)\.ya?ml$", "")


def is_manifest(path: Column) -> Column:
    name = base(path)
    out = name.isin(*MANIFESTS)
    for pattern in MANIFEST_PATTERNS:
        out = out | name.rlike(pattern)
    return out


def is_workflow(path: Column) -> Column:
    return path.rlike(WORKFLOW)


def is_infra(path: Column) -> Column:
    """Container, compose, Terraform and chart files, and cluster resources; never a workflow."""
    name, low = base(path), F.lower(path)
    chart = ((name == "Chart.yaml") | name.rlike(r"(?i)^values([.-].*)?\.ya?ml$")) & low.rlike("/(helm|charts)/")
    named = name.rlike(r"(?i)^dockerfile([.-].*)?$|^(docker-)?compose([.-].*)?\.ya?ml$|\.(tf|tfvars)$")
    cluster = name.rlike(r"(?i)\.(ya?ml|json)$") & low.rlike("(^|/)(k8s|kubernetes)/")
    return ~is_workflow(path) & (named | chart | cluster)


def is_content_text(path: Column) -> Column:
    return path.rlike(CONTENT_TEXT) & ~path.rlike(GENERATED)


def is_contract(path: Column) -> Column:
    return path.rlike(SOLIDITY)


def is_ignored_contract(path: Column) -> Column:
    return path.rlike(IGNORED_CONTRACT) | F.lower(base(path)).contains("correct")


def is_hidden_asset(path: Column) -> Column:
    """An image whose path speaks of hiding, or an upload with a # in its name."""
    hiding = path.rlike(HIDING) | (path.contains("/uploads/") & base(path).contains("#"))
    return ~path.rlike(IGNORED_CONTENT) & path.rlike(IMAGE) & hiding


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base(path), r"\.([^.]*)$", 1))


def _of(path: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for suffix, language in names.items():
        out = F.when(extension(path) == suffix, language).otherwise(out)
    return out


def supported(path: Column) -> Column:
    """The language of code analysis; null for others."""
    return _of(path, SUPPORTED)


def unsupported(path: Column) -> Column:
    return _of(path, UNSUPPORTED)


def is_asset(path: Column) -> Column:
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    return F.arrays_overlap(F.split(low, "/"), F.array(*(F.lit(x) for x in ASSETS))) | low.contains("-doc/") | low.rlike(r"\.(min|bundle)\.js$")


def _file_url(url: Column) -> Column:
    """The path of a file:// URL of this machine; null for other hosts, encoded slashes, malformed escapes and bytes that are no UTF-8."""
    path = F.regexp_extract(url, r"^file://(?i:localhost)?(/[^?#]*)", 1)
    kept = F.split(path, "/")
    up = lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(part)))
    path = F.array_join(F.aggregate(F.slice(kept, 2, F.size(kept)), F.slice(kept, 1, 1), up), "/")
    decoded = F.try_url_decode(F.regexp_replace(path, r"\+", "%2B"))
    bad = (path == "") | path.rlike("(?i)%2f") | path.rlike("%(?![0-9A-Fa-f]{2})") | (decoded.contains("\ufffd") & ~path.contains("\ufffd"))
    return F.when(~bad, decoded)


def scanned(path: Column) -> Column:
    """A scanner's path in the repository: no file scheme, source directory or ./; null where that is not safe."""
    out = F.regexp_replace(path, r"(?U)^\s+|\s+$", "")
    out = F.when(out.startswith("file://"), _file_url(out)).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(out, f"^{SOURCE_DIR}/", ""), r"^\./", "")
    bad = (out == "") | out.contains("\0") | out.contains("\\") | F.exists(F.split(out, "/"), lambda p: p.isin("", ".", ".."))
    return F.when(~bad, out)


def is_quiet(tool: Column, rule: Column, path: Column) -> Column:
    """A code-execution rule in a syntax highlighter's or a packaged minified library's script."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    highlighter = low.rlike("syntax-?highlighter/scripts/") & base(low).rlike(r"^sh[a-z0-9_-]*\.js$")
    library = base(low).rlike(r"[.-]min\.js$") & low.rlike("|".join(LIBRARIES))
    return (tool == "opengrep") & rule.isin(*QUIET_RULES) & (highlighter | library)


def ecosystem(purl: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(purl, "^pkg:([^/]+)/", 1)), F.lit(""))
