"""Column functions of the findings model: severities, ids, paths, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from mild to severe, and what each adds to a score.
SEVERITIES = ("unknown", "low", "medium", "high", "critical")
SCORES = {"critical": 100, "high": 80, "medium": 50, "low": 20, "unknown": 10}
#: File extensions and their languages.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "php": "php", "rb": "ruby", "swift": "swift", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "vue": "vue", "svelte": "svelte"}
#: Patterns of secrets and what replaces them, in order.
REDACTIONS = (
    (r"AKIA[0-9A-Z]{16}", "[REDACTED_AWS_KEY]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED_TOKEN]"),
    (r"sk_(live|test)_[A-Za-z0-9]+", "[REDACTED_KEY]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    (r"(password|secret|token|api_key)\s*[=:]\s*\S+", "[REDACTED_VALUE]"),
)
_S = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _start(letters: str) -> str:
    """A word edge before one of some letters: the letter is looked at first, which few places of a text pass."""
    return f"(?=[{letters}])(?<![A-Za-z0-9_])"


#: The reference's six shapes of secrets in its order (spaces and word edges as in JavaScript): rule, pattern, what replaces it.
SECRETS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "-----BEGIN REDACTED PRIVATE KEY-----\n***REDACTED***\n-----END REDACTED PRIVATE KEY-----"),
    ("aws-key", f"{_start('A')}AKIA[0-9A-Z]{{16}}{_EDGE}", "***REDACTED***"),
    ("github-token", f"{_start('g')}gh[pousr]_[A-Za-z0-9_]{{20,}}{_EDGE}", "***REDACTED***"),
    ("payment-key", f"{_start('s')}sk_(?:live|test)_[A-Za-z0-9_=-]{{10,}}{_EDGE}", "***REDACTED***"),
    ("bearer", f"(?i){_start('a')}(Authorization[{_S}]*:[{_S}]*Bearer[{_S}]+)[A-Za-z0-9._~+/=-]{{8,}}", "$1***REDACTED***"),
    ("assignment", f"(?i){_start('apst')}((?:api[_-]?key|access[_-]?token|auth[_-]?token|token|secret|password|passwd|pwd)[{_S}]*[:=][{_S}]*[\"']?)[^\"',{_S}\\\\]{{8,}}", "$1***REDACTED***"),
)
#: Words of each shape, in lower case; a text that holds none of them in any case has no such secret.
SECRET_WORDS = {"private-key": ("private key-----",), "aws-key": ("akia",), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "payment-key": ("sk_live_", "sk_test_"), "bearer": ("bearer",), "assignment": ("key", "token", "secret", "passw", "pwd")}


def language(path: Column) -> Column:
    """The language of a path's extension; null if it is not code."""
    extension, out = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)), F.lit(None).cast("string")
    for name, lang in LANGUAGES.items():
        out = F.when(extension == name, lang).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for rank, name in enumerate(SEVERITIES):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def normal_severity(severity: Column, category: Column) -> Column:
    """Lower case; error, warning and note become high, medium and low; else medium for ci and iac, unknown otherwise."""
    low = F.lower(severity)
    named = F.when(low == "error", "high").when(low == "warning", "medium").when(low == "note", "low").when(low.isin(*SEVERITIES), low)
    return F.coalesce(named, F.when(category.isin("ci", "iac"), "medium").otherwise("unknown"))


def priority(severity: Column, category: Column) -> Column:
    out = F.lit(10)
    for name, score in SCORES.items():
        out = F.when(severity == name, score).otherwise(out)
    return out + F.when(category == "secret", 10).when(category == "dependency", 5).otherwise(0)


def verdict_impact(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "blocks-deploy").when(severity == "medium", "degrades").otherwise("informational")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the SHA-256 of the parts joined by NUL; null parts count as empty."""
    joined = F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))


def redacted(text: Column) -> Column:
    for pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, pattern, mask.replace("$", r"\$"))
    return text


def without_secrets(text: Column) -> Column:
    """The six redactions of whole texts, in order: key blocks span lines, so lines are split after it."""
    for _, pattern, mask in SECRETS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(mask))
    return text


def safe_relative(path: Column) -> Column:
    """Neither empty nor absolute, no NUL or backslash, no empty, `.` or `..` segment."""
    bad = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return F.coalesce((path != "") & ~path.contains("\0") & ~path.contains("\\") & ~bad, F.lit(False))
