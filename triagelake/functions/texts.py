"""Column functions over texts and locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a long text is cut and what shows it; what a text for owners may not hold.
TEXT_LIMIT, CUT_MARK = 500, "... [truncated]"
HOST_PATH = r"(^|[ \t\r\n\"'`(])(/(tmp|work|Users|home|root|etc|var)\b|[A-Za-z]:\\|\.\.)"
CLAIMS = r"(?i)\b(confirmed|exploited|proved|proven)\b"


def truncated(text: Column, limit: int = TEXT_LIMIT) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(CUT_MARK))).otherwise(text)


def safe(text: Column) -> Column:
    """Neither a path of the host nor a claim that something was proven."""
    return ~text.rlike(HOST_PATH) & ~text.rlike(CLAIMS)


def plain(text: Column) -> Column:
    """Lower case, spaces collapsed, without a trailing (path:line)."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"\([^() ]+:[0-9]+\)", "")), r"[ \t\r\n]+", " "))


def remote(url: Column) -> Column:
    """A git remote in its https form, without .git and trailing slashes."""
    https = F.regexp_replace(F.trim(url), r"^git@([^:]+):(.+)$", "https://$1/$2")
    return F.regexp_replace(F.regexp_replace(https, "/+$", ""), r"\.git$", "")


def repository_name(url: Column) -> Column:
    return F.regexp_extract(remote(url), "([^/]*)$", 1)


def same_package(a: Column, b: Column) -> Column:
    """Equal, or one ends with a slash and the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))
