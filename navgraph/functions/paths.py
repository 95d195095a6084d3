"""Paths and dotted names as column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_of(path: Column) -> Column:
    """Module of a ``.py`` path: separators become dots, a package's ``__init__`` stands for the package."""
    bare = F.regexp_replace(path, r"\.py$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(^|/)__init__$", ""), "/", ".")


def within(path: Column, scope: str) -> Column:
    """The scope itself, or below it as a folder; the empty scope holds everything."""
    root = scope.rstrip("/")
    return F.lit(True) if not root else (path == root) | path.startswith(root + "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """Path without its last part; '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def folder_key(path: Column, depth: int) -> Column:
    """Roll-up key: the first ``depth`` + 1 parts of a deeper path, else its folder."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth + 1, F.array_join(F.slice(parts, 1, depth + 1), "/")).otherwise(folder(path))


def top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit(""))


def matches(path: Column, patterns: list[str]) -> Column:
    """The file name fits one of the shell patterns (case counts)."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | base_name(path).rlike("^" + fnmatch.translate(pattern).replace(r"\Z", "$").replace("(?s:", "(?:"))
    return found


def like_literal(text: str) -> str:
    """``text`` for a LIKE pattern with escape backslash, its own wildcards taken literally."""
    return text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")


def display_name(cls: Column, name: Column) -> Column:
    """``Class.func``, ``func``, the class alone, or ``?`` where neither is known."""
    return F.when(cls.isNull() & name.isNull(), "?").otherwise(F.concat_ws(".", cls, name))
