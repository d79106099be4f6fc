"""Path expressions: lexical only, nothing looks at a disk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    """The directory, empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """The basename up to its last dot; a leading dot belongs to the name."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?<=.)\.([^.]*)$", 1)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def normalize(path: Column) -> Column:
    """Without ``.`` and with ``..`` resolved; null where it leaves the root or is absolute."""
    escaped = F.array(F.lit("\u0000"))

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) == 0, escaped).when(acc == escaped, acc).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when((part == "") | (part == "."), acc).when(part == "..", up).when(acc == escaped, acc).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.startswith(path, F.lit("/")) | F.array_contains(parts, "\u0000"), None).otherwise(F.array_join(parts, "/"))


def absolute(base: Column, rel: Column) -> Column:
    """``rel`` seen from the absolute directory ``base``, itself if it is absolute; ``.`` and ``..`` are resolved by their spelling and ``..`` stops at the root; null if ``rel`` is."""

    def step(acc: Column, part: Column) -> Column:
        return F.when((part == "") | (part == "."), acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    whole = F.when(F.startswith(rel, F.lit("/")), rel).otherwise(F.concat_ws("/", base, rel))
    return F.when(rel.isNotNull(), F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")))


def ancestors(path: Column) -> Column:
    """All directories above a path and the path itself, the root ``''`` first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def suffixes(path: Column) -> Column:
    """The path and everything behind one of its slashes: the keys of a suffix join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def join_rel(base: Column, rel: Column) -> Column:
    """``rel`` from the directory ``base``, normalised."""
    return normalize(F.when(base == "", rel).otherwise(F.concat_ws("/", base, rel)))


def literal_prefix(pattern: Column) -> Column:
    """Whole components before the first one with a wildcard."""
    parts = F.split(pattern, "/")
    wild = F.transform(parts, lambda p: p.rlike(r"[*?\[{]"))
    first = F.array_position(wild, True)
    return F.when(first == 0, pattern).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int")), "/"))


def strip_trailing_separators(path: Column) -> Column:
    """Without trailing slashes; the root stays."""
    return F.when(path.rlike("^/+$"), "/").otherwise(F.regexp_replace(path, "/+$", ""))


def is_repo_relative(uri: Column) -> Column:
    """Neither absolute, nor a URL, nor a drive."""
    return ~(F.startswith(uri, F.lit("/")) | F.startswith(uri, F.lit("\\")) | F.contains(uri, F.lit("://")) | (uri.rlike(r"(?s)^[A-Za-z]:[\\/]") & (F.octet_length(uri) > 3)))


def is_inside(path: Column, region: Column) -> Column:
    """At a component boundary; a path is not inside itself."""
    return F.startswith(path, F.concat(F.regexp_replace(region, "/+$", ""), F.lit("/"))) & (path != region)
