"""Paths as columns.  A path is absolute; empty segments don't count; the root is ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    """The names on the way from the root, none for the root."""
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def from_segments(names: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(names, "/"))


def normalize(path: Column) -> Column:
    """Without repeated and trailing slashes, with a leading one; paths that are so aren't taken apart."""
    plain = path.startswith("/") & ~path.contains("//") & ~path.endswith("/")
    return F.when(plain, path).otherwise(from_segments(segments(path)))


def depth(path: Column) -> Column:
    return F.size(segments(path))


def parent(path: Column) -> Column:
    """Null for the root."""
    s = segments(path)
    return F.when(F.size(s) > 0, from_segments(F.slice(s, F.lit(1), F.size(s) - 1)))


def name(path: Column) -> Column:
    """Empty for the root."""
    return F.element_at(F.concat(F.array(F.lit("")), segments(path)), -1)


def ancestors(path: Column) -> Column:
    """Proper ancestors without the root, nearest last; none of a child of the root."""
    s = segments(path)
    n = F.size(s)
    # a sequence from 1 to 0 would count down
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: from_segments(F.slice(s, F.lit(1), i)))).otherwise(F.array().cast("array<string>"))


def self_and_ancestors(path: Column) -> Column:
    """The path, its ancestors and the root."""
    return F.array_distinct(F.concat(F.array(F.lit("/")), ancestors(path), F.array(normalize(path))))


def within(path: Column, root: str) -> Column:
    """Whether the path is ``root`` or below it; pushed down to scans as a prefix test."""
    if root == "/":
        return path.isNotNull()
    return (path == root) | path.startswith(root + "/")


def below(path: Column, root: str) -> Column:
    """Whether the path is a proper descendant of ``root``."""
    return (path != "/") if root == "/" else path.startswith(root + "/")


def document_order(path: Column) -> Column:
    """Key of the order in which a node comes right before its descendants."""
    return segments(path)


def normalize_text(path: str) -> str:
    """``normalize`` for a path that the caller gives."""
    return "/" + "/".join(s for s in path.split("/") if s)
