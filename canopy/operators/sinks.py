"""Writing exports: JSON lines, Parquet, interned SQLite; provenance and guards.

An output is written beside its place and moved there at the end, so a reader
never sees half of one.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
from collections.abc import Callable
from contextlib import closing
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import paths, values
from canopy.schema import NODES, PROPERTIES, PROPERTY_TYPES, FormatError, require_schema

FORMAT = 1
STAMP = "_PROVENANCE.json"


@dataclass(frozen=True)
class Provenance:
    """What an export was made of."""

    revision: str
    root_path: str
    depth_limit: int | None = None
    format: int = FORMAT


def json_lines(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """``path`` and ``line``: each node as a JSON object of its path and properties, names in byte order.

    A multiple property is an array, also an empty one; a binary is an object
    with its length or its reference; a number that JSON lacks is a string.
    """
    number = F.col("double_value").cast("string")
    finite = ~F.isnan("double_value") & (F.abs(F.col("double_value")) != float("inf"))
    one = F.coalesce(
        values.escape_json(F.col("value")), F.col("long_value").cast("string"), F.when(finite, number).otherwise(F.concat(F.lit('"'), number, F.lit('"'))), F.col("boolean_value").cast("string"),
        F.concat(F.lit('{"binary_length":'), F.col("binary_length").cast("string"), F.lit("}")), F.concat(F.lit('{"binary_reference":'), values.escape_json(F.col("binary_reference")), F.lit("}")),
    )
    item = F.when(F.col("position").isNotNull(), F.struct("position", F.coalesce(one, F.lit("null")).alias("text")))
    per_property = properties.groupBy("path", "name").agg(F.max("multiple").alias("m"), F.array_sort(F.collect_list(item)).alias("v"))
    joined = F.array_join(F.col("v.text"), ",")
    shown = F.concat(values.escape_json(F.col("name")), F.lit(":"), F.when(F.col("m"), F.concat(F.lit("["), joined, F.lit("]"))).otherwise(joined))
    per_node = per_property.select("path", F.struct("name", shown.alias("text")).alias("p")).groupBy("path").agg(F.array_sort(F.collect_list("p")).alias("p"))
    body = F.coalesce(F.array_join(F.col("p.text"), ","), F.lit(""))
    line = F.concat(F.lit('{"path":'), values.escape_json(F.col("path")), F.lit(',"properties":{'), body, F.lit("}}"))
    return nodes.select("path").join(per_node, "path", "left").select("path", line.alias("line"))


def _place(target: str, source: str | None) -> Path:
    """The target, refused if it exists or lies within the source's directory."""
    place = Path(target).resolve()
    if place.exists():
        raise FileExistsError(target)
    if source and (root := Path(source).resolve()) in (place, *place.parents):
        raise ValueError(f"{target} lies within {source}")
    return place


def write_json_lines(nodes: DataFrame, properties: DataFrame, target: str, source: str | None = None) -> None:
    place = _place(target, source)
    beside = f"{place}.writing"
    json_lines(nodes, properties).orderBy(paths.document_order(F.col("path"))).select("line").write.mode("overwrite").text(beside)
    os.replace(beside, place)


def write_parquet(nodes: DataFrame, properties: DataFrame, target: str, provenance: Provenance, source: str | None = None, replace: bool = False) -> None:
    """Both tables, sorted by path so that path predicates skip row groups, zstd, each with the stamp."""
    place = Path(target).resolve() if replace else _place(target, source)
    beside = Path(f"{place}.writing")
    for name, df, schema in (("nodes", nodes, NODES), ("properties", properties, PROPERTIES)):
        df = df.select(*(f.name for f in schema.fields))
        df.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").option("compression", "zstd").parquet(f"{beside}/{name}")
        (beside / name / STAMP).write_text(json.dumps(asdict(provenance)))
    if place.exists():
        old = Path(f"{place}.replaced")
        shutil.rmtree(old, ignore_errors=True)
        os.replace(place, old)
        os.replace(beside, place)
        shutil.rmtree(old)
    else:
        os.replace(beside, place)


def read_parquet(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of an export; raises FormatError for others."""
    out = []
    for name, schema in (("nodes", NODES), ("properties", PROPERTIES)):
        out.append(require_schema(spark.read.parquet(f"{target}/{name}"), schema, name))
    return out[0], out[1]


def read_stamp(target: str, name: str) -> Provenance | None:
    """The stamp of one table; None if it is missing or can't be read."""
    try:
        found = json.loads((Path(target) / name / STAMP).read_text())
        return Provenance(**found) if found.get("format") == FORMAT else None
    except (OSError, ValueError, TypeError, AttributeError):
        return None


def classify(target: str, root_path: str, depth_limit: int | None, resolves) -> tuple[str, str]:
    """What may happen to an existing export: ``Reusable``, ``Replaceable`` or ``Guarded``, and why.

    ``resolves`` tells whether a revision is known.
    """
    base = Path(target)
    present = {n: (base / n).exists() for n in ("nodes", "properties")}
    stamps = {n: read_stamp(target, n) for n, there in present.items() if there}
    if any(s is None or (base / n).is_symlink() or not (base / n).is_dir() for n, s in stamps.items()):
        return "Guarded", "not written by this export"
    if not stamps:
        return "Replaceable", "no export yet"
    if any((s.root_path, s.depth_limit) != (root_path, depth_limit) for s in stamps.values()):
        return "Guarded", "an export of something else"
    if not all(resolves(s.revision) for s in stamps.values()):
        return "Guarded", "its revision isn't known here"
    if len(stamps) == 1:
        return "Replaceable", "half of an export"
    return ("Reusable", "complete") if len(set(stamps.values())) == 1 else ("Replaceable", "an interrupted refresh")


@dataclass(frozen=True)
class Refreshed:
    """How a refresh ended: ``Current``, ``Refreshed``, ``NotReusable`` or ``Missing``."""

    outcome: str
    ranges: int = 0
    nodes: int = 0
    reason: str = ""


def refresh_parquet(spark: SparkSession, target: str, provenance: Provenance, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], *, resolves: Callable[[str], bool]) -> Refreshed:
    """Brings an export to the revision of ``provenance`` by replacing only what changed since its own.

    ``before`` and ``after`` are the nodes and properties of the whole tree at both
    revisions, and ``resolves`` says whether a revision is known: an export of one
    that isn't is left alone.  The result equals a full export.
    """
    from canopy.operators.diff import dirty_paths, dirty_ranges, node_changes, property_changes, refresh
    from canopy.operators.tree import as_export, subtree

    kind, why = classify(target, provenance.root_path, provenance.depth_limit, resolves)
    if kind != "Reusable":
        return Refreshed("NotReusable", reason=why)
    if read_stamp(target, "nodes").revision == provenance.revision:
        return Refreshed("Current")
    root, limit = provenance.root_path, provenance.depth_limit
    scope = lambda side: (subtree(side[0], root, limit), side[1].join(subtree(side[0], root, limit).select("path"), "path", "left_semi"))
    old, new = scope(before), scope(after)
    if new[0].isEmpty():
        return Refreshed("Missing")
    ranges = dirty_ranges(node_changes(old[0], new[0]), property_changes(old[1], new[1], old[0], new[0]), root, limit)
    n = ranges.count()
    if not n:
        return Refreshed("Current")
    published = read_parquet(spark, target)
    exported = (as_export(new[0], root), new[1])
    write_parquet(refresh(published[0], exported[0], ranges), refresh(published[1], exported[1], ranges), target, provenance, replace=True)
    return Refreshed("Refreshed", n, dirty_paths(exported[0], ranges).count())


#: The columns of the interned form's view: those of a table that are taken as they are, and those that are looked up (table, own key, its column).
EXPANDED = {
    "path": ("node_paths", "node_id", "path"), "name": ("strings", "name_id", "value"), "property_type": ("property_types", "type_id", "name"), "multiple": None, "position": None,
    "value": ("strings", "value_id", "value"), "long_value": None, "double_value": None, "boolean_value": None, "binary_length": None, "binary_reference": ("strings", "binary_reference_id", "value"),
}
OPTIONAL = {"value", "binary_reference"}
EXPANDED_VIEW = "CREATE VIEW properties_expanded AS SELECT {} FROM properties p{}".format(
    ", ".join(f"of_{c}.{x[2]} AS {c}" if x else f"p.{c}" for c, x in EXPANDED.items()),
    "".join(f"{' LEFT' if c in OPTIONAL else ''} JOIN {x[0]} of_{c} ON of_{c}.id = p.{x[1]}" for c, x in EXPANDED.items() if x),
)


def write_sqlite(nodes: DataFrame, properties: DataFrame, target: str, root_path: str = "/", indexes: bool = True, source: str | None = None) -> None:
    """One SQLite file of the interned form with its views.

    A single file has a single writer: rows stream through the driver, one
    partition at a time, in one transaction.
    """
    place = _place(target, source)
    beside = f"{place}.writing"
    Path(beside).unlink(missing_ok=True)
    with closing(sqlite3.connect(beside)) as db, db:
        db.executescript("""
            CREATE TABLE strings (id INTEGER PRIMARY KEY, value TEXT NOT NULL UNIQUE);
            CREATE TABLE nodes (id INTEGER PRIMARY KEY, parent_id INTEGER, name_id INTEGER NOT NULL, depth INTEGER NOT NULL, primary_type_id INTEGER);
            CREATE TABLE property_types (id INTEGER PRIMARY KEY, name TEXT NOT NULL);
            CREATE TABLE properties (node_id INTEGER NOT NULL, name_id INTEGER NOT NULL, type_id INTEGER NOT NULL, multiple INTEGER NOT NULL, position INTEGER NOT NULL, value_id INTEGER,
              long_value INTEGER, double_value REAL, boolean_value INTEGER, binary_length INTEGER, binary_reference_id INTEGER, PRIMARY KEY (node_id, name_id, position)) WITHOUT ROWID;
            CREATE TABLE export (root_path TEXT NOT NULL);
            CREATE VIEW node_paths AS WITH RECURSIVE w(id, path) AS (SELECT id, (SELECT root_path FROM export) FROM nodes WHERE parent_id IS NULL UNION ALL
              SELECT n.id, rtrim(w.path, '/') || '/' || s.value FROM nodes n JOIN w ON n.parent_id = w.id JOIN strings s ON s.id = n.name_id)
              SELECT w.id, w.path, n.depth, t.value AS primary_type FROM w JOIN nodes n ON n.id = w.id LEFT JOIN strings t ON t.id = n.primary_type_id;""")
        db.execute(EXPANDED_VIEW)
        db.executemany("INSERT INTO property_types VALUES (?, ?)", PROPERTY_TYPES.items())
        db.execute("INSERT INTO export VALUES (?)", (root_path,))
        tags = {v: k for k, v in PROPERTY_TYPES.items()}
        known: dict[str, int] = {}

        def intern(text: str | None) -> int | None:
            if text is None:
                return None
            if text not in known:
                if len(known) > 1 << 20:
                    known.clear()
                db.execute("INSERT OR IGNORE INTO strings(value) VALUES (?)", (text,))
                known[text] = db.execute("SELECT id FROM strings WHERE value = ?", (text,)).fetchone()[0]
            return known[text]

        db.execute("CREATE TEMP TABLE places (path TEXT PRIMARY KEY, id INTEGER)")
        for k, r in enumerate(nodes.orderBy(paths.document_order(F.col("path"))).toLocalIterator(), 1):
            parent = db.execute("SELECT id FROM places WHERE path = ?", (r.parent_path,)).fetchone()
            db.execute("INSERT INTO places VALUES (?, ?)", (r.path, k))
            db.execute("INSERT INTO nodes VALUES (?, ?, ?, ?, ?)", (k, parent and parent[0], intern(r.name), r.depth, intern(r.primary_type)))
        for r in properties.toLocalIterator():
            node = db.execute("SELECT id FROM places WHERE path = ?", (r.path,)).fetchone()
            if node is None or r.property_type not in tags:
                raise FormatError(f"property {r.name} of {r.path} can't be interned")
            position = -1 if r.position is None else r.position
            row = (node[0], intern(r.name), tags[r.property_type], int(r.multiple), position, intern(r.value), r.long_value, r.double_value, None if r.boolean_value is None else int(r.boolean_value), r.binary_length, intern(r.binary_reference))
            db.execute("INSERT INTO properties VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", row)
        if indexes:
            db.execute("CREATE INDEX nodes_by_parent ON nodes(parent_id)")
            db.execute("CREATE INDEX properties_by_name ON properties(name_id)")
        db.execute("ANALYZE")
    os.chmod(beside, 0o600)  # content is for its owner only
    os.replace(beside, place)


