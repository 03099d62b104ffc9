"""A store as one object: every question that its command line would answer is a method that gives a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import paths, values
from canopy.operators import checkpoints, diff, digest, gc, orphans, search, sinks, tree, versions
from canopy.operators.common import cut
from canopy.schema import CONTENT_COLUMNS, FormatError, QueryError, violations
from canopy.sources import archives, journal, records


class ContentStore:
    """A stopped store's directory, opened to be read; nothing in it is ever written."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    @classmethod
    def open(cls, spark: SparkSession, directory: str) -> ContentStore:
        archives.read_manifest(directory)
        return cls(spark, directory)

    # -- storage

    def archives(self) -> DataFrame:
        return archives.read_archives(self.spark, self.directory, "archives")

    @cached_property
    def _entries(self) -> DataFrame:
        return archives.read_archives(self.spark, self.directory, "segments")

    @cached_property
    def _segments(self) -> DataFrame:
        """One row per segment: that of its newest archive."""
        newest = self._entries.groupBy("segment").agg(F.max(F.struct("archive_number", "archive", "position")).alias("m")).select("segment", "m.archive", "m.position")
        return self._entries.join(newest, ["segment", "archive", "position"], "left_semi")

    def segments(self) -> DataFrame:
        return self._segments.drop("content")

    def segment(self, segment: str) -> DataFrame:
        """The records of one segment with the names of their types."""
        known = F.get(F.array(*(F.lit(n) for n in records.TYPE_NAMES)), F.col("type"))
        found = records.decode(self._segments.where(F.col("segment") == segment))
        return found.select("record_number", F.coalesce(known, F.concat(F.lit("UnknownType("), "type", F.lit(")"))).alias("type"), "offset", "problem")

    def raw_segment(self, segment: str) -> DataFrame:
        """``offset``, ``hex`` and ``text`` of a segment's bytes, 16 to a row; works on corrupt ones too."""
        one = self._segments.where(F.col("segment") == segment).select("content")
        rows = one.select("content", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("content") - 1) / 16).cast("int"))).alias("row"))
        piece = F.substring(F.col("content"), F.col("row") * 16 + 1, F.lit(16))
        return rows.select((F.col("row") * 16).alias("offset"), F.lower(F.hex(piece)).alias("hex"), F.regexp_replace(F.decode(piece, "ISO-8859-1"), r"[^ -~]", ".").alias("text"))

    def references(self) -> DataFrame:
        """Edges between segments: of archives' graphs, and of segments' own tables where an archive has none."""
        stored = archives.read_archives(self.spark, self.directory, "references")
        without = self._segments.join(stored.select("archive").distinct(), "archive", "left_anti")
        return stored.select("source", "target").unionByName(records.segment_references(without)).distinct()

    def binary_references(self) -> DataFrame:
        return archives.read_archives(self.spark, self.directory, "binary_references")

    def record_histogram(self) -> DataFrame:
        return self._decoded.records.groupBy("segment", "type").agg(F.count(F.lit(1)).alias("records"))

    def gc_log(self) -> DataFrame:
        path = os.path.join(self.directory, "gc.log")
        lines = self.spark.read.text(path) if os.path.exists(path) else self.spark.createDataFrame([], "value string")
        return lines.select(*journal.parse_gc_line("value"))

    # -- revisions

    def journal(self) -> DataFrame:
        """Lines with ``state``: ``ok``, ``segment missing`` or ``unparseable``."""
        lines = journal.read_journal(self.spark, os.path.join(self.directory, "journal.log"))
        return versions.validity(lines, self._segments.select("segment"))

    def head(self) -> str:
        """The newest revision whose segment is there."""
        newest = self.journal().where("state = 'ok'").agg(F.max(F.struct("line_no", "revision")).alias("m")).first().m
        if newest is None:
            raise FormatError("no revision of the journal can be resolved")
        return newest.revision

    def resolve(self, revision: str) -> str:
        """The key of a revision given as ``head`` or as a record identifier in either form."""
        if revision.lower() == "head":
            return self.head()
        row = self.spark.range(1).select(values.record_text(values.record_segment(F.lit(revision)), values.record_number(F.lit(revision))).alias("key")).first()
        if row.key is None:
            raise QueryError(f"not a revision: {revision}")
        return row.key

    @cached_property
    def _decoded(self) -> records.Decoded:
        return records.Decoded(self._segments)

    @cached_property
    def _children(self) -> DataFrame:
        return cut(self._decoded.children())

    @cached_property
    def _properties(self) -> DataFrame:
        return cut(records.property_rows(self._decoded.properties()))

    def _child(self, record: str, name: str) -> str | None:
        row = self._children.where((F.col("owner") == record) & (F.col("name") == name)).select("value").first()
        return row and row.value

    def _tree(self, record: str | None) -> DataFrame:
        """``path``, ``parent_path``, ``name``, ``depth`` and ``node`` of all that a node reaches, a level at a time."""
        columns = "path string, parent_path string, name string, depth int, node string"
        level = done = self.spark.createDataFrame([("/", None, "", 0, record)] if record else [], columns)
        depth = 0
        while not level.isEmpty():
            depth += 1
            up = level.select(F.col("node").alias("owner"), F.col("path").alias("parent_path"))
            path = F.concat(F.when(F.col("parent_path") == "/", "").otherwise(F.col("parent_path")), F.lit("/"), F.col("name"))
            level = cut(self._children.join(up, "owner").select(path.alias("path"), "parent_path", "name", F.lit(depth).alias("depth"), F.col("value").alias("node")))
            done = done.unionByName(level)
        return done

    def placed(self, revision: str = "head", checkpoint: str | None = None) -> DataFrame:
        """The content tree of a revision, or of a checkpoint in it, with each node's record."""
        top = self.resolve(revision)
        if checkpoint is not None:
            held = self._child(top, "checkpoints")
            top = held and self._child(held, checkpoint)
            if top is None:
                raise QueryError(f"no checkpoint {checkpoint}")
        return self._tree(self._child(top, "root"))

    def nodes(self, revision: str = "head", checkpoint: str | None = None) -> DataFrame:
        kinds = self._properties.where("name = 'jcr:primaryType' and property_type = 'Name' and not multiple").select("node", F.col("value").alias("primary_type"))
        return self.placed(revision, checkpoint).join(kinds, "node", "left").select("path", "parent_path", "name", "depth", "primary_type")

    def properties(self, revision: str = "head", checkpoint: str | None = None) -> DataFrame:
        return self.placed(revision, checkpoint).select("path", "node").join(self._properties, "node").drop("node", *CONTENT_COLUMNS)

    def checkpoints(self) -> DataFrame:
        held = self._child(self.head(), "checkpoints")
        inner = self._tree(held)
        rows = inner.select(F.concat(F.lit("/checkpoints"), "path").alias("path"), "node").join(self._properties, "node").drop("node")
        names = inner.where("depth = 1").select("name")
        return names.join(checkpoints.read_checkpoints(rows), "name", "left")

    # -- questions

    def stable_identifiers(self) -> DataFrame:
        """``path`` and ``stable`` of the head's nodes: an identifier that outlives compactions."""
        return self.placed().join(self._decoded.stable_identifiers(), "node", "left").select("path", "stable")

    def history_facts(self, storage: str = "/jcr:system/jcr:versionStorage") -> DataFrame:
        return orphans.history_facts(self.nodes(), self.properties(), storage)

    def summary(self) -> DataFrame:
        """One row: archives and their bytes, data and bulk segments, revisions, the head and its checkpoints."""
        s = self._segments.agg(F.count_if(F.col("kind") == "data").alias("data_segments"), F.count_if(F.col("kind") == "bulk").alias("bulk_segments"))
        a = self.archives().agg(F.count(F.lit(1)), F.sum("bytes")).first()
        return s.select(F.lit(a[0]).alias("archives"), F.lit(a[1]).alias("bytes"), "data_segments", "bulk_segments", F.lit(self.journal().count()).alias("revisions"), F.lit(self.head()).alias("head"), F.lit(self.checkpoints().count()).alias("checkpoints"))

    def node(self, path: str) -> DataFrame:
        return tree.properties_of(self.properties(), path)

    def tree(self, path: str = "/", depth: int = 1) -> DataFrame:
        return tree.listing(self.nodes(), path, depth)

    def search_nodes(self, has_property: Sequence[str] = (), has_child: Sequence[str] = (), values_equal: Sequence[tuple[str, str]] = (), limit: int = 10_000) -> DataFrame:
        """``node`` of each matching record, of revisions that no path leads to any more too."""
        found = self._decoded.nodes.select(F.col("node").alias("path"))
        kids = self._children.select(F.col("value").alias("path"), F.col("owner").alias("parent_path"), "name")
        nodes = found.withColumn("parent_path", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string")).unionByName(kids)
        hits = search.search(nodes, self._properties.withColumnRenamed("node", "path"), has_property, has_child, values_equal, limit=0).distinct()
        return (hits.orderBy("path").limit(limit) if limit else hits).withColumnRenamed("path", "node")

    def difference(self, before: str, after: str = "head", path: str = "/") -> tuple[DataFrame, DataFrame]:
        """Topmost nodes added and removed, and properties changed, at or below ``path``."""
        old, new = self.placed(before), self.placed(after)
        root = paths.normalize_text(path)
        scope = lambda df: df.where(paths.within(F.col("path"), root))
        # what has the same record is the same: equal subtrees are left out before any property is read
        both = old.select("path", F.col("node").alias("a")).join(new.select("path", F.col("node").alias("b")), "path").where("a <> b")
        values_of = lambda side: both.select("path", F.col(side).alias("node")).join(self._properties, "node").drop("node")
        return diff.node_changes(scope(old), scope(new)), diff.property_changes(scope(values_of("a")), scope(values_of("b")))

    def history(self, path: str) -> DataFrame:
        """``line_no``, ``revision`` and the record of a path in every revision that resolves; null where it isn't."""
        names = [s for s in path.split("/") if s]
        if names[:1] != ["checkpoints"]:
            names = ["root", *names]
        at = self.journal().where("state = 'ok'").select("line_no", "revision", F.col("revision").alias("record"))
        for name in names:  # as many joins as the path has names
            step = self._children.where(F.col("name") == name).select(F.col("owner").alias("record"), F.col("value").alias("next"))
            at = at.join(step, "record", "left").select("line_no", "revision", F.col("next").alias("record"))
        return at

    def digest(self, without: Sequence[str] = ()) -> DataFrame:
        read = self.placed().select("path", "node").join(self._properties, "node").drop("node")
        return digest.digest_lines(self.nodes(), read, without)

    def check(self) -> DataFrame:
        """``path`` and ``problem`` of the head's content, and of records that can't be read."""
        unread = self._decoded.records.where("problem is not null").select(F.col("record").alias("path"), "problem")
        p = self.properties()
        bad = p.where(((F.col("property_type") == "Long") & F.col("long_value").isNull() | (F.col("property_type") == "Double") & F.col("double_value").isNull()) & F.col("position").isNotNull())
        return unread.unionByName(violations(self.nodes(), p)).unionByName(bad.select("path", F.concat(F.lit("unreadable value of "), "name").alias("problem")))

    def attribution(self, archive: str) -> DataFrame:
        """``path``, ``record`` and ``part`` (node or template) of the head's content that an archive holds."""
        held = self._segments.where(F.col("archive") == archive).select("segment")
        at = self.placed().select("path", F.col("node").alias("record"), F.lit("node").alias("part"))
        shapes = self.placed().join(self._decoded.nodes.select("node", "template"), "node").select("path", F.col("template").alias("record"), F.lit("template").alias("part"))
        return at.unionByName(shapes).withColumn("segment", F.substring_index("record", ":", 1)).join(held, "segment", "left_semi").drop("segment")

    def plan_reclaim(self, full: bool = True, retained: int = 2) -> DataFrame:
        """What a collection would do with each archive."""
        segment = self.head().partition(":")[0]
        s = self.segments()
        marked = gc.mark(s, self.references(), s.where(F.col("segment") == segment), full, retained)
        files = self.spark.createDataFrame([(f,) for f in os.listdir(self.directory)], "file_name string")
        return gc.sweep(marked, files, savings_gate=True)

    def segment_times(self) -> DataFrame:
        """``segment`` and ``written_ms``, the time that a data segment's first record states; null without one."""
        first = self._decoded.records.where("record_number = 0")
        return first.select("segment", F.regexp_extract("text", r'"t":(-?[0-9]+)', 1).try_cast("bigint").alias("written_ms"))

    def super_roots(self) -> DataFrame:
        """``node`` of every record that could be a head, having both a root and checkpoints, newest first."""
        both = self._children.where(F.col("name").isin("root", "checkpoints")).groupBy("owner").agg(F.countDistinct("name").alias("n")).where("n = 2")
        at = both.select(F.col("owner").alias("node"), F.substring_index("owner", ":", 1).alias("segment"), F.substring_index("owner", ":", -1).cast("int").alias("number"))
        order = [F.desc_nulls_last("written_ms"), F.desc(values.signed_half(F.col("segment"), True)), F.desc(values.signed_half(F.col("segment"), False)), F.desc("number")]
        return at.join(self.segment_times(), "segment", "left").orderBy(*order).select("node", "written_ms")

    @cached_property
    def _soundness(self) -> DataFrame:
        return cut(self._decoded.soundness())

    def _verified(self, roots: Sequence[str]) -> DataFrame:
        """``tree`` (the place in ``roots``), ``path``, ``shallow`` and ``sound`` of all that the roots reach, a level at a time.

        A node is shallowly sound if its template and values can be read, and sound
        if its child map can be read too and it doesn't stand inside itself.
        """
        columns = "tree int, path string, node string, above array<string>"
        level, done = self.spark.createDataFrame([(k, "/", r, []) for k, r in enumerate(roots)], columns), None
        while not level.isEmpty():
            circle = F.array_contains("above", F.col("node"))
            shallow = F.coalesce(F.col("shape") & F.col("values"), F.lit(False))
            at = level.join(self._soundness, "node", "left").select("tree", "path", shallow.alias("shallow"), (shallow & F.col("entries") & ~circle).alias("sound"))
            done = at if done is None else done.unionByName(at)
            up = level.where(~circle).select("tree", F.col("node").alias("owner"), F.col("path").alias("parent_path"), F.array_append("above", F.col("node")).alias("above"))
            path = F.concat(F.when(F.col("parent_path") == "/", "").otherwise(F.col("parent_path")), F.lit("/"), F.col("name"))
            level = cut(self._children.join(up, "owner").select("tree", path.alias("path"), F.col("value").alias("node"), "above"))
        return cut(done)

    def _trees_hold(self, roots: Sequence[str], memory: list[str]) -> bool:
        """Whether the trees are sound and have all paths of ``memory``; the first unsound path is added to it."""
        if not roots:
            return True
        rows = self._verified(roots)
        probed = {(r.tree, r.path) for r in rows.where(F.col("path").isin(memory) & F.col("shallow")).select("tree", "path").collect()}
        # in the order of the child maps, a node ahead of what is below it
        names = F.filter(F.split("path", "/"), lambda n: n != "")
        order = F.struct(F.transform(names, lambda n: F.struct(values.map_hash(n).alias("hash"), n.alias("name"))).alias("names"), "path")
        broken = {r.tree: r.m.path for r in rows.where(~F.col("sound")).groupBy("tree").agg(F.min(order).alias("m")).collect()}
        for k in range(len(roots)):
            if any((k, path) not in probed for path in memory):
                return False
            if k in broken:
                memory.append(broken[k])
                return False
        return True

    def consistent(self, top: str, memory: list[str] | None = None) -> bool:
        """Whether all that a super-root's content and its checkpoints' content reach can be read.

        Every part of a child map, name, template, property, value and block must
        be there; metadata of checkpoints isn't looked at, and a number whose text
        doesn't parse counts as read (``check`` lists it).  ``memory`` holds paths
        found broken in newer super-roots: each must exist and be readable in every
        tree, or the super-root is turned down.  What is found here is added to it.
        """
        memory = [] if memory is None else memory
        shaped = self._soundness.where("shape").select(F.col("node").alias("owner"), "entries")
        inside = self._children.join(shaped, "owner")
        under = {r.name: r.value for r in inside.where((F.col("owner") == top) & F.col("name").isin("root", "checkpoints")).select("name", "value").collect()}
        if "root" not in under or not self._trees_hold([under["root"]], memory) or "checkpoints" not in under:
            return False
        held = under["checkpoints"]
        if shaped.where((F.col("owner") == held) & F.col("entries")).isEmpty():
            return False
        snapshots = inside.where("name = 'root'").select(F.col("owner").alias("point"), F.col("value").alias("root"))
        points = inside.where(F.col("owner") == held).select(values.map_hash(F.col("name")).alias("place"), "name", F.col("value").alias("point")).join(snapshots, "point", "left")
        roots = [r.root for r in points.orderBy("place", "name").collect()]
        present = roots[: roots.index(None)] if None in roots else roots
        return self._trees_hold(present, memory) and len(present) == len(roots)

    def recovered_journal(self) -> list[str]:
        """Revisions for a new journal, newest first: the newest inconsistent candidates are left out, older ones are kept unverified.

        Paths that are broken in one candidate are looked at first in the older ones.
        Candidates come to the driver, one per commit, as a journal's lines do.
        """
        found, memory = [r.node for r in self.super_roots().collect()], []
        for k, top in enumerate(found):
            if self.consistent(top, memory):
                return found[k:]
        return []

    def provenance(self, path: str = "/", depth: int | None = None) -> sinks.Provenance:
        return sinks.Provenance(self.head(), paths.normalize_text(path), depth)

    def export(self, target: str, path: str = "/", depth: int | None = None, kind: str = "parquet") -> int | None:
        """Writes a subtree as ``json-lines``, ``parquet`` or ``sqlite``; the number of nodes, None without any output if the path is missing."""
        nodes = tree.subtree(self.nodes(), path, depth)
        n = nodes.count()
        if not n:
            return None
        held = self.properties().join(nodes.select("path"), "path", "left_semi")
        if kind == "json-lines":
            sinks.write_json_lines(nodes, held, target, self.directory)
        elif kind == "parquet":
            sinks.write_parquet(tree.as_export(nodes, path), held, target, self.provenance(path, depth), self.directory)
        elif kind == "sqlite":
            sinks.write_sqlite(tree.as_export(nodes, path), held, target, paths.normalize_text(path), source=self.directory)
        else:
            raise QueryError(f"no such format: {kind}")
        return n
