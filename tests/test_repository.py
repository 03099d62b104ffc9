"""Operators of the content model on small fixtures with known results."""

import math
import random

import pytest
from content import every_shape, nodes, prop, properties, two_revisions
from pyspark.sql import functions as F

from canopy import schema
from canopy.functions import paths, values
from canopy.operators import checkpoints, diff, digest, gc, interned, orphans, search, sinks, tree, versions
from canopy.sources import journal


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, normal, depth, above",
    [("/", "/", 0, []), ("", "/", 0, []), ("a//b/", "/a/b", 2, ["/a"]), ("/a", "/a", 1, []), ("/a/b/c", "/a/b/c", 3, ["/a", "/a/b"]), ("/%/_/ü", "/%/_/ü", 3, ["/%", "/%/_"])],
)
def test_paths(spark, text, normal, depth, above):
    assert one(spark, text, paths.normalize) == normal == paths.normalize_text(text)
    assert one(spark, text, paths.depth) == depth
    assert one(spark, text, paths.ancestors) == above
    assert one(spark, text, paths.parent) == (None if depth == 0 else "/" + "/".join(normal[1:].split("/")[:-1]))
    assert one(spark, text, paths.name) == (normal.split("/")[-1] if depth else "")


def test_boundary_of_subtrees(spark):
    df = spark.createDataFrame([("/a/b",), ("/a/bc",), ("/a/b/c",), ("/",), (None,)], "p string")
    assert {r.p for r in df.where(paths.within(F.col("p"), "/a/b")).collect()} == {"/a/b", "/a/b/c"}
    assert {r.p for r in df.where(paths.below(F.col("p"), "/")).collect()} == {"/a/b", "/a/bc", "/a/b/c"}


@pytest.mark.parametrize("name, want", [("", 0xB4600A74), ("a", 0x3C9CBB27), ("root", 0xC28924EE), ("content", 0x96466A8F), ("Aa", 0x6059D734), ("BB", 0x6059D734)])
def test_map_hash(spark, name, want):
    assert one(spark, name, values.map_hash) == want


def test_string_hash(spark):
    assert one(spark, "hello", values.string_hash) == 99162322
    for text in ("é🙂x", "polygenelubricants", "zzzzzzzzzzz"):
        h = 0
        raw = text.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 31 + raw[k] * 256 + raw[k + 1]) % 2**32
        assert one(spark, text, values.string_hash) == (h - 2**32 if h >= 2**31 else h)


@pytest.mark.parametrize(
    "text, want",
    [("2012-03-01T12:30:45.678+01:00", 1330601445), ("1970-01-01T00:00:00Z", 0), ("1970-01-01T00:00:00.5Z", 0), ("2012-03-01T12:30:45", None), ("2012-03-01T12:30:45+0100", None), ("2012-13-01T12:30:45Z", None),
     ("2021-02-30T00:00:00Z", 1614643200), ("", None), (None, None)],
)
def test_epoch_seconds(spark, text, want):
    assert one(spark, text, values.epoch_seconds) == want


def test_small_formats(spark):
    for text, want in (("abc#123", 123), ("a#b#42", 42), ("abc", None), ("abc#notanumber", None), ("#", None)):
        assert one(spark, text, values.blob_length) == want
    u = "0f1e2d3c-4b5a-6978-a796-a5b4c3d2e1f0"
    for text, want in ((f"{u}:7", 7), (f"{u}.0000000a", 10), (f"{u}:07", None), (f"{u}.80000000", None), (f"{u}:2147483648", None), (u, None)):
        assert one(spark, text, values.record_number) == want
        assert one(spark, text, values.record_segment) == (u if want is not None else None)
    assert one(spark, u.upper(), values.identifier) == u and one(spark, "x" + u, values.identifier) is None
    assert one(spark, u, values.segment_kind) == "data"
    for n, want in ((0, "0 bytes"), (1, "1 byte"), (1023, "1023 bytes"), (1024, "1.0 KiB"), (50017075, "47.6 MiB"), (2**63 - 1, "7.9 EiB")):
        assert one(spark, n, values.byte_size, "bigint") == want
    assert one(spark, 18796598, values.grouped_count, "bigint") == "18,796,598"
    for n, want in ((-1, "unknown"), (0, "1970-01-01T00:00:00.000Z"), (1750000000123, "2025-06-15T15:06:40.123Z")):
        assert one(spark, n, values.instant_text, "bigint") == want
    for n, want in ((2**31, -(2**31)), (-(2**31) - 1, 2**31 - 1), (5, 5)):
        assert one(spark, n, values.wrap32, "bigint") == want
    assert one(spark, "a\tb\\n\x1f\x85\"é\x00", values.escape_json) == '"a\\tb\\\\n\\u001f\\u0085\\"é\\u0000"'
    assert one(spark, "\\\t\x1f", values.escape_digest) == "\\\\\\t\\x1F"
    assert one(spark, "a,,b,,", values.java_fields) == ["a", "", "b"] and one(spark, ",,", values.java_fields) == [] and one(spark, "", values.java_fields) == [""]
    assert [one(spark, t, values.boolean) for t in ("TRUE", "true ", "x", None)] == [True, False, False, False]
    assert one(spark, 12, values.type_name, "int") == "Decimal" and one(spark, "URI", values.type_tag) == 11 and one(spark, 13, values.type_name, "int") is None


def test_tree(spark):
    n, p = every_shape(spark)
    assert tree.node_at(n, "content/").count() == 1
    assert {r.path: r.children for r in tree.child_counts(n).collect()} == {"/": 1, "/content": 1, "/content/jcr:content": 0}
    assert tree.properties_of(p, "/content").count() == 10 and tree.properties_of(p, "/content", stored_only=True).count() == 9
    assert [r.line for r in tree.listing(n, "/", 9).collect()] == ["/", "  content [nt:unstructured]", "    jcr:content [nt:unstructured]"]
    assert {(r.path, r.parent_path, r.depth) for r in tree.as_export(n, "/content").collect()} == {("/content", None, 0), ("/content/jcr:content", "/content", 1)}
    assert tree.subtree(n, "/content", 0).count() == 1 and tree.subtree(n, "/nowhere").count() == 0
    assert schema.violations(n, p).count() == 0
    broken = n.where("path <> '/content'")
    assert {r.problem for r in schema.violations(broken, p.unionByName(p)).collect()} == {"missing parent", "property of a missing node", "repeated value"}
    with pytest.raises(schema.BudgetError):
        tree.guarded(n, most_nodes=2)
    with pytest.raises(schema.FormatError):
        schema.require_schema(n, schema.PROPERTIES, "nodes")
    order = spark.createDataFrame([("/a-b",), ("/a/b",), ("/a",), ("/",)], "path string").orderBy(paths.document_order(F.col("path")))
    assert [r.path for r in order.collect()] == ["/", "/a", "/a/b", "/a-b"]


def test_explode(spark):
    e = spark.createDataFrame([("/a", [1, 2]), ("/b", []), ("/c", None)], "path string, v array<bigint>")
    assert {(r.path, r.position, r.long_value) for r in tree.explode_values(e, "n", "Long", "v", True).collect()} == {("/a", 0, 1), ("/a", 1, 2), ("/b", None, None)}


def test_json_lines(spark):
    n, p = every_shape(spark)
    lines = {r.path: r.line for r in sinks.json_lines(n, p).collect()}
    assert lines["/"] == '{"path":"/","properties":{}}'
    assert lines["/content/jcr:content"] == '{"path":"/content/jcr:content","properties":{"jcr:primaryType":"nt:unstructured"}}'
    assert lines["/content"] == (
        '{"path":"/content","properties":{"count":42,"data":{"binary_length":3},"empty_tags":[],"external":{"binary_reference":"blob-1"},"flag":true,"jcr:primaryType":"nt:unstructured","ratio":2.5,"tags":["a","b"],"title":"Hello"}}'
    )
    odd = properties(spark, prop("/", "x", "Double", [math.nan, math.inf, -math.inf], True))
    assert sinks.json_lines(n.where("path = '/'"), odd).first().line.endswith('{"x":["NaN","Infinity","-Infinity"]}}')


def test_search(spark):
    n, p = every_shape(spark)
    found = lambda **k: [r.path for r in search.search(n, p, **k).collect()]
    assert found(has_property=["title", "count"]) == ["/content"] == found(has_child=["jcr:content"]) == found(values_equal=[("tags", "b"), ("flag", "true"), ("ratio", "2.5")])
    assert found(values_equal=[("data", "3")]) == [] == found(has_property=["title"], has_child=["nope"])
    assert search.parse_predicate("a=b=c") == ("a", "b=c")
    for bad in ("a", "=b"):
        with pytest.raises(schema.QueryError):
            search.parse_predicate(bad)
    with pytest.raises(schema.QueryError):
        search.search(n, p)


def test_diff_and_refresh(spark):
    (n0, p0), (n1, p1) = two_revisions(spark)
    dn, dp = diff.node_changes(n0, n1), diff.property_changes(p0, p1, n0, n1)
    assert {tuple(r) for r in dn.collect()} == {("/content/subtree", "removed"), ("/content/added", "added")}
    assert {(r.path, r.name, r.change) for r in dp.collect()} == {("/content", "title", "changed"), ("/content/jcr:content", "extra", "added")}
    ranges = diff.dirty_ranges(dn, dp, "/content")
    assert ranges.count() == 4
    assert diff.dirty_paths(n1, ranges).count() == 5
    for old, new in ((n0, n1), (p0, p1)):
        assert sorted(map(repr, diff.refresh(old, new, ranges).collect())) == sorted(map(repr, new.collect()))
    assert diff.dirty_ranges(dn, dp, "/content", 0).count() == 1
    assert diff.node_changes(n0, n0).count() == 0 == diff.property_changes(p0, p0).count()
    back = {(r.path, r.change) for r in diff.node_changes(n1, n0).collect()}
    assert back == {("/content/subtree", "added"), ("/content/added", "removed")}
    lines = {r.line for r in diff.rendered(dn, dp).collect()}
    assert "- /content/subtree" in lines and "  ^ /content/title\n    - Hello\n    + Goodbye" in lines


def test_value_equality(spark):
    def changes(a, b):
        return [(r.change, r.old_type, r.new_type) for r in diff.property_changes(properties(spark, a), properties(spark, b)).collect()]

    assert changes(prop("/", "x", "Double", math.nan), prop("/", "x", "Double", math.nan)) == []
    assert changes(prop("/", "x", "Double", 0.0), prop("/", "x", "Double", -0.0)) == [("changed", "Double", "Double")]
    assert changes(prop("/", "x", "String", "a"), prop("/", "x", "Name", "a")) == [("changed", "String", "Name")]
    assert changes(prop("/", "x", "String", "a"), prop("/", "x", "String", ["a"], True)) == [("changed", "String", "String")]
    assert changes(prop("/", "x", "String", [], True), prop("/", "x", "Long", [], True)) == [("changed", "String", "Long")]
    assert changes(prop("/", "x", "String", ["a", "b"], True), prop("/", "x", "String", ["b", "a"], True)) == [("changed", "String", "String")]


def test_digest(spark):
    n, p = every_shape(spark)
    lines = {r.path: r.line for r in digest.digest_lines(n, p).collect()}
    assert lines["/"] == "/"
    assert lines["/content"].split("\t")[1:] == [
        "count=Long:42", "data=Binary:3/3", "empty_tags=String[]:", "external=Binary:external:blob-1", "flag=Boolean:true", "jcr:primaryType=Name:nt:unstructured", "ratio=Double:2.5", "tags=String[]:a\x1fb", "title=String:Hello",
    ]
    assert tuple(digest.digest_summary(n, p).first()) == (3, 10, 2, 3)
    (n0, p0), (n1, p1) = two_revisions(spark)
    changed = {(r.path, r.change) for r in digest.compare_digests(digest.digest_lines(n0, p0), digest.digest_lines(n1, p1)).collect()}
    assert ("/content", "changed") in changed and ("/content/subtree/x", "removed") in changed and len(changed) == 7
    a = {r.path: r.subtree_hash for r in digest.subtree_hashes(n0, p0).collect()}
    b = {r.path: r.subtree_hash for r in digest.subtree_hashes(n1.repartition(7), p1.repartition(5)).collect()}
    assert a["/content/kept"] == b["/content/kept"] and a["/content"] != b["/content"] and a["/"] != b["/"] and len(a) == 7
    assert digest.subtree_hashes(n0.limit(0), p0).count() == 0


def test_parquet_export_and_refresh(spark, tmp_path):
    before, after = two_revisions(spark)
    target = str(tmp_path / "export")
    stamp = sinks.Provenance("r1", "/content")
    sinks.write_parquet(tree.as_export(before[0], "/content"), before[1], target, stamp)
    with pytest.raises(FileExistsError):
        sinks.write_parquet(*before, target, stamp)
    with pytest.raises(ValueError):
        sinks.write_json_lines(*before, str(tmp_path / "store/out"), str(tmp_path / "store"))
    again = sinks.refresh_parquet(spark, target, sinks.Provenance("r1", "/content"), before, after, resolves=lambda _: True)
    assert again.outcome == "Current"
    done = sinks.refresh_parquet(spark, target, sinks.Provenance("r2", "/content"), before, after, resolves=lambda _: True)
    assert (done.outcome, done.ranges, done.nodes) == ("Refreshed", 4, 5)
    got, full = sinks.read_parquet(spark, target), (tree.as_export(after[0], "/content"), after[1])
    assert sorted(map(repr, got[0].collect())) == sorted(map(repr, full[0].collect()))
    assert {tuple(r) for r in got[1].collect()} == {tuple(r) for r in full[1].collect()}
    gone = sinks.refresh_parquet(spark, target, sinks.Provenance("r3", "/content"), after, (after[0].where("path = '/'"), after[1].limit(0)), resolves=lambda _: True)
    assert gone.outcome == "Missing"
    unknown = sinks.refresh_parquet(spark, target, sinks.Provenance("r3", "/content"), before, after, resolves=lambda _: False)
    assert unknown.outcome == "NotReusable"
    assert sinks.classify(target, "/other", None, lambda _: True)[0] == "Guarded"
    assert sinks.classify(target, "/content", None, lambda _: False)[0] == "Guarded"
    assert sinks.classify(str(tmp_path / "none"), "/", None, lambda _: True)[0] == "Replaceable"
    (tmp_path / "export/nodes" / sinks.STAMP).write_text('{"revision": "r9", "root_path": "/content", "depth_limit": null, "format": 1}')
    assert sinks.classify(target, "/content", None, lambda _: True)[0] == "Replaceable"
    (tmp_path / "export/nodes" / sinks.STAMP).write_text("{")
    assert sinks.classify(target, "/content", None, lambda _: True)[0] == "Guarded"


def test_sqlite_and_lines(spark, tmp_path):
    import sqlite3

    n, p = every_shape(spark)
    sinks.write_sqlite(n, p, str(tmp_path / "x.sqlite"))
    db = sqlite3.connect(tmp_path / "x.sqlite")
    assert db.execute("SELECT path FROM node_paths ORDER BY id").fetchall() == [("/",), ("/content",), ("/content/jcr:content",)]
    view = {r[1:] for r in db.execute("SELECT id, path, depth, primary_type FROM node_paths")}
    assert view == {(r.path, r.depth, r.primary_type) for r in n.collect()}
    assert (tmp_path / "x.sqlite").stat().st_mode & 0o777 == 0o600
    rows = db.execute("SELECT name, position, value, long_value, binary_reference FROM properties_expanded WHERE path = '/content' ORDER BY name, position").fetchall()
    assert ("tags", 1, "b", None, None) in rows and ("empty_tags", -1, None, None, None) in rows and ("external", 0, None, None, "blob-1") in rows
    sinks.write_json_lines(n, p, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 3


def test_types_beyond_the_bound(spark):
    """Rows of types beyond the bound aren't lost in silence."""
    types = spark.range(interned.MOST_TYPES + 6).selectExpr("cast(id as int) id", "concat('t', id) name")
    strings = spark.createDataFrame([(1, "n")], "id bigint, value string")
    rows = types.selectExpr("1L node_id", "1L name_id", "id type_id", "0 multiple", "id position", "1L value_id", "cast(null as bigint) binary_reference_id")
    nodes = spark.createDataFrame([(1, "/")], "id bigint, path string")
    with pytest.raises(schema.FormatError):
        interned.expand(rows, strings, types, nodes)
    assert interned.expand(rows, strings, types.where(f"id < {interned.MOST_TYPES}"), nodes).count() == interned.MOST_TYPES


def test_interned(spark):
    n, p = every_shape(spark)
    ids = {r.value: r.id for r in interned.with_ids(interned.dictionary(n, p)).collect()}
    assert sorted(ids.values()) == list(range(1, len(ids) + 1)) and sorted(ids) == sorted(ids, key=ids.get)
    t = spark.createDataFrame([(1, None, 10), (2, 1, 11), (3, 2, 12), (8, 9, 11), (9, 8, 11)], "id bigint, parent_id bigint, name_id bigint")
    s = spark.createDataFrame([(10, ""), (11, "a"), (12, "b")], "id bigint, value string")
    assert {r.id: r.path for r in interned.node_paths(t, s).collect()} == {1: "/", 2: "/a", 3: "/a/b"}
    t.createOrReplaceTempView("tree_nodes")
    s.createOrReplaceTempView("tree_strings")
    by_sql = spark.sql(interned.NODE_PATHS_SQL.format(levels=50, nodes="tree_nodes", strings="tree_strings"))
    assert {r.id: r.path for r in by_sql.collect()} == {1: "/", 2: "/a", 3: "/a/b"}


def test_journal(spark, tmp_path):
    (tmp_path / "journal.log").write_text("a:1 root 5\nnospace\nb:2 root x\nc:3 root\n")
    got = [tuple(r) for r in journal.read_journal(spark, str(tmp_path / "journal.log")).orderBy("line_no").collect()]
    assert got == [(0, "a:1", 5), (2, "b:2", -1), (3, "c:3", -1)]
    j = spark.createDataFrame([(k, k % 3 != 0) for k in range(20)], "line_no int, readable boolean")
    beyond = {r.line_no for r in journal.retention_boundary(j, 4).where("beyond_retention").collect()}
    readable = [k for k in range(19, -1, -1) if k % 3]
    assert beyond == {k for k in range(20) if sum(x > k for x in readable) >= 4}
    line = spark.createDataFrame([("1,2,3,4,5,r",), ("1,2,3,4,9,6,r",), ("x,,3",), ("",)], "raw_line string").select(*journal.parse_gc_line())
    assert [tuple(r)[3:] for r in line.collect()] == [(4, 4, 5, "r"), (4, 9, 6, "r"), (-1, -1, -1, journal.NULL_RECORD), (-1, -1, -1, journal.NULL_RECORD)]


def test_corrupt_memory(spark):
    rnd = random.Random(6)
    rows, want = [], {}
    for path in ("/a", "/b", "/c", "/d", "/e", "/f"):
        memory, answer = [], None
        for line in range(12, -1, -1):
            corrupt = rnd.choice([None, "/x", "/y", "/z"]) if line > 3 else rnd.choice([None, "/x"])
            sound = [p for p in ("/x", "/y", "/z") if rnd.random() < 0.7 and p != corrupt]
            rows.append((path, line, f"r{line}", corrupt, sound))
            if answer is None and all(m in sound for m in memory):
                if corrupt is None:
                    answer = line
                elif corrupt not in memory:
                    memory.append(corrupt)
        want[path] = answer
    got = versions.newest_good_remembering(spark.createDataFrame(rows, "path string, line_no int, revision string, corrupt_at string, sound array<string>").repartition(4))
    assert {r.path: r.line_no for r in got.collect()} == want


def test_backups_and_checkpoints(spark):
    b = spark.createDataFrame([("t", str(k), m) for k, m in enumerate([100, 90, 90, 80, 10, 2000])], "target string, name string, mtime bigint")
    kept = {r.mtime for r in versions.kept_backups(b, 1000, 500, 3).where("kept").collect()}
    assert kept == {2000, 100, 90}
    c = spark.createDataFrame([("a", 5), ("b", 10), ("c", None)], "name string, expires_ms bigint")
    assert {r.name for r in c.where(checkpoints.expired(10)).collect()} == {"a"} and {r.name for r in c.where(checkpoints.expired(10, True)).collect()} == {"a", "c"}
    p = properties(spark, prop("/checkpoints/x", "created", "Long", 5), prop("/checkpoints/x", "timestamp", "Long", 9), prop("/checkpoints/y", "timestamp", "String", "9"), prop("/checkpoints/x/root", "created", "Long", 1))
    assert {tuple(r) for r in checkpoints.read_checkpoints(p).collect()} == {("x", 5, 9), ("y", None, None)}


def test_collection_planning(spark):
    rows = [("h", "data", "data00001a.tar", 5, 10, 9, 4, True), ("new", "data", "data00001a.tar", 6, 10, 9, 4, True), ("old", "data", "data00000a.tar", 1, 10, 5, 2, False), ("same", "data", "data00000a.tar", 2, 10, 9, 4, False),
            ("kept", "bulk", "data00000a.tar", 0, 10, 0, 0, False), ("free", "bulk", "data00000a.tar", -1, 10, 0, 0, False), ("odd", "data", "data00000a.tar", 3, 10, None, None, None)]
    s = spark.createDataFrame(rows, "segment string, kind string, archive string, position int, size int, generation int, full_generation int, is_compacted boolean")
    r = spark.createDataFrame([("same", "kept"), ("old", "free")], "source string, target string")
    marked = gc.mark(s, r, s.where("segment = 'h'"), full=True, retained=2)
    assert {x.segment for x in marked.where("reclaimable").collect()} == {"new", "old", "free"}
    files = spark.createDataFrame([("data00000a.tar",), ("data00001a.tar",), ("data00001b.tar",), ("x.tar",)], "file_name string")
    assert {x.archive: x.decision for x in gc.sweep(marked, files, False).collect()} == {"data00000a.tar": "Rewrite", "data00001a.tar": "BlockedByOccupiedGeneration"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert {x.segment for x in gc.closure(spark.createDataFrame([("a",)], "segment string"), edges).collect()} == {"a", "b", "c"}
    assert {x.file_name for x in gc.newest_letters(files).collect()} == {"data00000a.tar", "data00001b.tar"}
    ahead = {x.segment for x in gc.ahead_of_head(s, "h").where("ahead").collect()}
    assert ahead == {"new"}


def test_orphans(spark):
    u = lambda c: f"{c * 8}-1111-1111-1111-111111111111"
    h = spark.createDataFrame([(u("a"), "/s/1/a", 0, 5, 2, False), (u("b"), "/s/1/b", 0, 7, 3, False), (u("c"), "/s/2/c", 0, 9, 4, True), (u("d"), "/s/3/d", None, 1, 1, False), ("bad", "/s/3/x", 0, 1, 1, False)],
                              "history string, path string, newest bigint, bytes bigint, nodes bigint, configuration boolean")
    live = orphans.live_identifiers(properties(spark, prop("/content", "jcr:uuid", "String", u("a").upper()), prop("/s/9", "jcr:uuid", "String", u("b")), prop("/x", "jcr:uuid", "String", [u("b")], True)), "/s")
    lost = orphans.orphans(h, live)
    assert {r.history for r in lost.collect()} == {u("b"), u("c"), u("d")}
    assert tuple(orphans.report(h, live).first()) == (5, 1, 3, 8, 17, 1)
    none = spark.createDataFrame([], "history string")
    gone = orphans.purgeable(lost, none, 100, 50)
    assert {r.history for r in gone.collect()} == {u("b")}
    assert orphans.purgeable(lost, spark.createDataFrame([(u("b"),)], "history string"), 100, 50).count() == 0
    assert {r.path for r in orphans.empty_intermediates(h.where("history <> 'bad'"), lost.where("history not like 'd%'"), "/s").collect()} == {"/s/2"}
    refs = spark.createDataFrame([("A#1000",), ("A#1000",), ("B#2048",), ("custom",), (None,)], "binary_reference string")
    assert tuple(orphans.external_footprint(refs).first()) == (3, 3048, 1)


def test_provenance_and_fixture_names(spark):
    assert nodes(spark, {"/a/b": "t"}).first().parent_path == "/a"


def test_options():
    from canopy.operators.maintenance import Options
    from canopy.schema import QueryError

    good = [Options(), Options("full", purge_histories=True, purge_minimum_age=5), Options("tail", frozenset({"journal"}), journal_revisions=3), Options(tasks=frozenset({"recovery-backups"}), backups_count=1)]
    bad = [
        Options("other"), Options(tasks=frozenset({"other"})), Options("tail", purge_histories=True), Options("full", purge_minimum_age=5), Options(tasks=frozenset({"recovery-backups"})),
        Options(tasks=frozenset({"recovery-backups", "repair-archives"}), backups_age=1), Options("full", journal_revisions=3),
    ]
    assert [o.validated() for o in good] == good
    for o in bad:
        with pytest.raises(QueryError):
            o.validated()


def test_files_and_generations(spark):
    from canopy.operators import maintenance

    files = [("data00000a.tar", 5, True), ("data00000b.tar", 5, True), ("data00000c.tar", 0, True), ("data00000d.tar", 5, None), ("data00001.tar", None, True), ("x.tar", 5, True), ("journal.log.recovered", 1, None), ("data00000a.tar.cleaning.007", 1, None), ("journal.log.cleaning.1", 1, None), ("manifest.cleaning.000", 1, None)]
    df = spark.createDataFrame(files, "file_name string, size int, index_valid boolean")
    assert {r.file_name[4:10]: r.state for r in maintenance.archive_states(df).collect()} == {"00000a": "stale", "00000b": "active", "00000c": "unusable", "00000d": "unusable", "00001.": "undecided"}
    assert {tuple(r) for r in maintenance.temporaries(df).collect()} == {("journal.log.recovered", "journal"), ("data00000a.tar.cleaning.007", "archive"), ("manifest.cleaning.000", "manifest")}
    row = spark.createDataFrame([(2**31 - 1, 4)], "g int, f int").select(maintenance.target_generation(F.col("g"), F.col("f"), True).alias("a"), maintenance.target_generation(F.col("g"), F.col("f"), False).alias("b")).first()
    assert tuple(row.a) == (-(2**31), 5, True) and tuple(row.b) == (-(2**31), 4, True)


def test_unique_letters(spark):
    from canopy.schema import FormatError

    df = spark.createDataFrame([("data00000.tar",), ("data00000a.tar",), ("data00001b.tar",)], "file_name string")
    assert {r.file_name for r in gc.newest_letters(df).collect()} == {"data00000a.tar", "data00001b.tar"}
    with pytest.raises(FormatError):
        gc.newest_letters(df, unique=True)


def test_facts_of_nested_histories(spark):
    storage = "/jcr:system/jcr:versionStorage"
    kinds = [(storage, "rep:versionStorage"), (f"{storage}/a", "nt:versionHistory"), (f"{storage}/a/1", "nt:version"), (f"{storage}/a/1/b", "nt:versionHistory"), (f"{storage}/a/1/b/2", "nt:version"), ("/a", "nt:versionHistory"), (f"{storage}/loose", None)]
    nodes = tree.derive_nodes(spark.createDataFrame(kinds, "path string, primary_type string"))
    value = lambda path, name, kind, v=None, n=None, r=None: (path, name, kind, False, 0, v, None, None, None, n, r)
    properties = spark.createDataFrame(
        [value(f"{storage}/a/1", "jcr:created", "Date", "1970-01-01T00:00:09.000Z"), value(f"{storage}/a/1/b/2", "jcr:created", "Date", "bad"), value(f"{storage}/a/1/b/2", "x", "Binary", None, 7), value(f"{storage}/a/1/b/2", "y", "Binary", None, None, "blob"),
         value(f"{storage}/a/1/b", "jcr:frozenPrimaryType", "Name", "nt:configuration"), value("/a", "x", "Binary", None, 9)],
        "path string, name string, property_type string, multiple boolean, position int, value string, long_value bigint, double_value double, boolean_value boolean, binary_length bigint, binary_reference string",
    )
    got = {r.history: (r.newest, r.bytes, r.nodes, r.external_references, r.configuration) for r in orphans.history_facts(nodes, properties, storage).collect()}
    assert got == {"a": (9, 0, 2, 0, False), "b": (None, 7, 2, 1, True)}


def test_expiry_beyond_64_bits(spark, tmp_path):
    from canopy.plans import repository

    rows = [(1, -0.5), (1, 999.5), (775_807, 0.0), (775_808, 0.0), (860_160, -999.99), (899_999, 9999.99), (899_999, None)]
    spark.createDataFrame(rows, "c_custkey bigint, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    top = 2**63 - 1
    want = {(k, top if b is None else min(9223372036854000000 + k + math.floor(b * 1000), top)) for k, b in rows}
    got = repository.checkpoint_expiry(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want and dict(got.dtypes)["expires"] == "bigint"


def test_histories_are_folded_without_a_second_shuffle(spark, tmp_path):
    """Lines that repeat a number are one version; the tables that the facts are made of are shuffled by key only."""
    from canopy.plans import models, repository

    orders = [(k, "1-URGENT" if k % 2 else "5-LOW") for k in range(200)]
    lines = [(k, n, float(n), f"1996-01-{n + k % 20 + 1:02d}") for k in range(0, 190) for n in (1, 2, 2, 3)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    rows = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_quantity double, day string")
    rows.withColumn("l_shipdate", F.col("day").cast("timestamp")).drop("day").write.parquet(str(tmp_path / "lineitem.parquet"))
    stored, _ = models.version_storage(spark, str(tmp_path))
    assert stored.count() == stored.select("path").distinct().count() == 200 + 190 * 6
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        df = repository.history_facts(spark, str(tmp_path))
        got = {r.path: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    key = F.col("o_orderkey")
    for r in spark.createDataFrame(orders, "o_orderkey bigint, o string").select(key, models._history(key)[1].alias("path"), models._history(key)[0].alias("name")).collect():
        k, f = r.o_orderkey, got.pop(r.path)
        newest = 820454400 + (3 + k % 20) * 86400 if k < 190 else None
        assert (f.history, f.newest, f.bytes, f.nodes, f.external_references, f.configuration) == (r.name, newest, 8 if k < 190 else 0, 7 if k < 190 else 1, 0, k % 2 == 1 and k < 190)
    assert not got
    planned = [x for x in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in x]
    assert planned and all("path" not in x and "l_linenumber" not in x.split("hashpartitioning(")[1].split(")")[0] for x in planned)


def test_facts_of_histories_at_many_depths(spark):
    """Against a walk up from each node; shared keys or none, properties without a node, nodes outside."""
    storage, rnd = "/jcr:system/jcr:versionStorage", random.Random(5)
    kinds: dict[str, str | None] = {}
    for _ in range(400):
        parent = rnd.choice([storage, *kinds]) if kinds else storage
        kinds[f"{parent}/{rnd.choice('abcd')}"] = rnd.choice(["nt:versionHistory", "nt:version", "nt:version", "nt:frozenNode", None])
    extra = {"/content/x": "nt:versionHistory"}
    nodes = tree.derive_nodes(spark.createDataFrame([*kinds.items(), *extra.items()], "path string, primary_type string"))
    props = []
    for p in [*kinds, "/content/x", f"{storage}/none", *(f"{k}/none" for k in list(kinds)[:20])]:
        props += [(p, "jcr:created", "Date", False, 0, f"1970-01-01T00:00:{rnd.randrange(60):02d}.000Z", None, None, None, None, None), (p, "b", "Binary", False, 0, None, None, None, None, rnd.randrange(9), None), (p, "r", "Binary", True, 1, None, None, None, None, None, "x")]
    columns = "path string, name string, property_type string, multiple boolean, position int, value string, long_value bigint, double_value double, boolean_value boolean, binary_length bigint, binary_reference string"
    want: dict[str, list] = {p: [None, 0, 0, 0] for p, k in kinds.items() if k == "nt:versionHistory"}
    owner = lambda p: p if p in want else owner(p.rpartition("/")[0]) if p else None
    for p in kinds:
        if o := owner(p):
            want[o][2] += 1
    for p, name, *_, v, _, _, _, n, _ in props:
        if p in kinds and (o := owner(p)):
            if name == "jcr:created" and kinds[p] == "nt:version":
                want[o][0] = max(want[o][0] or 0, int(v[17:19]))
            want[o][1] += n or 0
            want[o][3] += name == "r"
    got = orphans.history_facts(nodes, spark.createDataFrame(props, columns), storage).collect()
    assert len({p.count("/") for p in want}) > 2
    assert {r.path: [r.newest, r.bytes, r.nodes, r.external_references] for r in got} == want and all(r.history == r.path.rpartition("/")[2] for r in got)
