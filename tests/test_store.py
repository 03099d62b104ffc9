"""Reading stores that an independent writer made."""

import zlib

import pytest
from store_writer import Bulk, Segment, archive, bulk_id, data_id

from canopy.schema import FormatError, QueryError
from canopy.sources import archives
from canopy.store import ContentStore

LONG = "é" * 20_000


@pytest.fixture(scope="module")
def directory(tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    s, b, t = Segment(data_id(1)), Bulk(bulk_id(2)), Segment(data_id(3), (2, 1, False))
    leaves = {f"child-{k:02d}": s.node(properties=[("n", 3, s.text(str(k)))], primary="nt:leaf") for k in range(40)}
    props = [("title", 1, s.text("Hello World")), ("count", 3, s.text("42")), ("active", 6, s.text("TRUE")), ("ratio", 4, s.text("2.5")), ("bad", 3, s.text("x")), ("text", 1, s.long_text(LONG, b)),
             ("tags", -1, [s.text("a"), s.text("b")]), ("none", -1, []), ("many", -3, [s.text(str(k)) for k in range(600)]), ("data", 2, s.text("abc")), ("big", 2, s.external("blob#7"))]
    child_map = s.map_of(leaves)
    content = s.node(properties=props, primary="nt:page", mixins=["mix:a", "mix:b"], child_map=child_map)
    root = s.node({"content": content})
    point = s.node({"root": root, "properties": s.node()}, [("created", 3, s.text("5")), ("timestamp", 3, s.text("9"))])
    first = s.node({"root": root, "checkpoints": s.node({"cp-one": point})})
    new_leaf = t.node(properties=[("n", 3, t.text("1000"))], primary="nt:leaf")
    changed = t.node(properties=[("title", 1, t.text("Bye"))], primary="nt:page", child_map=t.overlay("child-00", new_leaf, t.overlay("extra", t.node(), child_map)))
    second = t.node({"root": t.node({"content": changed}), "checkpoints": t.node({"cp-one": point})})
    archive(d / "data00000a.tar", [s, b], binaries=[(s, ["blob#7"])])
    archive(d / "data00001a.tar", [Segment(data_id(9))])
    archive(d / "data00001b.tar", [t], index=False, graph=False)
    archive(d / "data00001c.tar", [t], graph=False)
    (d / "data00004a.tar").write_bytes(b"")
    (d / "manifest").write_text("# a comment\nstore.version=2\n")
    (d / "journal.log").write_text(f"{first[0]}:{first[1]} root 1000\nbroken\n{second[0]}:{second[1]} root 2000\n{data_id(77)}:1 root 3000\nx:y root 4000\n")
    (d / "gc.log").write_text(f"10,5,1000,1,1,7,{first[0]}:{first[1]}\n")
    return str(d), f"{first[0]}:{first[1]}", f"{second[0]}:{second[1]}"


@pytest.fixture(scope="module")
def store(spark, directory):
    return ContentStore.open(spark, directory[0])


def test_storage(store, directory):
    assert {(r.file_name, r.index_version, r.recovery_reason is None) for r in store.archives().collect()} == {("data00000a.tar", 2, True), ("data00001c.tar", 2, True)}
    rows = {r.segment: r for r in store.segments().collect()}
    assert {r.kind for r in rows.values()} == {"data", "bulk"} and len(rows) == 3
    assert rows[str(data_id(3))].generation == 2 and rows[str(data_id(3))].archive == "data00001c.tar"
    edges = {(r.source, r.target) for r in store.references().collect()}
    assert edges == {(str(data_id(1)), str(bulk_id(2))), (str(data_id(3)), str(data_id(1)))}
    assert [r.blob_id for r in store.binary_references().collect()] == ["blob#7"]
    assert store.summary().first().head == directory[2]
    dump = store.raw_segment(str(data_id(3))).orderBy("offset").first()
    assert dump.hex.startswith("30614b0d") and dump.text.startswith("0aK.")
    assert {r.type for r in store.segment(str(data_id(3))).collect()} == {"Value", "Template", "Node", "MapLeaf"} | {r.type for r in store.segment(str(data_id(3))).collect()}
    assert store.gc_log().first().compacted_nodes == 7


def test_journal_and_history(store, directory):
    assert {r.line_no: r.state for r in store.journal().collect()} == {0: "ok", 2: "ok", 3: "segment missing", 4: "unparseable"}
    assert store.head() == directory[2] == store.resolve("HEAD")
    with pytest.raises(QueryError):
        store.resolve("nonsense")
    history = {r.line_no: r.record for r in store.history("/content/extra").collect()}
    assert history[0] is None and history[2] is not None


def test_content(store, directory):
    nodes = {r.path: r for r in store.nodes(directory[1]).collect()}
    assert len(nodes) == 42 and nodes["/content"].primary_type == "nt:page" and nodes["/content/child-39"].depth == 2 and nodes["/"].primary_type is None
    rows = store.properties(directory[1]).where("path = '/content'").collect()
    at = {(r.name, r.position): r for r in rows}
    assert at["title", 0].value == "Hello World" and at["count", 0].long_value == 42 and at["active", 0].boolean_value is True and at["ratio", 0].double_value == 2.5
    assert at["text", 0].value == LONG and at["data", 0].binary_length == 3 and at["big", 0].binary_reference == "blob#7"
    assert at["tags", 1].value == "b" and at["none", None].multiple and at["jcr:mixinTypes", 1].value == "mix:b" and at["jcr:primaryType", 0].property_type == "Name"
    assert [at["many", k].long_value for k in range(600)] == list(range(600))
    newer = {r.path for r in store.nodes().collect()}
    assert newer == set(nodes) | {"/content/extra"}
    assert {tuple(r) for r in store.properties().where("path = '/content/child-00' and name = 'n'").select("long_value").collect()} == {(1000,)}
    assert [tuple(r) for r in store.checkpoints().collect()] == [("cp-one", 5, 9)]
    assert store.nodes(checkpoint="cp-one").count() == 42


def test_questions(store, directory, tmp_path):
    added, changed = store.difference(directory[1], "head", "/content")
    assert {tuple(r) for r in added.collect()} == {("/content/extra", "added")}
    names = {(r.path, r.name, r.change) for r in changed.collect()}
    assert ("/content", "title", "changed") in names and ("/content/child-00", "n", "changed") in names and ("/content", "count", "removed") in names
    hits = store.search_nodes(has_property=["title"], has_child=["child-01"], values_equal=[("title", "Hello World")])
    assert hits.count() == 1
    assert {r.problem for r in store.check().collect()} == set()
    assert store.attribution("data00001c.tar").where("part = 'node'").count() == 4
    assert store.export(str(tmp_path / "x"), "/content/child-00", kind="json-lines") == 1
    assert store.export(str(tmp_path / "y"), "/missing") is None and not (tmp_path / "y").exists()
    assert store.tree("/", 1).count() == 2
    assert store.plan_reclaim().columns == ["archive", "decision", "segments", "eligible_bytes", "freed_bytes"]


def test_recovery(store, directory):
    assert {r.node for r in store.super_roots().collect()} == set(directory[1:])
    assert store.recovered_journal() == [directory[2], directory[1]]
    assert store.consistent(directory[1]) and not store.consistent(f"{data_id(1)}:99999")


def test_damage(spark, directory, tmp_path):
    t = Segment(data_id(5))
    t.node(primary="x")
    archive(tmp_path / "data00000a.tar", [t, Segment(data_id(6))], index=False)
    raw = bytearray((tmp_path / "data00000a.tar").read_bytes())
    raw[512 + 40] ^= 1
    (tmp_path / "data00000a.tar").write_bytes(bytes(raw))
    found = archives.read_archives(spark, str(tmp_path)).collect()
    assert [r.segment for r in found] == [str(data_id(6))]
    assert archives.read_archives(spark, str(tmp_path), "archives").first().index_version is None
    with pytest.raises(FormatError):
        ContentStore.open(spark, str(tmp_path))
    (tmp_path / "manifest").write_text("store.version = 3")
    with pytest.raises(FormatError):
        archives.read_manifest(str(tmp_path))
    archive(tmp_path / "data00000.tar", [t])
    with pytest.raises(FormatError):
        archives.select_archives(str(tmp_path))


def saved(spark, directory, *segments):
    directory.mkdir()
    archive(directory / "data00000a.tar", list(segments))
    (directory / "manifest").write_text("store.version=2\n")
    (directory / "journal.log").write_text("")
    return ContentStore.open(spark, str(directory))


def super_root(s, content, **more):
    points = s.node({"cp": s.node({"root": s.node({"content": content})}, [("created", 3, s.text("5"))])})
    top = s.node({"root": s.node({"content": content, **more}), "checkpoints": points})
    return f"{top[0]}:{top[1]}"


def lost_branch(s, lost, bulk):
    return s.node(child_map=lost.map_of({f"n{k}": s.node() for k in range(40)}))


def lost_name(s, lost, bulk):
    return s.node(child_map=s.overlay("a", s.node(), s.add(0, s_leaf(s, lost))))


def s_leaf(s, lost):
    return b"\0\0\0\1" + b"\0\0\0\0" + s.ref(lost.text("child")) + s.ref(s.node())


CUTS = {
    "branch": lost_branch,
    "name": lost_name,
    "value": lambda s, lost, bulk: s.node(properties=[("p", 1, lost.text("x"))]),
    "element": lambda s, lost, bulk: s.node(properties=[("p", -1, [s.text("x"), lost.text("y")])]),
    "list": lambda s, lost, bulk: s.node(properties=[("p", 1, lost.counted([])), ("q", 1, s.text("x"))]),
    "block": lambda s, lost, bulk: s.node(properties=[("p", 2, s.long_text("z" * 20_000, bulk))]),
    "child": lambda s, lost, bulk: s.node({"x": lost.node()}),
    "nothing": lambda s, lost, bulk: s.node(properties=[("p", 2, s.text("x")), ("q", -1, [])], primary="t", mixins=["m"]),
}


def test_consistency_of_damaged_stores(spark, tmp_path):
    """Each head reaches something in a segment that is lost, but for one."""
    s = Segment(data_id(1))
    tops = {cut: super_root(s, make(s, Segment(data_id(8)), Bulk(bulk_id(9)))) for cut, make in CUTS.items()}
    store = saved(spark, tmp_path / "s", s)
    assert {cut: store.consistent(top) for cut, top in tops.items()} == {cut: cut == "nothing" for cut in CUTS}


def test_recovery_remembers_broken_paths(spark, tmp_path):
    """A head from before the broken node was made doesn't have it, so it doesn't count as whole; one that can read it does."""
    lost = Segment(data_id(8))
    segments = [Segment(data_id(k)) for k in range(1, 5)]
    tops = []
    for k, s in enumerate(segments):
        more = {} if k == 0 else {"late": s.node(properties=[("p", 1, (lost if k == 3 else s).text("x"))])}
        content = s.node({"late": more["late"]}) if more else s.node()
        tops.append(super_root(s, content))
    assert saved(spark, tmp_path / "a", segments[0], segments[3]).recovered_journal() == []
    assert saved(spark, tmp_path / "b", *segments).recovered_journal() == [tops[2], tops[1], tops[0]]


class Raw(bytes):
    def encode(self):
        return bytes(self)


def test_binaries_of_equal_length(spark, tmp_path):
    """Other bytes of the same length are a change, and a digest shows what was read."""
    old, new, bulk, lost = Segment(data_id(1)), Segment(data_id(2)), Bulk(bulk_id(3)), Bulk(bulk_id(4))
    small, large = (Raw(b"\xff\x01"), Raw(b"\xfe\x01")), (Raw(b"\xf0" * 20_000), Raw(b"\xf1" * 20_000))
    same = Raw(bytes(range(256)))
    rows = lambda s, k: [("small", 2, s.text(small[k])), ("large", 2, s.long_text(large[k], bulk)), ("same", 2, s.text(same))]
    first = super_root(old, old.node(properties=rows(old, 0)))
    second = super_root(new, new.node(properties=[*rows(new, 1), ("gone", 2, new.long_text(large[1], lost))]))
    store = saved(spark, tmp_path / "s", old, new, bulk)
    (tmp_path / "s" / "journal.log").write_text(f"{first} root 1\n{second} root 2\n")
    changed = {(r.name, r.change) for r in store.difference(first, second)[1].collect()}
    assert changed == {("small", "changed"), ("large", "changed"), ("gone", "added")}
    line = store.digest().where("path = '/content'").first().line
    shown = {p.partition("=")[0]: p.partition(":")[2] for p in line.split("\t")[1:]}
    crc = lambda raw: f"{len(raw)}/{len(raw)}@{zlib.crc32(raw):08x}"
    assert shown == {"small": crc(small[1]), "large": crc(large[1]), "same": crc(same), "gone": "20000/0@00000000"}
    assert "binary_crc32" not in store.properties().columns


def test_stable_identifiers(spark, store, tmp_path):
    """A node that was never rewritten is its own; a rewritten one points at a block with where it was."""
    import struct

    own = {r.path: r.stable for r in store.stable_identifiers().collect()}
    assert own["/"] and {r.path: r.node for r in store.placed().collect()} == own
    s = Segment(data_id(5))
    block = s.add(5, data_id(77).bytes + struct.pack(">i", 12))
    root = s.node()
    at = s.ref(block)
    kind, body = s.records[root[1]]
    s.records[root[1]] = (kind, at + body[6:])
    top = s.node({"root": root, "checkpoints": s.node()})
    archive(tmp_path / "data00000a.tar", [s])
    (tmp_path / "manifest").write_text("store.version=2\n")
    (tmp_path / "journal.log").write_text(f"{top[0]}:{top[1]} root 1\n")
    moved = ContentStore.open(spark, str(tmp_path))
    assert [r.stable for r in moved.stable_identifiers().collect()] == [f"{data_id(77)}:12"]
    assert moved.summary().first().checkpoints == 0 and moved.history_facts().count() == 0
