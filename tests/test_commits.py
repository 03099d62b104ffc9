import pytest
from content import nodes, prop, properties, two_revisions

from canopy.operators import commits
from canopy.schema import QueryError


def test_edits(spark):
    (n, p), _ = two_revisions(spark)
    gone = spark.createDataFrame([("/content/subtree",), ("/content/kept/leaf",)], "path string")
    put_nodes = nodes(spark, {"/content/kept/leaf": "new", "/content/z": "t"})
    put = properties(spark, prop("/content/z", "a", "Long", 1))
    n2, p2 = commits.edited(n, p, gone, put_nodes, put)
    assert {r.path: r.primary_type for r in n2.collect()} == {"/": None, "/content": "t", "/content/jcr:content": "t", "/content/kept": "t", "/content/kept/leaf": "new", "/content/z": "t"}
    assert {(r.path, r.name) for r in p2.collect()} == {("/content", "title"), ("/content", "count"), ("/content", "data"), ("/content/jcr:content", "ratio"), ("/content/z", "a")}


def test_versions(spark, tmp_path):
    before, after = two_revisions(spark)
    t = commits.VersionedTree(spark, str(tmp_path / "a"))
    with pytest.raises(QueryError):
        t.read()
    t.commit(*before, "r1", None)
    t.commit(*after, "r2", "r1")
    with pytest.raises(commits.ConflictError):
        t.commit(*before, "r3", "r1")
    assert t.revisions() == ["r2", "r1"] and t.read()[0].count() == after[0].count() and t.read("r1")[0].count() == before[0].count()
    other = t.backup(str(tmp_path / "b"))
    assert other.revisions() == ["r2"] and t.prune(1) == ["r1"] and t.revisions() == ["r2"]
    third = commits.VersionedTree(spark, str(tmp_path / "c"))
    third.restore(str(tmp_path / "b"))
    assert third.head() == "r2" and third.read()[1].count() == after[1].count()


def test_checkpoints(spark):
    c = spark.createDataFrame([("old", 1, 5), ("lost", 1, None), ("young", 1, 50)], "name string, created_ms bigint, expires_ms bigint")
    made = commits.created(c, "new", 10, 7)
    assert {(r.name, r.expires_ms) for r in made.collect()} == {("young", 50), ("new", 17)}
    assert {r.name for r in commits.removed(c, ["old"]).collect()} == {"lost", "young"} and commits.removed(c).count() == 0
    with pytest.raises(QueryError):
        commits.created(c, "x", 1, 0)
