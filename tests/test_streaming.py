from content import two_revisions

from canopy.operators import sinks, tree
from canopy.streaming import refresh


def test_export_follows_the_journal(spark, tmp_path):
    before, after = two_revisions(spark)
    trees = {"r1": before, "r2": after}
    target, lines = str(tmp_path / "export"), tmp_path / "lines"
    lines.mkdir()
    make = lambda r: sinks.Provenance(r, "/content")
    sinks.write_parquet(tree.as_export(before[0], "/content"), before[1], target, make("r1"))
    done = []
    query = refresh.follow(refresh.journal_stream(spark, str(lines)), target, make, lambda s, r: trees[r], lambda: sinks.read_stamp(target, "nodes").revision, str(tmp_path / "state"), done.append)
    try:
        for name, text in (("a", "r1 root 1\n"), ("b", "junk\nr1 root 1\nr2 root 2\n")):
            (lines / name).write_text(text)
            query.processAllAvailable()
    finally:
        query.stop()
    assert [r.outcome for r in done] == ["Current", "Refreshed"]
    assert sinks.read_parquet(spark, target)[0].count() == tree.subtree(after[0], "/content").count()


def test_rates(spark, tmp_path):
    day = 86_400_000
    (tmp_path / "1").write_text(f"1,5,{day},1,1,x\n1,7,{day + 5},1,1,x\nbad\n")
    (tmp_path / "2").write_text(f"1,100,{10 * day},1,1,x\n")
    (tmp_path / "3").write_text(f"1,9,{day},1,1,x\n1,1,{20 * day},1,1,x\n")
    q = refresh.gc_rates(spark, str(tmp_path)).writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path.parent / "rates-state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = {r.start.day: (r.collections, r.reclaimed_bytes) for r in spark.table("rates").collect()}
    assert rows[2] in ((2, 12), (3, 21))
