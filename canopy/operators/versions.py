"""Questions to a journal of revisions: history of a path, the newest consistent revision, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validity(journal: DataFrame, segments: DataFrame, revision: str = "revision", segment: str = "segment") -> DataFrame:
    """Adds ``state``: ``ok``, ``segment missing`` or ``unparseable`` by the segment that the revision names.

    Of segments only their distinct ids are joined.
    """
    from canopy.functions import values

    named = journal.withColumn("__segment", values.record_segment(F.col(revision)))
    known = segments.select(F.col(segment).alias("__segment")).distinct().withColumn("__known", F.lit(True))
    state = F.when(F.col("__segment").isNull(), "unparseable").when(F.col("__known"), "ok").otherwise("segment missing")
    return named.join(known, "__segment", "left").withColumn("state", state).drop("__segment", "__known")


def node_history(journal: DataFrame, versions: DataFrame, path: str) -> DataFrame:
    """``line_no``, ``revision`` and ``record`` of a path in each revision of the journal; null where it isn't."""
    at = versions.where(F.col("path") == path).select("revision", "record")
    return journal.select("line_no", "revision").join(at, "revision", "left").select("line_no", "revision", "record")


def history_runs(history: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``run``, which grows where the record of a path differs from its record one revision before."""
    order = Window.partitionBy(path).orderBy("line_no")
    fresh = ~F.col("record").eqNullSafe(F.lag("record").over(order)) | (F.row_number().over(order) == 1)
    return history.withColumn("run", F.sum(fresh.cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def newest_good(checks: DataFrame, revision_limit: int = 0) -> DataFrame:
    """``path`` and the newest ``line_no`` and ``revision`` at which it is good; nulls where none is.

    ``checks`` has ``path``, ``line_no``, ``revision`` and ``good``.  With a limit,
    only the newest so many revisions are tried.
    """
    if revision_limit:
        newest = checks.select("line_no").distinct().orderBy(F.desc("line_no")).limit(revision_limit)
        checks = checks.join(newest, "line_no", "left_semi")
    good = F.when(F.col("good"), F.struct("line_no", "revision"))
    return checks.groupBy("path").agg(F.max(good).alias("m")).select("path", F.col("m.line_no").alias("line_no"), F.col("m.revision").alias("revision"))


def overall_good(per_path: DataFrame) -> DataFrame:
    """One row: the line at which the last outstanding path became good, null unless all paths are."""
    return per_path.agg(F.when(F.bool_and(F.col("line_no").isNotNull()), F.min("line_no")).alias("line_no"), F.count(F.lit(1)).alias("paths"))


def newest_good_remembering(checks: DataFrame) -> DataFrame:
    """Like ``newest_good``, where a place found corrupt in a newer revision must be sound in an older one.

    ``checks`` has ``path``, ``line_no``, ``revision``, ``corrupt_at`` (the first
    corrupt place in path order, null if the revision is sound) and ``sound`` (the
    places that can be read there).  From the newest revision on, one that can't
    read a remembered place is rejected untraversed and adds nothing; any other
    adds its first corrupt place, or is the answer.  The revisions of one path are
    folded in order; there are as many as the journal has lines.
    """
    entry = F.struct((-F.col("line_no")).alias("newest"), "line_no", "revision", "corrupt_at", "sound")
    folded = checks.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("revisions"))
    start = F.struct(F.lit(None).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("revision"), F.array().cast("array<string>").alias("memory"))

    def step(state: Column, r: Column) -> Column:
        done = state["line_no"].isNotNull()
        rejected = F.size(F.array_except(state["memory"], F.coalesce(r["sound"], F.array().cast("array<string>")))) > 0
        good = ~done & ~rejected & r["corrupt_at"].isNull()
        learns = ~done & ~rejected & r["corrupt_at"].isNotNull()
        return F.struct(
            F.when(good, r["line_no"].cast("bigint")).otherwise(state["line_no"]).alias("line_no"),
            F.when(good, r["revision"]).otherwise(state["revision"]).alias("revision"),
            F.when(learns, F.array_union(state["memory"], F.array(r["corrupt_at"]))).otherwise(state["memory"]).alias("memory"),
        )

    result = F.aggregate("revisions", start, step)
    return folded.select("path", result.alias("r")).select("path", F.col("r.line_no").alias("line_no"), F.col("r.revision").alias("revision"))


def prune_reasons(journal: DataFrame, keep: int | None) -> DataFrame:
    """Adds ``reason`` for each raw line that goes, null for those that stay.

    ``journal`` has ``line_no``, ``has_space``, ``valid_id``, ``segment_exists`` and
    ``readable``.  Only readable revisions fill the places of ``keep``.
    """
    from canopy.sources.journal import retention_boundary

    counts = F.col("has_space") & F.col("valid_id") & F.col("segment_exists") & F.col("readable")
    j = journal.withColumn("__fills", counts)
    j = retention_boundary(j, keep, "__fills") if keep else j.withColumn("beyond_retention", F.lit(False))
    reason = (
        F.when(~F.col("has_space"), "ParserSkippedNoSpace")
        .when(~F.col("valid_id"), "InvalidRecordIdentifier")
        .when(~F.col("segment_exists"), "MissingSegment")
        .when(F.col("beyond_retention"), "BeyondRetention")
        .when(~F.col("readable"), "UnreadableRevision")
    )
    return j.withColumn("reason", reason).drop("__fills", "beyond_retention")


def kept_backups(backups: DataFrame, now: int, age: int, keep: int) -> DataFrame:
    """Adds ``kept``: younger than ``age``, from the future, or among the newest ``keep`` of their target, ties included.

    ``backups`` has ``target``, ``name`` and ``mtime``.  A target's backups are few
    next to all; their ranks come from counts of the distinct times per target.
    """
    times = backups.groupBy("target", "mtime").agg(F.count(F.lit(1)).alias("n"))
    newer = Window.partitionBy("target").orderBy(F.desc("mtime")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = times.select("target", "mtime", (F.coalesce(F.sum("n").over(newer), F.lit(0)) + 1).alias("rank"))
    old = (F.col("mtime") <= now) & (F.lit(now) - F.col("mtime") >= age)
    return backups.join(ranks, ["target", "mtime"]).withColumn("kept", ~old | (F.col("rank") <= keep)).drop("rank")
