"""Planning of garbage collection over the catalogue of segments.

``segments`` has ``segment``, ``kind`` (``data`` or ``bulk``), ``archive``,
``position``, ``size``, ``generation``, ``full_generation`` and ``is_compacted``;
``references`` has ``source`` and ``target``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import values
from canopy.operators.common import cut
from canopy.schema import FormatError

ARCHIVE_NAME = r"\Adata([0-9]{5,})([a-z])?\.tar\z"
#: A closure of more rounds than this isn't one of real data.
MOST_ROUNDS = 10_000
#: Rounds of a closure that are kept apart.
ROUNDS_APART = 16


def archive_names(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds ``archive_number`` and ``letter`` (``a`` if missing) to the files that are archives."""
    found = files.where(F.col(name).rlike(ARCHIVE_NAME))
    letter = F.regexp_extract(F.col(name), ARCHIVE_NAME, 2)
    return found.withColumn("archive_number", F.regexp_extract(F.col(name), ARCHIVE_NAME, 1).cast("bigint")).withColumn("letter", F.when(letter == "", "a").otherwise(letter))


def newest_letters(files: DataFrame, index_valid: str | None = None, unique: bool = False) -> DataFrame:
    """Per archive number the file of the highest letter, among those with a valid index if there are any.

    With ``unique`` two files of one number and letter (one may bear the letter
    ``a``, the other none) raise FormatError; else the greater name counts.
    """
    named = archive_names(files)
    if unique:
        twice = named.groupBy("archive_number", "letter").agg(F.countDistinct("file_name").alias("n"), F.min("file_name").alias("f")).where("n > 1").select("f").first()
        if twice:
            raise FormatError(f"two archives of one number and letter: {twice.f}")
    rank = F.struct(F.col(index_valid), "letter", "file_name") if index_valid else F.struct("letter", "file_name")
    best = named.groupBy("archive_number").agg(F.max(rank).alias("m"))
    return best.select("archive_number", F.col("m.letter").alias("letter"), F.col("m.file_name").alias("file_name"))


def first_locations(entries: DataFrame, probe_order: str) -> DataFrame:
    """One row per segment: its first archive in probe order."""
    return entries.groupBy("segment").agg(F.min(F.struct(probe_order, "archive")).alias("m")).select("segment", F.col("m.archive").alias("archive"))


def mark(segments: DataFrame, references: DataFrame, head: DataFrame, full: bool, retained: int, protected: DataFrame | None = None) -> DataFrame:
    """``segment``, ``archive``, ``kind``, ``size`` and ``reclaimable``.

    ``head`` is the head's row of ``segments``; without one nothing goes by its
    generation, and all compacted segments count as ahead.  Segments are seen in reverse order of writing: a compacted one ahead of the head goes, the
    head stays, other data segments go by their generations (unknown ones stay),
    and bulk segments go unless a data segment that stays refers to them.
    Each bulk segment is taken to be written before its referrers.

    Whether a segment is ahead of the head is a comparison with the head's own
    place, not a window over all segments.
    """
    h = head.select("segment", "archive", "position", "generation", "full_generation", "is_compacted").first()  # one row: it goes into the plan as it is
    s = segments
    is_head = F.col("segment") == F.lit(h.segment) if h else F.lit(False)
    by_generation, ahead = F.lit(False), F.lit(True)
    if h:
        ahead = F.struct("archive", "position") > F.struct(F.lit(h.archive), F.lit(h.position).cast(segments.schema["position"].dataType))
        own = tuple(F.lit(x) for x in (h.generation, h.full_generation, h.is_compacted))
        by_generation = F.coalesce(values.reclaimable(own, (F.col("generation"), F.col("full_generation"), F.col("is_compacted")), full, retained), F.lit(False))
    keep = is_head
    if protected is not None:
        s = s.join(protected.select("segment").distinct().withColumn("__kept", F.lit(True)), "segment", "left")
        keep = keep | (F.coalesce("__kept", F.lit(False)) & (F.col("kind") == "data"))
    first = F.when(keep, F.lit(False)).when(F.col("is_compacted") & ahead, F.lit(True)).when(F.col("kind") == "data", by_generation)
    s = s.withColumn("__first", first)
    kept_data = s.where((F.col("kind") == "data") & ~F.col("__first")).select(F.col("segment").alias("source"))
    alive = references.join(kept_data, "source", "left_semi").select(F.col("target").alias("segment")).distinct().withColumn("__alive", F.lit(True))
    return s.join(alive, "segment", "left").select("segment", "archive", "kind", "size", F.coalesce("__first", F.col("__alive").isNull()).alias("reclaimable"))


def sweep(marked: DataFrame, existing_files: DataFrame, savings_gate: bool, indexed: DataFrame | None = None) -> DataFrame:
    """Per archive with something to reclaim: ``decision``, its segments and the bytes won.

    ``indexed`` lists the archives (``archive``) that have an index, if not all do.
    An entry takes 512 bytes more than its size, which is filled up to 512.
    """
    occupied = (512 + F.ceil(F.col("size") / 512) * 512).cast("bigint")
    per = marked.groupBy("archive").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("reclaimable").alias("segments"),
        F.sum(occupied).alias("before"), F.sum(F.when(~F.col("reclaimable"), occupied).otherwise(0)).alias("after"),
    )
    files = archive_names(existing_files.select("file_name").distinct())
    per = archive_names(per.where(F.col("segments") > 0), "archive")
    if indexed is not None:  # without its index nobody knows what an archive holds: it is left alone
        per = per.join(indexed.select("archive").distinct(), "archive", "left_semi")
    letters = files.groupBy("archive_number").agg(F.collect_set("letter").alias("letters"))
    per = per.join(letters, "archive_number", "left")
    next_letter = F.chr(F.ascii("letter") + 1)
    others = F.size(F.array_except("letters", F.array("letter"))) > 0
    whole = F.col("segments") == F.col("entries")
    deferred = F.lit(savings_gate) & values.sweep_defers(F.col("before"), F.col("after"))
    decision = (
        F.when(whole & others, "BlockedByOccupiedGeneration")
        .when(whole, "Remove")
        .when(deferred, "DeferredBySavings")
        .when(F.col("letter") >= "z", "DeferredAtLastGeneration")
        .when(F.array_contains("letters", next_letter), "BlockedByOccupiedGeneration")
        .otherwise("Rewrite")
    )
    freed = F.when(F.col("decision").isin("Remove", "Rewrite"), F.col("before") - F.col("after")).otherwise(0)
    return per.withColumn("decision", decision).select("archive", "decision", "segments", (F.col("before") - F.col("after")).alias("eligible_bytes"), freed.cast("bigint").alias("freed_bytes"))


def sweep_totals(sweeps: DataFrame) -> DataFrame:
    """Per decision: archives, segments, bytes eligible and freed."""
    return sweeps.groupBy("decision").agg(
        F.count(F.lit(1)).alias("archives"), F.sum("segments").alias("segments"), F.sum("eligible_bytes").alias("eligible_bytes"), F.sum("freed_bytes").alias("freed_bytes")
    )


def closure(start: DataFrame, references: DataFrame) -> DataFrame:
    """``segment`` of all that the start reaches over references.

    Breadth first: each round joins only what the last one found, and is
    a checkpoint.  The driver sees counts, never segments.
    """
    frontier = cut(start.select("segment").distinct())
    seen = [frontier]
    edges = references.select(F.col("source").alias("segment"), "target")
    for _ in range(MOST_ROUNDS):
        known = reduce(DataFrame.unionByName, seen)
        found = edges.join(frontier, "segment", "left_semi").select(F.col("target").alias("segment")).distinct().join(known, "segment", "left_anti")
        frontier = cut(found)
        if frontier.isEmpty():
            return known
        # rounds are kept as they are and put together now and then, so that no row is written every round
        seen = [cut(known), frontier] if len(seen) >= ROUNDS_APART else [*seen, frontier]
    raise RuntimeError("the references are deeper than any real ones")


def convergence(reachable: DataFrame, head: DataFrame) -> DataFrame:
    """One row: whether the head is compacted and all reachable data segments are of its very generation."""
    h = head.agg(F.max(F.struct("generation", "full_generation", "is_compacted"))).scalar()
    data = reachable.where(F.col("kind") == "data").withColumn("__h", h)
    same = F.struct("generation", "full_generation", "is_compacted") == F.col("__h")
    return data.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.bool_and(same & F.col("__h.is_compacted")), F.lit(False)).alias("uniform"))


def totalized_graph(segments: DataFrame, references: DataFrame) -> DataFrame:
    """``segment`` and ``references``, their number, of every segment, 0 for those without."""
    n = references.distinct().groupBy(F.col("source").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return segments.select("segment").join(n, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("references"))


def ahead_of_head(segments: DataFrame, head_segment: str) -> DataFrame:
    """``segment`` and ``ahead`` by a running maximum in reverse order of writing: the windowed form, for small catalogues."""
    order = Window.orderBy(F.desc("archive"), F.desc("position")).rowsBetween(Window.unboundedPreceding, 0)
    return segments.select("segment", (F.max((F.col("segment") == head_segment).cast("int")).over(order) == 0).alias("ahead"))
