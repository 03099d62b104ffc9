"""What a maintenance run may do, where it writes, and which files it leaves behind.

``files`` has ``file_name``, ``size`` and ``index_valid`` of a store's directory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import values
from canopy.operators.gc import ARCHIVE_NAME, archive_names
from canopy.schema import QueryError

#: The tasks of a run.
TASKS = ("compaction", "stale-archives", "temporaries", "journal", "checkpoints", "recovery-backups", "repair-archives")
#: Fixed forms: files that a run which didn't end has left.
ARCHIVE = ARCHIVE_NAME.removeprefix(r"\A").removesuffix(r"\z")
TEMPORARIES = {
    "journal": r"\Ajournal\.log\.(?:compacting|recovered|cleaning\.[0-9]{3})\z",
    "manifest": r"\Amanifest\.cleaning\.[0-9]{3}\z",
    "archive": rf"\A{ARCHIVE}\.(?:recovering|cleaning\.[0-9]{{3}})\z",
}


@dataclass(frozen=True)
class Options:
    """What is asked of a run; ``kind`` is ``full``, ``tail`` or None for no compaction."""

    kind: str | None = None
    tasks: frozenset[str] = field(default_factory=frozenset)
    purge_histories: bool = False
    purge_minimum_age: int | None = None
    backups_age: int | None = None
    backups_count: int | None = None
    journal_revisions: int | None = None

    def problem(self) -> str | None:
        """The first reason why these can't go together."""
        checks = (
            (self.kind not in (None, "full", "tail"), f"no such compaction: {self.kind}"),
            (bool(self.tasks - set(TASKS)), f"no such task: {', '.join(sorted(self.tasks - set(TASKS)))}"),
            (self.purge_histories and self.kind != "full", "histories can only be purged by a full compaction"),
            (self.purge_minimum_age is not None and not self.purge_histories, "a least age of purged histories needs their purge"),
            ("recovery-backups" in self.tasks and self.backups_age is None and self.backups_count is None, "backups need an age or a number to be kept"),
            ({"repair-archives", "recovery-backups"} <= self.tasks, "backups can't be retired in the run that repairs, for it makes them"),
            (self.journal_revisions is not None and "journal" not in self.tasks, "a bound of revisions needs the journal's task"),
        )
        return next((why for bad, why in checks if bad), None)

    def validated(self) -> Options:
        """These options, or QueryError."""
        if why := self.problem():
            raise QueryError(why)
        return self


def target_generation(generation: Column, full_generation: Column, full: bool) -> Column:
    """The generation that a compaction writes: one more, of the next full one if it is full; 32-bit numbers wrap."""
    following = lambda c: values.wrap32(c.cast("bigint") + 1).cast("int")
    return F.struct(following(generation).alias("generation"), (following(full_generation) if full else full_generation.cast("int")).alias("full_generation"), F.lit(True).alias("is_compacted"))


def temporaries(files: DataFrame) -> DataFrame:
    """``file_name`` and ``kind`` of files that an interrupted run left."""
    kind = F.coalesce(*(F.when(F.col("file_name").rlike(form), kind) for kind, form in TEMPORARIES.items()))
    return files.select("file_name", kind.alias("kind")).where(F.col("kind").isNotNull())


def archive_states(files: DataFrame) -> DataFrame:
    """``file_name`` and ``state`` of every archive.

    Of one number the highest letter that isn't empty and has a valid index is
    ``active``; lower letters are ``stale``, higher ones ``unusable``; without an
    active one all are ``undecided``.  Null sizes and validities count as empty
    and not valid.
    """
    usable = F.coalesce((F.col("size") > 0) & F.col("index_valid"), F.lit(False))
    named = archive_names(files).withColumn("usable", usable)
    best = named.groupBy("archive_number").agg(F.max(F.when(F.col("usable"), F.struct("letter", "file_name"))).alias("best"))
    own = F.struct("letter", "file_name")
    state = F.when(F.col("best").isNull(), "undecided").when(own == F.col("best"), "active").when(own < F.col("best"), "stale").otherwise("unusable")
    return named.join(best, "archive_number").select("file_name", state.alias("state"))
