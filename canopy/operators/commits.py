"""Writing: edits of a tree, versions of it with a head that moves by comparison, checkpoints of versions.

A version is a directory of Parquet tables that is never changed.  The journal is
appended to only after the version's data are written, so its lines never name
data that aren't there; a head that moved meanwhile makes a commit fail.
"""

from __future__ import annotations

import fcntl
import os
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import paths
from canopy.operators import sinks
from canopy.schema import ContentError, QueryError


class ConflictError(ContentError):
    """The head isn't what the commit was made from."""


def edited(nodes: DataFrame, properties: DataFrame, removed: DataFrame, put_nodes: DataFrame, put_properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree without the subtrees at ``removed.path``, with nodes put in place of those of the same path.

    A node that is put brings all its properties; its children stay.  Subtrees are
    found through ancestors, by equality.  Putting wins over removing.
    """
    gone = nodes.select("path", F.explode(paths.self_and_ancestors(F.col("path"))).alias("up")).join(removed.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("path").distinct()
    out = gone.unionByName(put_nodes.select("path")).distinct()
    kept_nodes, kept = nodes.join(out, "path", "left_anti"), properties.join(out, "path", "left_anti")
    return kept_nodes.unionByName(put_nodes.select(*nodes.columns)), kept.unionByName(put_properties.select(*properties.columns))


class VersionedTree:
    """Versions of a tree in a directory that the cluster shares."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.base = spark, Path(directory)
        self.base.mkdir(parents=True, exist_ok=True)

    @property
    def _journal(self) -> Path:
        return self.base / "journal.log"

    @contextmanager
    def _locked(self) -> Iterator[None]:
        with (self.base / "repo.lock").open("w") as f:
            fcntl.lockf(f, fcntl.LOCK_EX)
            yield

    def revisions(self) -> list[str]:
        """Newest first; those whose version is there."""
        lines = self._journal.read_text().splitlines() if self._journal.exists() else []
        return [r for r in (line.split(" ")[0] for line in reversed(lines)) if (self.base / "versions" / r).is_dir()]

    def head(self) -> str | None:
        return next(iter(self.revisions()), None)

    def read(self, revision: str | None = None) -> tuple[DataFrame, DataFrame]:
        revision = revision or self.head()
        if revision is None:
            raise QueryError("there is no version yet")
        return sinks.read_parquet(self.spark, str(self.base / "versions" / revision))

    def commit(self, nodes: DataFrame, properties: DataFrame, revision: str, expected: str | None) -> None:
        """Writes a version and makes it the head if the head still is ``expected``."""
        sinks.write_parquet(nodes, properties, str(self.base / "versions" / revision), sinks.Provenance(revision, "/"))
        with self._locked():
            if self.head() != expected:
                raise ConflictError(f"the head is {self.head()}, not {expected}")
            with self._journal.open("a") as f:
                f.write(f"{revision} root {int(time.time() * 1000)}\n")
                f.flush()
                os.fsync(f.fileno())

    def backup(self, target: str) -> VersionedTree:
        """Copies the head alone to another directory."""
        other, head = VersionedTree(self.spark, target), self.head()
        if head is None:
            raise QueryError("there is no version yet")
        if head not in other.revisions():
            other.commit(*self.read(head), head, other.head())
        return other

    def restore(self, source: str) -> None:
        """Makes the head of another directory the head of this one."""
        VersionedTree(self.spark, source).backup(str(self.base))

    def prune(self, keep: int) -> list[str]:
        """Takes all but the newest ``keep`` revisions out of the journal; their versions stay for who still reads them."""
        with self._locked():
            revisions = self.revisions()
            beside = self._journal.with_suffix(".writing")
            beside.write_text("".join(line + "\n" for line in self._journal.read_text().splitlines() if line.split(" ")[0] in revisions[:keep]))
            os.replace(beside, self._journal)
            return revisions[keep:]


def created(checkpoints: DataFrame, name: str, now: int, lifetime: int) -> DataFrame:
    """Checkpoints with a new one; expired ones, and such without expiry, make room for it."""
    from canopy.operators.checkpoints import expired

    if lifetime <= 0:
        raise QueryError("a checkpoint needs a lifetime")
    row = checkpoints.sparkSession.createDataFrame([(name, now, min(now + lifetime, 2**63 - 1))], "name string, created_ms bigint, expires_ms bigint")
    return checkpoints.where(~expired(now, missing_counts=True)).select("name", "created_ms", "expires_ms").unionByName(row)


def removed(checkpoints: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Checkpoints without those named, or none at all."""
    return checkpoints.where(~F.col("name").isin(list(names))) if names is not None else checkpoints.limit(0)
