"""How often every term, or sequence of terms, occurs, and in how many records.

Suffix-sorted counting: every suffix of a record's terms, cut to the longest
length of interest, is routed by its first term, the suffixes are sorted in
reverse lexicographic order (longer before their prefixes), and one pass with a
stack adds up all prefixes at once: an entry that leaves the stack hands its
count and its records on to its prefix.

A term that a third of all records have would make one route as heavy, so a
route is a first term and a share of the records; there are as many shares as
keep the records of one few, whatever the cluster.  The shares' records are
disjoint: counts and record counts of a term are plain sums over its shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Records of one share: what a stack holds of them is 16 bytes each and level.
RECORDS_OF_A_SHARE = 500_000


class _Stack:
    """The prefixes of the current suffix with their counts and records.

    Records are 128-bit digests, kept as sorted arrays; what came since an array was
    last made is folded into it when it is as much again, so that a level holds
    at most twice its different records.
    """

    def __init__(self) -> None:
        self.field: str | None = None
        self.terms: list[str] = []
        self.counts: list[int] = []
        self.parts: list[list[np.ndarray]] = []
        self.sizes: list[list[int]] = []  # of a level: different records when it was last folded, records since

    @staticmethod
    def _distinct(parts: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(parts)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(axis=1)
        return both[new]

    def _put(self, level: int, records: np.ndarray) -> None:
        self.parts[level].append(records)
        size = self.sizes[level]
        size[1] += len(records)
        if size[1] > max(size[0], 1 << 12):
            folded = self._distinct(self.parts[level])
            self.parts[level], self.sizes[level] = [folded], [len(folded), 0]

    def pop(self, depth: int) -> Iterator[tuple]:
        while len(self.terms) > depth:
            count, records = self.counts.pop(), self._distinct(self.parts.pop())
            self.sizes.pop()
            yield self.field, tuple(self.terms), count, len(records)
            self.terms.pop()
            if self.terms:
                self.counts[-1] += count
                self._put(len(self.terms) - 1, records)

    def move(self, field: str, terms: list[str]) -> Iterator[tuple]:
        """To the next suffix; yields the prefixes that are complete."""
        same = 0
        if field == self.field:
            while same < min(len(terms), len(self.terms)) and terms[same] == self.terms[same]:
                same += 1
            if same == len(terms) == len(self.terms):
                return
        yield from self.pop(same)
        self.field = field
        for t in terms[same:]:
            self.terms.append(t)
            self.counts.append(0)
            self.parts.append([])
            self.sizes.append([0, 0])

    def add(self, records: np.ndarray, counts: np.ndarray) -> None:
        """Rows of the current suffix."""
        self.counts[-1] += int(counts.sum())
        self._put(len(self.terms) - 1, records)


def count_terms(sequences: DataFrame, field: str = "field", terms: str = "terms", record: str = "record", rows: str = "n_rows", longest: int = 1, most_records: int | None = None) -> DataFrame:
    """``field``, ``term`` (an array of 1 to ``longest`` terms), ``n_rows`` and ``n_records``.

    ``sequences`` has arrays of terms with the record they belong to and a
    count of how often that row stands (``rows``).  Null terms and null arrays
    are left out, empty strings are terms, terms count as written; a null
    record counts as a record of its own, a null field is a field.  A term that
    stands twice in a row counts twice, its record once.  Empty input gives
    an empty result; other columns are ignored.

    ``most_records`` is a bound of the number of records, by default the number of
    sequences, which then are counted; it decides into how many shares the records
    go.  A share's records are all that a task holds of a term, however common.
    """
    n = sequences.count() if most_records is None else most_records
    shares = -(-max(1, n) // RECORDS_OF_A_SHARE)
    text = F.coalesce(F.concat(F.lit("="), F.col(record).cast("string")), F.lit(""))
    s = sequences.select(
        F.col(field).alias("field"), F.array_compact(F.col(terms)).alias("terms"), F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(1), text).alias("r2"), F.col(rows).cast("bigint").alias("n")
    ).where(F.size("terms") > 0)
    at = F.explode(F.sequence(F.lit(1), F.size("terms")))
    suffixes = s.select("field", "terms", "r1", "r2", "n", at.alias("i")).select("field", F.slice("terms", F.col("i"), F.lit(longest)).alias("suffix"), "r1", "r2", "n")
    share = F.pmod(F.col("r1"), F.lit(shares))
    routed = suffixes.withColumn("share", share).repartition("field", F.col("suffix")[0], "share").sortWithinPartitions("share", F.desc("field"), F.desc("suffix"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, share = _Stack(), None
        out: list[tuple] = []

        def pack() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array([list(t) for t in columns[1]], pa.list_(pa.string())), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=["field", "term", "n_rows", "n_records"],
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # runs of equal field, suffix and share: their borders, found on dictionary codes
            suffix = batch.column("suffix")
            flat, offsets = suffix.flatten(), suffix.offsets.to_numpy()
            offsets = offsets - offsets[0]
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            width = np.diff(offsets)
            border = np.ones(n, bool)
            border[1:] = width[1:] != width[:-1]
            for k in range(longest):
                a = np.where(width > k, codes[np.minimum(offsets[:-1] + k, len(codes) - 1)], -1)
                border[1:] |= a[1:] != a[:-1]
            names = pa.array(batch.column("field").fill_null("\0")).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            part = batch.column("share").to_numpy(zero_copy_only=False)
            border[1:] |= (names[1:] != names[:-1]) | (part[1:] != part[:-1])
            begin = np.flatnonzero(border)
            counts = batch.column("n").to_numpy(zero_copy_only=False)
            records = np.stack([batch.column(r).to_numpy(zero_copy_only=False) for r in ("r1", "r2")], axis=1)
            for a, b in zip(begin, [*begin[1:], n], strict=True):
                if part[a] != share:  # another share: nothing is handed on
                    out.extend(stack.pop(0))
                    stack.field, share = None, part[a]
                out.extend(stack.move(batch.column("field")[a].as_py(), suffix[a].as_py()))
                stack.add(records[a:b], counts[a:b])
            if len(out) >= 10_000:
                yield pack()
        out.extend(stack.pop(0))
        if out:
            yield pack()

    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.ArrayType(T.StringType())), T.StructField("n_rows", T.LongType()), T.StructField("n_records", T.LongType())])
    counted = routed.mapInArrow(scan, schema)
    return counted.groupBy("field", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))


def mark_terms(counts: DataFrame, all_records: DataFrame, rare_below: int, common_above: float) -> DataFrame:
    """Adds ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than the share of ``all_records``' rows."""
    total = all_records.agg(F.count(F.lit(1))).scalar()
    rare = F.when(F.col("n_records") < rare_below, "rare")
    return counts.withColumn("mark", F.coalesce(rare, F.when(F.col("n_records") > F.lit(common_above) * total, "common")))
