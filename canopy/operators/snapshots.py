"""What changed between consecutive full snapshots of a table.

All snapshots are shuffled once by key and brought into the order of their keys,
one beside the other, and cut into chunks where a key's own hash says so, so that
an insertion moves no cut but the ones beside it.  A chunk whose digest (its rows
and 128 bits over their keys and contents) is the same in the neighbouring
snapshot is dropped whole; the rows of other chunks are joined by key, as sorted
streams where they lie, and classified.  Contents travel as 128-bit digests,
never as values, so the shuffle carries keys and fixed-width numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators.common import HOT_SHARE, latest_rows, row_digest

#: A chunk holds 2**CHUNK_BITS keys on average.
CHUNK_BITS = 4
#: The catalogue of snapshots goes to every task; more of them are refused.
MOST_SNAPSHOTS = 100_000
#: Rows on which keys are sought that are delivered again and again, and how often such a key must be among them.
SOUGHT_ROWS, LEAST_REPEATS = 20_000, 30
CHANGES = ("added", "removed", "changed")


def _new_keys(rows: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether each row has another key than the one before; null equals null and NaN equals NaN."""
    n = rows.num_rows
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for k in keys:
            a, b = rows.column(k).slice(1), rows.column(k).slice(0, n - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            if pa.types.is_floating(a.type):
                same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
            out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def _classified(rows: pa.RecordBatch, keys: Sequence[str], last: int) -> pa.RecordBatch:
    """Changes within whole chunks of rows sorted by key, rank and version; ``last`` is the greatest rank."""
    new_key = _new_keys(rows, keys)
    rank = rows.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
    chunk = np.cumsum(new_key & rows.column("begins").to_numpy(zero_copy_only=False))
    # of repeated rows the last one counts: it has the latest version
    newest = np.flatnonzero(np.append(new_key[1:] | (rank[1:] != rank[:-1]), True))
    key, rank, chunk = np.cumsum(new_key)[newest], rank[newest], chunk[newest]
    content = [rows.column(h).to_numpy(zero_copy_only=False).view(np.uint64)[newest] for h in ("h1", "h2")]

    # digests of the cells that there are: a chunk in a snapshot
    place = chunk * (last + 1) + rank
    order = np.argsort(place, kind="stable")
    begin = np.flatnonzero(np.diff(place[order], prepend=-1))
    cells = place[order][begin]
    digest = [np.diff(begin, append=len(order)).astype(np.uint64), *(np.add.reduceat(h[order], begin) for h in content)]  # sums wrap, whatever the order
    follows = np.diff(cells) == 1
    for d in digest:
        follows &= d[1:] == d[:-1]
    # follows[i]: cell i + 1 is that of the next snapshot and matches, unless it is another chunk's
    follows &= cells[1:] % (last + 1) != 0
    of = np.searchsorted(cells, place)
    later = ~np.append(False, follows)[of] & (rank > 0)
    earlier = ~np.append(follows, False)[of] & (rank < last)

    rest = np.flatnonzero(later | earlier)  # rows of chunks that don't match
    key, rank, later, earlier = key[rest], rank[rest], later[rest], earlier[rest]
    beside = (key[1:] == key[:-1]) & (rank[1:] == rank[:-1] + 1)
    differs = np.zeros(max(len(rest) - 1, 0), bool)
    for h in content:
        differs |= h[rest][1:] != h[rest][:-1]
    old, new = np.append(False, beside)[: len(rest)], np.append(beside, False)[: len(rest)]
    added, removed = np.flatnonzero(later & ~old), np.flatnonzero(earlier & ~new)
    changed = np.flatnonzero(later & np.append(False, beside & differs)[: len(rest)])
    at = np.concatenate((added, removed, changed))
    pair = np.concatenate((rank[added], rank[removed] + 1, rank[changed]))
    code = np.repeat(np.arange(3), (len(added), len(removed), len(changed)))
    kept = rows.select(list(keys)).take(pa.array(newest[rest][at]))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(pair, pa.int32()), pa.array(CHANGES).take(pa.array(code))], names=[*keys, "pair", "change"])


def _differences(keys: Sequence[str], last: int):
    """Changes among rows sorted by key, rank and version.

    A chunk begins where a key's hash says so, in all snapshots alike, and at a
    partition's edge.  No more than a batch and an unfinished chunk is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        before = True
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = batch.column("begins").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(begins & ~np.concatenate(([before], begins[:-1])))  # surely another key
            before = begins[-1]
            if len(cuts):
                yield from _whole([*held, batch.slice(0, int(cuts[-1]))], keys, last)
                held = []
            held.append(batch.slice(int(cuts[-1])) if len(cuts) else batch)
        yield from _whole(held, keys, last)

    return run


def _whole(held: list[pa.RecordBatch], keys: Sequence[str], last: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in held if b.num_rows]
    if held:
        yield _classified(pa.Table.from_batches(held).combine_chunks().to_batches()[0], keys, last)


def snapshot_catalogue(snapshots: DataFrame, snapshot: str) -> tuple[DataFrame, int]:
    """``snapshot`` (as ``__id``) with its ``rank`` in their order, and how many there are.

    Fails when there are more than MOST_SNAPSHOTS, for the result is broadcast;
    changes only depend on two neighbours, so that longer lists can be given in
    parts that share a snapshot.
    """
    ids = sorted(r[0] for r in snapshots.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().limit(MOST_SNAPSHOTS + 1).collect())
    if len(ids) > MOST_SNAPSHOTS:
        raise ValueError(f"more than {MOST_SNAPSHOTS} snapshots")
    rows = [(s, k) for k, s in enumerate(ids)]
    kind = snapshots.schema[snapshot].dataType
    schema = T.StructType([T.StructField("__id", kind), T.StructField("rank", T.IntegerType())])
    return snapshots.sparkSession.createDataFrame(rows, schema), len(ids)


def _fold_hot(rows: DataFrame, digested: DataFrame, source: Sequence[str], own: Sequence[str]) -> DataFrame:
    """The digested rows with keys that are delivered again and again folded ahead of the shuffle.

    Such keys are found on a sample of ``rows`` by their hash; theirs are the only rows
    that are aggregated first.  The result is the same with and without.
    """
    n = rows.count()
    sought = rows.select(row_digest(source, 3).alias("k")).sample(min(1.0, SOUGHT_ROWS / max(n, 1)), 1).groupBy("k").count()
    least = max(LEAST_REPEATS, min(n, SOUGHT_ROWS) * HOT_SHARE)
    hot = [r.k for r in sought.where(F.col("count") >= least).collect()]  # at most 1 / HOT_SHARE and a few by chance
    if not hot:
        return digested.drop("k")
    folded = latest_rows(digested.where(F.col("k").isin(hot)), ["rank", *own], "version", ["h1", "h2"]).withColumn("version", F.lit(None).cast(digested.schema["version"].dataType))
    return digested.where(~F.col("k").isin(hot)).drop("k").unionByName(folded)


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, keys: Sequence[str], values: Sequence[str], version: str, snapshot: str = "snapshot_id") -> DataFrame:
    """``snapshot`` (the later one), the keys and ``change``: ``added``, ``removed`` or ``changed``.

    ``snapshots`` lists the snapshots in its column ``snapshot``; rows of others
    don't count.  Of several rows with the same snapshot and keys the one with
    the latest ``version`` counts; equal rows count once, and a tie between
    others is settled by their digests.  Null equals null, NaN equals NaN and
    strings compare byte by byte; null keys are keys.  Keys are of plain types.
    A snapshot without rows has lost everything its predecessor had.  Other
    columns of the input are ignored.  No snapshot or a single one, and an empty
    table, give no changes.
    """
    catalogue, n = snapshot_catalogue(snapshots, snapshot)
    all_columns = [*keys, *values]
    own = [f"__k{i}" for i in range(len(keys))]
    plain = rows.select(
        F.col(snapshot).alias("__id"), *(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(version).alias("version"),
        row_digest(all_columns, 1).alias("h1"), row_digest(all_columns, 2).alias("h2"), row_digest([snapshot, *keys], 3).alias("k"),
    )
    digested = plain.join(F.broadcast(catalogue), "__id").drop("__id")
    folded = _fold_hot(rows, digested, [snapshot, *keys], own)
    ordered = folded.repartition(*own).sortWithinPartitions(*own, "rank", "version", "h1", "h2")
    begins = row_digest(own, 4).bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)) == 0
    prepared = ordered.select(*own, "rank", "h1", "h2", begins.alias("begins"))
    schema = T.StructType([*(f for f in prepared.schema.fields if f.name in own), T.StructField("pair", T.IntegerType()), T.StructField("change", T.StringType())])
    changes = prepared.mapInArrow(_differences(own, n - 1), schema)
    names = catalogue.select(F.col("rank").alias("pair"), F.col("__id").alias(snapshot))
    return changes.join(F.broadcast(names), "pair").select(snapshot, *(F.col(o).alias(k) for o, k in zip(own, keys, strict=True)), "change")
