"""Loading delimited lines while setting apart those that can't be read.

Each Arrow batch is parsed as one byte buffer.  A mask of its quote bytes and
the parity of their running count tell delimiters from commas inside quotes;
counts and type checks then make each line either a typed row or a reject with
the first reason that applies: ``quoting``, ``column_count``, ``value``.
The work is a narrow map: no shuffle, and memory in proportion to a batch.
Files whose quoted fields may hold line ends are read in splits: the parity of
the quotes ahead of a split tells which of its line ends are ends of records.

Defined results: null and empty lines are ``column_count``; trailing CR and LF
don't belong to a line; a line repeated in the input is judged each time;
an empty table gives an empty table; columns that aren't named are dropped,
so that clashing names can't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, COMMA, CR, LF = 34, 44, 13, 10
#: Bytes of a split of a file, and of what is read at once beyond its end to finish a record.
SPLIT, READ_ON = 64 << 20, 1 << 20


@dataclass(frozen=True)
class Field:
    """A column of the layout: ``kind`` is ``int``, ``long``, ``record`` or ``text``."""

    name: str
    kind: str


#: The fields of a garbage-collection journal line; a line of six fields has no
#: ``full_generation`` of its own and takes that of ``generation``.
GC_FIELDS = (
    Field("repository_size", "long"),
    Field("reclaimed_size", "long"),
    Field("timestamp_milliseconds", "long"),
    Field("generation", "int"),
    Field("full_generation", "int"),
    Field("compacted_nodes", "long"),
    Field("root_record_identifier_text", "record"),
)
GC_LAYOUTS = {7: GC_FIELDS, 6: tuple(f for f in GC_FIELDS if f.name != "full_generation")}
GC_DEFAULTS = {"full_generation": "generation"}

#: Fixed forms of a record identifier: `<uuid>:<decimal>` and `<uuid>.<8 hex>`.
RECORD = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?::(?:0|[1-9][0-9]{0,9})|\.[0-7][0-9a-f]{7})\z"
INTEGER = r"\A[+-]?[0-9]+\z"
LIMITS = {"int": (2**31 - 1, 10), "long": (2**63 - 1, 19)}


@dataclass
class Structure:
    """Where the lines of a buffer and their fields lie, and which lines are well quoted."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    quoted_well: np.ndarray
    delimiters: np.ndarray
    first_delimiter: np.ndarray
    fields: np.ndarray


def index_lines(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Structure:
    """Structural index of the lines ``data[start:end]``; they don't overlap and ascend.

    A quote with an even number of quotes before it in its line opens, one with
    an odd number closes.  A line is well quoted when its quotes are even in
    number, every opening one stands at a field's start or right behind a
    closing one (a doubled quote), and every closing one is followed by a
    delimiter, the line's end or a quote.
    """
    end = end.copy()
    while True:  # trailing line ends: as many rounds as the longest run of them
        last = np.where(end > start, end - 1, 0)
        cut = (end > start) & np.isin(data[last] if len(data) else np.zeros(len(end)), (CR, LF))
        if not cut.any():
            break
        end[cut] -= 1
    n = len(start)
    is_quote = data == QUOTE
    running = np.concatenate(([0], np.cumsum(is_quote)))  # quotes before each byte
    before_line = running[start]
    quotes = np.flatnonzero(is_quote)
    line_of = np.searchsorted(start, quotes, side="right") - 1
    inside = quotes < end[line_of] if n else np.zeros(0, bool)
    quotes, line_of = quotes[inside], line_of[inside]
    opens = (running[quotes] - before_line[line_of]) % 2 == 0
    left = data[np.maximum(quotes - 1, 0)]
    right = data[np.minimum(quotes + 1, max(len(data) - 1, 0))] if len(data) else data
    ok_open = (quotes == start[line_of]) | (left == COMMA) | (left == QUOTE)
    ok_close = (quotes + 1 == end[line_of]) | (right == COMMA) | (right == QUOTE)
    bad = np.where(opens, ~ok_open, ~ok_close)
    well = (running[end] - before_line) % 2 == 0
    well[line_of[bad]] = False

    commas = np.flatnonzero(data == COMMA)
    line_of = np.searchsorted(start, commas, side="right") - 1
    keep = (commas < end[line_of]) & ((running[commas] - before_line[line_of]) % 2 == 0) if n else np.zeros(0, bool)
    commas, line_of = commas[keep], line_of[keep]
    count = np.bincount(line_of, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    return Structure(data, start, end, well, commas, first, count + 1)


def field_bounds(s: Structure, lines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of field ``k`` of each of the lines, without its outer quotes."""
    last = s.fields[lines] - 1
    a = s.start[lines] if k == 0 else s.delimiters[s.first_delimiter[lines] + k - 1] + 1
    if len(s.delimiters):
        b = np.where(last == k, s.end[lines], s.delimiters[np.minimum(s.first_delimiter[lines] + k, len(s.delimiters) - 1)])
    else:
        b = s.end[lines]
    quoted = (b > a) & (s.data[np.minimum(a, max(len(s.data) - 1, 0))] == QUOTE)
    return a + quoted, b - quoted


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings ``data[start:end]``, gathered in one pass."""
    length = end - start
    offsets = np.concatenate(([0], np.cumsum(length)))
    take = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[take])))


def read_integers(texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text is an integer of the kind, and its value (0 where it isn't)."""
    most, digits = LIMITS[kind]
    shaped = pc.match_substring_regex(texts, INTEGER)
    negative = pc.starts_with(texts, "-").to_numpy(zero_copy_only=False)
    bare = pc.utf8_ltrim(texts, "+-")
    bare = pc.if_else(shaped, bare, "0")
    bare = pc.utf8_ltrim(bare, "0")
    size = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    small = size <= digits
    padded = pc.if_else(pa.array(small), pc.utf8_lpad(bare, width=digits, padding="0"), "0" * digits)
    # 19 digits fit an unsigned 64-bit number
    value = pc.cast(padded, pa.uint64()).to_numpy(zero_copy_only=False)
    ok = shaped.to_numpy(zero_copy_only=False) & small & (value <= np.uint64(most) + negative.astype(np.uint64))
    # two's complement: negation of the unsigned number wraps to the signed one
    signed = np.where(negative, ~value + np.uint64(1), value).view(np.int64)
    return ok, np.where(ok, signed, 0)


def read_records(texts: pa.Array) -> np.ndarray:
    """Whether each text is a record identifier whose number fits 31 bits."""
    shaped = pc.match_substring_regex(texts, RECORD)
    number = pc.utf8_slice_codeunits(texts, start=37)
    decimal = pc.and_(shaped, pc.equal(pc.utf8_slice_codeunits(texts, start=36, stop=37), ":"))
    value = pc.cast(pc.if_else(decimal, number, "0"), pa.int64())
    return pc.and_(shaped, pc.less_equal(value, 2**31 - 1)).to_numpy(zero_copy_only=False)


def _string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string column; nulls have no bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[: int(at[-1])] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at[:-1].copy(), at[1:].copy()


def parse_lines(column: pa.Array, layouts: dict[int, Sequence[Field]], defaults: dict[str, str]) -> tuple[pa.Array, dict[str, pa.Array]]:
    """The reason against each line (null: none) and the columns of all fields (null in rejects)."""
    data, start, end = _string_buffers(column)
    n = len(start)
    s = index_lines(data, start, end)
    counted = np.isin(s.fields, list(layouts))
    names = {f.name: f.kind for fields in layouts.values() for f in fields}
    values: dict[str, np.ndarray] = {k: np.zeros(n, np.int64) if kind in LIMITS else np.full(n, None, object) for k, kind in names.items()}
    good = s.quoted_well & counted
    for width, fields in layouts.items():
        lines = np.flatnonzero(s.quoted_well & (s.fields == width))
        if not len(lines):
            continue
        fine = np.ones(len(lines), bool)
        for k, f in enumerate(fields):
            texts = slices(data, *field_bounds(s, lines, k))
            if f.kind in LIMITS:
                ok, number = read_integers(texts, f.kind)
                values[f.name][lines] = number
            else:
                ok = read_records(texts) if f.kind == "record" else np.ones(len(lines), bool)
                texts = pc.replace_substring(texts, '""', '"')  # fields without quotes have none
                values[f.name][lines] = texts.to_numpy(zero_copy_only=False)
            fine &= ok
        for name, other in defaults.items():
            if name not in {f.name for f in fields}:
                values[name][lines] = values[other][lines]
        good[lines] &= fine
    reason = np.full(n, None, object)
    reason[~good] = "value"
    reason[~counted] = "column_count"
    reason[~s.quoted_well] = "quoting"
    types = {"int": pa.int32(), "long": pa.int64()}
    columns = {k: pa.array(v, types.get(names[k], pa.string()), mask=~good) for k, v in values.items()}
    return pa.array(reason, pa.string()), columns


def load_lines(
    lines: DataFrame,
    identifier: str = "line_id",
    text: str = "raw_line",
    layouts: dict[int, Sequence[Field]] = GC_LAYOUTS,
    defaults: dict[str, str] = GC_DEFAULTS,
    only: str | None = None,
) -> DataFrame:
    """Every line as ``identifier``, ``reason`` and the typed fields of the layout.

    ``reason`` is null in valid rows, the fields are null in rejects.  ``only``
    leaves just the ``"valid"`` or the ``"rejected"`` ones.
    """
    kinds = {"int": T.IntegerType(), "long": T.LongType()}
    widest = layouts[max(layouts)]
    schema = T.StructType([lines.schema[identifier], T.StructField("reason", T.StringType())])
    for f in widest:
        schema = schema.add(f.name, kinds.get(f.kind, T.StringType()))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reason, columns = parse_lines(batch.column(1), layouts, defaults)
            out = pa.RecordBatch.from_arrays([batch.column(0), reason, *(columns[f.name] for f in widest)], names=[identifier, "reason", *(f.name for f in widest)])
            if only:
                out = out.filter(pc.is_null(reason) if only == "valid" else pc.is_valid(reason))
            yield out

    return lines.select(identifier, text).mapInArrow(parse, schema)


# ---------------------------------------------------------------- files


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def record_starts(data: np.ndarray, inside: bool, begins: bool) -> np.ndarray:
    """Where records start among the bytes, and at their end: ``inside`` a quoted field at the first byte, which itself ``begins`` a record or not."""
    within = np.logical_xor.accumulate(np.concatenate(([inside], data == QUOTE)))[:-1]  # quotes ahead of each byte, odd or even
    after = np.flatnonzero((data == LF) & ~within) + 1
    return np.concatenate(([0], after)) if begins else after


def _records_of(path: str, start: int, end: int, inside: bool) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record that starts in a split; the last one is read to its end, wherever that is."""
    with _open(path) as f:
        f.seek(max(start - 1, 0))
        before = f.read(1) if start else b"\n"
        raw = f.read(end - start)
        starts = record_starts(np.frombuffer(raw, np.uint8), inside, before == b"\n" and not inside)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield start + a, raw[a : b - 1]
        last = int(starts[-1]) if len(starts) else len(raw)
        if last < len(raw):
            parts, odd = [raw[last:]], raw.count(b'"', last) % 2 == 1
            while more := f.read(READ_ON):
                ends = record_starts(np.frombuffer(more, np.uint8), odd, False)
                if len(ends):
                    parts.append(more[: int(ends[0]) - 1])
                    break
                parts.append(more)
                odd ^= more.count(b'"') % 2 == 1
            yield start + last, b"".join(parts)


def read_file_records(spark: SparkSession, paths: Sequence[str], split: int = SPLIT) -> DataFrame:
    """``record_id`` (the file and the offset in it) and ``raw_line`` of every record of files.

    A line end within a quoted field doesn't end a record, so that a quote which
    is never closed takes the rest of its file with it.  Quotes are counted split by
    split first; the running parity of the counts says whether a split begins
    within quotes, so that all splits are read at the same time.  ``paths`` are
    URIs or absolute paths that every executor reaches.  Bytes that aren't UTF-8 become
    replacement characters.  An empty file has no records, and a line end at the end of
    a file begins none.
    """
    sizes = [(p, fs.FileSystem.from_uri(p)[0].get_file_info(fs.FileSystem.from_uri(p)[1]).size) for p in paths]
    files = spark.createDataFrame(sizes, "file string, size bigint").where("size > 0")
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("start")
    splits = files.select("file", "size", start).select("file", "start", F.least(F.col("start") + split, F.col("size")).alias("end")).repartition("file", "start")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = []
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(path) as f:
                    f.seek(start)
                    odd.append(f.read(end - start).count(b'"') % 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd, pa.int32())], names=["file", "start", "end", "odd"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["record_id", "raw_line"])

        for batch in batches:
            for path, start, end, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for offset, raw in _records_of(path, start, end, inside):
                    rows.append((f"{path}#{offset}", raw.decode("utf-8", "replace")))
                    if len(rows) == 10_000:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    counted = splits.mapInArrow(count, "file string, start bigint, end bigint, odd int")
    ahead = F.sum("odd").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    begun = counted.select("file", "start", "end", (F.coalesce(ahead, F.lit(0)) % 2 == 1).alias("inside")).repartition("file", "start")
    return begun.mapInArrow(cut_up, "record_id string, raw_line string")


def load_files(spark: SparkSession, paths: Sequence[str], layouts: dict[int, Sequence[Field]] = GC_LAYOUTS, defaults: dict[str, str] = GC_DEFAULTS, only: str | None = None, split: int = SPLIT) -> DataFrame:
    """``load_lines`` of the records of files: ``record_id``, ``reason`` and the fields."""
    return load_lines(read_file_records(spark, paths, split), "record_id", "raw_line", layouts, defaults, only)
