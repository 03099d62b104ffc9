"""From segments to content: records are decoded where their segment is, and references are resolved by joins.

A record's key is ``segment:number``.  ``decode`` makes one row per record with
its text, a number, its references and its integers; lists, maps, templates and
nodes are then put together by equality of keys, a level at a time.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import values as v
from canopy.operators.common import cut
from canopy.schema import PROPERTY_TYPES, FormatError

#: Fixed values of the record format.
VIRTUAL_SIZE, HEADER = 262_144, 32
MAP_LEAF, MAP_BRANCH, BUCKET, LIST, VALUE, BLOCK, TEMPLATE, NODE, BLOB_ID = range(9)
TYPE_NAMES = ["MapLeaf", "MapBranch", "ListBucket", "List", "Value", "Block", "Template", "Node", "ExternalBlobIdentifier"]
SMALL, MEDIUM, BLOCK_SIZE, BUCKET_SIZE, MOST_SPLIT_LEVEL = 128, 16_512, 4096, 255, 7
DIFF_HEAD = 0xFFFFFFFF

SCHEMA = "record string, segment string, record_number int, type int, offset int, text string, n bigint, refs array<string>, ints array<bigint>, raw binary, problem string"


class _Segment:
    """A data segment's header and records."""

    def __init__(self, segment: str, content: bytes) -> None:
        if content[:3] != b"0aK" or content[3] not in (12, 13):
            raise FormatError("no data segment")
        self.segment, self.content = segment, content
        references, records = struct.unpack(">ii", content[14:22])
        self.known = [segment] + [str(uuid.UUID(bytes=content[HEADER + 16 * k : HEADER + 16 * k + 16])) for k in range(references)]
        at = HEADER + 16 * references
        self.records = [struct.unpack(">iBi", content[at + 9 * k : at + 9 * k + 9]) for k in range(records)]
        places = sorted({self.place(o) for *_, o in self.records} | {len(content)})
        self.ends = dict(zip(places, places[1:], strict=False))

    def place(self, offset: int) -> int:
        return len(self.content) - VIRTUAL_SIZE + offset

    def key(self, at: int) -> str:
        which, number = struct.unpack(">Hi", self.content[at : at + 6])
        return f"{self.known[which]}:{number}"

    def keys(self, at: int, count: int) -> list[str]:
        return [self.key(at + 6 * k) for k in range(count)]

    def inline(self, at: int, n: int) -> tuple:
        """The text, and the bytes where the text doesn't give them back."""
        raw = self.content[at : at + n]
        if len(raw) < n:
            raise FormatError("value ends early")
        text = raw.decode("utf-8", "replace")
        return text, raw if "\ufffd" in text else None

    def value(self, at: int) -> tuple:
        """Text, length, references, integers and bytes of a value: an inline text, a list of blocks, or an external id."""
        c, first = self.content, self.content[at]
        if first < 0x80:
            text, raw = self.inline(at + 1, first)
            return text, first, [], [0], raw
        if first < 0xC0:
            n = (struct.unpack(">H", c[at : at + 2])[0] & 0x3FFF) + SMALL
            text, raw = self.inline(at + 2, n)
            return text, n, [], [0], raw
        if first < 0xE0:
            n = (struct.unpack(">Q", c[at : at + 8])[0] & ((1 << 61) - 1)) + MEDIUM
            return None, n, [self.key(at + 8)], [0]
        if first < 0xF0:
            n = struct.unpack(">H", c[at : at + 2])[0] & 0xFFF
            return self.inline(at + 2, n)[0], None, [], [1]
        if first < 0xF8:
            return None, None, [self.key(at + 1)], [1]
        raise FormatError("no value")

    def map_node(self, at: int, end: int) -> tuple:
        (head,) = struct.unpack(">I", self.content[at : at + 4])
        if head == DIFF_HEAD:
            return None, -1, self.keys(at + 8, 3), []
        size, level = head & ((1 << 29) - 1), head >> 29
        if size > 32 and level < MOST_SPLIT_LEVEL:
            (bits,) = struct.unpack(">I", self.content[at + 4 : at + 8])
            return None, size, self.keys(at + 8, bits.bit_count()), [1]
        return None, size, self.keys(at + 4 + 4 * size, 2 * size), [0]

    def template(self, at: int) -> tuple:
        """Integers: primary type there, mixins, arity (0, 1 or 2 for many), properties, then their types, negative if multiple."""
        (head,) = struct.unpack(">I", self.content[at : at + 4])
        primary, mixins, none, many = head >> 31, (head >> 18) & 0x3FF, head >> 29 & 1, head >> 28 & 1
        if not head >> 30 & 1:
            mixins = 0
        count, arity = head & 0x3FFFF, 0 if none else 2 if many else 1
        refs = self.keys(at + 4, primary + mixins + (arity == 1) + (count > 0))
        types = struct.unpack(f">{count}b", self.content[at + 4 + 6 * len(refs) : at + 4 + 6 * len(refs) + count])
        return None, None, refs, [primary, mixins, arity, count, *types]

    def decoded(self, kind: int, at: int) -> tuple:
        if at < HEADER:
            raise FormatError("place outside the segment")
        end = self.ends[at]
        if kind in (VALUE, BLOB_ID):
            return self.value(at)
        if kind in (MAP_LEAF, MAP_BRANCH):
            return self.map_node(at, end)
        if kind == LIST:
            (n,) = struct.unpack(">i", self.content[at : at + 4])
            return None, n, [self.key(at + 4)] if n else [], []
        if kind == TEMPLATE:
            return self.template(at)
        if kind in (BUCKET, NODE):
            return None, None, self.keys(at, min((end - at) // 6, BUCKET_SIZE if kind == BUCKET else 4)), []
        if kind == BLOCK and end - at >= 20:
            return None, None, [], list(struct.unpack(">qqi", self.content[at : at + 20]))
        return None, None, [], []


def decode_segment(segment: str, content: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA; a record, or a whole segment, that can't be read is a row with its problem."""
    try:
        s = _Segment(segment, content)
    except (FormatError, struct.error, ValueError) as e:
        yield f"{segment}:-1", segment, -1, -1, None, None, None, [], [], None, f"segment: {e}"
        return
    for number, kind, offset in s.records:
        try:
            text, n, refs, ints, *raw = s.decoded(kind, s.place(offset))
            yield f"{segment}:{number}", segment, number, kind, offset, text, n, refs, ints, raw[0] if raw else None, None
        except (FormatError, struct.error, ValueError, IndexError, KeyError) as e:
            yield f"{segment}:{number}", segment, number, kind, offset, None, None, [], [], None, f"record: {e}"


def decode(segments: DataFrame) -> DataFrame:
    """Records of all data segments."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for segment, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(decode_segment(segment, content.as_py()))
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return segments.where("kind = 'data'").select("segment", "content").mapInArrow(run, schema)


def segment_references(segments: DataFrame) -> DataFrame:
    """``source`` and ``target`` from the segments' own tables."""
    content = F.col("content")
    n = F.conv(F.hex(F.substring(content, 15, 4)), 16, 10).cast("int")
    raw = F.transform(F.sequence(F.lit(1), n), lambda k: F.lower(F.hex(F.substring(content, HEADER + 1 + (k - 1) * 16, F.lit(16)))))
    h = F.explode(F.when(n > 0, raw))
    dashed = F.concat_ws("-", *(F.substring("h", a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return segments.where("kind = 'data'").select(F.col("segment").alias("source"), h.alias("h")).select("source", dashed.alias("target"))


def expand_lists(lists: DataFrame, records: DataFrame) -> DataFrame:
    """``owner``, ``position`` and ``ref`` of the elements of lists, given by ``owner``, ``ref`` and ``n``.

    A list of one is its reference itself; others point at a bucket of at most
    255, nested up to three deep.
    """
    buckets = records.where(F.col("type") == BUCKET).select(F.col("record").alias("ref"), F.col("refs").alias("inner"))
    state = lists.where("n > 0").select("owner", F.lit(0).cast("bigint").alias("position"), "ref", F.col("n").cast("bigint").alias("n"))
    done = state.where("n = 1").select("owner", "position", "ref")
    for _ in range(3):
        cover = F.when(F.col("n") <= BUCKET_SIZE, 1).when(F.col("n") <= BUCKET_SIZE**2, BUCKET_SIZE).otherwise(BUCKET_SIZE**2)
        parts = F.ceil(F.col("n") / cover).cast("int")
        open_lists = state.where("n > 1").withColumn("cover", cover).withColumn("parts", parts).join(buckets, "ref", "left")
        children = open_lists.select("owner", "position", "n", "cover", F.posexplode(F.slice("inner", F.lit(1), F.col("parts"))).alias("k", "child"))
        state = children.select("owner", (F.col("position") + F.col("k") * F.col("cover")).alias("position"), F.col("child").alias("ref"), F.least(F.col("cover"), F.col("n") - F.col("k") * F.col("cover")).cast("bigint").alias("n"))
        done = done.unionByName(state.where("n = 1").select("owner", "position", "ref"))
    return done


def texts(records: DataFrame, segments: DataFrame) -> DataFrame:
    """``record``, ``text``, ``length``, ``external``, ``octets`` and ``raw`` of every value; long texts are put together of their blocks.

    ``octets`` is the number of bytes really there: less than ``length`` where
    blocks are missing or cut; the text is null where all are missing.  ``raw``
    has the bytes of short values that aren't UTF-8; other texts keep theirs.
    """
    no_bytes = F.lit(None).cast("binary").alias("raw")
    values = records.where(F.col("type").isin(VALUE, BLOB_ID))
    short = values.where(F.col("text").isNotNull()).select("record", "text", F.col("n").alias("length"), (F.col("ints")[0] == 1).alias("external"), F.col("n").alias("octets"), "raw")
    long = values.where(F.col("text").isNull() & F.col("n").isNotNull())
    blocks = expand_lists(long.select(F.col("record").alias("owner"), F.col("refs")[0].alias("ref"), F.ceil(F.col("n") / BLOCK_SIZE).alias("n")), records)
    at = records.where((F.col("type") == BLOCK) & F.col("problem").isNull()).select(F.col("record").alias("ref"), "offset")
    lengths = long.select(F.col("record").alias("owner"), "n")
    # in a bulk segment the number is the place
    segment = F.substring_index("ref", ":", 1)
    offset = F.coalesce("offset", F.when(v.segment_kind(segment) == "bulk", F.substring_index("ref", ":", -1).cast("int")))
    placed = blocks.join(at, "ref", "left").select("owner", "position", segment.alias("segment"), offset.alias("offset")).join(lengths, "owner")
    start = F.octet_length("content") - VIRTUAL_SIZE + F.col("offset") + 1
    size = F.least(F.lit(BLOCK_SIZE), F.col("n") - F.col("position") * BLOCK_SIZE).cast("int")
    bytes_ = placed.join(segments.select("segment", "content"), "segment").where(start > 0).select("owner", F.struct("position", F.substring(F.col("content"), start, size).alias("b")).alias("p"))
    whole = bytes_.groupBy("owner").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["b"]))
    long_texts = lengths.join(whole.select("owner", joined.alias("all")), "owner", "left")
    long_texts = long_texts.select(F.col("owner").alias("record"), F.col("all").cast("string").alias("text"), F.col("n").alias("length"), F.lit(False).alias("external"), F.coalesce(F.octet_length("all"), F.lit(0)).cast("bigint").alias("octets"), no_bytes)
    by_record = values.where(F.col("text").isNull() & F.col("n").isNull()).select("record", F.get("refs", F.lit(0)).alias("id_record"))
    names = short.unionByName(long_texts).where("not external and octets = length")
    external = by_record.join(names.select(F.col("record").alias("id_record"), "text"), "id_record").select("record", "text", F.lit(None).cast("bigint").alias("length"), F.lit(True).alias("external"), F.lit(None).cast("bigint").alias("octets"), no_bytes)
    return short.unionByName(long_texts).unionByName(external)


def open_maps(maps: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of maps, given by ``owner`` and ``ref``, as keys of records with the ``age`` of their overlay; and the ``owner`` of every part that can't be read.

    Branches are opened level by level.
    """
    parts = records.where(F.col("type").isin(MAP_LEAF, MAP_BRANCH) & F.col("problem").isNull()).select(F.col("record").alias("ref"), "n", "refs", "ints")
    state = cut(maps.select("owner", "ref", F.lit(0).alias("age")))
    found, lost = state.select("owner", "age", F.struct(F.lit("").alias("k"), F.lit("").alias("v")).alias("e")).limit(0), state.select("owner").limit(0)
    while not state.isEmpty():
        at = cut(state.join(parts, "ref", "left"))
        lost = lost.unionByName(at.where("n is null").select("owner"))
        leaf = at.where((F.col("n") >= 0) & (F.get("ints", F.lit(0)) == 0))
        pairs = F.transform(F.sequence(F.lit(0), (F.size("refs") / 2 - 1).cast("int")), lambda k: F.struct(F.get("refs", k * 2).alias("k"), F.get("refs", k * 2 + 1).alias("v")))
        entries = leaf.where(F.size("refs") > 0).select("owner", "age", F.explode(pairs).alias("e"))
        overlay = at.where("n = -1").select("owner", "age", F.struct(F.get("refs", F.lit(0)).alias("k"), F.get("refs", F.lit(1)).alias("v")).alias("e"))
        found = found.unionByName(entries.unionByName(overlay))
        branch = at.where((F.col("n") >= 0) & (F.get("ints", F.lit(0)) == 1)).select("owner", F.explode("refs").alias("ref"), "age")
        base = at.where("n = -1").select("owner", F.get("refs", F.lit(2)).alias("ref"), (F.col("age") + 1).alias("age"))
        state = cut(branch.unionByName(base))
    return found.select("owner", "age", F.col("e.k").alias("record"), F.col("e.v").alias("value")), lost.distinct()


def expand_maps(entries: DataFrame, names: DataFrame) -> DataFrame:
    """``owner``, ``name`` and ``value`` (a key) of opened maps; an overlaid entry wins over its base."""
    named = entries.join(names, "record")
    return named.groupBy("owner", "name").agg(F.min(F.struct("age", "value")).alias("m")).select("owner", "name", F.col("m.value").alias("value"))


class Decoded:
    """Nodes, children and properties of all records of a store, by record."""

    def __init__(self, segments: DataFrame) -> None:
        self.segments = segments
        self.records = cut(decode(segments))
        self.texts = cut(texts(self.records, segments))
        self.names = self.texts.where("text is not null").select("record", F.col("text").alias("name"))
        templates = self.records.where(F.col("type") == TEMPLATE).select(F.col("record").alias("template"), F.col("refs").alias("t"), F.col("ints").alias("i"))
        nodes = self.records.where(F.col("type") == NODE).select(F.col("record").alias("node"), F.get("refs", F.lit(1)).alias("template"), F.col("refs").alias("r"))
        primary, mixins, arity, count = (F.col("i")[k] for k in range(4))
        self.nodes = cut(
            nodes.join(templates, "template").select(
                "node", "template", primary.alias("primary"), mixins.alias("mixins"), arity.alias("arity"), count.alias("count"), "t", F.slice("i", F.lit(5), F.greatest(F.size("i") - 4, F.lit(0))).alias("types"),
                F.when(arity > 0, F.get("r", F.lit(2))).alias("child"), F.when(count > 0, F.get("r", F.when(arity > 0, 3).otherwise(2))).alias("values"),
            )
        )

    def stable_identifiers(self) -> DataFrame:
        """``node`` and ``stable``: the record that a node had before any compaction; null if that can't be read."""
        slots = self.records.where(F.col("type") == NODE).select(F.col("record").alias("node"), F.get("refs", F.lit(0)).alias("slot"))
        blocks = self.records.where((F.col("type") == BLOCK) & (F.size("ints") == 3)).select(F.col("record").alias("slot"), F.col("ints").alias("i"))
        first = F.concat(v.identifier_text(F.col("i")[0], F.col("i")[1]), F.lit(":"), F.col("i")[2])
        return slots.join(blocks, "slot", "left").select("node", F.when(F.col("slot") == F.col("node"), F.col("node")).otherwise(first).alias("stable"))

    @cached_property
    def maps(self) -> tuple[DataFrame, DataFrame]:
        return open_maps(self.nodes.where("arity = 2").select(F.col("node").alias("owner"), F.col("child").alias("ref")), self.records)

    def children(self) -> DataFrame:
        """``owner``, ``name`` and ``value``, the child's record."""
        many = expand_maps(self.maps[0], self.names)
        single = self.nodes.where("arity = 1").select(F.col("node").alias("owner"), F.get("t", (F.col("primary") + F.col("mixins")).cast("int")).alias("record"), F.col("child").alias("value"))
        return many.unionByName(single.join(self.names, "record").select("owner", "name", "value"))

    def soundness(self) -> DataFrame:
        """Each ``node`` that has a template, and whether its ``shape``, its ``values`` and its ``entries`` can all be read.

        The shape is the template with its names; values are all slots, elements
        of lists and blocks of long values; entries are all parts of the child
        map and the children's names.  Whether the children themselves are there
        is for who walks the tree to say.  Texts of numbers aren't parsed.
        """
        good = self.texts.where("external or octets = length").select(F.col("record").alias("ref"))
        full = lambda rows: rows.join(good, "ref", "left_semi").groupBy("owner").agg(F.count(F.lit(1)).alias("have"))
        t = self.nodes.dropDuplicates(["template"])
        first = F.col("primary") + F.col("mixins") + (F.col("arity") == 1).cast("int")
        fixed = t.select("template", F.explode(F.slice("t", F.lit(1), first.cast("int"))).alias("ref")).join(good, "ref", "left_anti").select("template")
        slots = expand_lists(t.where("count > 0").select(F.col("template").alias("owner"), F.get("t", first.cast("int")).alias("ref"), F.col("count").alias("n")), self.records)
        known = F.forall("types", lambda x: F.abs(x).isin(list(PROPERTY_TYPES)))
        named = t.join(full(slots).withColumnRenamed("owner", "template"), "template", "left").where((F.coalesce("have", F.lit(0)) != F.col("count")) | ~known).select("template")
        misshapen = fixed.unionByName(named).distinct().withColumn("shape", F.lit(False))
        lists = self.records.where((F.col("type") == LIST) & F.col("problem").isNull()).select(F.col("record").alias("owner"), F.get("refs", F.lit(0)).alias("ref"), "n")
        whole = lists.select("owner", "n").join(full(expand_lists(lists, self.records)), "owner", "left").where(F.coalesce("have", F.lit(0)) == F.col("n")).select(F.col("owner").alias("ref"))
        n = self.nodes.where("count > 0")
        held = expand_lists(n.select(F.col("node").alias("owner"), F.col("values").alias("ref"), F.col("count").alias("n")), self.records)
        held = held.join(n.select(F.col("node").alias("owner"), "types"), "owner").withColumn("signed", F.get("types", F.col("position").cast("int")))
        fine = held.where("signed > 0").join(good, "ref", "left_semi").unionByName(held.where("signed < 0").join(whole, "ref", "left_semi")).groupBy("owner").agg(F.count(F.lit(1)).alias("have"))
        entries, lost = self.maps
        lost = lost.unionByName(entries.join(good.withColumnRenamed("ref", "record"), "record", "left_anti").select("owner")).distinct().withColumn("entries", F.lit(False))
        out = self.nodes.select("node", "template", "count").join(misshapen, "template", "left").join(fine.withColumnRenamed("owner", "node"), "node", "left").join(lost.withColumnRenamed("owner", "node"), "node", "left")
        return out.select("node", F.coalesce("shape", F.lit(True)).alias("shape"), (F.coalesce("have", F.lit(0)) == F.col("count")).alias("values"), F.coalesce("entries", F.lit(True)).alias("entries"))

    def properties(self) -> DataFrame:
        """``node``, ``name``, ``type`` (a tag), ``multiple``, ``position`` (null: empty list) and the value's ``text``, ``length``, ``external`` and ``raw``.

        The types of a node come first, as properties of their own.
        """
        text = self.texts.select("record", "text", "length", "external", "raw")
        n = self.nodes.where("count > 0")
        # names belong to templates: they are read once per template, not per node
        t = n.select("template", "t", "types", "count", "arity", "primary", "mixins").dropDuplicates(["template"])
        first = (F.col("primary") + F.col("mixins") + (F.col("arity") == 1).cast("int")).cast("int")
        slots = expand_lists(t.select(F.col("template").alias("owner"), F.get("t", first).alias("ref"), F.col("count").alias("n")), self.records)
        names = slots.join(self.names.withColumnRenamed("record", "ref"), "ref").join(t.select(F.col("template").alias("owner"), "types"), "owner")
        names = names.select(F.col("owner").alias("template"), F.col("position").alias("slot"), "name", F.get("types", F.col("position").cast("int")).alias("signed"))
        held = expand_lists(n.select(F.col("node").alias("owner"), F.col("values").alias("ref"), F.col("count").alias("n")), self.records)
        held = held.select(F.col("owner").alias("node"), F.col("position").alias("slot"), "ref").join(n.select("node", "template"), "node").join(names, ["template", "slot"])
        single = held.where("signed > 0").select("node", "name", F.col("signed").alias("type"), F.lit(False).alias("multiple"), F.lit(0).cast("bigint").alias("position"), "ref")
        lists = held.where("signed < 0").join(self.records.where(F.col("type") == LIST).select(F.col("record").alias("ref"), "n", F.get("refs", F.lit(0)).alias("inner")), "ref")
        owner = F.concat_ws("\0", "node", "name")
        elements = expand_lists(lists.select(owner.alias("owner"), F.col("inner").alias("ref"), "n"), self.records)
        multiple = lists.select(owner.alias("owner"), "node", "name", (-F.col("signed")).alias("type")).join(elements, "owner", "left").select("node", "name", "type", F.lit(True).alias("multiple"), "position", "ref")
        of_type = self.nodes.where("primary = 1").select("node", F.lit("jcr:primaryType").alias("name"), F.lit(7).cast("bigint").alias("type"), F.lit(False).alias("multiple"), F.lit(0).cast("bigint").alias("position"), F.col("t")[0].alias("ref"))
        mixed = self.nodes.where("mixins > 0").select("node", F.posexplode(F.slice("t", F.col("primary").cast("int") + 1, F.col("mixins").cast("int"))).alias("p", "ref"))
        mixed = mixed.select("node", F.lit("jcr:mixinTypes").alias("name"), F.lit(7).cast("bigint").alias("type"), F.lit(True).alias("multiple"), F.col("p").cast("bigint").alias("position"), "ref")
        rows = single.unionByName(multiple).unionByName(of_type).unionByName(mixed)
        return rows.join(text.withColumnRenamed("record", "ref"), "ref", "left").select("node", "name", "type", "multiple", "position", "text", "length", "external", "raw")


def property_rows(properties: DataFrame) -> DataFrame:
    """Decoded properties as value columns by their types; ``node`` stays for a path.

    Inline binaries have their bytes' number, CRC-32 and SHA-256 besides, of what was really read.
    """
    kinds = F.create_map(*(F.lit(x) for pair in PROPERTY_TYPES.items() for x in pair))
    kind = F.element_at(kinds, F.col("type").cast("int"))
    of = lambda *names: kind.isin(*names)
    content, inline = F.coalesce("raw", F.col("text").cast("binary"), F.lit(b"")), of("Binary") & ~F.col("external")
    return properties.select(
        "node", "name", kind.alias("property_type"), "multiple", F.col("position").cast("int").alias("position"),
        F.when(~of("Long", "Double", "Boolean", "Binary"), F.col("text")).alias("value"),
        F.when(of("Long"), F.col("text")).try_cast("bigint").alias("long_value"),
        F.when(of("Double"), F.col("text")).try_cast("double").alias("double_value"),
        F.when(of("Boolean") & F.col("text").isNotNull(), F.lower("text") == "true").alias("boolean_value"),
        F.when(of("Binary") & ~F.col("external"), F.col("length")).alias("binary_length"),
        F.when(of("Binary") & F.col("external"), F.col("text")).alias("binary_reference"),
        F.when(inline, F.octet_length(content)).cast("bigint").alias("binary_octets"),
        F.when(inline, F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")).alias("binary_crc32"),
        F.when(inline, F.sha2(content, 256)).alias("binary_sha256"),
    )
