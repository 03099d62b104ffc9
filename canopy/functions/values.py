"""Values of properties and small formats as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.schema import PROPERTY_TYPES

#: Fixed forms.
IDENTIFIER = r"\A(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
RECORD_DECIMAL = r"\A([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}):(0|[1-9][0-9]{0,9})\z"
RECORD_HEX = r"\A([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.([0-9a-f]{8})\z"
INSTANT = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]*)?(?:Z|([+-])([0-9]{2}):([0-9]{2}))\z"
#: Factors of the hash that orders child maps.
MAP_HASH_FACTOR, MAP_HASH_ADDEND = 0xDEECE66D, 0xB
BYTE_UNITS = {"EiB": 60, "PiB": 50, "TiB": 40, "GiB": 30, "MiB": 20, "KiB": 10}


def canonical_text(value: Column, long_value: Column, double_value: Column, boolean_value: Column) -> Column:
    """A value's text; null for binaries, which have none."""
    return F.coalesce(value, long_value.cast("string"), double_value.cast("string"), boolean_value.cast("string"))


def value_identity(value: Column, long_value: Column, double_value: Column, boolean_value: Column, binary_length: Column, binary_reference: Column, binary_sha256: Column | None = None) -> Column:
    """Equal for equal values only, types aside: zeros differ by sign, NaN equals NaN.

    Inline binaries are told apart by their bytes only if a digest of these is given, else by their length.
    """
    length = F.concat(F.lit("#"), binary_length.cast("string"))
    inline = length if binary_sha256 is None else F.concat(length, F.coalesce(F.concat(F.lit(":"), binary_sha256), F.lit("")))
    return F.coalesce(
        F.concat(F.lit("="), canonical_text(value, long_value, double_value, boolean_value)), inline, F.concat(F.lit("@"), binary_reference)
    )


def type_name(tag: Column) -> Column:
    """Name of a type's tag; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in PROPERTY_TYPES.items() for x in pair)), tag)


def type_tag(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in PROPERTY_TYPES.items() for x in (v, k))), name)


def boolean(text: Column) -> Column:
    """True only for ``true`` in any case; everything else is false."""
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def escape_digest(text: Column) -> Column:
    """Backslash first, then tab, line ends and the separator of values."""
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\x1f", "\\x1F")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def escape_json(text: Column) -> Column:
    """A JSON string literal in which all control characters are escaped, DEL and C1 too."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    # the rest is rare: character by character only where there is one
    slow = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"\A[\x00-\x1f\x7f-\x9f]\z"), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.encode(c, "UTF-16BE"))), 4, "0"))).otherwise(c)), ""
    )
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f\x7f-\x9f]"), slow).otherwise(text), F.lit('"'))


def epoch_seconds(text: Column) -> Column:
    """Seconds since the epoch of an ISO date with a zone; the fraction is cut; null for anything else.

    Days up to 31 count in every month, beyond its end into the next one.
    """
    part = lambda at, n=2: F.substring(text, at, n).try_cast("bigint")
    day_ok = part(6).between(1, 12) & part(9).between(1, 31)
    first = F.make_date(part(1, 4).cast("int"), part(6).cast("int"), F.lit(1))
    days = F.unix_date(F.when(day_ok, first)).cast("bigint") + part(9) - 1
    offset = F.when(text.endswith("Z"), F.lit(0)).otherwise((part(-5) * 60 + part(-2)) * 60 * F.when(F.substring(text, -6, 1) == "-", -1).otherwise(1))
    # only the fraction has no fixed width: one match says that all parts are in their places
    return F.when(text.rlike(INSTANT), days * 86400 + part(12) * 3600 + part(15) * 60 + part(18) - offset)


def identifier(text: Column) -> Column:
    """A node identifier in lower case; null for anything else."""
    return F.when(text.rlike(IDENTIFIER), F.lower(text))


def blob_length(reference: Column) -> Column:
    """The length that a blob's id states behind its last ``#``; null without one."""
    return F.regexp_extract(reference, r"#([0-9]+)\z", 1).try_cast("bigint")


def record_segment(text: Column) -> Column:
    """Segment of a record identifier in either form; null for anything else."""
    return F.when(record_number(text).isNotNull(), F.substring(text, 1, 36))


def record_number(text: Column) -> Column:
    """Number of a record identifier, decimal or of eight hex digits, up to 31 bits; null for anything else."""
    decimal = F.when(text.rlike(RECORD_DECIMAL), F.regexp_extract(text, RECORD_DECIMAL, 2).try_cast("bigint"))
    hexadecimal = F.when(text.rlike(RECORD_HEX), F.conv(F.regexp_extract(text, RECORD_HEX, 2), 16, 10).try_cast("bigint"))
    number = F.coalesce(decimal, hexadecimal)
    return F.when(number <= 2**31 - 1, number)


def record_text(segment: Column, number: Column, diagnostic: bool = False) -> Column:
    """A record identifier as the journal writes it, or in its diagnostic form."""
    if diagnostic:
        return F.concat(segment, F.lit("."), F.lpad(F.lower(F.hex(number.cast("bigint"))), 8, "0"))
    return F.concat(segment, F.lit(":"), number.cast("string"))


def segment_kind(segment: Column) -> Column:
    """``data`` or ``bulk`` by the digit that tells, null for others."""
    digit = F.lower(F.substring(segment, 20, 1))
    return F.when(digit == "a", "data").when(digit == "b", "bulk")


def signed_half(segment: Column, upper: bool) -> Column:
    """Upper or lower 64 bits of an identifier as a signed number, by which segments are ordered."""
    digits = F.substring(F.replace(segment, F.lit("-"), F.lit("")), 1 if upper else 17, 16)
    unsigned = lambda a, n: F.conv(F.substring(digits, a, n), 16, 10).cast("bigint")
    high, low = unsigned(1, 8), unsigned(9, 8)
    return F.when(high >= 2**31, high - 2**32).otherwise(high) * F.lit(2**32) + low


def identifier_text(upper: Column, lower: Column) -> Column:
    """The identifier of two signed 64-bit halves."""
    digits = F.lower(F.concat(F.lpad(F.hex(upper), 16, "0"), F.lpad(F.hex(lower), 16, "0")))
    part = lambda a, n: F.substring(digits, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))


def wrap32(number: Column) -> Column:
    """The number as 32-bit arithmetic would leave it."""
    return F.pmod(number.cast("bigint") + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash over UTF-16 units, signed."""
    units = F.transform(
        F.sequence(F.lit(1), F.greatest(F.octet_length(F.encode(text, "UTF-16BE")) / 2, F.lit(1)).cast("int")),
        lambda i: F.coalesce(F.conv(F.hex(F.substring(F.encode(text, "UTF-16BE"), i * 2 - 1, F.lit(2))), 16, 10).try_cast("bigint"), F.lit(0)),
    )
    hashed = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: (h * 31 + u) % F.lit(2**32))
    return F.when(F.length(text) == 0, F.lit(0).cast("bigint")).otherwise(wrap32(hashed))


def map_hash(text: Column) -> Column:
    """The scrambled hash that places a name in a child map, unsigned."""
    h = F.pmod(string_hash(text), F.lit(2**32)).bitwiseXOR(F.lit(MAP_HASH_FACTOR))
    product = h.cast("decimal(20,0)") * F.lit(MAP_HASH_FACTOR).cast("decimal(18,0)") + F.lit(MAP_HASH_ADDEND)
    return F.pmod(product, F.lit(2**32).cast("decimal(18,0)")).cast("bigint")


def byte_size(count: Column) -> Column:
    """In binary units with one decimal, cut rather than rounded."""
    out = F.when(count == 1, "1 byte").otherwise(F.concat(count.cast("string"), F.lit(" bytes")))
    for unit, bits in reversed(list(BYTE_UNITS.items())):
        ten, size = count.cast("decimal(20,0)") * 10, F.lit(1 << bits).cast("decimal(20,0)")
        # what is left after the remainder divides exactly
        whole = ((ten - ten % size) / size).cast("bigint")
        text = F.concat(F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(count >= (1 << bits), text).otherwise(out)
    return out


def grouped_count(count: Column) -> Column:
    """With commas between thousands."""
    return F.format_number(count, 0)


def instant_text(milliseconds: Column) -> Column:
    """Milliseconds since the epoch as an ISO date in UTC; ``unknown`` for negative ones."""
    days = F.date_from_unix_date(F.floor(milliseconds / 86_400_000).cast("int"))
    rest = milliseconds % 86_400_000
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat(two(rest / 3_600_000), F.lit(":"), two(rest / 60_000 % 60), F.lit(":"), two(rest / 1000 % 60), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"))
    return F.when(milliseconds < 0, "unknown").otherwise(F.concat(days.cast("string"), F.lit("T"), clock))


def java_fields(line: Column) -> Column:
    """Fields between commas, without empty ones at the end."""
    fields = F.split(line, ",", -1)
    kept = F.array_max(F.transform(fields, lambda f, i: F.when(f != "", i + 1).otherwise(0)))
    return F.when(line == "", F.array(F.lit(""))).otherwise(F.slice(fields, F.lit(1), kept))


def lenient_number(text: Column, kind: str) -> Column:
    """An integer of the kind, -1 for anything else."""
    return F.coalesce(F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text).try_cast(kind), F.lit(-1).cast(kind))


def reclaimable(reference: Sequence[Column], segment: Sequence[Column], full: bool, retained: int) -> Column:
    """Whether a segment's generations allow its removal.

    A generation is (number, full number, compacted).  After a full compaction
    a segment goes when its full generation is old, or its generation is old and
    it isn't compacted; after a tail compaction when its generation is old,
    unless it was compacted in the reference's full generation.
    """
    (g, f, _), (sg, sf, compacted) = reference, segment
    old = wrap32(g.cast("bigint") - sg) >= retained
    if full:
        return (wrap32(f.cast("bigint") - sf) >= retained) | (old & ~compacted)
    return old & ~(compacted & (sf == f))


def sweep_defers(before: Column, after: Column) -> Column:
    """Whether too little would be won: the rest is at least three quarters, in 32-bit arithmetic."""
    wrapped = wrap32(before.cast("bigint") * 3)
    quarter = F.when(wrapped >= 0, F.floor(wrapped / 4)).otherwise(F.ceil(wrapped / 4))
    return after >= quarter


def saturating_sum(a: Column, b: Column) -> Column:
    """The sum, at most the greatest 64-bit number."""
    total = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    top = F.lit(2**63 - 1).cast("decimal(20,0)")
    return F.least(total, top).cast("bigint")
