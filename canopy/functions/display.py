"""How values and sizes are shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: UTF-16 units of a text that a preview shows.
PREVIEW = 60
ELLIPSIS = "..."


def type_label(property_type: Column, multiple: Column) -> Column:
    """A type in upper case, in the plural for several values."""
    plural = F.when(property_type == "Binary", "BINARIES").otherwise(F.concat(F.upper(property_type), F.lit("S")))
    return F.when(multiple, plural).otherwise(F.upper(property_type))


def text_preview(text: Column) -> Column:
    """The first PREVIEW units of a text in quotes; a character outside the basic plane, which takes two, isn't split."""
    raw = F.encode(text, "UTF-16BE")
    head = F.substring(raw, F.lit(1), F.lit(2 * PREVIEW))
    # a first half of a pair at the cut goes: its bytes start with d8 to db
    split = F.hex(F.substring(raw, F.lit(2 * PREVIEW - 1), F.lit(1))).rlike("^D[89AB]$")
    cut = F.decode(F.when(split, F.substring(raw, F.lit(1), F.lit(2 * PREVIEW - 2))).otherwise(head), "UTF-16BE")
    return F.concat(F.lit('"'), F.when(F.octet_length(raw) > 2 * PREVIEW, F.concat(cut, F.lit(ELLIPSIS))).otherwise(text), F.lit('"'))


def binary_label(length: Column, reference: Column) -> Column:
    """A binary by its size; -1 for one that can't be read."""
    return F.concat(F.lit("{"), F.coalesce(length, F.regexp_extract(reference, r"#([0-9]+)\z", 1).try_cast("bigint"), F.lit(-1).cast("bigint")).cast("string"), F.lit(" bytes}"))


def printable(text: Column) -> Column:
    """Without what a terminal would obey: control characters are shown as their code points."""
    shown = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"\A[\x00-\x1f\x7f-\x9f]\z"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.encode(c, "UTF-16BE"))), F.lit("}"))).otherwise(c)), "")
    return F.when(text.rlike(r"[\x00-\x1f\x7f-\x9f]"), shown).otherwise(text)
