"""Queries over all rows, also those that SQL can't say, against brute force."""

import hashlib
import math
from collections import defaultdict
from pathlib import Path

import pytest

import __spark_entry__ as entry
from canopy.plans import models as m

SMALL = Path(entry.SMALL)
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def rows(spark):
    return m.properties(spark, str(SMALL)).collect()


@pytest.fixture(scope="module")
def paths(spark):
    return [r.path for r in m.nodes(spark, str(SMALL)).collect()]


def result(spark, name):
    return [tuple(r) for r in entry.queries()[name](spark, str(SMALL)).collect()]


def double(x):
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "-Infinity" if x < 0 else "Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x)
    shortest = next(t for t in (f"{abs(x):.{n}e}" for n in range(18)) if float(t) == abs(x))
    digits, _, power = shortest.partition("e")
    return ("-" if x < 0 else "") + (digits if "." in digits else digits + ".0") + "E" + str(int(power))


def text(r):
    if r.value is not None or r.long_value is not None:
        return r.value if r.value is not None else str(r.long_value)
    if r.double_value is not None:
        return double(r.double_value)
    return None if r.boolean_value is None else str(r.boolean_value).lower()


def units(name):
    raw = name.encode("utf-16-be")
    return [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)]


def escaped(t):
    return t.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace("\x1f", "\\x1F")


def test_canonical_text(spark, rows):
    assert sorted(map(repr, result(spark, "canonical_text"))) == sorted(repr((r.path, r.name, r.position, text(r))) for r in rows)


def test_java_string_hash(spark, rows):
    def hashed(name):
        h = 0
        for u in units(name):
            h = (h * 31 + u) % 2**32
        return h

    assert dict(result(spark, "java_string_hash")) == {r.name: hashed(r.name) for r in rows}


def test_utf16_order(spark, rows):
    key = lambda r: (units(r.value), r.path.encode(), r.name.encode(), -1 if r.position is None else r.position)
    expected = [(r.path, r.name, r.position, k) for k, r in enumerate(sorted((r for r in rows if r.value is not None), key=key), 1)]
    assert sorted(result(spark, "utf16_order"), key=lambda r: r[3]) == expected


def test_digest_lines(spark, rows, paths):
    held = defaultdict(lambda: defaultdict(list))
    for r in rows:
        held[r.path][r.name].append(r)

    def shown(r):
        t = text(r)
        if t is not None:
            return escaped(t)
        return f"{r.binary_length}/{r.binary_length}" if r.binary_length is not None else "" if r.binary_reference is None else "external:" + escaped(r.binary_reference)

    def line(path):
        out = escaped(path)
        for name, some in sorted(held[path].items(), key=lambda x: x[0].encode()):
            some = sorted((r for r in some if r.position is not None), key=lambda r: r.position) or some
            v = "\x1f".join(shown(r) for r in some if r.position is not None)
            out += f"\t{escaped(name)}={max(r.property_type for r in held[path][name])}{'[]' if any(r.multiple for r in held[path][name]) else ''}:{v}"
        return hashlib.md5(out.encode()).hexdigest()

    assert dict(result(spark, "digest_lines")) == {p: line(p) for p in paths}


def test_json_lines_shape(spark, rows, paths):
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    start = lambda p: '{"path":"' + "".join(short.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 or 127 <= ord(c) < 160 else c) for c in p) + '"'
    names = defaultdict(set)
    for r in rows:
        names[r.path].add(r.name)
    assert sorted(result(spark, "json_lines_shape")) == sorted((p, start(p), len(names[p])) for p in paths)
