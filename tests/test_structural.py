"""Line loading against a character-by-character reading of the rules."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.operators import structural
from canopy.operators.structural import GC_DEFAULTS, GC_LAYOUTS, load_lines, parse_lines

UUID = "0f1e2d3c-4b5a-6978-8796-a5b4c3d2e1f0"
GOOD = f"10,20,30,4,5,6,{UUID}:7"


def fields_of(line):
    """The fields, or None if quoting is wrong."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                text += line[j:k]
                if line[k + 1 : k + 2] == '"':
                    text, j = text + '"', k + 2
                    continue
                i = k + 1
                break
            if i < len(line) and line[i] != ",":
                return None
        else:
            k = line.find(",", i)
            k = len(line) if k < 0 else k
            text, i = line[i:k], k
            if '"' in text:
                return None
        out.append(text)
        if i >= len(line):
            return out
        i += 1


def number(text, bits):
    return re.fullmatch(r"[+-]?[0-9]+", text, re.A) is not None and -(2 ** (bits - 1)) <= int(text) < 2 ** (bits - 1)


def root(text):
    m = re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?::(0|[1-9][0-9]*)|\.([0-9a-f]{8}))", text)
    return bool(m) and (int(m[1]) if m[1] else int(m[2], 16)) <= 2**31 - 1


def reason_of(line):
    if line is None:
        return "column_count"
    f = fields_of(line.rstrip("\r\n"))
    if f is None:
        return "quoting"
    if len(f) not in (6, 7):
        return "column_count"
    bits = [64, 64, 64, 32] + [32] * (len(f) == 7) + [64]
    return None if all(number(x, b) for x, b in zip(f, bits, strict=False)) and root(f[-1]) else "value"


CASES = [
    None, "", "\n", "\r\n", GOOD, GOOD + "\r\n\n", f"1,2,3,4,5,{UUID}.7fffffff", f"1,2,3,4,5,{UUID}.80000000", f'"1","2","3","4","5","6","{UUID}:0"', f"1,2,3,4,5,{UUID}:2147483648",
    f"1,2,3,4,5,{UUID}:01", f"1,2,3,4,5,{UUID.upper()}:1", f"-9223372036854775808,9223372036854775807,+3,-2147483648,2147483647,6,{UUID}:1", f"9223372036854775808,2,3,4,5,{UUID}:1",
    f"-9223372036854775809,2,3,4,5,{UUID}:1", f"00000000000000000000000000012,2,3,4,5,{UUID}:1", f"1,2,3,2147483648,5,{UUID}:1", "1,2,3", ",,,,,", f"１,2,3,4,5,{UUID}:1", f" 1,2,3,4,5,{UUID}:1",
    f'1,2,"3,4,5,{UUID}:1', f'1,2"2,3,4,5,{UUID}:1', f'"1"x,2,3,4,5,{UUID}:1', f'"1,1",2,3,4,5,{UUID}:1', f'"1""1",2,3,4,5,{UUID}:1', f'"",2,3,4,5,{UUID}:1', '"', '""', '"""', '""""', ',"', f"1,2,3,4,5,{UUID}:1\nx",
    f"+,2,3,4,5,{UUID}:1", f"--1,2,3,4,5,{UUID}:1", f"99999999999999999999999,2,3,4,5,{UUID}:1", f"1,2,3,4,5,{UUID}:99999999999999999999", "x" * 5000, f"0,-0,+0,0,0,{UUID}:0", f"é,2,3,4,5,{UUID}:1",
]


def check(lines):
    reasons, columns = parse_lines(pa.array(lines, pa.string()), GC_LAYOUTS, GC_DEFAULTS)
    assert reasons.to_pylist() == [reason_of(x) for x in lines]
    for k, line in enumerate(lines):
        values = {n: c[k].as_py() for n, c in columns.items()}
        if reason_of(line) is None:
            f = fields_of(line.rstrip("\r\n"))
            want = [int(x) for x in f[:-1]]
            if len(f) == 6:
                want.insert(4, want[3])
            assert [values[n] for n in ("repository_size", "reclaimed_size", "timestamp_milliseconds", "generation", "full_generation", "compacted_nodes")] == want
            assert values["root_record_identifier_text"] == f[-1]
        else:
            assert set(values.values()) == {None}


def test_cases():
    check(CASES)
    check(CASES[::-1])
    check([])
    check([None])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='",1-+\r\n:a', max_size=14), st.sampled_from([x for x in CASES if x]).flatmap(lambda s: st.integers(0, len(s)).map(lambda k: s[:k] + '"' + s[k:]))), max_size=8))
def test_random(lines):
    check(lines)


def test_frames(spark):
    rows = [(k, x, "clash") for k, x in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string, reason string").repartition(3)
    got = load_lines(df)
    assert sorted((r.line_id, r.reason or "") for r in got.collect()) == sorted((k, reason_of(x) or "") for k, x, _ in rows)
    assert load_lines(df, only="valid").count() + load_lines(df, only="rejected").count() == len(rows)
    assert load_lines(df.limit(0)).count() == 0


TEXT_LAYOUT = {3: (structural.Field("id", "long"), structural.Field("a", "text"), structural.Field("b", "text"))}


def test_doubled_quotes(spark):
    rows = [(1, '1,"x""y",'), (2, '2,"""",z'), (3, '3,"",""""""'), (4, '4,x""y,z'), (5, '5,"a, b","c\nd"')]
    got = {r.line_id: (r.reason, r.a, r.b) for r in structural.load_lines(spark.createDataFrame(rows, "line_id int, raw_line string"), layouts=TEXT_LAYOUT, defaults={}).collect()}
    assert got == {1: (None, 'x"y', ""), 2: (None, '"', "z"), 3: (None, "", '""'), 4: ("quoting", None, None), 5: (None, "a, b", "c\nd")}


@pytest.mark.parametrize("split", [3, 17, 1 << 20])
def test_files(spark, tmp_path, split, monkeypatch):
    """Line ends in quotes, against the csv module, wherever the splits fall."""
    import csv
    import io

    rnd = random.Random(split)
    pieces = ["x", "é", '"', "\n", "\r\n", ",", " ", "long text"]
    want, paths = {}, []
    for k in range(3):
        rows = [[str(n), *("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 6))) for _ in range(2))] for n in range(40)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        text = out.getvalue()[: -1 if k == 2 else None]
        paths.append(str(tmp_path / f"{k}.csv"))
        with open(paths[-1], "w", newline="", encoding="utf-8") as f:
            f.write(text)
        want |= {(k, int(r[0])): (r[1], r[2]) for r in rows}
    (tmp_path / "empty.csv").write_bytes(b"")
    got = structural.load_files(spark, [*paths, str(tmp_path / "empty.csv")], TEXT_LAYOUT, {}, split=split).collect()
    assert all(r.reason is None for r in got)
    assert {(paths.index(r.record_id.split("#")[0]), r.id): (r.a, r.b) for r in got} == want and len(got) == len(want)


def test_file_with_a_quote_that_stays_open(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_bytes(b'1,a,b\n2,"c,d\n3,e,f\n\xff')
    got = [(r.id, r.reason) for r in structural.load_files(spark, [str(path)], TEXT_LAYOUT, {}, split=5).collect()]
    assert sorted(got, key=repr) == [(1, None), (None, "quoting")]
