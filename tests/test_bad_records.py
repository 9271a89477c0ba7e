"""The record parser against an independent character automaton, and its edge cases."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import bad_records as B
from ledgerloom.session import table

from .conftest import DATA


def automaton(record, delimiter, names, types):
    """(reason, column) by one character at a time."""
    fields, field, state = [], "", "start"
    for ch in record:
        if state == "start":
            if ch == '"':
                state = "quoted"
            elif ch == delimiter:
                fields.append("")
            else:
                field, state = ch, "plain"
        elif state == "plain":
            if ch == '"':
                return "quoting", ""
            if ch == delimiter:
                fields.append(field)
                field, state = "", "start"
            else:
                field += ch
        elif state == "quoted":
            if ch == '"':
                state = "closed"
            else:
                field += ch
        elif ch == '"':
            field += '"'
            state = "quoted"
        elif ch == delimiter:
            fields.append(field)
            field, state = "", "start"
        else:
            return "quoting", ""
    if state == "quoted":
        return "quoting", ""
    fields.append(field)
    if len(fields) != len(types):
        return "column_count", ""
    for value, name, kind in zip(fields, names, types):
        if not value or kind not in (1, 2, 3):
            continue
        ok = True
        if kind == 1:
            body = value[1:] if value[0] in "+-" else value
            ok = body != "" and all(c in "0123456789" for c in body) and -(2**63) <= int(value) <= 2**63 - 1
        elif kind == 2:
            try:
                float(value)
                ok = value == value.strip() and "_" not in value and value.isascii()
                ok = ok and (value.lstrip("+-").lower() in ("inf", "infinity", "nan") or value[-1] not in "fFlL")
            except ValueError:
                ok = False
        else:
            ok = value.lower() in ("true", "1", "yes", "t", "y", "false", "0", "no", "f", "n") and value.isascii()
        if not ok:
            return "invalid_value", name
    return "", ""


def test_matches_automaton():
    rnd = random.Random(5)
    pieces = ["1", "-7", "+3", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "0" * 30 + "5", "1.5", ".5", "5.", ".", "1e5", "1e", "inf", "-Infinity", "NaN", "nan ", " 1", "true", "T", "yes", "maybe", "", '"', '""', '"a"', '"a""b"', '"a', 'a"b', "x", "é", "\n", "\r", "٣", "1_0"]
    for delimiter in ",;|\t":
        for _ in range(300):
            types = [rnd.choice([0, 1, 2, 3, 7]) for _ in range(rnd.randint(1, 4))]
            names = [f"c{i}" for i in range(len(types))]
            records = []
            for _ in range(rnd.randint(1, 20)):
                n = len(types) if rnd.random() < 0.8 else rnd.randint(1, 5)
                good = {0: "t", 1: "12", 2: "1.5", 3: "no", 7: "z"}
                cells = [good[types[i]] if i < len(types) and rnd.random() < 0.7 else "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 2))) for i in range(n)]
                records.append(delimiter.join('"' + c.replace('"', '""') + '"' if rnd.random() < 0.2 else c for c in cells))
            records = [r for r in records if r]
            if not records:
                continue
            good_rows, single, failed = B.check_block(pa.array(records), delimiter, names, types)
            bad = {i: (why, col) for i, why, col in failed}
            for i, r in enumerate(records):
                assert bad.get(i, ("", "")) == automaton(r, delimiter, names, types), (r, delimiter, types)
            assert sum(n for _, n, _ in good_rows) + len(single) + len(failed) == len(records)


def test_fields_of_valid_records():
    good, single, failed = B.check_block(pa.array(['1,"a ""b"" c",', '2,"x\ny",1.5', "3,a\rb,"]), ",", ["a", "b", "c"], [1, 0, 2])
    got = {}
    for first, n, columns in good:
        got |= {first + i: [c[i].as_py() for c in columns] for i in range(n)}
    got |= dict(single)
    assert not failed and got == {0: ["1", 'a "b" c', ""], 1: ["2", "x\ny", "1.5"], 2: ["3", "a\rb", ""]}


@pytest.fixture
def files(spark):
    options = spark.createDataFrame([("f", ",", True, "null"), ("g", ";", False, "null"), ("h", ",", False, "null"), (None, ",", False, "null")], "file_id string, delimiter string, has_header boolean, null_handling string")
    columns = spark.createDataFrame([("f", 0, "n", 1), ("f", 1, "t", 0), ("f", 1, "t", 0), ("g", 0, "ok", 3), ("h", 0, None, None)], "file_id string, col_no int, name string, type_id int")
    return options, columns


def test_edge_cases(spark, files):
    rows = [
        ("f", 1, "n,t", 1), ("f", 2, "7,x\r", 1), ("f", 3, "", 1), ("f", 4, "\r", 1), ("f", 5, "x,y", 1), ("f", 5, "x,y", 2), ("f", 6, "1", 1), ("f", 7, '1,"a', 1), ("f", 8, ",", 1), ("f", 9, "1," + "y" * 200_000, 1),
        ("f", 10, "bad", 1), ("f", 10, "8,late", 2), ("g", 1, "maybe", 1), ("g", 2, "Y", 1), ("h", 1, "anything", 1), ("nofile", 1, "a", 1), (None, 1, "a", 1), ("f", None, "a", 1), ("f", 11, None, 1),
    ]
    records = spark.createDataFrame(rows, "file_id string, line_no bigint, raw_text string, loaded_ts int").withColumn("names", F.lit("clash"))
    parsed = B.parse_records(records, *files)
    bad = {(r.file_id, r.line_no): (r.reason, r.column_name) for r in B.failing_records(parsed).collect()}
    assert bad == {("f", 5): ("invalid_value", "n"), ("f", 6): ("column_count", ""), ("f", 7): ("quoting", ""), ("g", 1): ("invalid_value", "ok")}
    typed = {(r.file_id, r.line_no, r.col_no): (r.string_value, r.bigint_value, r.boolean_value) for r in B.typed_rows(parsed).collect()}
    assert typed[("f", 2, 0)] == (None, 7, None) and typed[("f", 2, 1)] == ("x", None, None)
    assert typed[("f", 8, 0)] == (None, None, None) and len(typed[("f", 9, 1)][0]) == 200_000
    assert typed[("f", 10, 0)][1] == 8 and typed[("g", 2, 0)][2] is True and typed[("h", 1, 0)][0] == "anything"


def test_large_files_are_spread(spark, files, monkeypatch):
    monkeypatch.setattr(B, "PART", 100)
    monkeypatch.setattr(B, "BLOCK", 8)
    rows = [("f", i, f"{i},x" if i % 50 else "bad", 1) for i in range(2, 1002)] + [("g", i, "maybe", 1) for i in range(1, 4)]
    records = spark.createDataFrame(rows, "file_id string, line_no bigint, raw_text string, loaded_ts int")
    prepared = B.prepare_records(records, *files)
    assert prepared.where("raw is not null").count() == len(rows) and prepared.where("raw is null").count() == 10 + 1 + 1  # a definition a part
    parsed = B.parse_records(records, *files)
    assert {(r.file_id, r.line_no) for r in B.failing_records(parsed).collect()} == {("f", i) for i in range(50, 1002, 50)} | {("g", i) for i in range(1, 4)}


def test_empty_tables(spark, files):
    none = spark.createDataFrame([], "file_id string, line_no bigint, raw_text string, loaded_ts int")
    assert B.parse_records(none, *files).count() == 0


def test_whole_tables(spark):
    """Each record of the smallest tables against the automaton."""
    raw, options, columns = (table(spark, DATA, t) for t in ("raw_records", "csv_options", "column_defs"))
    defs = {}
    for r in columns.orderBy("file_id", "col_no").collect():
        defs.setdefault(r.file_id, []).append((r.name, r.type_id))
    files = {r.file_id: r for r in options.collect()}
    want = {}
    for r in raw.collect():
        o, text = files[r.file_id], r.raw_text.removesuffix("\r")
        if text and not (o.has_header and r.line_no == 1):
            names, types = zip(*defs[r.file_id])
            if (found := automaton(text, o.delimiter, names, types))[0]:
                want[r.file_id, r.line_no] = found
    got = {(r.file_id, r.line_no): (r.reason, r.column_name) for r in B.failing_records(B.parse_records(raw, options, columns)).collect()}
    assert got == want


def test_record_that_ends_in_cr_among_valid_ones():
    """A CR that remains is part of the last field, whatever the record's neighbours."""
    records = pa.array([*(f"a,{i}" for i in range(100)), "a,5\r", *(f"b,{i}" for i in range(100))])
    good, single, failed = B.check_block(records, ",", ["s", "n"], [0, 1])
    assert failed == [(100, "invalid_value", "n")]
    assert sum(n for _, n, _ in good) + len(single) == 200
    good, single, failed = B.check_block(records, ",", ["s", "t"], [0, 0])
    assert not failed and [f for i, f in single if i == 100] == [["a", "5\r"]]
